"""Summary statistics, redundancy, metrics and featurisation."""

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..functions.windows import lag as lag_, log_return, rsd
from ..operators import stats as T
from ..sources.store import panel
from .registry import query
from .sqltext import KEY, PANEL, lag, over, r, rs, sd, strict

RR = f"rr AS (SELECT *, ln(close) - {lag('ln(close)')} AS ret FROM panel)"


@query("inventory", "D9", f"""WITH {PANEL} SELECT instrument, min(date) AS start, max(date) AS end, count(*) AS n_rows,
  {r('avg(close)', 2, 'mean_close')}, quantile_cont(volume, 0.5) AS median_volume, {r('avg(open_interest)', 6, 'mean_oi')},
  {r('(max(date) - min(date)) / 365.25', 6, 'years')} FROM panel GROUP BY 1""")
def inventory(spark, sf):
    return rounded(T.inventory(panel(spark, sf)), special={"mean_close": 2})


@query("return_moments", "D10", f"""WITH {PANEL}, {RR} SELECT instrument, {r('avg(ret) * 1e4', 4, 'mean_daily_bp')},
  {r('stddev_samp(ret) * sqrt(252.0) * 100', 4, 'ann_vol_pct')}, {r('skewness(ret)', 6, 'skew')}, {r('kurtosis(ret)', 6, 'kurtosis')},
  {r('min(ret) * 100', 6, 'min_day_pct')}, {r('max(ret) * 100', 6, 'max_day_pct')}, count(ret) AS n_obs FROM rr GROUP BY 1""")
def return_moments(spark, sf):
    return rounded(T.return_moments(panel(spark, sf)), special={"mean_daily_bp": 4, "ann_vol_pct": 4})


BLOCK = ("ret", "hl", "oto", "lv", "absr", "mom5", "rev5", "sd10")
BLK = f"""{RR}, blk AS (SELECT instrument, date, ret, ln(high / low) AS hl, ln(open / {lag('open')}) AS oto, ln(volume) AS lv,
  abs(ret) AS absr, ln(close / {lag('close', 5)}) AS mom5, -ln(close / {lag('close', 5)}) + 0.1 * ln(volume) AS rev5,
  {sd('ret', 10)} AS sd10 FROM rr)"""


def block(spark, sf):
    p = panel(spark, sf).withColumn("ret", log_return())
    mom = F.ln(F.col("close") / lag_("close", 5))
    return p.select("instrument", "date", "ret", F.ln(F.col("high") / F.col("low")).alias("hl"),
                    F.ln(F.col("open") / lag_("open")).alias("oto"), F.ln("volume").alias("lv"),
                    F.abs("ret").alias("absr"), mom.alias("mom5"),
                    (-mom + 0.1 * F.ln("volume")).alias("rev5"), rsd("ret", 10).alias("sd10"))


def pair_sql(src="blk", mp=252):
    out = []
    for i, a in enumerate(BLOCK):
        for b in BLOCK[i + 1:]:
            f = f"FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)"
            out.append(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN count(*) {f} >= {mp} THEN corr({a}, {b}) END AS corr, "
                       f"count(*) {f} AS n_pairs FROM {src}")
    return "pc AS (" + " UNION ALL ".join(out) + ")"


@query("pairwise_corr", "D13", f"WITH {PANEL}, {BLK}, {pair_sql()} SELECT a, b, {r('corr')}, n_pairs FROM pc")
def pairwise_corr(spark, sf):
    return rounded(T.column_corr(block(spark, sf), BLOCK))


def rank_sql():
    cols = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) + "
                     f"(count(*) OVER (PARTITION BY {c}) - 1) / 2.0 END AS {c}" for c in BLOCK)
    return f"rk AS (SELECT {cols} FROM blk)"


@query("spearman_distance", "D17", f"WITH {PANEL}, {BLK}, {rank_sql()}, {pair_sql('rk')} "
       f"SELECT a, b, {r('1 - abs(corr)', 6, 'distance')}, n_pairs FROM pc")
def spearman_distance(spark, sf):
    c = T.column_corr(block(spark, sf), BLOCK, method="spearman")
    return rounded(c.select("a", "b", (1 - F.abs("corr")).alias("distance"), "n_pairs"))


@query("max_corr_partner", "D14 T2", f"""WITH {PANEL}, {BLK}, {pair_sql()}, both_ AS (SELECT a AS feature, b AS partner, round(abs(corr), 9) AS c FROM pc
  UNION ALL SELECT b, a, round(abs(corr), 9) FROM pc), k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY c DESC, partner) AS k FROM both_)
SELECT feature, partner AS max_corr_partner, {r('c', 6, 'max_abs_corr')} FROM k WHERE k = 1""")
def max_corr_partner(spark, sf):
    return rounded(T.max_partner(T.column_corr(block(spark, sf), BLOCK)))


@query("redundancy_groups", "D15", f"""WITH RECURSIVE {PANEL}, {BLK}, {pair_sql()}, e AS (SELECT a AS u, b AS v FROM pc WHERE abs(corr) > 0.3
  UNION SELECT b, a FROM pc WHERE abs(corr) > 0.3 UNION SELECT x, x FROM (VALUES {', '.join(f"('{b}')" for b in BLOCK)}) t(x)),
reach AS (SELECT u, v FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
lab AS (SELECT u AS feature, min(v) AS group_id FROM reach GROUP BY 1)
SELECT feature, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM lab""")
def redundancy_groups(spark, sf):
    corr = T.column_corr(block(spark, sf), BLOCK)
    feats = corr.select(F.explode(F.array("a", "b")).alias("feature")).distinct()
    return T.redundancy_groups(corr, feats, 0.3)


def lw_sql():
    cols = BLOCK[:5]
    cen = ", ".join(f"{c} - avg({c}) OVER () AS {c}" for c in cols)
    full = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    ents = " UNION ALL ".join(
        f"SELECT '{cols[i]}' AS i, '{cols[j]}' AS j, avg({cols[i]}*{cols[j]}) AS s, avg(({cols[i]}*{cols[j]})**2) AS s2, "
        f"{1 if i == j else 2} AS m, count(*) AS n FROM cen" for i in range(5) for j in range(i, 5))
    return f"""WITH {PANEL}, {BLK}, fullr AS (SELECT * FROM blk WHERE {full}), cen AS (SELECT {cen} FROM fullr), en AS ({ents}),
tt AS (SELECT sum(s) FILTER (i = j) / 5 AS mu, sum(m*s*s) AS ss, sum(m*(s2 - s*s)) AS b, max(n) AS n FROM en),
kk AS (SELECT mu, (ss - mu*mu*5) / 5 AS delta, b / n / 5 AS beta FROM tt),
k2 AS (SELECT mu, least(beta, delta) / delta AS k FROM kk)
SELECT i, j, {r('(1 - k) * s + CASE WHEN i = j THEN k * mu ELSE 0 END', 8, 'cov')}, {r('k', 8, 'shrinkage')} FROM en, k2"""


@query("ledoit_wolf", "D16", lw_sql())
def ledoit_wolf(spark, sf):
    return rounded(T.ledoit_wolf(block(spark, sf), BLOCK[:5]), 8)


# ---- metrics -------------------------------------------------------------------

FC = f"fc AS (SELECT instrument, asset_class, date, close AS y, {lag('close')} AS p FROM panel)"


def forecast(spark, sf):
    return panel(spark, sf).select("instrument", "asset_class", "date", F.col("close").alias("y"),
                                   lag_("close").alias("p"))


@query("regression_metrics", "D37", f"""WITH {PANEL}, {FC} SELECT instrument, {r('avg(abs(y - p))', 3, 'mae')}, {r('avg((y - p)**2)', 0, 'mse')},
  {r('sqrt(avg((y - p)**2))', 3, 'rmse')}, {r('avg(abs((y - p) / y)) * 100', 5, 'mape')},
  {r('1 - sum((y - p)**2) / (var_pop(y) * count(y))', 6, 'r2')} FROM fc WHERE p IS NOT NULL GROUP BY 1""")
def regression_metrics(spark, sf):
    m = T.regression_metrics(forecast(spark, sf), "y", "p", ["instrument"])
    return rounded(m, 6, {"mae": 3, "mse": 0, "rmse": 3, "mape": 5})


CLS = f"""cl0 AS (SELECT instrument, date, close, lead(close) OVER ({KEY}) AS nx, {strict('avg', 'close', 5)} AS m FROM panel),
cl AS (SELECT instrument, date, CASE WHEN nx > close THEN 1 ELSE 0 END AS y, round(1 / (1 + exp(close / m - 1)), 3) AS p
  FROM cl0 WHERE nx IS NOT NULL AND m IS NOT NULL)"""


def scored(spark, sf):
    from ..functions.windows import lead, sma
    df = panel(spark, sf).withColumns({"nx": lead("close"), "m": sma("close", 5)})
    df = df.filter("nx IS NOT NULL AND m IS NOT NULL")
    return df.select("instrument", "date", (F.col("nx") > F.col("close")).cast("int").alias("y"),
                     F.round(1 / (1 + F.exp(F.col("close") / F.col("m") - 1)), 3).alias("p"))


CM = ("count(*) FILTER (y = 1 AND {h}) AS tp, count(*) FILTER (y <> 1 AND {h}) AS fp, "
      "count(*) FILTER (y = 1 AND NOT {h}) AS fn, count(*) FILTER (y <> 1 AND NOT {h}) AS tn")
RATES = ", ".join([r("(tp + tn) / NULLIF(tp + fp + fn + tn, 0)", 6, "accuracy"), r("tp / NULLIF(tp + fp, 0)", 6, "precision"),
                   r("tp / NULLIF(tp + fn, 0)", 6, "recall"), r("2 * tp / NULLIF(2 * tp + fp + fn, 0)", 6, "f1")])


@query("classification_metrics", "D38", f"WITH {PANEL}, {CLS}, c AS (SELECT instrument, {CM.format(h='p >= 0.5')} FROM cl GROUP BY 1) SELECT *, {RATES} FROM c")
def classification_metrics(spark, sf):
    return rounded(T.classification_metrics(scored(spark, sf), "y", "p", ["instrument"]))


TH = [i / 10 for i in range(1, 10)]


@query("threshold_sweep", "D38", f"WITH {PANEL}, {CLS}, c AS (SELECT threshold, {CM.format(h='p >= threshold')} FROM cl, (VALUES "
       + ", ".join(f"({t}::DOUBLE)" for t in TH) + f") v(threshold) GROUP BY 1) SELECT *, {RATES} FROM c")
def threshold_sweep(spark, sf):
    return rounded(T.threshold_sweep(scored(spark, sf), "y", "p", TH))


@query("auc_by_instrument", "D38", f"""WITH {PANEL}, {CLS}, k AS (SELECT *, rank() OVER (PARTITION BY instrument ORDER BY p)
  + (count(*) OVER (PARTITION BY instrument, p) - 1) / 2.0 AS rk FROM cl)
SELECT instrument, {r('(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))', 6, 'auc')}
FROM k GROUP BY 1""")
def auc_by_instrument(spark, sf):
    return rounded(T.auc(scored(spark, sf), "y", "p", ["instrument"]))


@query("forecast_metrics", "D39", f"""WITH {PANEL}, {FC}, tr AS (SELECT instrument, avg(d) AS scale FROM (SELECT instrument,
  abs(y - lag(y, 5) OVER ({KEY})) AS d FROM fc WHERE year(date) <= 2000) GROUP BY 1),
te AS (SELECT instrument, avg(abs(y - p) / (abs(y) + abs(p))) AS smape, avg(abs(y - p)) AS mae, avg((y - p)**2) AS mse
  FROM fc WHERE year(date) > 2000 AND p IS NOT NULL GROUP BY 1)
SELECT instrument, {r('smape')}, {r('mae', 3)}, {r('mse', 0)}, {r('mae / scale', 6, 'mase')} FROM te JOIN tr USING (instrument)""")
def forecast_metrics(spark, sf):
    f = forecast(spark, sf)
    m = T.forecast_metrics(f.filter("year(date) > 2000 AND p IS NOT NULL"), f.filter("year(date) <= 2000"), "y", "p")
    return rounded(m, 6, {"mae": 3, "mse": 0})


# ---- featurisation -----------------------------------------------------------------

DAYS = f"""dt AS (SELECT date, sum(volume) AS total FROM panel GROUP BY 1),
dy AS (SELECT * FROM (SELECT date, total - lag(total) OVER (ORDER BY date) AS y FROM dt) WHERE y IS NOT NULL)"""


@query("daily_total_difference", "D41", f"WITH {PANEL}, {DAYS} SELECT date, y FROM dy", causal=True)
def daily_total_difference(spark, sf):
    return T.daily_total_difference(panel(spark, sf), "volume")


@query("centred_smooth", "W6", f"""WITH {PANEL}, {DAYS} SELECT date, y, {r('CASE WHEN count(*) OVER w = 4 THEN avg(y) OVER w ELSE y END', 6, 'y_smooth')}
FROM dy WINDOW w AS (ORDER BY date ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""")
def centred_smooth(spark, sf):
    return rounded(T.centred_smooth(T.daily_total_difference(panel(spark, sf), "volume")))


def feat_sql():
    bf = f"({KEY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    raw = [f"{lag('close', k)} AS lag_{k}" for k in (1, 3, 7, 14)]
    for n in (7, 14):
        w = f"({KEY} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        raw += [f"CASE WHEN count(close) OVER {w} = {n} THEN avg(close) OVER {w} END AS rolling_mean_{n}",
                f"CASE WHEN count(close) OVER {w} = {n} THEN stddev_samp(close) OVER {w} END AS rolling_std_{n}"]
    names = [f"lag_{k}" for k in (1, 3, 7, 14)] + [f"rolling_{s}_{n}" for n in (7, 14) for s in ("mean", "std")]
    fill = ", ".join(r(f"first_value({c} IGNORE NULLS) OVER {bf}", 3, c) for c in names)
    cyc = ", ".join(r(f"{fn}(2 * pi() * {c} / {n})", 6, f"{c}_{fn}") for c, n in (("month", 12), ("day", 31), ("dayofweek", 7))
                    for fn in ("sin", "cos"))
    return f"""WITH {PANEL}, a AS (SELECT instrument, date, close AS y, {', '.join(raw)}, CAST(day(date) AS INTEGER) AS day,
  CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter, CAST(isodow(date) - 1 AS INTEGER) AS dayofweek,
  CAST(dayofyear(date) AS INTEGER) AS dayofyear, CAST(weekofyear(date) AS INTEGER) AS weekofyear,
  CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CAST(date - min(date) OVER (PARTITION BY instrument) AS INTEGER) AS days_since_start FROM panel)
SELECT instrument, date, y, day, month, quarter, dayofweek, dayofyear, weekofyear, is_weekend, days_since_start, {cyc}, {fill} FROM a"""


@query("series_featurize", "W5", feat_sql())
def series_featurize(spark, sf):
    df = T.featurize(panel(spark, sf).select("instrument", "date", F.col("close").alias("y")))
    big = {c: 3 for c in df.columns if c.startswith(("lag_", "rolling_"))}
    return rounded(df, 6, big, keep=("y",))


@query("forward_fill_log", "W7", f"""WITH {PANEL}, v AS (SELECT instrument, date, open_interest, last_value(CASE WHEN open_interest > 0 THEN ln(open_interest) END IGNORE NULLS)
  OVER ({KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS log_oi FROM panel)
SELECT instrument, date, open_interest, {r('log_oi')} FROM v WHERE log_oi IS NOT NULL""", causal=True)
def forward_fill_log(spark, sf):
    p = panel(spark, sf).select("instrument", "date", "open_interest")
    return rounded(T.forward_fill(p, "open_interest", "log_oi"), keep=("open_interest",))


@query("series_calendar", "W8", f"""WITH {PANEL} SELECT instrument, date, CAST(date - DATE '2000-01-03' AS INTEGER) AS days_from_start,
  CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month, CAST(weekofyear(date) AS INTEGER) AS week_of_year,
  CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year FROM panel""", causal=True)
def series_calendar(spark, sf):
    return T.series_calendar(panel(spark, sf).select("instrument", "date"))
