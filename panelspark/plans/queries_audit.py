"""Signal audit and exploratory tables."""

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import audit as A, xsection as X
from ..sources.store import panel
from .registry import query
from .sqltext import KEY, PANEL, lag, over, r

LAGS = A.LAGS
NAMES = [A.corr_name(k) for k in LAGS]


def lagcol(k):
    return f"r_lag_{k}".replace("-", "m")


def frame_sql(src="panel", keys="instrument"):
    w = f"PARTITION BY {keys} ORDER BY date"
    lags = ", ".join((f"lag(r, {k}) OVER ({w})" if k >= 0 else f"lead(r, {-k}) OVER ({w})")
                     + f" AS {lagcol(k)}" for k in LAGS)
    return f"""ret0 AS (SELECT instrument, date, ln(close) - {lag('ln(close)')} AS r FROM panel),
al AS (SELECT sg.*, r FROM {src} sg JOIN ret0 USING (instrument, date)),
al2 AS (SELECT *, CASE WHEN r IS NOT NULL THEN sum(r) OVER ({w}) END AS c FROM al),
al3 AS (SELECT *, {lags}, s * lead(r) OVER ({w}) AS pnl_next_day,
  s * (lead(c, 10) OVER ({w}) - c) AS pnl_h FROM al2),
frame AS (SELECT *, CASE WHEN s <> 0 THEN 1 ELSE 0 END AS bet,
  CASE WHEN s <> 0 AND pnl_h > 0 THEN 1 ELSE 0 END AS hit_h FROM al3 WHERE s IS NOT NULL)"""


def stats_sql():
    out = []
    for k in LAGS:
        y = lagcol(k)
        f = f"FILTER ({y} IS NOT NULL)"
        out.append(f"CASE WHEN count({y}) >= 3 AND stddev_pop(s) {f} > 1e-12 AND stddev_pop({y}) > 1e-12 "
                   f"THEN corr(s, {y}) END AS {A.corr_name(k)}")
    out += ["avg(pnl_next_day) AS mean_pnl_next_day", "avg(pnl_h) AS mean_pnl_h",
            "avg(hit_h) FILTER (bet = 1 AND pnl_h IS NOT NULL) AS hit_rate_h"]
    return ", ".join(out)


def tag_sql(x):
    return (f"CASE WHEN {x} IS NULL THEN 'n/a' WHEN {x} > 0.05 THEN 'trend' "
            f"WHEN {x} < -0.05 THEN 'mean_reverting' ELSE 'mixed' END")


SIG = f"{PANEL}, sig AS (SELECT instrument, date, s FROM panel)"


def frame(spark, sf):
    p = panel(spark, sf)
    return A.aligned_frame(p, p.select("instrument", "date", "s"))


@query("audit_frame", "C1 W1", f"WITH {SIG}, {frame_sql('sig')} SELECT instrument, date, s, "
       + ", ".join(r(lagcol(k), 9) for k in LAGS)
       + f", {r('r', 9)}, {r('pnl_next_day', 9)}, {r('pnl_h', 9)}, bet, hit_h FROM frame")
def audit_frame(spark, sf):
    return rounded(frame(spark, sf), 9)


AUD = f"aud AS (SELECT instrument, count(s) AS n_signal_dates, CAST(sum(bet) AS BIGINT) AS n_bets, {stats_sql()} FROM frame GROUP BY 1)"


@query("signal_audit", "D18 D19 D20 D21", f"""WITH {SIG}, {frame_sql('sig')}, {AUD},
t AS (SELECT *, list_avg(list_filter([corr_trail_1, corr_trail_5, corr_trail_10, corr_trail_20],
  lambda v: v IS NOT NULL)) AS mtc FROM aud)
SELECT instrument, n_signal_dates, n_bets, {', '.join(r(n) for n in NAMES + list(A.STATS))},
  {r('mtc', 6, 'mean_trail_corr')}, {tag_sql('mtc')} AS tag, {tag_sql('corr_trail_1')} AS tag_trail_1,
  {tag_sql('corr_trail_10')} AS tag_trail_h10 FROM t""")
def signal_audit(spark, sf):
    return rounded(A.signal_audit(frame(spark, sf)))


N_BOOT = 1000


def boot_sql(keys, n_boot):
    k = keys.split(", ")
    cat = " || '|' || ".join(k)
    on = " AND ".join(f"p.{x} = f.{x}" for x in k)
    terms, st = {}, []
    for kk in LAGS:
        y, c = lagcol(kk), A.corr_name(kk)
        for name, x in (("n", "1.0"), ("x", "s"), ("y", y), ("xx", "s*s"), ("yy", f"{y}*{y}"), ("xy", f"s*{y}")):
            terms[f"{c}__{name}"] = f"CASE WHEN {y} IS NOT NULL THEN {x} ELSE 0.0 END"
        n, vx, vy = f"{c}__n", f"({c}__xx - {c}__x*{c}__x/{c}__n)", f"({c}__yy - {c}__y*{c}__y/{c}__n)"
        st.append(f"CASE WHEN {n} >= 3 AND {vx}/{n} > 1e-15 AND {vy}/{n} > 1e-15 "
                  f"THEN ({c}__xy - {c}__x*{c}__y/{n})/sqrt({vx}*{vy}) END AS {c}")
    for c, x, cond in (("mean_pnl_next_day", "pnl_next_day", "pnl_next_day IS NOT NULL"), ("mean_pnl_h", "pnl_h", "pnl_h IS NOT NULL"),
                       ("hit_rate_h", "hit_h", "bet = 1 AND pnl_h IS NOT NULL")):
        terms[f"{c}__n"], terms[f"{c}__x"] = (f"CASE WHEN {cond} THEN {v} ELSE 0.0 END" for v in ("1.0", x))
        st.append(f"{c}__x / NULLIF({c}__n, 0) AS {c}")
    names = NAMES + list(A.STATS)
    q = ", ".join(f"quantile_cont({c}, 0.025) AS {c}_lo, quantile_cont({c}, 0.975) AS {c}_hi" for c in names)
    up = f"(PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"""fp AS MATERIALIZED (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY date) - 1 AS pos,
  {', '.join(f'sum(CAST({x} AS DOUBLE)) OVER {up} AS {c}' for c, x in terms.items())} FROM frame),
sz AS (SELECT {keys}, count(*) AS n, least(20, count(*)) AS sz FROM fp GROUP BY ALL HAVING count(*) >= 2),
bk AS (SELECT sz.*, b, unnest(generate_series(0, (n - 1) // sz)) AS j FROM sz, generate_series(0, {n_boot - 1}) g(b)),
dr AS (SELECT *, sha256({cat} || '|42|' || b || '|' || (j // 10)) AS h FROM bk),
st AS (SELECT *, CAST('0x' || substr(h, CAST(1 + 6*(j % 10) AS BIGINT), 6) AS BIGINT) % (n - sz + 1) AS start FROM dr),
pk AS (SELECT {keys}, b, start + least(sz, n - j*sz) - 1 AS pos, 1.0 AS sign FROM st
  UNION ALL SELECT {keys}, b, start - 1, -1.0 FROM st WHERE start > 0),
sm AS (SELECT {', '.join('p.' + x for x in k)}, b, {', '.join(f'sum(sign * {c}) AS {c}' for c in terms)}
  FROM pk p JOIN fp f ON {on} AND p.pos = f.pos GROUP BY ALL),
rp AS (SELECT {keys}, b, {', '.join(st)} FROM sm),
ci AS (SELECT {keys}, {q} FROM rp GROUP BY ALL)"""


CI = [f"{c}_{e}" for c in NAMES + list(A.STATS) for e in ("lo", "hi")]


@query("moving_block_ci", "D23", f"WITH {SIG}, {frame_sql('sig')}, {boot_sql('instrument', N_BOOT)} "
       f"SELECT instrument, {', '.join(r(c, 5) for c in CI)} FROM ci")
def moving_block_ci(spark, sf):
    return rounded(A.block_bootstrap(frame(spark, sf), n_boot=N_BOOT), 5)


HALF = """cut AS (SELECT DATE '1970-01-01' + CAST(floor(quantile_cont(date - DATE '1970-01-01', 0.5)) AS INTEGER) AS split_date
  FROM (SELECT DISTINCT date FROM sig)),
halves AS (SELECT sig.*, split_date, CASE WHEN date < split_date THEN 'first' ELSE 'second' END AS half FROM sig, cut)"""


@query("split_halves", "B13", f"WITH {SIG}, {HALF} SELECT * FROM halves")
def split_halves(spark, sf):
    return A.split_halves(panel(spark, sf).select("instrument", "date", "s"))


METRICS = ", ".join(f"('{m}')" for m in A.STABILITY)


@query("audit_stability", "D22 U6", f"""WITH {SIG}, {HALF},
parts AS (SELECT instrument, 'full' AS part, date, s FROM halves UNION ALL
  SELECT instrument, half, date, s FROM halves),
{frame_sql('parts', 'instrument, part')}, {boot_sql('instrument, part', N_BOOT)},
pt AS (SELECT instrument, part, {stats_sql()} FROM frame GROUP BY 1, 2),
lg AS (SELECT pt.instrument, pt.part, m.metric,
  CASE m.metric {' '.join(f"WHEN '{m}' THEN pt.{m}" for m in A.STABILITY)} END AS v,
  CASE m.metric {' '.join(f"WHEN '{m}' THEN ci.{m}_lo" for m in A.STABILITY)} END AS lo,
  CASE m.metric {' '.join(f"WHEN '{m}' THEN ci.{m}_hi" for m in A.STABILITY)} END AS hi
  FROM pt JOIN ci USING (instrument, part), (VALUES {METRICS}) m(metric)),
wd AS (SELECT instrument, metric, max(v) FILTER (part = 'full') AS full_window,
  max(v) FILTER (part = 'first') AS first_half, max(v) FILTER (part = 'second') AS second_half,
  max(lo) FILTER (part = 'first') AS l1, max(hi) FILTER (part = 'first') AS h1,
  max(lo) FILTER (part = 'second') AS l2, max(hi) FILTER (part = 'second') AS h2 FROM lg GROUP BY 1, 2)
SELECT instrument, metric, {r('full_window')}, {r('first_half')}, {r('second_half')},
  coalesce((first_half > 0) <> (second_half > 0) AND (l1 > 0 OR h1 < 0) AND (l2 > 0 OR h2 < 0), false)
    AS sign_flip_flag FROM wd""")
def audit_stability(spark, sf):
    return rounded(A.stability(panel(spark, sf), N_BOOT))


RR = f"rr AS (SELECT *, ln(close) - {lag('ln(close)')} AS ret FROM panel)"


def fwd_sql(h):
    w = f"({KEY} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"""WITH {PANEL}, {RR}, f AS (SELECT instrument, s, CASE WHEN count(ret) OVER {w} = {h}
  THEN sum(ret) OVER {w} END AS f FROM rr), g AS (SELECT *, s * f AS pnl FROM f WHERE s IS NOT NULL AND f IS NOT NULL)
SELECT instrument, {r('avg(f) FILTER (s = -1) * 1e4', 4, 'mean_r_short_bp')},
  {r('avg(f) FILTER (s = 0) * 1e4', 4, 'mean_r_flat_bp')}, {r('avg(f) FILTER (s = 1) * 1e4', 4, 'mean_r_long_bp')},
  {r('avg(CASE WHEN sign(f) = sign(s) THEN 1 ELSE 0 END) FILTER (s <> 0)', 6, 'hit_rate')},
  {r('avg(pnl) / CASE WHEN stddev_samp(pnl) > 1e-12 THEN stddev_samp(pnl) END * sqrt(252.0)', 6, 'pnl_sharpe')}
FROM g GROUP BY 1"""


for _h in (1, 5, 20):
    def _build(spark, sf, h=_h):
        return rounded(A.forward_by_label(panel(spark, sf), h), special={
            f"mean_r_{k}_bp": 4 for k in ("short", "flat", "long")})
    query(f"forward_by_label_{_h}d", "D26", fwd_sql(_h))(_build)

PNL = f"""{RR}, pl AS (SELECT * FROM (SELECT instrument, date, s, s * lead(ret) OVER ({KEY}) AS pnl FROM rr)
  WHERE pnl IS NOT NULL)"""


@query("equity_curves", "D27", f"""WITH {PANEL}, {PNL}
SELECT instrument, date, {r('pnl', 9)}, {r(f'sum(pnl) OVER ({KEY})', 6, 'cum_pnl')} FROM pl""")
def equity_curves(spark, sf):
    return rounded(A.equity_curves(panel(spark, sf)), 6, {"pnl": 9})


@query("portfolio_curve", "D27", f"""WITH {PANEL}, {PNL}, d AS (SELECT date, avg(pnl) AS pnl FROM pl GROUP BY 1)
SELECT date, {r('pnl')}, {r('sum(pnl) OVER (ORDER BY date)', 6, 'cum_pnl')} FROM d""")
def portfolio_curve(spark, sf):
    return rounded(A.portfolio(panel(spark, sf)))


@query("portfolio_summary", "D27", f"""WITH {PANEL}, {PNL}, d AS (SELECT date, avg(pnl) AS pnl FROM pl GROUP BY 1)
SELECT {r('avg(pnl) * 252', 6, 'ann_mean')}, {r('stddev_samp(pnl) * sqrt(252.0)', 6, 'ann_vol')},
  {r('avg(pnl) / stddev_samp(pnl) * sqrt(252.0)', 6, 'sharpe')} FROM d""")
def portfolio_summary(spark, sf):
    return rounded(A.portfolio_summary(panel(spark, sf)))


KS = list(range(-5, 6))


@query("lead_lag_grid", "D28", f"""WITH {PANEL}, {RR}, g AS (SELECT i.instrument, d.date, x.ret, p.s
  FROM (SELECT DISTINCT instrument FROM rr WHERE ret IS NOT NULL) i
  CROSS JOIN (SELECT DISTINCT date FROM rr WHERE ret IS NOT NULL) d
  LEFT JOIN rr x ON x.instrument = i.instrument AND x.date = d.date
  LEFT JOIN panel p ON p.instrument = i.instrument AND p.date = d.date),
sh AS (SELECT *, {', '.join((f'lead(ret, {k})' if k >= 0 else f'lag(ret, {-k})') + f' OVER ({KEY}) AS k{i}' for i, k in enumerate(KS))} FROM g),
fl AS (SELECT * FROM sh WHERE s IS NOT NULL),
ag AS (""" + " UNION ALL ".join(
    f"SELECT instrument, {k} AS k, CASE WHEN count(k{i}) > 30 AND stddev_pop(s) FILTER (k{i} IS NOT NULL) > 1e-12 "
    f"AND stddev_pop(k{i}) > 1e-12 THEN corr(s, k{i}) END AS corr FROM fl GROUP BY 1" for i, k in enumerate(KS))
       + f") SELECT instrument, k, {r('corr')} FROM ag")
def lead_lag_grid(spark, sf):
    p = panel(spark, sf)
    grid = X.union_grid(X.class_returns(p)).select("instrument", "date", "ret")
    return rounded(A.lead_lag_grid(p, grid, KS))


@query("conditional_vol", "D29", f"""WITH {PANEL}, {RR}, f AS (SELECT * FROM (SELECT instrument, s,
  lead(ret) OVER ({KEY}) AS f FROM rr) WHERE s IS NOT NULL AND f IS NOT NULL),
v AS (SELECT instrument, stddev_samp(f) FILTER (s <> 0) * sqrt(252.0) AS a, stddev_samp(f) FILTER (s = 0) * sqrt(252.0) AS b
  FROM f GROUP BY 1)
SELECT instrument, {r('a', 6, 'vol_active')}, {r('b', 6, 'vol_flat')}, {r('a / CASE WHEN b > 0 THEN b END', 6, 'ratio')} FROM v""")
def conditional_vol(spark, sf):
    return rounded(A.conditional_vol(panel(spark, sf)))


@query("max_drawdown", "D31 T6", f"""WITH {PANEL}, {RR}, c AS (SELECT instrument, date, sum(ret) OVER ({KEY}) AS cum
  FROM rr WHERE ret IS NOT NULL), d AS (SELECT *, round(cum - max(cum) OVER ({KEY}), 9) AS dd FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY dd, date) AS k FROM d)
SELECT instrument, {r('exp(dd) - 1', 6, 'max_drawdown')}, date AS mdd_date FROM k WHERE k = 1""")
def max_drawdown(spark, sf):
    return rounded(A.max_drawdown(panel(spark, sf)))


@query("backtest_metrics", "D40", f"""WITH {PANEL}, {PNL}, a AS (SELECT *, sum(pnl) OVER ({KEY}) AS cum,
  abs(s - {lag('s')}) AS turn, CASE WHEN s = {lag('s')} THEN 0 ELSE 1 END AS chg FROM pl),
b AS (SELECT *, cum - max(cum) OVER ({KEY}) AS dd, sum(chg) OVER ({KEY}) AS run FROM a)
SELECT instrument, count(*) AS n_days, {r('avg(pnl) * 252', 6, 'ann_log_return')},
  {r('stddev_samp(pnl) * sqrt(252.0)', 6, 'ann_vol')}, {r('avg(pnl) / stddev_samp(pnl) * sqrt(252.0)', 6, 'sharpe')},
  {r('avg(pnl) / sqrt(avg(CASE WHEN pnl < 0 THEN pnl * pnl ELSE 0 END)) * sqrt(252.0)', 6, 'sortino')},
  {r('min(dd)', 6, 'max_drawdown_log')},
  {r('count(*) FILTER (s <> 0) / count(DISTINCT CASE WHEN s <> 0 THEN run END)', 6, 'avg_holding')},
  {r('avg(turn)', 6, 'turnover')} FROM b GROUP BY 1""")
def backtest_metrics(spark, sf):
    return rounded(A.backtest_metrics(panel(spark, sf)))
