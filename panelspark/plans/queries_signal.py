"""Signal-derived and cross-sectional families."""

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import price as P, signal as S, xsection as X
from ..sources.store import panel
from .registry import query
from .sqltext import KEY, PANEL, ewm_sql, lag, over, pos, r, rs, sd, sma, strict

RETS = f"""rets AS (SELECT * FROM (SELECT instrument, asset_class, date,
  ln(close) - {lag('ln(close)')} AS ret FROM panel) WHERE ret IS NOT NULL)"""


def f5_sql():
    w20, run = over(20), f"({KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ent = "-(" + " + ".join(
        f"(CASE WHEN p{k} > 0 THEN p{k} * ln(p{k}) ELSE 0 END)" for k in ("m", "z", "p")) + ")"
    gap = sma("close", 20)
    return f"""WITH {PANEL},
b0 AS (SELECT *, ln(close) - {lag('ln(close)')} AS ret, close - {gap} AS gap,
  row_number() OVER ({KEY}) AS rn,
  CASE WHEN row_number() OVER ({KEY}) = 1 THEN 1 WHEN s = {lag('s')} THEN 0 ELSE 1 END AS chg,
  count(*) FILTER (s = -1) OVER {w20} / 20.0 AS pm, count(*) FILTER (s = 0) OVER {w20} / 20.0 AS pz,
  count(*) FILTER (s = 1) OVER {w20} / 20.0 AS pp, count(s) OVER {w20} AS ns FROM panel),
b AS (SELECT *, sum(chg) OVER {run} AS run_id, CASE WHEN rn > 1 THEN chg END AS flip,
  max(CASE WHEN s <> 0 THEN rn END) OVER {run} AS la, s * ret AS pnl,
  -(gap - {sma('gap', 20)}) / {pos(sd('gap', 20))} AS mr FROM b0),
c AS (SELECT *, row_number() OVER (PARTITION BY instrument, run_id ORDER BY date) AS rl FROM b)
SELECT instrument, date, CAST(s AS DOUBLE) AS f5_signal, CAST(abs(s) AS DOUBLE) AS f5_abs_signal,
  CAST(rl AS DOUBLE) AS f5_trailing_run_length, CAST(rl - 1 AS DOUBLE) AS f5_days_since_flip,
  CAST(rn - la AS DOUBLE) AS f5_days_since_nonzero,
  {r(sma('abs(s)', 20), 6, 'f5_participation_20')}, {r(sma('abs(s)', 60), 6, 'f5_participation_60')},
  {r(sma('s', 20), 6, 'f5_long_bias_20')}, {r(sma('flip', 60), 6, 'f5_flip_rate_60')},
  {r(f'CASE WHEN ns = 20 THEN {ent} END', 6, 'f5_signal_entropy_20')},
  {r(strict('sum', 'pnl', 20), 6, 'signal_cum_pnl_20d')}, {r('sign(s) * sign(mr)', 6, 'f5_sign_agree_mr')}
FROM c"""


@query("f5_signal", "F5a F5b F5c F5d F5e F5f F5g F5h", f5_sql(), causal=True)
def f5_signal(spark, sf):
    p = panel(spark, sf)
    gap = p.withColumn("_gap", F.col("close") - P.sma("close", 20))
    gap = gap.withColumn("mr", -P.zscore("_gap", 20))
    return rounded(S.signal_features(gap, "mr"))


@query("class_balance", "D12", f"""WITH {PANEL}, b AS (SELECT instrument,
  count(*) FILTER (s = -1) AS n_short, count(*) FILTER (s = 0) AS n_flat,
  count(*) FILTER (s = 1) AS n_long, count(s) AS n FROM panel GROUP BY 1)
SELECT *, {r('n_short / n', 6, 'short_share')}, {r('n_flat / n', 6, 'flat_share')},
  {r('n_long / n', 6, 'long_share')} FROM b""")
def class_balance(spark, sf):
    return rounded(S.class_balance(panel(spark, sf)))


@query("signal_persistence", "D32", f"""WITH {PANEL},
b AS (SELECT instrument, date, s, CASE WHEN row_number() OVER ({KEY}) = 1 THEN NULL
  WHEN s = {lag('s')} THEN 0 ELSE 1 END AS flip, {lag('s')} AS ps FROM panel WHERE s IS NOT NULL),
c AS (SELECT *, sum(coalesce(flip, 1)) OVER ({KEY}) AS run FROM b),
l AS (SELECT *, count(*) OVER (PARTITION BY instrument, run) AS len FROM c)
SELECT instrument, {r('avg(len) FILTER (s = -1)', 6, 'mean_run_short')},
  {r('avg(len) FILTER (s = 0)', 6, 'mean_run_flat')}, {r('avg(len) FILTER (s = 1)', 6, 'mean_run_long')},
  {r('avg(flip)', 6, 'flip_rate')}, {r('corr(s, ps)', 6, 'lag1_autocorr')} FROM l GROUP BY 1""")
def signal_persistence(spark, sf):
    return rounded(S.persistence(panel(spark, sf)))


@query("net_position", "D30", f"""WITH {PANEL}, d AS (SELECT date, count(*) FILTER (s = 1) AS n_long,
  count(*) FILTER (s = -1) AS n_short, count(*) FILTER (s = 0) AS n_flat,
  CAST(coalesce(sum(s), 0) AS BIGINT) AS net FROM panel GROUP BY 1)
SELECT *, {r('CASE WHEN count(*) OVER w = 20 THEN avg(net) OVER w END', 6, 'net_mean_20')} FROM d
WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", causal=True)
def net_position(spark, sf):
    return rounded(S.net_position(panel(spark, sf)))


@query("signal_coverage", "D11", f"""WITH {PANEL}, d AS (SELECT date, count(close) AS n_instruments,
  count(s) AS k FROM panel GROUP BY 1)
SELECT n_instruments, count(*) AS n_days FROM d WHERE k > 0 GROUP BY 1""")
def signal_coverage(spark, sf):
    return S.signal_coverage(panel(spark, sf))


def rank_sql(sign):
    return f"""WITH {PANEL}, sc AS (SELECT instrument, date,
  {sign}(ln(close) - {lag('ln(close)', 20)}) AS sc FROM panel),
k AS (SELECT *, count(sc) OVER (PARTITION BY date) AS n,
  row_number() OVER (PARTITION BY date ORDER BY sc ASC NULLS LAST, instrument) - 1 AS p FROM sc)
SELECT instrument, date, CAST(n AS DOUBLE) AS f9_xsection_universe_size,
  {r('CASE WHEN sc IS NULL THEN NULL WHEN n = 1 THEN 0.0 ELSE 2.0 * p / (n - 1) - 1 END', 6, 'f9_xsect_rank')}
FROM k"""


@query("f9_xsect_rank", "F9a F9b", rank_sql("-"), causal=True)
def f9_xsect_rank(spark, sf):
    return rounded(X.xsect_rank(panel(spark, sf)))


@query("f9_xsect_rank_momentum", "F9a", rank_sql(""), causal=True)
def f9_xsect_rank_momentum(spark, sf):
    return rounded(X.xsect_rank(panel(spark, sf), score="momentum"))


PAIRS = f"""pairs AS (SELECT a.instrument AS a, b.instrument AS b, a.date, a.ret AS ra, b.ret AS rb
  FROM rets a JOIN rets b ON a.asset_class = b.asset_class AND a.date = b.date
  AND a.instrument < b.instrument)"""
PW = over(120, "PARTITION BY a, b ORDER BY date")
PC = f"""pc AS (SELECT a, b, date, CASE WHEN count(ra) OVER {PW} = 120 THEN corr(ra, rb) OVER {PW} END
  AS pair_corr FROM pairs)"""


@query("pair_intersection", "C8 U3", f"""WITH {PANEL}, {RETS}, {PAIRS}
SELECT a, b, count(*) AS n_joint, {r('corr(ra, rb)', 6, 'corr')} FROM pairs GROUP BY 1, 2""")
def pair_intersection(spark, sf):
    p = X.pair_returns(X.class_returns(panel(spark, sf)))
    return rounded(p.groupBy("a", "b").agg(F.count("*").alias("n_joint"),
                                           F.corr("ra", "rb").alias("corr")))


@query("rolling_pair_corr", "E3", f"""WITH {PANEL}, {RETS}, {PAIRS}, {PC}
SELECT a, b, date, {r('pair_corr')} FROM pc""", causal=True)
def rolling_pair_corr(spark, sf):
    return rounded(X.rolling_pair_corr(X.class_returns(panel(spark, sf))))


@query("f9_pair_corr_mean", "F9c", f"""WITH {PANEL}, {RETS}, {PAIRS}, {PC}
SELECT r.instrument, r.date, {r('m', 6, 'f9_pair_corr_mean')} FROM rets r LEFT JOIN (
  SELECT instrument, date, avg(pair_corr) AS m FROM (
    SELECT a AS instrument, date, pair_corr FROM pc UNION ALL SELECT b, date, pair_corr FROM pc) GROUP BY 1, 2) p
  ON p.instrument = r.instrument AND p.date = r.date""", causal=True)
def f9_pair_corr_mean(spark, sf):
    return rounded(X.pair_corr_mean(X.class_returns(panel(spark, sf))))


GRID = """grid AS (SELECT i.instrument, i.asset_class, d.date, r.ret
  FROM (SELECT DISTINCT instrument, asset_class FROM rets) i
  CROSS JOIN (SELECT DISTINCT date FROM rets) d
  LEFT JOIN rets r ON r.instrument = i.instrument AND r.date = d.date)"""


@query("f9_lead_lag_centroid", "F9d", f"""WITH {PANEL}, {RETS}, {GRID},
t AS (SELECT date, sum(ret) AS t, count(ret) AS k FROM rets GROUP BY 1),
c AS (SELECT g.*, (t.t - coalesce(ret, 0)) / NULLIF(t.k - CASE WHEN ret IS NULL THEN 0 ELSE 1 END, 0) AS c
  FROM grid g JOIN t USING (date)),
d AS (SELECT *, (ret - {lag('c')}) ** 2 AS d2 FROM c),
e AS (SELECT instrument, date, ret, sqrt({strict('avg', 'd2', 21)}) AS v FROM d)
SELECT instrument, date, {r('v', 6, 'f9_dist_lead_lag_centroid')} FROM e WHERE ret IS NOT NULL""",
       causal=True)
def f9_lead_lag_centroid(spark, sf):
    return rounded(X.lead_lag_centroid(X.class_returns(panel(spark, sf)), 21))


@query("f9_class_dispersion_z", "F9e", f"""WITH {PANEL}, {RETS}, {GRID},
disp AS (SELECT asset_class, date, stddev_pop(ret) AS sdv FROM grid GROUP BY 1, 2),
z AS (SELECT asset_class, date, (sdv - {sma('sdv', 63, key='PARTITION BY asset_class ORDER BY date')}) /
  {pos('(' + strict('stddev_pop', 'sdv', 63, 'PARTITION BY asset_class ORDER BY date') + ')')} AS z FROM disp)
SELECT rets.instrument, rets.date, {r('z', 6, 'f9_asset_class_dispersion_z')}
FROM rets JOIN z USING (asset_class, date)""", causal=True)
def f9_class_dispersion_z(spark, sf):
    return rounded(X.class_dispersion_z(X.class_returns(panel(spark, sf))))


A20 = 1.0 - 0.5 ** (1.0 / 20)


@query("f9_implied_corr_z", "F9f", f"""WITH RECURSIVE {PANEL}, {RETS}, {GRID},
pr AS (SELECT a.instrument AS a, b.instrument AS b, a.date,
  CASE WHEN b.ret IS NOT NULL THEN a.ret END AS x, CASE WHEN a.ret IS NOT NULL THEN b.ret END AS y
  FROM grid a JOIN grid b ON a.date = b.date AND a.instrument < b.instrument),
pm AS (SELECT *, x*x AS xx, y*y AS yy, x*y AS xy FROM pr),
{ewm_sql('ew', 'pm', [(f'm{c}', c, A20, 1) for c in ('x', 'y', 'xx', 'yy', 'xy')], key='a, b', keep='a, b, date')},
c AS (SELECT a, b, date, CASE WHEN mxx - mx*mx > 1e-18 AND myy - my*my > 1e-18 THEN
  (mxy - mx*my) / sqrt((mxx - mx*mx) * (myy - my*my)) END AS c FROM ew),
i AS (SELECT instrument, date, avg(c) AS i FROM (SELECT a AS instrument, date, c FROM c
  UNION ALL SELECT b, date, c FROM c) GROUP BY 1, 2),
z AS (SELECT instrument, date, (i - {sma('i', 252)}) / {pos('(' + strict('stddev_pop', 'i', 252) + ')')} AS z FROM i)
SELECT z.instrument, z.date, {r('z', 5, 'f9_ewma_implied_corr_z')} FROM z JOIN rets USING (instrument, date)""",
       causal=True)
def f9_implied_corr_z(spark, sf):
    return rounded(X.implied_corr_z(X.class_returns(panel(spark, sf))), 5)
