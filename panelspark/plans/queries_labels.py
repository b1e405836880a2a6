"""Labels, sampling and their weights."""

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import labels as L
from ..sources import bars as B
from ..sources.store import panel
from .registry import query
from .sqltext import EVENTS, KEY, PANEL, ewm_sql, lag, over, r

SPAN, H = 100, 10
AL = 2 / (SPAN + 1)
VOL = f"""rr AS (SELECT *, ret * ret AS ret2 FROM (SELECT instrument, date, close, s,
  ln(close) - {lag('ln(close)')} AS ret FROM panel)),
{ewm_sql('ew', 'rr', [('m1', 'ret', AL, 1), ('m2', 'ret2', AL, 1)])},
nn AS (SELECT instrument, date, close, s, count(ret) OVER ({KEY}) AS n FROM rr),
vol AS (SELECT nn.*, CASE WHEN n >= 2 THEN sqrt(greatest(m2 - m1*m1, 0) / (1 - (power({(1 - AL) ** 2!r}, n - 1)
  + {AL * AL!r} * (1 - power({(1 - AL) ** 2!r}, n - 1)) / {1 - (1 - AL) ** 2!r}))) END AS sigma
  FROM nn JOIN ew USING (instrument, date))"""


def events_sql(pt="1.0", sl="1.0", extra=""):
    path = f"({KEY} ROWS BETWEEN 1 FOLLOWING AND {H + 1} FOLLOWING)"
    return f"""pos AS (SELECT v.*, row_number() OVER ({KEY}) AS pos, list(ln(close)) OVER {path} AS lcs,
  list(date) OVER {path} AS ds FROM vol v),
ev0 AS (SELECT *, sign(s) AS side, list_transform(lcs, lambda x: round((x - lcs[1]) * sign(s), 12)) AS dist
  FROM pos WHERE s <> 0 AND sigma > 0 AND len(lcs) = {H + 1}),
ev1 AS (SELECT * {extra}, coalesce(list_filter(generate_series(1, {H}), lambda i:
    dist[i + 1] >= round({pt} * sigma * sqrt({H}.0), 12) OR dist[i + 1] <= -round({sl} * sigma * sqrt({H}.0), 12))[1], {H}) AS off
  FROM ev0),
ev AS (SELECT instrument, date AS t_signal, ds[1] AS t_start, ds[off + 1] AS t_end, CAST(side AS INTEGER) AS side,
  dist[off + 1] AS ret, CAST(dist[off + 1] > 0 AS INTEGER) AS label, sigma, pos, off FROM ev1)"""


EV = f"{PANEL}, {VOL}, {events_sql()}"


@query("label_vol", "W2", f"WITH RECURSIVE {PANEL}, {VOL} SELECT instrument, date, {r('sigma')} FROM vol",
       causal=True)
def label_vol(spark, sf):
    return rounded(L.label_vol(panel(spark, sf)).select("instrument", "date", "sigma"))


def events(spark, sf):
    return L.triple_barrier(L.label_vol(panel(spark, sf)), H)


# The twin counts concurrency by a join of events to the bars they span.
UNIQ = """bars_u AS (SELECT instrument, pos FROM pos),
conc AS (SELECT b.instrument, b.pos, count(*) AS c FROM bars_u b JOIN ev e ON e.instrument = b.instrument
  AND b.pos BETWEEN e.pos + 1 AND e.pos + 1 + e.off GROUP BY 1, 2),
uw AS (SELECT e.instrument, e.t_signal, avg(1.0 / c) AS w FROM ev e JOIN conc c ON c.instrument = e.instrument
  AND c.pos BETWEEN e.pos + 1 AND e.pos + 1 + e.off GROUP BY 1, 2)"""


@query("triple_barrier_labels", "L1 L4 C9", f"""WITH RECURSIVE {EV}, {UNIQ}
SELECT instrument, t_signal, t_start, t_end, side, {r('ret')}, label, {r('w', 6, 'uniqueness_weight')},
  {r('sigma')} FROM ev JOIN uw USING (instrument, t_signal)""")
def triple_barrier_labels(spark, sf):
    return rounded(events(spark, sf))


@query("label_balance", "D33 A10", f"""WITH RECURSIVE {EV} SELECT instrument, count(*) AS n_events,
  count(*) FILTER (side > 0) AS n_long, count(*) FILTER (side < 0) AS n_short,
  count(*) FILTER (label = 1) AS n_label_1, count(*) FILTER (label = 0) AS n_label_0 FROM ev GROUP BY 1""")
def label_balance(spark, sf):
    return L.events_meta(L.triple_barrier(L.label_vol(panel(spark, sf)), H, uniqueness=False))


@query("labels_on_panel", "C12", f"""WITH RECURSIVE {EV} SELECT p.instrument, p.date, p.s, e.label, e.t_end
FROM panel p LEFT JOIN ev e ON e.instrument = p.instrument AND e.t_signal = p.date WHERE p.s <> 0""")
def labels_on_panel(spark, sf):
    p = panel(spark, sf)
    ev = L.triple_barrier(L.label_vol(p), H, uniqueness=False)
    ev = ev.select("instrument", F.col("t_signal").alias("date"), "label", "t_end")
    return p.filter("s <> 0").select("instrument", "date", "s").join(ev, ["instrument", "date"], "left")


CONFIGS = ((0.5, 0.5), (1.0, 1.0), (2.0, 1.0), (1.0, 2.0))


@query("barrier_sweep", "L11", f"WITH RECURSIVE {PANEL}, {VOL}, cfgs AS (SELECT * FROM (VALUES "
       + ", ".join(f"({i}, {p}, {s})" for i, (p, s) in enumerate(CONFIGS)) + ") v(cfg, pt, sl)), "
       + events_sql("pt", "sl", "").replace("FROM ev0)", "FROM ev0, cfgs)").replace(
           "SELECT instrument, date AS t_signal", "SELECT cfg, instrument, date AS t_signal")
       + f"""SELECT cfg, count(*) AS n_events, {r('avg(label)', 6, 'label_share')}, {r('avg(ret)', 6, 'mean_ret')},
  {r('avg(t_end - t_start)', 6, 'mean_days')} FROM ev GROUP BY 1""")
def barrier_sweep(spark, sf):
    return rounded(L.barrier_sweep(L.label_vol(panel(spark, sf)), CONFIGS))


# ---- trend scanning ------------------------------------------------------------

def scan_sql(forward):
    rng = "b.pos BETWEEN a.pos AND a.pos + h" if forward else "b.pos BETWEEN a.pos - h AND a.pos"
    ok = "a.pos - 1 <= a.n - 20" if forward else "a.pos - 1 >= 20"
    t1 = "max" if forward else "min"
    return f"""WITH {PANEL}, p AS (SELECT instrument, date, close, row_number() OVER ({KEY}) AS pos,
  count(*) OVER (PARTITION BY instrument) AS n FROM panel),
fit AS (SELECT a.instrument, a.date, h, {t1}(b.date) AS t1, corr(b.close, b.pos) AS rho
  FROM p a, generate_series(5, 19) g(h), p b
  WHERE b.instrument = a.instrument AND {rng} AND {ok} GROUP BY 1, 2, 3),
tv AS (SELECT *, CASE WHEN isnan(rho) THEN NULL WHEN 1 - rho*rho <= 1e-12 THEN sign(rho) * CAST('inf' AS DOUBLE) ELSE rho * sqrt(h - 1) / sqrt(1 - rho*rho) END AS t FROM fit),
best AS (SELECT *, row_number() OVER (PARTITION BY instrument, date ORDER BY abs(t) DESC, h) AS k
  FROM tv WHERE t IS NOT NULL)
SELECT instrument, date, t1, {r('greatest(least(t, 20.0), -20.0)', 5, 't_val')},
  CAST(sign(t) AS INTEGER) AS bin, CAST(h AS INTEGER) AS window_size FROM best WHERE k = 1"""


@query("trend_scan_forward", "W4 T5", scan_sql(True))
def trend_scan_forward(spark, sf):
    return rounded(L.trend_scan(panel(spark, sf)), 5)


@query("trend_scan_backward", "W4", scan_sql(False), causal=True)
def trend_scan_backward(spark, sf):
    return rounded(L.trend_scan(panel(spark, sf), forward=False), 5)


# ---- intraday sampling and generic barriers ----------------------------------------

HOURLY = f"""{EVENTS}, hb AS (SELECT instrument, date_trunc('hour', ts) AS bar_ts, arg_max(px, ts) AS close
  FROM ev GROUP BY 1, 2)"""
HK = "PARTITION BY instrument ORDER BY bar_ts"
CUS = f"""df AS (SELECT instrument, bar_ts, row_number() OVER ({HK}) AS k, d FROM (
  SELECT instrument, bar_ts, close - lag(close) OVER ({HK}) AS d FROM hb) WHERE d IS NOT NULL),
cu AS (SELECT instrument, bar_ts, k, CASE WHEN greatest(0.0, d) > 60 THEN 0.0 ELSE greatest(0.0, d) END AS sp,
    CASE WHEN least(0.0, d) < -60 THEN 0.0 ELSE least(0.0, d) END AS sn,
    CASE WHEN d < -60 THEN -1 WHEN d > 60 THEN 1 ELSE 0 END AS side FROM df WHERE k = 1
  UNION ALL SELECT n.instrument, n.bar_ts, n.k,
    CASE WHEN NOT least(0.0, sn + d) < -60 AND greatest(0.0, sp + d) > 60 THEN 0.0 ELSE greatest(0.0, sp + d) END,
    CASE WHEN least(0.0, sn + d) < -60 THEN 0.0 ELSE least(0.0, sn + d) END,
    CASE WHEN least(0.0, sn + d) < -60 THEN -1 WHEN greatest(0.0, sp + d) > 60 THEN 1 ELSE 0 END
  FROM cu c JOIN df n ON n.instrument = c.instrument AND n.k = c.k + 1)"""


def hourly(spark, sf):
    return B.time_bars(B.events(spark, sf)).select("instrument", "bar_ts", "close")


@query("cusum_events", "L5", f"""WITH RECURSIVE {HOURLY}, {CUS}
SELECT instrument, bar_ts, side FROM cu WHERE side <> 0""", causal=True)
def cusum_events(spark, sf):
    return L.cusum_events(hourly(spark, sf), "close", 60.0)


A50 = 2 / 51
TGT = f"""dv AS (SELECT p.instrument, p.bar_ts, p.close, p.close / a.close - 1 AS ret FROM hb p
  ASOF LEFT JOIN hb a ON a.instrument = p.instrument AND p.bar_ts - INTERVAL 1 DAY > a.bar_ts),
seq AS (SELECT *, row_number() OVER ({HK}) AS k FROM dv WHERE ret IS NOT NULL),
tg AS (SELECT a.instrument, a.bar_ts, a.k, sum(power({1 - A50!r}, a.k - b.k)) AS sw,
  sum(power({1 - A50!r}, 2 * (a.k - b.k))) AS sw2, sum(power({1 - A50!r}, a.k - b.k) * b.ret) AS s1,
  sum(power({1 - A50!r}, a.k - b.k) * b.ret * b.ret) AS s2
  FROM seq a JOIN seq b ON a.instrument = b.instrument AND b.k <= a.k GROUP BY 1, 2, 3),
trg AS (SELECT instrument, bar_ts, CASE WHEN k >= 2 THEN sqrt(greatest(s2/sw - (s1/sw)**2, 0) / (1 - sw2/(sw*sw))) END AS trgt
  FROM tg)"""


@query("day_target", "W3 C10", f"""WITH {HOURLY}, {TGT}
SELECT d.instrument, d.bar_ts, {r('ret')}, {r('trgt')} FROM dv d LEFT JOIN trg USING (instrument, bar_ts)""",
       causal=True)
def day_target(spark, sf):
    t = L.day_target(hourly(spark, sf), 50)
    return rounded(t.select("instrument", "bar_ts", "ret", "trgt"))


def generic_sql(pt, sl, zero, events):
    up = f"min(b.bar_ts) FILTER (round((b.close / e.close - 1) * side, 12) > round({pt} * trgt, 12))" if pt else "NULL"
    dn = f"min(b.bar_ts) FILTER (round((b.close / e.close - 1) * side, 12) < round(-{sl} * trgt, 12))" if sl else "NULL"
    bin_ = "CAST(sign(round(ret, 12)) AS INTEGER)"
    if zero:
        bin_ = f"CASE WHEN vertical THEN 0 ELSE {bin_} END"
    return f"""evs AS (SELECT h.instrument, h.bar_ts, h.close, trgt, x.side FROM hb h
  JOIN trg USING (instrument, bar_ts) JOIN ({events}) x USING (instrument, bar_ts) WHERE trgt > 0),
vt AS (SELECT e.*, (SELECT min(bar_ts) FROM hb v WHERE v.instrument = e.instrument
  AND v.bar_ts >= e.bar_ts + INTERVAL 1 DAY) AS v_t FROM evs e),
tch AS (SELECT e.instrument, e.bar_ts, e.close, e.side, e.trgt, e.v_t, {up} AS t_pt, {dn} AS t_sl FROM vt e
  JOIN hb b ON b.instrument = e.instrument AND b.bar_ts >= e.bar_ts AND b.bar_ts <= coalesce(e.v_t, TIMESTAMP '2100-01-01')
  GROUP BY 1, 2, 3, 4, 5, 6),
res AS (SELECT *, least(t_pt, t_sl, v_t) AS t1, t_pt IS NULL AND t_sl IS NULL AS vertical FROM tch),
fin AS (SELECT r.*, (h.close / r.close - 1) * side AS ret FROM res r JOIN hb h ON h.instrument = r.instrument AND h.bar_ts = r.t1)
SELECT instrument, bar_ts AS t0, t1, side, {r('trgt')}, {r('ret')}, {bin_} AS bin,
  CASE WHEN round(ret, 12) > 0 THEN 1 ELSE 0 END AS meta_bin, vertical FROM fin"""


@query("generic_barriers_cusum", "L6 L6b", f"WITH RECURSIVE {HOURLY}, {CUS}, {TGT}, " + generic_sql(
    1.0, 1.0, True, "SELECT instrument, bar_ts, 1 AS side FROM cu WHERE side <> 0"))
def generic_barriers_cusum(spark, sf):
    h = hourly(spark, sf)
    ev = L.cusum_events(h, "close", 60.0).select("instrument", "bar_ts", F.lit(1).alias("side"))
    t = L.day_target(h, 50).drop("ret").join(ev, ["instrument", "bar_ts"], "left")
    return rounded(L.generic_barriers(t, 1.0, 1.0, zero_vertical=True))


@query("generic_barriers_meta", "L6 L6b", f"WITH RECURSIVE {HOURLY}, {CUS}, {TGT}, " + generic_sql(
    0.25, 0, False, "SELECT instrument, bar_ts, side FROM cu WHERE side <> 0"))
def generic_barriers_meta(spark, sf):
    h = hourly(spark, sf)
    ev = L.cusum_events(h, "close", 60.0)
    t = L.day_target(h, 50).drop("ret").join(ev, ["instrument", "bar_ts"], "left")
    return rounded(L.generic_barriers(t, 0.25, 0.0))
