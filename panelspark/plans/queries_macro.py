"""As-of joins and the point-in-time macro family."""

from pyspark.sql import functions as F

from ..functions.joins import asof
from ..functions.numeric import rnd, rounded
from ..operators import macro as M
from ..sources import bars as B
from ..sources.store import panel
from .registry import query
from .sqltext import EVENTS, MACRO, PANEL, r

SERIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW",
          "weekly_F", "weekly_O", "weekly_P", "monthly_F", "monthly_O", "monthly_P")
SPREADS = (("urgent_low", "1-URGENT", "5-LOW"), ("high_medium", "2-HIGH", "3-MEDIUM"),
           ("urgent_unset", "1-URGENT", "4-NOT SPECIFIED"), ("weekly_open", "weekly_O", "weekly_F"))
TRAIN_END = "1999-07-01"

CAD = f"""{MACRO}, cad AS (SELECT series, release_class, bin AS stamp, arg_max(value, stamp) AS value FROM (
  SELECT *, CASE release_class WHEN 'weekly' THEN stamp + CAST((12 - isodow(stamp)) % 7 AS INTEGER)
    WHEN 'monthly' THEN last_day(stamp) ELSE stamp END AS bin FROM macro_obs) GROUP BY 1, 2, 3),
avail AS (SELECT *, CASE release_class WHEN 'weekly' THEN stamp + 6 WHEN 'monthly' THEN
  stamp + CASE isodow(stamp) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END ELSE stamp END AS available FROM cad)"""


@query("macro_latest_stamps", "A5", """WITH o AS (SELECT o_orderpriority AS series, 'daily' AS release_class,
  CAST(o_orderdate AS DATE) AS stamp, o_totalprice AS value, o_orderkey AS ingest FROM orders)
SELECT series, release_class, stamp, arg_max(value, ingest) AS value FROM o GROUP BY 1, 2, 3""")
def macro_latest_stamps(spark, sf):
    from ..sources.readers import table
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series"), F.lit("daily").alias("release_class"),
        F.to_date("o_orderdate").alias("stamp"), F.col("o_totalprice").alias("value"),
        F.col("o_orderkey").alias("ingest"))
    return M.latest_stamps(o)


@query("macro_cadence", "A6", f"WITH {CAD} SELECT series, release_class, stamp, {r('value', 4)} FROM cad")
def macro_cadence(spark, sf):
    return rounded(M.recover_cadence(B.macro_obs(spark, sf)), 4)


@query("macro_availability", "K9", f"""WITH {CAD}
SELECT series, release_class, stamp, available, {r('value', 4)} FROM avail""")
def macro_availability(spark, sf):
    return rounded(M.with_availability(M.recover_cadence(B.macro_obs(spark, sf))), 4)


APPLIED = f"""{PANEL}, {CAD}, td AS (SELECT DISTINCT date FROM panel WHERE s <> 0),
av AS (SELECT series, available, arg_max(value, stamp) AS value FROM avail GROUP BY 1, 2),
bg AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM td) - 200, (SELECT max(date) FROM td),
  INTERVAL 1 DAY)) AS DATE) AS date),
grid AS (SELECT date FROM bg WHERE isodow(date) < 6 UNION SELECT date FROM td),
probe AS (SELECT n.series, n.release_class, g.date FROM grid g, (SELECT DISTINCT series, release_class FROM cad) n),
applied AS (SELECT p.series, p.release_class, p.date, a.value AS level FROM probe p
  ASOF LEFT JOIN av a ON p.series = a.series AND p.date >= a.available)"""


def applied(spark, sf):
    td = panel(spark, sf).filter("s <> 0").select("date").distinct()
    return M.applied_panel(M.recover_cadence(B.macro_obs(spark, sf)), td), td


@query("asof_macro_panel", "C6 K10", f"""WITH {APPLIED}
SELECT series, release_class, date, {r('level', 4)} FROM applied""", causal=True)
def asof_macro_panel(spark, sf):
    return rounded(applied(spark, sf)[0], 4)


FEAT = f"""{APPLIED}, lv AS (SELECT * FROM applied UNION ALL
  SELECT p.n, a.release_class, a.date, a.level - b.level FROM (VALUES {', '.join("('%s','%s','%s')" % t for t in SPREADS)}) p(n, a, b)
  JOIN applied a ON a.series = p.a JOIN applied b ON b.series = p.b AND b.date = a.date),
feat AS (SELECT series, date, level,
  level - CASE WHEN release_class = 'monthly' THEN lag(level, 21) OVER w ELSE lag(level, 5) OVER w END AS chg_short,
  level - CASE WHEN release_class = 'monthly' THEN lag(level, 63) OVER w ELSE lag(level, 20) OVER w END AS chg_long
  FROM lv WINDOW w AS (PARTITION BY series ORDER BY date)),
onday AS (SELECT * FROM feat WHERE date IN (SELECT date FROM td))"""

ALL = SERIES + tuple(n for n, _, _ in SPREADS)
COLS = [f"f11_{M.slug(n)}_{c}" for n in ALL for c in ("level", "chg_short", "chg_long")]


def features(spark, sf):
    ap, td = applied(spark, sf)
    return M.macro_features(M.with_spreads(ap, SPREADS), td)


@query("f11_macro_features", "K11", f"""WITH {FEAT}
SELECT series, date, {r('level', 4)}, {r('chg_short', 4)}, {r('chg_long', 4)} FROM onday""", causal=True)
def f11_macro_features(spark, sf):
    return rounded(features(spark, sf).drop("release_class"), 4)


WIDE = "wide AS (SELECT date, " + ", ".join(
    f"max({c}) FILTER (series = '{n}') AS f11_{M.slug(n)}_{c}" for n in ALL
    for c in ("level", "chg_short", "chg_long")) + " FROM onday GROUP BY 1)"


@query("f11_macro_wide", "K11 C7", f"WITH {FEAT}, {WIDE} SELECT date, {', '.join(r(c, 4) for c in COLS)} FROM wide")
def f11_macro_wide(spark, sf):
    return rounded(M.macro_wide(features(spark, sf), ALL), 4)


ZC = [c for c in COLS if c.startswith(("f11_1", "f11_monthly_f", "f11_urgent_low"))]


@query("f11_macro_frozen_z", "K12 D35 K1", f"""WITH {FEAT}, {WIDE}, st AS (SELECT {', '.join(
    f"coalesce(avg({c}), 0) AS {c}__m, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS {c}__s"
    for c in ZC)} FROM wide WHERE date <= DATE '{TRAIN_END}')
SELECT date, {', '.join(r(f'({c} - {c}__m) / {c}__s', 6, c) for c in ZC)} FROM wide, st""")
def f11_macro_frozen_z(spark, sf):
    wide = M.macro_wide(features(spark, sf), ALL)
    stats = M.frozen_stats(wide, ZC, F.col("date") <= F.lit(TRAIN_END).cast("date"))
    return rounded(M.frozen_zscore(wide, stats, ZC))


@query("macro_broadcast_join", "C7", f"""WITH {FEAT}, {WIDE}
SELECT p.instrument, p.date, p.s, {', '.join(r('o.' + c, 4, c) for c in COLS)} FROM panel p LEFT JOIN wide o ON o.date = p.date""")
def macro_broadcast_join(spark, sf):
    wide = rounded(M.macro_wide(features(spark, sf), ALL), 4)
    p = panel(spark, sf).select("instrument", "date", "s")
    return p.join(F.broadcast(wide), "date", "left")      # one row per calendar date


# ---- intraday as-of ----------------------------------------------------------

@query("asof_day_earlier", "C10", f"""WITH {EVENTS}
SELECT p.instrument, p.ts, p.px, a.ts AS prior_ts, a.px AS prior_px FROM ev p
ASOF LEFT JOIN ev a ON p.instrument = a.instrument AND p.ts - INTERVAL 1 DAY > a.ts""", causal=True)
def asof_day_earlier(spark, sf):
    ev = B.events(spark, sf).select("instrument", "ts", "px")
    left = ev.withColumn("probe", F.col("ts") - F.expr("INTERVAL 1 DAY"))
    out = asof(left, ev, "instrument", "probe", "ts", "px", "prior_px", strict=True, block="day")
    return out.select("instrument", "ts", "px", F.col("prior_px_time").alias("prior_ts"), "prior_px")


@query("asof_forward", "C11", f"""WITH {EVENTS}, pr AS (SELECT instrument, ts, ts + INTERVAL 1 DAY AS probe FROM ev)
SELECT p.instrument, p.ts, a.ts AS next_ts, a.px AS next_px FROM pr p
ASOF LEFT JOIN ev a ON p.instrument = a.instrument AND p.probe <= a.ts""")
def asof_forward(spark, sf):
    ev = B.events(spark, sf).select("instrument", "ts", "px")
    left = ev.select("instrument", "ts", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("probe"))
    out = asof(left, ev, "instrument", "probe", "ts", "px", "next_px", "forward", block="day")
    return out.select("instrument", "ts", F.col("next_px_time").alias("next_ts"), "next_px")
