"""Splits, embargo, scope, folds and reshapes."""

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import labels as L, splits as S
from ..sources import bars as B
from ..sources.store import panel
from .queries_labels import EV, H
from .registry import query
from .sqltext import KEY, PANEL, lag, r

SIG = f"{PANEL}, sg AS (SELECT instrument, asset_class, date, s FROM panel WHERE s IS NOT NULL)"
SPLIT = """dp AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n
  FROM (SELECT DISTINCT date FROM sg)),
sp AS (SELECT date, pos, CAST(floor(n * 0.6) AS BIGINT) AS val_start, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS val_end,
  CASE WHEN pos < floor(n * 0.6) THEN 'train' WHEN pos < floor(n * 0.8::DOUBLE) THEN 'val' ELSE 'test' END AS partition FROM dp)"""
RUNS = f"""rn AS (SELECT *, sum(chg) OVER ({KEY}) AS run FROM (SELECT *, CASE WHEN s = {lag('s')} THEN 0 ELSE 1 END AS chg FROM sg)),
rl AS (SELECT instrument, run, count(*) AS len FROM rn GROUP BY 1, 2),
p90 AS (SELECT instrument, CAST(floor(quantile_cont(len, 0.9)) AS BIGINT) AS embargo_p90 FROM rl GROUP BY 1)"""
EMB = """emb AS (SELECT sg.*, sp.pos, sp.val_start, sp.val_end, sp.partition, p90.embargo_p90 FROM sg JOIN sp USING (date)
  JOIN p90 USING (instrument) WHERE pos >= val_start + embargo_p90 AND pos < val_end - embargo_p90)"""
NEFF = f"""ne AS (SELECT instrument, CAST(sum(chg) AS BIGINT) AS n_eff FROM (SELECT instrument,
  CASE WHEN s = {lag('s')} THEN 0 ELSE 1 END AS chg FROM emb) GROUP BY 1)"""


def sig(spark, sf):
    return panel(spark, sf).filter("s IS NOT NULL").select("instrument", "asset_class", "date", "s")


@query("chronological_split", "L7", f"WITH {SIG}, {SPLIT} SELECT * FROM sp")
def chronological_split(spark, sf):
    return S.chronological_split(sig(spark, sf))


@query("run_length_p90", "D24", f"WITH {SIG}, {RUNS} SELECT * FROM p90")
def run_length_p90(spark, sf):
    return S.run_length_p90(sig(spark, sf))


@query("embargoed_val", "L8", f"WITH {SIG}, {SPLIT}, {RUNS}, {EMB} SELECT * FROM emb")
def embargoed_val(spark, sf):
    return S.embargoed_val(sig(spark, sf))


@query("n_eff", "D25", f"WITH {SIG}, {SPLIT}, {RUNS}, {EMB}, {NEFF} SELECT * FROM ne")
def n_eff(spark, sf):
    return S.n_eff(S.embargoed_val(sig(spark, sf)))


@query("scope_registry", "K14", f"""WITH {SIG}, {SPLIT}, {RUNS}, {EMB}, {NEFF}
SELECT c.instrument, c.asset_class, coalesce(n_eff, 0) AS n_eff_gate, 'per_instrument' AS fit_scope_regime,
  'pooled_within_class' AS fit_scope_latent, coalesce(n_eff, 0) < 10 AS low_power, embargo_p90
FROM (SELECT DISTINCT instrument, asset_class FROM sg) c JOIN p90 USING (instrument) LEFT JOIN ne USING (instrument)""")
def scope_registry(spark, sf):
    s = sig(spark, sf)
    return S.scope_registry(s, s.select("instrument", "asset_class").distinct())


META = """meta AS (SELECT sg.*, sp.partition, (SELECT max(date) FROM sp WHERE partition = 'train') AS fe_train_end_date
  FROM sg JOIN sp USING (date) WHERE s <> 0)"""


@query("partition_meta", "B9 B4 C14", f"WITH {SIG}, {SPLIT}, {META} SELECT * FROM meta")
def partition_meta(spark, sf):
    return S.partition_meta(sig(spark, sf))


@query("provenance_bounds", "D34", f"""WITH {SIG}, {SPLIT}, {META}, g AS (
  SELECT date, 'partition' AS scope, partition AS member FROM meta
  UNION ALL SELECT date, 'instrument', instrument FROM meta
  UNION ALL SELECT date, 'asset_class', asset_class FROM meta)
SELECT scope, member, count(*) AS n_rows, count(DISTINCT date) AS n_dates, min(date) AS first_date,
  max(date) AS last_date FROM g GROUP BY 1, 2""")
def provenance_bounds(spark, sf):
    return S.provenance(sig(spark, sf))


@query("purged_kfold", "L10 C13", f"""WITH RECURSIVE {EV},
d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)),
f AS (SELECT date, pos, CAST(floor(pos * 5 / n) AS BIGINT) AS fold FROM d),
sp AS (SELECT fold, min(date) AS a, max(date) AS b, max(pos) AS bp FROM f GROUP BY 1),
sp2 AS (SELECT sp.*, e.date AS emb_end FROM sp JOIN f e ON e.pos = least(bp + 10, (SELECT max(pos) FROM f)))
SELECT ev.instrument, ev.t_signal, x.fold, CASE WHEN o.fold = x.fold THEN 'test'
  WHEN ev.t_start <= x.b AND ev.t_end >= x.a THEN 'purged'
  WHEN ev.t_signal > x.b AND ev.t_signal <= x.emb_end THEN 'embargoed' ELSE 'train' END AS role
FROM ev JOIN f o ON o.date = ev.t_signal, sp2 x""")
def purged_kfold(spark, sf):
    p = panel(spark, sf)
    return S.purged_kfold(L.triple_barrier(L.label_vol(p), H, uniqueness=False), p)


@query("year_split_capped", "L12 T4 U6", f"""WITH {PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument, year(date) > 1999
  ORDER BY date) AS k FROM panel)
SELECT instrument, date, close, CASE WHEN year(date) <= 1999 THEN 'train' ELSE 'test' END AS part
FROM k WHERE year(date) <= 1999 OR k <= 250""")
def year_split_capped(spark, sf):
    return S.year_split_capped(panel(spark, sf).select("instrument", "date", "close"), 1999, 250)


# ---- reshapes and plain joins ---------------------------------------------------

NATIONS = [f"NATION_{i}" for i in range(25)]      # columns of the twins, which need them in their text


def columns_of(dim):
    """The instruments of a dimension, sorted: one column each, so as many as a row can hold."""
    return [x.instrument for x in dim.select("instrument").distinct().orderBy("instrument").collect()]


@query("universe_subset", "B3", f"""WITH {PANEL} SELECT instrument, count(*) AS n, {r('avg(close)', 2, 'mean_close')}
FROM panel WHERE instrument IN ('NATION_1', 'NATION_3', 'NATION_5', 'NATION_7') GROUP BY 1""")
def universe_subset(spark, sf):
    p = panel(spark, sf).filter(F.col("instrument").isin("NATION_1", "NATION_3", "NATION_5", "NATION_7"))
    return rounded(p.groupBy("instrument").agg(F.count("*").alias("n"), F.avg("close").alias("mean_close")), 2)


WIDE = "wide AS (SELECT date, " + ", ".join(
    f"max(s) FILTER (instrument = '{n}') AS {n}" for n in NATIONS) + " FROM panel GROUP BY 1)"


def wide_signals(spark, sf):
    p = panel(spark, sf)
    return p.groupBy("date").pivot("instrument", columns_of(B.instruments(spark, sf))).agg(F.max("s"))


@query("signals_wide", "B7 U1", f"WITH {PANEL}, {WIDE} SELECT * FROM wide")
def signals_wide(spark, sf):
    return wide_signals(spark, sf)


@query("signals_long", "B6", f"WITH {PANEL}, {WIDE} SELECT date, instrument, s FROM wide UNPIVOT INCLUDE NULLS (s FOR instrument IN ({', '.join(NATIONS)}))")
def signals_long(spark, sf):
    wide = wide_signals(spark, sf)
    return wide.unpivot("date", [c for c in wide.columns if c != "date"], "instrument", "s")


@query("returns_panel", "A4 B7", f"WITH {PANEL}, r0 AS (SELECT * FROM (SELECT instrument, date, ln(close) - {lag('ln(close)')} AS ret FROM panel) WHERE ret IS NOT NULL) SELECT date, "
       + ", ".join(r(f"max(ret) FILTER (instrument = '{n}')", 9, n) for n in NATIONS) + " FROM r0 GROUP BY 1", causal=True)
def returns_panel(spark, sf):
    from ..operators.price import native_returns
    p = panel(spark, sf)
    rets = native_returns(p)
    return rounded(rets.groupBy("date").pivot("instrument", columns_of(B.instruments(spark, sf))).agg(F.max("ret")), 9)


@query("family_outer_join", "C2 U1", f"""WITH {PANEL}, b AS (SELECT instrument, date, close FROM panel WHERE isodow(date) < 6),
s AS (SELECT instrument, date, s FROM panel WHERE day(date) <= 20)
SELECT instrument, date, close, s FROM b FULL JOIN s USING (instrument, date)""")
def family_outer_join(spark, sf):
    p = panel(spark, sf)
    b = p.filter(F.weekday("date") < 5).select("instrument", "date", "close")
    s = p.filter(F.dayofmonth("date") <= 20).select("instrument", "date", "s")
    return b.join(s, ["instrument", "date"], "full")


FROZEN = ("instrument", "date", "open", "close", "vix_level", "s")


def freeze_columns(df, order):
    """Columns in catalog order, absent ones as NULL doubles."""
    return df.select([F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in order])


@query("frozen_columns", "B10", f"WITH {PANEL} SELECT instrument, date, open, close, CAST(NULL AS DOUBLE) AS vix_level, s FROM panel")
def frozen_columns(spark, sf):
    return freeze_columns(panel(spark, sf), FROZEN)


@query("guarded_arithmetic", "B8", f"""WITH {PANEL} SELECT instrument, date,
  {r('close / NULLIF(high - low, 0)', 4, 'close_per_range')}, {r('CASE WHEN open_interest > 0 THEN ln(open_interest) END', 6, 'log_oi')},
  {r('greatest(-1, least(1, (close - open) / 1000))', 6, 'clipped')}, CAST(sign(close - open) AS INTEGER) AS direction,
  {r('volume / NULLIF(open_interest, 0)', 6, 'vol_per_oi')} FROM panel""")
def guarded_arithmetic(spark, sf):
    from ..functions.numeric import div, log_pos
    p = panel(spark, sf)
    return rounded(p.select(
        "instrument", "date", div("close", F.col("high") - F.col("low")).alias("close_per_range"),
        log_pos("open_interest").alias("log_oi"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("close") - F.col("open")) / 1000)).alias("clipped"),
        F.signum(F.col("close") - F.col("open")).cast("int").alias("direction"),
        div("volume", "open_interest").alias("vol_per_oi")), special={"close_per_range": 4})


@query("region_one_hot", "B14", """SELECT n_name AS instrument, r_name AS region, """
       + ", ".join(f"r_name = '{x[0]}' AS \"region_{x[0]}\"" for x in B.REGION_VENUES)
       + ", count(*) AS n_suppliers FROM nation JOIN region ON n_regionkey = r_regionkey "
         "JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def region_one_hot(spark, sf):
    from ..operators.stats import one_hot
    from ..sources.readers import table
    dim = B.instruments(spark, sf).select("n_nationkey", "instrument", F.col("asset_class").alias("region"))
    n = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n_suppliers"))
    out = n.join(F.broadcast(dim), n.s_nationkey == dim.n_nationkey)
    return one_hot(out, "region", [x[0] for x in B.REGION_VENUES]).drop("s_nationkey", "n_nationkey")
