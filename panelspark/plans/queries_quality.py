"""Cleaning, calendars and missing-session diagnostics."""

from pyspark.sql import functions as F

from ..functions import calendars as C
from ..functions.numeric import rnd
from ..operators import quality as Q
from ..sources import bars as B, readers as R
from ..sources.store import panel
from .registry import query
from .sqltext import BARS, DIM, DIRTY, KEY, PANEL, r

BAD = ("(isodow(date) >= 6 OR open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL "
       "OR high < low OR least(open, high, low, close) <= 0)")


def clean_sql(extra=""):
    return f"""WITH {DIRTY}
SELECT instrument, asset_class, date, open, high, low, close, volume, open_interest
FROM (SELECT *, row_number() OVER (PARTITION BY instrument, date ORDER BY ord) AS k FROM dirty
  WHERE NOT {BAD} {extra}) WHERE k = 1"""


@query("clean_long", "B1", clean_sql())
def clean_long(spark, sf):
    return Q.clean_long(B.dirty_bars(spark, sf))


@query("clean_long_drop_zero_volume", "B1", clean_sql("AND NOT coalesce(volume, 0) = 0"))
def clean_long_drop_zero_volume(spark, sf):
    return Q.clean_long(B.dirty_bars(spark, sf), drop_zero_volume=True)


@query("coerce_panel", "A2 A3", f"""WITH {DIRTY}, txt AS (SELECT instrument, date, ord,
  CASE WHEN volume IS NULL THEN 'n/a' WHEN volume = 0 THEN 'NaN' ELSE CAST(volume AS VARCHAR) END AS v,
  CASE WHEN close IS NULL THEN '' ELSE CAST(close AS VARCHAR) END AS c FROM dirty)
SELECT instrument, date, ord, TRY_CAST(c AS DOUBLE) AS close,
  CASE WHEN isnan(TRY_CAST(v AS DOUBLE)) THEN NULL ELSE TRY_CAST(v AS DOUBLE) END AS volume FROM txt""")
def coerce_panel(spark, sf):
    d = B.dirty_bars(spark, sf)
    v, c = F.col("volume"), F.col("close")
    txt = d.select("instrument", "date", "ord",
                   F.when(c.isNull(), "").otherwise(c.cast("string")).alias("close"),
                   F.when(v.isNull(), "n/a").when(v == 0, "NaN").otherwise(v.cast("string"))
                   .alias("volume"))
    return R.coerce_numeric(txt)


@query("clean_panel", "A3 B1", f"""WITH {DIRTY}, ok AS (SELECT *, row_number() OVER
  (PARTITION BY instrument, date ORDER BY ord) AS k FROM dirty WHERE NOT {BAD})
SELECT instrument, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date,
  {r('avg(close)', 2, 'mean_close')}, count(volume) AS n_volume FROM ok WHERE k = 1 GROUP BY 1""")
def clean_panel(spark, sf):
    raw = B.dirty_bars(spark, sf)
    text = raw.withColumns({x: F.col(x).cast("string") for x in Q.ROW_VALUES})
    clean = text.transform(R.coerce_numeric).transform(Q.clean_long)
    return clean.groupBy("instrument").agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"), rnd(F.avg("close"), 2, "mean_close"),
        F.count("volume").alias("n_volume"))


@query("anomalous_rows", "B2 U5", f"""WITH {DIRTY}, fl AS (SELECT *, unnest([
  CASE WHEN isodow(date) >= 6 THEN 'weekend_row' END,
  CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 'nonfinite_ohlc' END,
  CASE WHEN coalesce(high < low, false) OR coalesce(open <= 0, false) OR coalesce(high <= 0, false)
    OR coalesce(low <= 0, false) OR coalesce(close <= 0, false) THEN 'bad_ohlc_bounds' END,
  CASE WHEN isodow(date) < 6 AND coalesce(volume, 0) = 0 THEN 'zero_volume_weekday' END]) AS flag FROM dirty)
SELECT * FROM fl WHERE flag IS NOT NULL""")
def anomalous_rows(spark, sf):
    return Q.anomalous_rows(B.dirty_bars(spark, sf))


@query("anomaly_counts", "D8", f"""WITH {DIRTY}, fl AS (SELECT unnest([
  CASE WHEN isodow(date) >= 6 THEN 'weekend_row' END,
  CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 'nonfinite_ohlc' END,
  CASE WHEN coalesce(high < low, false) OR coalesce(open <= 0, false) OR coalesce(high <= 0, false)
    OR coalesce(low <= 0, false) OR coalesce(close <= 0, false) THEN 'bad_ohlc_bounds' END,
  CASE WHEN isodow(date) < 6 AND coalesce(volume, 0) = 0 THEN 'zero_volume_weekday' END]) AS flag FROM dirty)
SELECT flag, count(*) AS n FROM fl WHERE flag IS NOT NULL GROUP BY 1""")
def anomaly_counts(spark, sf):
    return Q.anomalous_rows(B.dirty_bars(spark, sf)).groupBy("flag").agg(F.count("*").alias("n"))


@query("canonical_frame", "B5", f"""WITH {DIRTY}
SELECT instrument, date, open, high, low, close, volume, open_interest FROM (
  SELECT *, row_number() OVER (PARTITION BY instrument, date ORDER BY ord) AS k FROM dirty
  WHERE close IS NOT NULL) WHERE k = 1""")
def canonical_frame(spark, sf):
    return Q.canonical_frame(B.dirty_bars(spark, sf))


# ---- calendars -------------------------------------------------------------

NTH = "(make_date({y},{m},1) + CAST(((({w} - (isodow(make_date({y},{m},1)) - 1)) % 7 + 7) % 7 + 7*({n}-1)) AS INTEGER))"


def nth(m, w, n):
    return NTH.format(y="y", m=m, w=w, n=n)


def obs(m, d):
    x = f"make_date(y,{m},{d})"
    return f"({x} + CASE isodow({x}) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END)"


# Carter's Easter rule (valid 1900-2099), independent of the formula used in Spark.
CAL = f"""cleanp AS (SELECT * FROM panel WHERE isodow(date) < 6),
yy AS (SELECT CAST(unnest(generate_series(year(min(date)), year(max(date)))) AS INTEGER) AS y FROM cleanp),
e1 AS (SELECT y, ((225 - 11 * (y % 19)) - 21) % 30 + 21 AS d0 FROM yy),
e2 AS (SELECT y, CASE WHEN d0 > 48 THEN d0 - 1 ELSE d0 END AS d FROM e1),
ys AS (SELECT y, make_date(y,3,1) + CAST(d + 7 - (y + y // 4 + d + 1) % 7 - 1 AS INTEGER) AS easter FROM e2),
mem AS (SELECT y, make_date(y,5,31) - CAST(isodow(make_date(y,5,31)) - 1 AS INTEGER) AS d FROM ys),
us AS (SELECT {obs(1, 1)} AS date, 'New Year''s Day' AS label FROM ys
  UNION ALL SELECT {nth(1, 0, 3)}, 'Martin Luther King Jr. Day' FROM ys WHERE y >= 1998
  UNION ALL SELECT {nth(2, 0, 3)}, 'Presidents'' Day' FROM ys
  UNION ALL SELECT easter - 2, 'Good Friday' FROM ys
  UNION ALL SELECT d, 'Memorial Day' FROM mem
  UNION ALL SELECT {obs(6, 19)}, 'Juneteenth' FROM ys WHERE y >= 2022
  UNION ALL SELECT {obs(7, 4)}, 'Independence Day' FROM ys
  UNION ALL SELECT {nth(9, 0, 1)}, 'Labor Day' FROM ys
  UNION ALL SELECT {nth(11, 3, 4)}, 'Thanksgiving Day' FROM ys
  UNION ALL SELECT {obs(12, 25)}, 'Christmas Day' FROM ys),
adh AS (SELECT CAST(d AS DATE) AS date, l AS label, s AS scope FROM (VALUES
  {", ".join("('%s','%s','%s')" % t for t in C.ADHOC_CLOSURES)}) v(d, l, s)
  WHERE year(CAST(d AS DATE)) IN (SELECT y FROM yy)),
early AS (SELECT make_date(y,12,24) AS date, 'Christmas Eve (early close)' AS label, 0 AS us FROM ys WHERE isodow(make_date(y,12,24)) < 6
  UNION ALL SELECT make_date(y,12,31), 'New Year''s Eve (early close)', 0 FROM ys WHERE isodow(make_date(y,12,31)) < 6
  UNION ALL SELECT {nth(11, 3, 4)} + 1, 'Day after Thanksgiving (early close)', 1 FROM ys
  UNION ALL SELECT make_date(y,7,3), 'July 3 (pre-Independence Day early close)', 1 FROM ys WHERE isodow(make_date(y,7,3)) < 6
  UNION ALL SELECT make_date(y,7,5), 'July 5 (Independence Day Friday bridge)', 1 FROM ys WHERE isodow(make_date(y,7,4)) = 4
  UNION ALL SELECT make_date(y,12,26), 'Dec 26 (Christmas Friday bridge)', 1 FROM ys WHERE isodow(make_date(y,12,25)) = 4
  UNION ALL SELECT make_date(y,1,2), 'Jan 2 (New Year Friday bridge)', 1 FROM ys WHERE isodow(make_date(y,1,1)) = 4
  UNION ALL SELECT make_date(y,1,3), 'Jan 3 (New Year Monday bridge)', 1 FROM ys WHERE isodow(make_date(y,1,1)) = 6),
eurex AS (SELECT make_date(y,1,1) AS date, 'New Year''s Day (Eurex)' AS label FROM ys
  UNION ALL SELECT easter - 2, 'Good Friday (Eurex)' FROM ys
  UNION ALL SELECT easter + 1, 'Easter Monday (Eurex)' FROM ys
  UNION ALL SELECT make_date(y,5,1), 'Labour Day (Eurex)' FROM ys
  UNION ALL SELECT make_date(y,12,25), 'Christmas Day (Eurex)' FROM ys
  UNION ALL SELECT make_date(y,12,26), 'Boxing Day (Eurex)' FROM ys
  UNION ALL SELECT easter + 50, 'Whit Monday (Eurex)' FROM ys WHERE y BETWEEN 1998 AND 2007 OR y = 2015),
cal AS (SELECT c AS calendar, date, 'holiday' AS kind, label FROM us, (VALUES ('CMES'),('CME_Equity')) v(c)
  UNION ALL SELECT c, date, 'holiday', label FROM adh, (VALUES ('CMES'),('CME_Equity')) v(c)
    WHERE scope = 'us_all' OR c = 'CME_Equity'
  UNION ALL SELECT 'XEUR', date, 'holiday', label FROM eurex
  UNION ALL SELECT c, date, 'early_close', label FROM early, (VALUES ('CMES'),('CME_Equity')) v(c)
  UNION ALL SELECT 'XEUR', date, 'early_close', label FROM early WHERE us = 0),
wd AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM cleanp), (SELECT max(date) FROM cleanp),
  INTERVAL 1 DAY)) AS DATE) AS date),
sess AS (SELECT c AS calendar, date FROM wd, (VALUES ('CMES'),('CME_Equity'),('XEUR')) v(c)
  WHERE isodow(date) < 6 AND (c, date) NOT IN (SELECT calendar, date FROM cal WHERE kind = 'holiday'))"""


def base(spark, sf):
    clean = panel(spark, sf).filter(F.weekday("date") < 5)
    cal = C.calendar_table(C.panel_years(clean))
    return clean, cal, B.instruments(spark, sf)


def cal_query(name, ids, where, pred):
    @query(name, ids, f"WITH {PANEL}, {CAL} SELECT * FROM cal WHERE {where}")
    def run(spark, sf):
        return base(spark, sf)[1].filter(pred)
    return run


cal_query("us_holidays", "Q1", "kind = 'holiday' AND calendar <> 'XEUR'",
          "kind = 'holiday' AND calendar <> 'XEUR'")
cal_query("eurex_holidays", "Q2", "kind = 'holiday' AND calendar = 'XEUR'",
          "kind = 'holiday' AND calendar = 'XEUR'")
cal_query("early_closes", "Q3", "kind = 'early_close'", "kind = 'early_close'")


@query("expected_sessions", "Q4", f"WITH {PANEL}, {CAL} SELECT * FROM sess")
def expected_sessions(spark, sf):
    clean, cal, _ = base(spark, sf)
    return C.expected_sessions(clean, cal)


MISS = f"""{DIM}, spans AS (SELECT instrument, min(date) AS a, max(date) AS b FROM cleanp GROUP BY 1),
miss AS (SELECT s.date, CASE WHEN e.label IS NULL THEN 'unexplained' ELSE 'early_close' END AS classification,
  coalesce(e.label, '') AS label, p.instrument, d.venue FROM spans p JOIN dim d USING (instrument)
  JOIN sess s ON s.calendar = d.calendar AND s.date BETWEEN p.a AND p.b
  LEFT JOIN cal e ON e.calendar = d.calendar AND e.date = s.date AND e.kind = 'early_close'
  WHERE NOT EXISTS (SELECT 1 FROM cleanp c WHERE c.instrument = p.instrument AND c.date = s.date))"""


def missing(spark, sf):
    clean, cal, dim = base(spark, sf)
    return Q.missing_sessions(clean, dim, C.expected_sessions(clean, cal), cal)


@query("missing_sessions", "C3 C4 U2", f"WITH {PANEL}, {CAL}, {MISS} SELECT * FROM miss")
def missing_sessions(spark, sf):
    return missing(spark, sf)


@query("inceptions", "D1", f"WITH {BARS} SELECT instrument, min(date) AS inception FROM bars GROUP BY 1")
def inceptions(spark, sf):
    return Q.inceptions(panel(spark, sf))


@query("missing_summary", "D2", f"""WITH {PANEL}, {CAL}, {MISS}, m AS (SELECT instrument, count(*) AS t,
  count(*) FILTER (classification = 'early_close') AS e, count(*) FILTER (classification = 'unexplained') AS u
  FROM miss GROUP BY 1)
SELECT c.instrument, d.venue, d.calendar, min(date) AS inception, count(DISTINCT date) AS n_present,
  coalesce(any_value(t), 0) AS n_missing_total, coalesce(any_value(e), 0) AS n_missing_early_close,
  coalesce(any_value(u), 0) AS n_missing_unexplained
FROM cleanp c JOIN dim d USING (instrument) LEFT JOIN m USING (instrument) GROUP BY 1, 2, 3""")
def missing_summary(spark, sf):
    clean, cal, dim = base(spark, sf)
    miss = Q.missing_sessions(clean, dim, C.expected_sessions(clean, cal), cal)
    return Q.missing_summary(clean, dim, miss)


PRES = """inc AS (SELECT instrument, min(date) AS inception FROM cleanp GROUP BY 1),
pres AS (SELECT w.date, i.instrument, i.inception, EXISTS (SELECT 1 FROM cleanp c
  WHERE c.instrument = i.instrument AND c.date = w.date) AS present
  FROM inc i, wd w WHERE isodow(w.date) < 6)"""


@query("presence_grid", "C5", f"WITH {PANEL}, {CAL}, {PRES} SELECT * FROM pres")
def presence_grid(spark, sf):
    return Q.presence(base(spark, sf)[0])


CLS = f"""{DIM}, {PRES}, act AS (SELECT p.*, d.venue, h.label AS hol, e.label AS early FROM pres p
  JOIN dim d USING (instrument)
  LEFT JOIN cal h ON h.calendar = d.calendar AND h.date = p.date AND h.kind = 'holiday'
  LEFT JOIN cal e ON e.calendar = d.calendar AND e.date = p.date AND e.kind = 'early_close'
  WHERE p.inception <= p.date),
agg AS (SELECT date, count(*) FILTER (NOT present) AS n_missing, count(*) AS n_active,
  bool_and(venue = 'EUREX') FILTER (NOT present) AS eu, bool_and(venue = 'CME_EQ') FILTER (NOT present) AS eq,
  bool_and(venue <> 'EUREX') FILTER (NOT present) AS us,
  arg_min(hol, instrument) FILTER (NOT present AND hol IS NOT NULL) AS hol,
  arg_min(early, instrument) FILTER (NOT present AND early IS NOT NULL) AS early,
  string_agg(instrument, ',' ORDER BY instrument) FILTER (NOT present) AS affected_instruments
  FROM act GROUP BY 1),
cls AS (SELECT date, CASE WHEN hol IS NOT NULL THEN 'full_holiday' WHEN early IS NOT NULL THEN 'early_close'
    ELSE 'glitch' END AS category,
  CASE WHEN n_missing = n_active THEN 'global' WHEN eu OR eq OR us THEN 'exchange_specific' ELSE 'mixed' END AS scope,
  CASE WHEN n_missing = n_active THEN 'ALL' WHEN eu THEN 'EUREX' WHEN eq THEN 'CME_EQ'
    WHEN us THEN 'US_FUTURES' ELSE 'MIXED' END AS venue_group,
  coalesce(hol, early, '') AS label, n_missing, n_active, affected_instruments FROM agg WHERE n_missing > 0),
vs AS (SELECT date, bool_or(calendar = 'CMES') AS m, bool_or(calendar = 'CME_Equity') AS q,
  bool_or(calendar = 'XEUR') AS x FROM cal WHERE kind = 'holiday' GROUP BY 1),
scopes AS (SELECT date, CASE WHEN m AND q AND x THEN 'global' WHEN m AND q THEN 'us_futures'
  WHEN q AND NOT m AND NOT x THEN 'cme_equity' WHEN x AND NOT m AND NOT q THEN 'eurex'
  WHEN m AND NOT q AND NOT x THEN 'nymex_comex' ELSE 'other' END AS venue_scope,
  concat_ws('+', CASE WHEN m THEN 'NYMEX/COMEX' END, CASE WHEN q THEN 'CME_EQ' END,
    CASE WHEN x THEN 'EUREX' END) AS venues_closed FROM vs)"""


def classified(spark, sf):
    clean, cal, dim = base(spark, sf)
    return Q.classify_missing(clean, dim, cal), cal


@query("classify_missing_dates", "D3 D4", f"WITH {PANEL}, {CAL}, {CLS} SELECT * FROM cls")
def classify_missing_dates(spark, sf):
    return classified(spark, sf)[0]


@query("holiday_venue_scope", "D5", f"WITH {PANEL}, {CAL}, {CLS} SELECT * FROM scopes")
def holiday_venue_scope(spark, sf):
    return Q.holiday_venue_scope(base(spark, sf)[1])


@query("missing_holiday_metadata", "D6", f"""WITH {PANEL}, {CAL}, {CLS}
SELECT date, year(date) AS year, label AS holiday_name,
  CASE WHEN date IN (SELECT date FROM adh) THEN 'adhoc' ELSE 'recurring' END AS holiday_type,
  venue_scope, venues_closed, scope AS observed_scope, n_missing, n_active, affected_instruments
FROM cls LEFT JOIN scopes USING (date) WHERE category = 'full_holiday'""")
def missing_holiday_metadata(spark, sf):
    return Q.missing_holidays(*classified(spark, sf))


@query("other_missing_metadata", "D7", f"""WITH {PANEL}, {CAL}, {CLS}
SELECT date, year(date) AS year, category, label, scope, venue_group, n_missing, n_active,
  affected_instruments FROM cls WHERE category <> 'full_holiday'""")
def other_missing_metadata(spark, sf):
    return Q.other_missing(classified(spark, sf)[0])


@query("category_scope_counts", "D8", f"""WITH {PANEL}, {CAL}, {CLS}
SELECT coalesce(category, 'ALL') AS category, coalesce(scope, 'ALL') AS scope, count(*) AS n
FROM cls GROUP BY ROLLUP (category, scope)""")
def category_scope_counts(spark, sf):
    return Q.category_scope_counts(classified(spark, sf)[0])


RETL = f"""lab AS (SELECT instrument, date, CAST(greatest(-3, least(3, round(ret))) AS INTEGER) AS bin FROM (
  SELECT instrument, date, ln(close) - lag(ln(close)) OVER ({KEY}) AS ret FROM panel) WHERE ret IS NOT NULL)"""


@query("drop_rare_labels", "B15", f"""WITH {PANEL}, {RETL}, k AS (SELECT bin, count(*) AS n FROM lab GROUP BY 1),
st AS (SELECT bin, n, row_number() OVER (ORDER BY n, bin) AS i,
  sum(n) OVER (ORDER BY n, bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
  count(*) OVER (ORDER BY n, bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_k FROM k)
SELECT bin, count(*) AS n FROM lab WHERE bin IN (SELECT bin FROM st WHERE i >= (SELECT min(i) FROM st
  WHERE n / rest > 0.12 OR left_k < 3)) GROUP BY 1""")
def drop_rare_labels(spark, sf):
    from ..operators.price import native_returns
    lab = native_returns(panel(spark, sf)).select(
        "instrument", "date",
        F.greatest(F.lit(-3), F.least(F.lit(3), F.round("ret").cast("int"))).alias("bin"))
    return Q.drop_rare_labels(lab, "bin", 0.12).groupBy("bin").agg(F.count("*").alias("n"))
