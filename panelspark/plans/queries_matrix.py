"""The joined feature matrix and the sinks' summary tables."""

import uuid

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import labels as L
from ..sources import sinks as S
from ..sources.store import panel, shared_dir
from .features import FeatureBuilder
from .queries_price import f1_sql, f2_sql, f6_sql, f7_sql, f12_sql
from . import queries_quality  # noqa: F401 - the tables that the sink writes
from .queries_labels import EV, UNIQ, events
from .queries_signal import f5_sql
from .queries_splits import META, SIG, SPLIT
from .registry import QUERIES, query

LIGHT = ("f1_counter_trend", "f2_volatility", "f5_signal", "f6_momentum", "f7_microstructure",
         "f8_calendar", "f9_xsect_rank", "f9_pair_corr_mean", "f10_price_action",
         "f12_path_structure", "f15_path_shape")
DIGITS = {"f2_atr_14": 4, "f6_macd_12_26": 2, "f6_macd_hist_12_26_9": 2, "f6_adx_14": 5,
          "f7_rolls_spread_20": 3, "f15_path_tortuosity_20": 4}


def matrix_sql():
    fams = ", ".join(f"q{i} AS ({QUERIES[n].sql})" for i, n in enumerate(LIGHT))
    joins = " ".join(f"LEFT JOIN q{i} USING (instrument, date)" for i in range(len(LIGHT)))
    return (f"WITH {fams}, mt AS (WITH {SIG}, {SPLIT}, {META} SELECT * EXCLUDE (s) FROM meta) "
            f"SELECT * FROM mt {joins}")


def register():
    from . import queries_price, queries_risk, queries_signal  # noqa: F401 - the twins joined below

    @query("feature_matrix", "K15 C2 U4", matrix_sql())
    def feature_matrix(spark, sf):
        p = panel(spark, sf)
        m = FeatureBuilder(heavy=False).fit(p).transform(p)
        cols = [c for c in m.columns if not c.startswith("z_")]
        return m.select(*[rnd(c, DIGITS.get(c, 6)) if t == "double" else F.col(c)
                          for c, t in m.dtypes if c in cols])


register()


# ---- sinks: written, read back and returned -----------------------------------------

def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def light_matrix(spark, sf):
    return QUERIES["feature_matrix"].build(spark, sf)


@query("sink_matrix", "A7 T1", matrix_sql())
def sink_matrix(spark, sf):
    return S.write_matrix(light_matrix(spark, sf), folder(spark, "matrix"))


FAMILIES = {"f1": "f1_", "f2": "f2_", "f5": "f5_", "f6": "f6_", "f12": "f12_"}


@query("sink_families", "A8", "SELECT date, instrument, COLUMNS(lambda c: regexp_matches(c, '^f(1|2|5|6|12)_')) FROM (" + matrix_sql() + ")")
def sink_families(spark, sf):
    path = folder(spark, "families")
    stored = S.write_matrix(light_matrix(spark, sf), path)
    families = {n: [c for c in stored.columns if c.startswith(p)] for n, p in FAMILIES.items()}
    S.write_families(stored, path, families)
    return S.read_families(spark, path, families)


def line_sql(cols):
    """Text of a row as the sink's ``line`` makes it; ``cols`` maps names to kinds."""
    return "concat_ws('|', " + ", ".join(
        f"coalesce(CAST({f'CAST(round({c} * 1e6) AS HUGEINT)' if k == 'double' else c} AS VARCHAR), '')"
        for c, k in sorted(cols.items())) + ")"


EVENT_COLS = {"instrument": "", "t_signal": "", "t_start": "", "t_end": "", "side": "", "ret": "double", "label": "",
              "uniqueness_weight": "double", "sigma": "double"}


@query("events_fingerprint", "A10", f"""WITH RECURSIVE {EV}, {UNIQ}, e AS (
  SELECT ev.* EXCLUDE (pos, off), w AS uniqueness_weight FROM ev JOIN uw USING (instrument, t_signal)),
h AS (SELECT CAST('0x' || substr(md5({line_sql(EVENT_COLS)}), 1, 12) AS BIGINT) AS h FROM e)
SELECT count(*) AS n_rows, bit_xor(h) AS xor_hash, CAST(sum(h) AS VARCHAR) AS sum_hash FROM h""")
def events_fingerprint(spark, sf):
    ev = events(spark, sf).select(*EVENT_COLS)
    return S.write_events(ev, L.events_meta(ev), folder(spark, "events"))


TABLES = {"classified": "classify_missing_dates", "missing_holidays": "missing_holiday_metadata",
          "other_missing": "other_missing_metadata", "scope_counts": "category_scope_counts",
          "per_instrument": "missing_sessions", "summary": "missing_summary", "anomalies": "anomaly_counts"}
TABLE_COLS = {
    "classified": "date category scope venue_group label n_missing n_active affected_instruments",
    "missing_holidays": "date year holiday_name holiday_type venue_scope venues_closed observed_scope n_missing "
                        "n_active affected_instruments",
    "other_missing": "date year category label scope venue_group n_missing n_active affected_instruments",
    "scope_counts": "category scope n",
    "per_instrument": "date classification label instrument venue",
    "summary": "instrument venue calendar inception n_present n_missing_total n_missing_early_close n_missing_unexplained",
    "anomalies": "flag n"}


@query("diagnostic_tables", "A9", " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", {line_sql(dict.fromkeys(TABLE_COLS[n].split(), ''))} AS line FROM ({QUERIES[q].sql})"
    for n, q in TABLES.items()))
def diagnostic_tables(spark, sf):
    tables = {n: QUERIES[q].build(spark, sf) for n, q in TABLES.items()}
    path = folder(spark, "diagnostics")
    S.write_tables(tables, path)
    return S.read_tables(spark, tables, path)
