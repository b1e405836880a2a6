"""Cleaning, anomaly flags and missing-session diagnostics."""

from pyspark.sql import DataFrame, functions as F

from ..functions.calendars import ADHOC_CLOSURES
from ..functions.joins import with_scalars

OHLC = ("open", "high", "low", "close")
ROW_VALUES = OHLC + ("volume", "open_interest")


def row_flags():
    """The four fault conditions of a row; NULL volume counts as zero."""
    weekend = F.weekday("date") >= 5
    nonfinite = F.greatest(*[F.col(x).isNull().cast("int") for x in OHLC]) == 1
    positive = [F.coalesce(F.col(x) <= 0, F.lit(False)) for x in OHLC]
    bounds = F.coalesce(F.col("high") < F.col("low"), F.lit(False))
    for p in positive:
        bounds = bounds | p
    zero_volume = ~weekend & (F.coalesce("volume", F.lit(0.0)) == 0)
    return {"weekend_row": weekend, "nonfinite_ohlc": nonfinite, "bad_ohlc_bounds": bounds,
            "zero_volume_weekday": zero_volume}


def clean_long(df: DataFrame, drop_zero_volume=False, order="ord") -> DataFrame:
    """B1: drop impossible rows, then keep the first copy of each (instrument, date).

    The copy is chosen by aggregation (primitive min_by buffers, combined on the
    map side), so a bar re-sent millions of times never meets in one task.
    """
    f = row_flags()
    bad = f["weekend_row"] | f["nonfinite_ohlc"] | f["bad_ohlc_bounds"]
    if drop_zero_volume:
        bad = bad | f["zero_volume_weekday"]
    extra = [x for x in ("asset_class",) if x in df.columns]
    return (df.filter(~bad).groupBy("instrument", *extra, "date")
            .agg(*[F.min_by(x, order).alias(x) for x in ROW_VALUES]))


def canonical_frame(df: DataFrame, order="ord") -> DataFrame:
    """Rows with a close, first of duplicate dates, float columns."""
    ok = df.filter(F.col("close").isNotNull())
    return ok.groupBy("instrument", "date").agg(
        *[F.min_by(F.col(x).cast("double"), order).alias(x) for x in ROW_VALUES])


def anomalous_rows(df: DataFrame) -> DataFrame:
    """B2: one output row per raised flag."""
    flags = F.array(*[F.when(cond, F.lit(name)) for name, cond in row_flags().items()])
    return df.withColumn("flag", F.explode(F.filter(flags, lambda x: x.isNotNull())))


def inceptions(df: DataFrame) -> DataFrame:
    """First date per instrument."""
    return df.groupBy("instrument").agg(F.min("date").alias("inception"))


def missing_sessions(df: DataFrame, dim: DataFrame, sessions: DataFrame,
                     calendar: DataFrame) -> DataFrame:
    """Expected sessions inside an instrument's span with no bar."""
    span = df.groupBy("instrument").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    expected = (span.join(dim.select("instrument", "calendar", "venue"), "instrument")
                .join(F.broadcast(sessions), "calendar")
                .filter(F.col("date").between(F.col("a"), F.col("b"))))
    gaps = expected.join(df.select("instrument", "date"), ["instrument", "date"], "left_anti")
    early = calendar.filter(F.col("kind") == "early_close").select("calendar", "date", "label")
    return (gaps.join(F.broadcast(early), ["calendar", "date"], "left")
            .select("date", F.when(F.col("label").isNotNull(), "early_close")
                    .otherwise("unexplained").alias("classification"),
                    F.coalesce("label", F.lit("")).alias("label"), "instrument", "venue"))


def missing_summary(df: DataFrame, dim: DataFrame, missing: DataFrame) -> DataFrame:
    """Presence and missing counts per instrument."""
    have = df.groupBy("instrument").agg(F.min("date").alias("inception"),
                                        F.count_distinct("date").alias("n_present"))
    miss = missing.groupBy("instrument").agg(
        F.count("*").alias("n_missing_total"),
        F.count_if(F.col("classification") == "early_close").alias("n_missing_early_close"),
        F.count_if(F.col("classification") == "unexplained").alias("n_missing_unexplained"))
    out = (have.join(dim.select("instrument", "venue", "calendar"), "instrument")
           .join(miss, "instrument", "left"))
    return out.fillna(0, [c for c in miss.columns if c != "instrument"])


def presence(df: DataFrame) -> DataFrame:
    """(date, instrument, present) over every weekday of the panel's span.

    Each instrument row explodes its own weekday sequence: no cross join.
    """
    span = df.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    keys = df.groupBy("instrument").agg(F.min("date").alias("inception"))
    grid = (with_scalars(keys, span)
            .select("instrument", "inception", F.explode(F.sequence("a", "b")).alias("date"))
            .filter(F.weekday("date") < 5))
    have = df.select("instrument", "date").distinct().withColumn("_p", F.lit(True))
    return (grid.join(have, ["instrument", "date"], "left")
            .select("date", "instrument", "inception",
                    F.coalesce("_p", F.lit(False)).alias("present")))


def classify_missing(df: DataFrame, dim: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per date the missing active members, their scope and the reason."""
    act = presence(df).filter(F.col("inception") <= F.col("date"))
    act = act.join(dim.select("instrument", "calendar", "venue"), "instrument")
    kinds = calendar.groupBy("calendar", "date").agg(
        F.max(F.when(F.col("kind") == "holiday", F.col("label"))).alias("hol"),
        F.max(F.when(F.col("kind") == "early_close", F.col("label"))).alias("early"))
    act = act.join(F.broadcast(kinds), ["calendar", "date"], "left")
    gone = ~F.col("present")

    def all_of(*venues):
        return F.min(F.when(gone, F.col("venue").isin(*venues)))

    day = act.groupBy("date").agg(
        F.count_if(gone).alias("n_missing"), F.count("*").alias("n_active"),
        all_of("EUREX").alias("eu"), all_of("CME_EQ").alias("eq"),
        all_of("NYMEX", "COMEX", "CME_EQ").alias("us"),
        # the first member (by name) with a holiday wins over any early close
        F.min_by("hol", F.when(gone & F.col("hol").isNotNull(), F.col("instrument"))).alias("hol"),
        F.min_by("early", F.when(gone & F.col("early").isNotNull(), F.col("instrument"))).alias("early"),
        F.array_join(F.array_sort(F.collect_set(F.when(gone, F.col("instrument")))), ",")
        .alias("affected_instruments"))
    day = day.filter(F.col("n_missing") > 0)
    full = F.col("n_missing") == F.col("n_active")
    one = F.col("eu") | F.col("eq") | F.col("us")
    return day.select(
        "date",
        F.when(F.col("hol").isNotNull(), "full_holiday")
        .when(F.col("early").isNotNull(), "early_close").otherwise("glitch").alias("category"),
        F.when(full, "global").when(one, "exchange_specific").otherwise("mixed").alias("scope"),
        F.when(full, "ALL").when(F.col("eu"), "EUREX").when(F.col("eq"), "CME_EQ")
        .when(F.col("us"), "US_FUTURES").otherwise("MIXED").alias("venue_group"),
        F.coalesce("hol", "early", F.lit("")).alias("label"),
        "n_missing", "n_active", "affected_instruments")


def holiday_venue_scope(calendar: DataFrame) -> DataFrame:
    """Which venue calendars observe each holiday date."""
    hol = calendar.filter(F.col("kind") == "holiday").groupBy("date").agg(
        *[F.max(F.col("calendar") == c).alias(c) for c in ("CMES", "CME_Equity", "XEUR")])
    m, q, x = F.col("CMES"), F.col("CME_Equity"), F.col("XEUR")
    scope = (F.when(m & q & x, "global").when(m & q & ~x, "us_futures")
             .when(~m & q & ~x, "cme_equity").when(~m & ~q & x, "eurex")
             .when(m & ~q & ~x, "nymex_comex").otherwise("other"))
    closed = F.concat_ws("+", F.when(m, "NYMEX/COMEX"), F.when(q, "CME_EQ"), F.when(x, "EUREX"))
    return hol.select("date", scope.alias("venue_scope"), closed.alias("venues_closed"))


def missing_holidays(classified: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row per full-holiday date with its intrinsic scope."""
    adhoc = [F.lit(d).cast("date") for d, _, _ in ADHOC_CLOSURES]
    return (classified.filter(F.col("category") == "full_holiday")
            .join(F.broadcast(holiday_venue_scope(calendar)), "date", "left")
            .select("date", F.year("date").alias("year"), F.col("label").alias("holiday_name"),
                    F.when(F.col("date").isin(*adhoc), "adhoc").otherwise("recurring")
                    .alias("holiday_type"), "venue_scope", "venues_closed",
                    F.col("scope").alias("observed_scope"), "n_missing", "n_active",
                    "affected_instruments"))


def other_missing(classified: DataFrame) -> DataFrame:
    """Early closes and glitches."""
    return (classified.filter(F.col("category") != "full_holiday")
            .select("date", F.year("date").alias("year"), "category", "label", "scope",
                    "venue_group", "n_missing", "n_active", "affected_instruments"))


def category_scope_counts(classified: DataFrame) -> DataFrame:
    """Counts by category and scope, with totals from a rollup.

    Spark's rollup of no rows is empty, so one row is joined on the left: a panel without
    gaps keeps its grand total of 0.
    """
    counts = classified.rollup("category", "scope").agg(F.count("*").alias("n"))
    return (classified.sparkSession.range(1).join(counts, F.lit(True), "left")
            .select(F.coalesce("category", F.lit("ALL")).alias("category"),
                    F.coalesce("scope", F.lit("ALL")).alias("scope"), F.coalesce("n", F.lit(0)).alias("n")))


def drop_rare_labels(df: DataFrame, label: str, min_share: float) -> DataFrame:
    """Drop the rarest class until every share exceeds ``min_share`` or two remain.

    Closed form on the class-count table: with classes in ascending order the
    loop stops at the first class whose share of the classes from it upward is
    large enough, or when only two are left.
    """
    from pyspark.sql import Window
    counts = df.groupBy(label).agg(F.count("*").alias("_n")).withColumn("_one", F.lit(1))
    asc = Window.partitionBy("_one").orderBy("_n", label)
    up = asc.rowsBetween(0, Window.unboundedFollowing)
    st = counts.withColumns({"_rest": F.sum("_n").over(up), "_k": F.count("*").over(up),
                             "_i": F.row_number().over(asc)})
    stop = (F.col("_n") / F.col("_rest") > min_share) | (F.col("_k") < 3)
    first = F.min(F.when(stop, F.col("_i"))).over(Window.partitionBy("_one"))
    kept = st.withColumn("_f", first).filter("_i >= _f").select(label)
    return df.join(kept, label, "left_semi")
