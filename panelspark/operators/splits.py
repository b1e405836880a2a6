"""Chronological splits, embargo, effective sample size, purging and folds."""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.joins import with_scalars
from ..functions.windows import KEY, ORDER, with_runs

# Split fractions and the low-power floor.
FRACS = (0.6, 0.2, 0.2)
FLOOR = 10


def date_positions(df: DataFrame) -> DataFrame:
    """Distinct dates with 0-based position: one row per calendar date."""
    days = df.select(ORDER).distinct().withColumn("_one", F.lit(1))
    w = Window.partitionBy("_one").orderBy(ORDER)
    return days.select(ORDER, (F.row_number().over(w) - 1).alias("pos"),
                       F.count("*").over(Window.partitionBy("_one")).alias("n_dates"))


def chronological_split(df: DataFrame, fracs=FRACS) -> DataFrame:
    """Date -> train / val / test by position over the ordered dates."""
    d = date_positions(df)
    n = F.col("n_dates")
    c1 = F.floor(n * F.lit(fracs[0]))
    c2 = F.floor(n * F.lit(fracs[0] + fracs[1]))
    return d.select(ORDER, "pos", c1.alias("val_start"), c2.alias("val_end"),
                    F.when(F.col("pos") < c1, "train").when(F.col("pos") < c2, "val")
                    .otherwise("test").alias("partition"))


def run_table(signals: DataFrame) -> DataFrame:
    """One row per maximal constant run."""
    return with_runs(signals, "s").groupBy(KEY, "run_id").agg(F.count("*").alias("len"))


def run_length_p90(signals: DataFrame) -> DataFrame:
    """Floored 90th percentile (linear) of run lengths."""
    return run_table(signals).groupBy(KEY).agg(
        F.floor(F.percentile("len", F.lit(0.9))).alias("embargo_p90"))


def n_eff(df: DataFrame) -> DataFrame:
    """Number of constant runs in the given slice."""
    return with_runs(df, "s").groupBy(KEY).agg(F.max("run_id").alias("n_eff"))


def embargoed_val(signals: DataFrame) -> DataFrame:
    """Validation rows left after dropping the embargo at both edges.

    Positions are places on the date axis that all instruments share.
    """
    split = F.broadcast(chronological_split(signals))         # one row per date
    emb = run_length_p90(signals)
    df = signals.join(split, ORDER).join(emb, KEY)
    return df.filter((F.col("pos") >= F.col("val_start") + F.col("embargo_p90"))
                     & (F.col("pos") < F.col("val_end") - F.col("embargo_p90")))


def scope_registry(signals: DataFrame, classes: DataFrame) -> DataFrame:
    """Embargo, gate n_eff on the embargoed validation slice, power flag."""
    gate = n_eff(embargoed_val(signals)).withColumnRenamed("n_eff", "n_eff_gate")
    out = classes.join(run_length_p90(signals), KEY).join(gate, KEY, "left")
    gate0 = F.coalesce("n_eff_gate", F.lit(0))
    return out.select(KEY, "asset_class", gate0.alias("n_eff_gate"),
                      F.lit("per_instrument").alias("fit_scope_regime"),
                      F.lit("pooled_within_class").alias("fit_scope_latent"),
                      (gate0 < FLOOR).alias("low_power"), "embargo_p90")


def partition_meta(df: DataFrame) -> DataFrame:
    """Join the split and the constant training end date to non-flat rows."""
    split = chronological_split(df)
    end = split.filter(F.col("partition") == "train").agg(F.max(ORDER).alias("fe_train_end_date"))
    rows = df.filter("s <> 0").join(F.broadcast(split.select(ORDER, "partition")), ORDER)
    return with_scalars(rows, end)


def provenance(df: DataFrame) -> DataFrame:
    """Count, first and last date per partition, instrument and class."""
    rows = partition_meta(df)
    scopes = F.array(*[F.struct(F.lit(c).alias("scope"), F.col(c).alias("member"))
                       for c in ("partition", KEY, "asset_class")])
    return (rows.select(ORDER, F.explode(scopes).alias("g")).groupBy("g.scope", "g.member")
            .agg(F.count("*").alias("n_rows"), F.countDistinct(ORDER).alias("n_dates"),
                 F.min(ORDER).alias("first_date"), F.max(ORDER).alias("last_date")))


def kfold_dates(df: DataFrame, k=5) -> DataFrame:
    """Contiguous date folds by position."""
    d = date_positions(df)
    return d.select(ORDER, "pos", F.floor(F.col("pos") * k / F.col("n_dates")).alias("fold"))


def purged_kfold(events: DataFrame, bars: DataFrame, k=5, embargo=10) -> DataFrame:
    """For every fold the train events that do not touch the test span.

    Test spans are k rows, exploded from one array per event instead of a range
    join. An event is purged when [t_start, t_end] overlaps the span, and
    embargoed when it starts within ``embargo`` positions after it.
    """
    folds = kfold_dates(bars, k)
    spans = folds.groupBy("fold").agg(F.min(ORDER).alias("a"), F.max(ORDER).alias("b"),
                                      F.max("pos").alias("bp"))
    ends = folds.select(F.col("pos").alias("ep"), F.col(ORDER).alias("emb_end"))
    last = folds.agg(F.max("pos").alias("_last"))
    spans = with_scalars(spans, last).withColumn("ep", F.least(F.col("bp") + embargo, "_last"))
    spans = spans.join(ends, "ep").select("fold", "a", "b", "emb_end")
    packed = spans.agg(F.collect_list(F.struct("fold", "a", "b", "emb_end")).alias("spans"))  # k rows
    ev = events.join(F.broadcast(folds.select(F.col(ORDER).alias("t_signal"),
                                              F.col("fold").alias("own"))), "t_signal")
    ev = with_scalars(ev, packed).withColumn("f", F.explode("spans"))
    role = (F.when(F.col("own") == F.col("f.fold"), "test")
            .when((F.col("t_start") <= F.col("f.b")) & (F.col("t_end") >= F.col("f.a")), "purged")
            .when((F.col("t_signal") > F.col("f.b")) & (F.col("t_signal") <= F.col("f.emb_end")),
                  "embargoed").otherwise("train"))
    return ev.select(KEY, "t_signal", F.col("f.fold").alias("fold"), role.alias("role"))


def year_split_capped(df: DataFrame, year: int, cap: int) -> DataFrame:
    """Rows up to a year, then the first ``cap`` later rows per id.

    The cap is the operator's own parameter (a fixed-length test set)."""
    w = Window.partitionBy(KEY).orderBy(ORDER)
    early = df.filter(F.year(ORDER) <= year).withColumn("part", F.lit("train"))
    late = (df.filter(F.year(ORDER) > year).withColumn("_k", F.row_number().over(w))
            .filter(F.col("_k") <= cap).drop("_k").withColumn("part", F.lit("test")))
    return early.unionByName(late)
