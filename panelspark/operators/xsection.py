"""cross-sectional features, all instruments in one plan.

Two grids are used on purpose. Ranks and pair correlations live on each
instrument's own bars; F9d-f live on the union grid of all panel dates, where a
missing bar voids a strict window. The union grid is made by exploding one
sequence of positions per instrument, never by a cross join.
"""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.joins import with_scalars
from ..functions.numeric import nonzero_sd, positive
from ..functions.windows import KEY, ORDER, lag, log_return, strict, trailing
from . import tiles


def xsect_rank(bars: DataFrame, lookback=20, score="reversal") -> DataFrame:
    """Rank of the trailing return among all instruments of that date, in [-1, 1]."""
    if score not in ("reversal", "momentum"):
        raise ValueError(score)
    logc = F.ln(positive("close"))
    trail = logc - F.lag(logc, lookback).over(Window.partitionBy(KEY).orderBy(ORDER))
    df = bars.withColumn("_sc", -trail if score == "reversal" else trail)
    by_date = Window.partitionBy(ORDER)
    # NULL scores sort first, so subtract their number
    order = by_date.orderBy(F.col("_sc").asc_nulls_last(), KEY)
    df = df.withColumns({"_n": F.count("_sc").over(by_date),
                         "_pos": F.row_number().over(order) - 1})
    rank = (F.when(F.col("_sc").isNull(), None).when(F.col("_n") == 1, F.lit(0.0))
            .otherwise(F.try_divide(2.0 * F.col("_pos"), F.col("_n") - 1) - 1.0))
    return df.select(KEY, ORDER, rank.alias("f9_xsect_rank"),
                     F.col("_n").cast("double").alias("f9_xsection_universe_size"))


def pair_returns(rets: DataFrame) -> DataFrame:
    """Dates on which both members of a class pair have a return.

    The pair table is the product itself (one row per class pair and date); the
    group joined is one class on one date, bounded by the instrument dimension.
    """
    a = rets.select(F.col(KEY).alias("a"), "asset_class", ORDER, F.col("ret").alias("ra"))
    b = rets.select(F.col(KEY).alias("b"), "asset_class", ORDER, F.col("ret").alias("rb"))
    return a.join(b, ["asset_class", ORDER]).filter("a < b")


def rolling_pair_corr(rets: DataFrame, n=120) -> DataFrame:
    """Rolling correlation per pair on the intersection of their dates."""
    w = trailing(n, key=("a", "b"))
    pairs = pair_returns(rets)
    return pairs.select("a", "b", ORDER, F.when(F.count("ra").over(w) == n,
                                                F.corr("ra", "rb").over(w)).alias("pair_corr"))


def pair_corr_mean(rets: DataFrame, n=120) -> DataFrame:
    """Mean rolling correlation with the class peers; NULL on dates without one."""
    grid = date_grid(rets)
    last = grid.agg(F.max("pos")).first()[0] or 0
    placed = rets.join(grid, ORDER).select(KEY, "asset_class", ORDER, "pos", "ret")
    sums = tiles.partner_sums(placed, tiles.rolling_corr(n, last), "asset_class").filter("n > 0")
    means = sums.select(KEY, "pos", (F.col("total") / F.col("n")).alias("f9_pair_corr_mean"))
    return placed.select(KEY, ORDER, "pos").join(means, [KEY, "pos"], "left").drop("pos")


def date_grid(rets: DataFrame) -> DataFrame:
    """All return dates with their position: one row per calendar date."""
    dates = rets.select(ORDER).distinct().withColumn("_one", F.lit(1))
    return dates.select(ORDER, F.row_number().over(
        Window.partitionBy("_one").orderBy(ORDER)).alias("pos"))


def union_grid(rets: DataFrame) -> DataFrame:
    """Every instrument on every panel date, ``ret`` NULL where it has no return."""
    grid = date_grid(rets)
    per_date = rets.join(grid, ORDER)
    last = grid.agg(F.max("pos").alias("last"))
    span = with_scalars(rets.select(KEY, "asset_class").distinct(), last)
    full = span.select(KEY, "asset_class", F.explode(F.sequence(F.lit(1), "last")).alias("pos"))
    return (full.join(F.broadcast(grid), "pos")            # one row per calendar date
            .join(per_date.select(KEY, ORDER, "ret"), [KEY, ORDER], "left"))


def lead_lag_centroid(rets: DataFrame, n=126) -> DataFrame:
    """F9d: RMS distance to yesterday's mean return of all other instruments."""
    grid = union_grid(rets)
    by_date = rets.groupBy(ORDER).agg(F.sum("ret").alias("_t"), F.count("ret").alias("_k"))
    df = grid.join(by_date, ORDER)
    others = F.try_divide(F.col("_t") - F.coalesce("ret", F.lit(0.0)),
                          F.col("_k") - F.col("ret").isNotNull().cast("int"))
    df = df.withColumn("_c", others).withColumn("_cl", lag("_c"))
    df = df.withColumn("_d2", F.pow(F.col("ret") - F.col("_cl"), 2.0))
    out = df.withColumn("f9_dist_lead_lag_centroid", F.sqrt(strict(F.avg, "_d2", n)))
    return out.filter("ret IS NOT NULL").select(KEY, ORDER, "f9_dist_lead_lag_centroid")


def class_dispersion_z(rets: DataFrame, n=63) -> DataFrame:
    """F9e: z-score (ddof 0) of the class's cross-section sd on the union grid."""
    disp = rets.groupBy("asset_class", ORDER).agg(F.stddev_pop("ret").alias("_s"))
    members = rets.groupBy("asset_class").agg(F.count_distinct(KEY).alias("_m"))
    grid = union_grid(rets).select("asset_class", ORDER).distinct()
    df = grid.join(disp, ["asset_class", ORDER], "left")
    k = {"key": "asset_class"}
    mu, sd = strict(F.avg, "_s", n, **k), strict(F.stddev_pop, "_s", n, **k)
    z = df.withColumn("f9_asset_class_dispersion_z", (F.col("_s") - mu) / nonzero_sd(sd))
    z = z.join(members, "asset_class").withColumn(
        "f9_asset_class_dispersion_z",
        F.when(F.col("_m") >= 2, F.col("f9_asset_class_dispersion_z")))
    return (rets.join(z, ["asset_class", ORDER])
            .select(KEY, ORDER, "f9_asset_class_dispersion_z"))


def implied_corr_z(rets: DataFrame, halflife=20, n=252, within_class=False) -> DataFrame:
    """F9f: z-score of the mean EWM correlation with the other instruments, on the union grid.

    ``within_class`` limits the partners to the own class; the default uses the whole
    instrument dimension.
    """
    grid = date_grid(rets)
    last = grid.agg(F.max("pos")).first()[0] or 0
    placed = rets.join(grid, ORDER).select(KEY, "asset_class", "pos", "ret")
    corr = tiles.ewm_corr(1.0 - 0.5 ** (1.0 / halflife), last)
    sums = tiles.partner_sums(placed, corr, "asset_class" if within_class else None)
    imp = (sums.withColumn("_i", F.when(F.col("n") > 0, F.col("total") / F.col("n")))
           .join(F.broadcast(grid), "pos").select(KEY, ORDER, "_i"))        # one row per calendar date
    mu, sd = strict(F.avg, "_i", n), strict(F.stddev_pop, "_i", n)
    z = imp.select(KEY, ORDER, ((F.col("_i") - mu) / nonzero_sd(sd)).alias("f9_ewma_implied_corr_z"))
    return rets.select(KEY, ORDER).join(z, [KEY, ORDER])


def class_returns(panel: DataFrame) -> DataFrame:
    """Native log returns with the asset class kept."""
    return (panel.withColumn("ret", log_return()).filter(F.col("ret").isNotNull())
            .select(KEY, "asset_class", ORDER, "ret"))
