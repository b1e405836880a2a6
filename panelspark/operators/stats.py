"""Summary tables, correlation structure and evaluation metrics."""

import itertools
import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.joins import with_scalars
from ..functions.windows import KEY, ORDER, log_return, ordered
from ..sources.store import checkpointed
from . import gram


def inventory(panel: DataFrame) -> DataFrame:
    """Span, size and typical levels per instrument (exact median)."""
    return panel.groupBy(KEY).agg(
        F.min(ORDER).alias("start"), F.max(ORDER).alias("end"), F.count("*").alias("n_rows"),
        F.avg("close").alias("mean_close"), F.percentile("volume", F.lit(0.5)).alias("median_volume"),
        F.avg("open_interest").alias("mean_oi"),
        (F.datediff(F.max(ORDER), F.min(ORDER)) / 365.25).alias("years"))


def return_moments(panel: DataFrame) -> DataFrame:
    """Bias-corrected return moments."""
    g = panel.withColumn("r", log_return()).groupBy(KEY).agg(
        F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"),
        F.skewness("r").alias("g1"), F.kurtosis("r").alias("g2"),
        F.min("r").alias("mn"), F.max("r").alias("mx"))
    n = F.col("n").cast("double")
    return g.select(
        KEY, (F.col("m") * 1e4).alias("mean_daily_bp"),
        (F.col("sd") * math.sqrt(252.0) * 100).alias("ann_vol_pct"),
        (F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"),
        (F.col("mn") * 100).alias("min_day_pct"), (F.col("mx") * 100).alias("max_day_pct"),
        F.col("n").alias("n_obs"))


def column_corr(df: DataFrame, cols, min_periods=252, method="pearson") -> DataFrame:
    """Pairwise-complete correlation of columns, (a, b, corr, n_pairs).

    All pairs come from masked Gram matrices of one scan, at any number of columns.
    """
    if method == "spearman":
        df = average_ranks(df, cols)
    return gram.correlation(df, cols, min_periods)


def average_ranks(df: DataFrame, cols) -> DataFrame:
    """Average rank of every value within its column, without a global sort in
    one task: distinct values are counted first, range-partitioned bucket totals
    are prefix-summed, and the rank table joins back by value."""
    df = df.withColumn("_id", F.monotonically_increasing_id())
    df = df.select("_id", *cols)
    long = df.unpivot("_id", cols, "col", "v").filter("v IS NOT NULL")
    counts = long.groupBy("col", "v").agg(F.count("*").alias("k"))
    # value buckets keep each running sum small: the leading bits of a quantile grid
    q = counts.groupBy("col").agg(F.percentile_approx("v", F.array(
        *[F.lit(i / 64.0) for i in range(1, 64)]), F.lit(10000)).alias("cuts"))
    counts = counts.join(F.broadcast(q), "col").withColumn(
        "bkt", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    tot = counts.groupBy("col", "bkt").agg(F.sum("k").alias("t"))
    tot = tot.select("col", "bkt", F.coalesce(F.sum("t").over(
        Window.partitionBy("col").orderBy("bkt").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("before"))
    inside = F.sum("k").over(Window.partitionBy("col", "bkt").orderBy("v").rowsBetween(
        Window.unboundedPreceding, -1))
    ranks = counts.withColumn("_in", F.coalesce(inside, F.lit(0))).join(
        F.broadcast(tot), ["col", "bkt"])
    ranks = ranks.select("col", "v", (F.col("before") + F.col("_in")
                                      + (F.col("k") + 1) / 2.0).alias("rk"))
    out = long.join(ranks, ["col", "v"]).groupBy("_id").pivot("col", list(cols)).agg(F.first("rk"))
    return out


def max_partner(corr: DataFrame) -> DataFrame:
    """Per feature the partner of largest |corr| (first name on ties)."""
    both = corr.select(F.explode(F.array(*[
        F.struct(F.col(x).alias("feature"), F.col(y).alias("partner"))
        for x, y in (("a", "b"), ("b", "a"))])).alias("p"), F.abs("corr").alias("c"))
    both = both.select("p.*", F.round(F.coalesce("c", F.lit(0.0)), 9).alias("c"))
    best = both.groupBy("feature").agg(
        F.min(F.struct((-F.col("c")).alias("neg"), "partner")).alias("m"))
    return best.select("feature", F.col("m.partner").alias("max_corr_partner"),
                       (-F.col("m.neg")).alias("max_abs_corr"))


def redundancy_groups(corr: DataFrame, features: DataFrame, threshold=0.70) -> DataFrame:
    """Connected components of the graph |corr| > threshold.

    Label propagation with pointer halving; each round is a join plus a
    partially aggregated min, and the lineage is cut by a reliable checkpoint.
    This is single linkage at distance 1 - threshold, a coarser grouping than
    average linkage at the same cut.
    """
    e = corr.filter(F.abs("corr") > threshold).select("a", "b")
    edges = e.union(e.select("b", "a")).union(features.select(
        F.col("feature").alias("a"), F.col("feature").alias("b"))).toDF("u", "v").distinct()
    edges = checkpointed(edges)
    lab = features.select(F.col("feature").alias("u"), F.col("feature").alias("l"))
    while True:
        near = (edges.join(lab.withColumnRenamed("u", "v"), "v").groupBy("u")
                .agg(F.min("l").alias("l")))
        jump = lab.select(F.col("u").alias("l"), F.col("l").alias("l2"))
        new = near.join(jump, "l").select("u", F.least("l", "l2").alias("l"))
        new = checkpointed(new)
        moved = new.join(lab.withColumnRenamed("l", "old"), "u").filter("l <> old").limit(1).count()
        lab = new
        if moved == 0:
            break
    size = lab.groupBy("l").agg(F.count("*").alias("group_size"))
    return lab.join(size, "l").select(F.col("u").alias("feature"), F.col("l").alias("group_id"),
                                      "group_size")


def ledoit_wolf(rows: DataFrame, cols, min_obs=252) -> DataFrame:
    """Shrinkage covariance on complete rows, as (i, j, cov, shrinkage).

    S = X'X/n of centred columns; delta^2 and beta^2 come from the sums of
    products and of squared products, so the data are read twice and only the
    p x p table is kept.
    """
    full = rows.dropna(subset=list(cols))
    means = full.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], F.count("*").alias("_n"))
    x = with_scalars(full, means).filter(F.col("_n") >= min_obs)
    x = x.select("_n", *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in cols])
    p = len(cols)
    entries = []
    for i, j in itertools.combinations_with_replacement(range(p), 2):
        prod = F.col(cols[i]) * F.col(cols[j])
        entries.append(F.struct(F.lit(cols[i]).alias("i"), F.lit(cols[j]).alias("j"),
                                F.avg(prod).alias("s"), F.avg(prod * prod).alias("s2"),
                                F.lit(1.0 if i == j else 2.0).alias("m")))
    t = x.groupBy("_n").agg(F.array(*entries).alias("e")).select("_n", F.explode("e").alias("e"))
    t = t.select("_n", "e.*")
    diag = F.col("i") == F.col("j")
    tot = t.agg(F.sum(F.when(diag, F.col("s"))).alias("_tr"),
                F.sum(F.col("m") * F.col("s") * F.col("s")).alias("_ss"),
                F.sum(F.col("m") * (F.col("s2") - F.col("s") * F.col("s"))).alias("_b"))
    t = with_scalars(t, tot)
    mu = F.col("_tr") / p
    delta = (F.col("_ss") - mu * mu * p) / p
    beta = F.least(F.col("_b") / F.col("_n") / p, delta)
    k = F.when(delta > 0, beta / delta).otherwise(0.0)
    return t.select("i", "j", ((1.0 - k) * F.col("s") + F.when(diag, k * mu).otherwise(0.0)).alias("cov"),
                    k.alias("shrinkage"))


# ---- evaluation metrics -----------------------------------------------------------

def regression_metrics(df: DataFrame, y: str, p: str, by=()) -> DataFrame:
    """MAE, MSE, RMSE, MAPE over non-zero y, R^2."""
    e = F.col(y) - F.col(p)
    sst = F.var_pop(y) * F.count(y)
    g = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by)
    return g.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
                 F.sqrt(F.avg(e * e)).alias("rmse"),
                 (F.avg(F.when(F.col(y) != 0, F.abs(e / F.nullif(F.col(y), F.lit(0.0))))) * 100).alias("mape"),
                 (1.0 - F.sum(e * e) / sst).alias("r2"))


def classification_metrics(df: DataFrame, y: str, p: str, by=(), threshold=0.5) -> DataFrame:
    """Confusion counts and rates at one threshold."""
    pos, hit = F.col(y) == 1, F.col(p) >= threshold
    g = df.groupBy(*by).agg(
        F.count_if(pos & hit).alias("tp"), F.count_if(~pos & hit).alias("fp"),
        F.count_if(pos & ~hit).alias("fn"), F.count_if(~pos & ~hit).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.withColumns({
        "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
        "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn)})


def threshold_sweep(df: DataFrame, y: str, p: str, thresholds) -> DataFrame:
    """The same rates at several thresholds; the list is exploded per row
    before a partial aggregation, so the shuffle carries one row per threshold."""
    t = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    t = t.withColumn("_hit", (F.col(p) >= F.col("threshold")).cast("double"))
    return classification_metrics(t, y, "_hit", by=("threshold",))


def auc(df: DataFrame, y: str, p: str, by) -> DataFrame:
    """Mann-Whitney AUC per group from the counts of each distinct score in [0, 1].

    The running count is split into score buckets, so a hot group is scanned by
    many tasks; bucket totals (at most 1,025 per group) carry across.
    """
    v = df.groupBy(*by, p).agg(F.count_if(F.col(y) == 1).alias("np"),
                               F.count_if(F.col(y) != 1).alias("nn"))
    v = v.withColumn("_bkt", F.floor(F.col(p) * 1024))
    tot = v.groupBy(*by, "_bkt").agg(F.sum("nn").alias("_t"))
    before = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*by, "_bkt", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    w = Window.partitionBy(*by, "_bkt").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("_in", F.coalesce(F.sum("nn").over(w), F.lit(0))).join(tot, [*by, "_bkt"])
    v = v.withColumn("below", F.col("_off") + F.col("_in"))
    return v.groupBy(*by).agg(F.try_divide(F.sum(F.col("np") * (F.col("below") + F.col("nn") / 2.0)),
                                           (F.sum("np") * F.sum("nn")).cast("double")).alias("auc"))


def forecast_metrics(test: DataFrame, train: DataFrame, y: str, p: str, season=5) -> DataFrame:
    """sMAPE, MAE, MSE and seasonal MASE per series."""
    scale = (train.withColumn("_d", F.abs(F.col(y) - F.lag(y, season).over(ordered())))
             .groupBy(KEY).agg(F.avg("_d").alias("_scale")))
    e = F.abs(F.col(y) - F.col(p))
    sm = F.try_divide(e, F.abs(y) + F.abs(p))
    g = test.groupBy(KEY).agg((F.avg(F.coalesce(sm, F.lit(0.0)))).alias("smape"),
                              F.avg(e).alias("mae"), F.avg(e * e).alias("mse"))
    return g.join(scale, KEY).withColumn("mase", F.try_divide(F.col("mae"), F.col("_scale"))).drop("_scale")


# ---- time-series featurisation -------------------------------------------------------

def daily_total_difference(df: DataFrame, value: str) -> DataFrame:
    """Sum over all series per date, then the first difference."""
    day = df.groupBy(ORDER).agg(F.sum(value).alias("total")).withColumn("_one", F.lit(1))
    w = Window.partitionBy("_one").orderBy(ORDER)         # one row per calendar date
    return (day.withColumn("y", F.col("total") - F.lag("total").over(w))
            .filter("y IS NOT NULL").select(ORDER, "y"))


def centred_smooth(day: DataFrame) -> DataFrame:
    """Mean of rows -2..+1, the raw value where the frame is incomplete."""
    w = Window.partitionBy(F.lit(1)).orderBy(ORDER).rowsBetween(-2, 1)
    return day.withColumn("y_smooth", F.coalesce(
        F.when(F.count("y").over(w) == 4, F.avg("y").over(w)), F.col("y")))


def calendar_parts():
    d = F.col(ORDER)
    return {"day": F.dayofmonth(d), "month": F.month(d), "quarter": F.quarter(d),
            "dayofweek": F.weekday(d), "dayofyear": F.dayofyear(d), "weekofyear": F.weekofyear(d),
            "is_weekend": (F.weekday(d) >= 5).cast("int")}


def featurize(df: DataFrame, y="y", key=KEY) -> DataFrame:
    """Calendar parts, lags, shifted rolling statistics, then a backward fill.

    The backward fill looks ahead: this table is not part of the causal registry.
    """
    w = Window.partitionBy(key).orderBy(ORDER)
    two_pi = 2.0 * math.pi
    cols = calendar_parts()
    df = df.withColumns(cols)
    cyc = {}
    for c, n in (("month", 12.0), ("day", 31.0), ("dayofweek", 7.0)):
        cyc[f"{c}_sin"] = F.sin(F.col(c) * (two_pi / n))
        cyc[f"{c}_cos"] = F.cos(F.col(c) * (two_pi / n))
    cyc["days_since_start"] = F.datediff(ORDER, F.min(ORDER).over(Window.partitionBy(key)))
    lagged = {f"lag_{k}": F.lag(y, k).over(w) for k in (1, 3, 7, 14)}
    for n in (7, 14):
        fr = w.rowsBetween(-n, -1)
        full = F.count(y).over(fr) == n
        lagged[f"rolling_mean_{n}"] = F.when(full, F.avg(y).over(fr))
        lagged[f"rolling_std_{n}"] = F.when(full, F.stddev_samp(y).over(fr))
    df = df.withColumns({**cyc, **lagged})
    # newest first: the backward fill becomes a running scan instead of O(n^2)
    back = Window.partitionBy(key).orderBy(F.col(ORDER).desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, True).over(back) for c in lagged})


def forward_fill(df: DataFrame, value: str, out: str) -> DataFrame:
    """Log of the positive value (0 -> NULL), filled forward, leading NULLs dropped."""
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    v = F.when(F.col(value) > 0, F.ln(value))
    return df.withColumn(out, F.last(v, True).over(w)).filter(F.col(out).isNotNull())


def series_calendar(df: DataFrame, origin="2000-01-03") -> DataFrame:
    """Calendar features of a series."""
    d = F.col(ORDER)
    return df.withColumns({
        "days_from_start": F.datediff(d, F.lit(origin).cast("date")), "day_of_week": F.weekday(d),
        "day_of_month": F.dayofmonth(d), "week_of_year": F.weekofyear(d), "month": F.month(d),
        "year": F.year(d)})


def one_hot(df: DataFrame, column: str, values) -> DataFrame:
    """Static category to indicator columns."""
    return df.withColumns({f"{column}_{v}": F.col(column) == F.lit(v) for v in values})
