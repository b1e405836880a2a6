"""Window kernel shared by every feature family.

Size bound: a daily panel is unique on (instrument, date), so one window
partition never holds more rows than there are calendar days (about 13,000 for
1990-2025), however many ticks an instrument has. Ticks are reduced to bars by
a partially aggregated groupBy first. Tick-level windows do not use this module
but the day-blocked prefix sums in ``sources.bars``.

All columns that share one frame should be added in one ``withColumns`` call so
that Catalyst plans one sort and one Window node for them.
"""

import math

from pyspark.sql import DataFrame, Window, functions as F

from .numeric import c, nonzero_sd

KEY = "instrument"
ORDER = "date"


def ordered(key=KEY, order=ORDER):
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(order)


def trailing(n, key=KEY, order=ORDER):
    return ordered(key, order).rowsBetween(-(n - 1), 0)


def running(key=KEY, order=ORDER):
    return ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)


def whole(key=KEY):
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys)


def strict(agg, x, n, key=KEY, order=ORDER, frame=None, need=None):
    """``agg(x)`` over a trailing n-row frame, NULL unless all n values are present."""
    w = frame if frame is not None else trailing(n, key, order)
    return F.when(F.count(c(x)).over(w) == (need or n), agg(c(x)).over(w))


def sma(x, n, **kw):
    return strict(F.avg, x, n, **kw)


def rsd(x, n, **kw):
    return strict(F.stddev_samp, x, n, **kw)


def rsum(x, n, **kw):
    return strict(F.sum, x, n, **kw)


def zscore(x, n, **kw):
    """Trailing z-score, sample sd; NULL where the window is flat."""
    return (c(x) - sma(x, n, **kw)) / nonzero_sd(rsd(x, n, **kw))


def lag(x, k=1, key=KEY, order=ORDER):
    return F.lag(c(x), k).over(ordered(key, order))


def lead(x, k=1, key=KEY, order=ORDER):
    return F.lead(c(x), k).over(ordered(key, order))


def log_return(price="close", key=KEY, order=ORDER):
    p = F.when(c(price) > 0, F.ln(c(price)))
    return p - F.lag(p, 1).over(ordered(key, order))


def percentile_rank(x, n, key=KEY, order=ORDER):
    """Share of the trailing n values that are <= the current one."""
    w = trailing(n, key, order)
    full = (F.count(c(x)).over(w) == n) & c(x).isNotNull()
    vals = F.collect_list(c(x)).over(w)
    share = F.size(F.filter(vals, lambda v: v <= c(x))) / F.lit(float(n))
    return F.when(full, share)


def expanding_z(x, min_count=60, key=KEY, order=ORDER):
    w = running(key, order)
    sd = F.stddev_samp(c(x)).over(w)
    return F.when(F.count(c(x)).over(w) >= min_count,
                  (c(x) - F.avg(c(x)).over(w)) / nonzero_sd(sd))


def with_runs(df: DataFrame, x: str, run_id="run_id", length="run_length",
              key=KEY, order=ORDER) -> DataFrame:
    """Constant-value runs. A NULL never equals its neighbour, so it breaks runs."""
    w = ordered(key, order)
    prev = F.lag(x).over(w)
    change = F.when(F.row_number().over(w) == 1, 1).when(F.col(x) == prev, 0).otherwise(1)
    keys = [key] if isinstance(key, str) else list(key)
    return (df.withColumn("_chg", change)
            .withColumn(run_id, F.sum("_chg").over(running(key, order)))
            .withColumn(length, F.row_number().over(
                Window.partitionBy(*keys, run_id).orderBy(order)))
            .drop("_chg"))


def with_ewm(df: DataFrame, specs, key=KEY, order=ORDER, mask=None) -> DataFrame:
    """Exponentially weighted means, ``adjust=False``, weights decaying over gaps.

    ``specs`` is a list of (output, input, alpha, min_count). The recursion
    y = g*y + (1-g)*x, g = w/(w+alpha), w = (1-alpha)^gap runs as a scaled
    running sum inside chunks of non-null values; the value entering a chunk is
    the last one of the chunk before. The total decay over one chunk is below
    1e-60, so older chunks add nothing a double can hold. A few windows over
    one hash partitioning, no recursion, no Python. Columns named ``_*`` are
    dropped.

    ``mask`` names a column whose NULLs are those of every input; the weights
    are then computed once per alpha instead of once per input.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w, run = ordered(key, order), running(key, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_rn", F.row_number().over(w))
    source = {x: (mask or x) for _, x, _, _ in specs}
    masks = {m: f"_x{i}" for i, m in enumerate(dict.fromkeys(source.values()))}
    cols = {}
    for m, p in masks.items():
        cols[f"{p}_n"] = F.count(c(m)).over(run)
        cols[f"{p}_prev"] = F.last(F.when(c(m).isNotNull(), F.col("_rn")), True).over(before)
    df = df.withColumns(cols)

    groups = {}                                   # (mask, alpha) -> shared weights
    for _, x, a, _ in specs:
        groups.setdefault((source[x], a), len(groups))
    cols = {}
    for (m, a), j in groups.items():
        p, per = masks[m], -math.log(1.0 - a)
        gap = F.col("_rn") - F.col(f"{p}_prev")
        lnw = gap * F.lit(-per)
        # a dense step has w + alpha = 1, so ln g = ln w exactly
        lng = F.when(gap == 1, F.lit(-per)).otherwise(lnw - F.ln(F.exp(lnw) + F.lit(a)))
        cols[f"_blk{j}"] = F.floor((F.col(f"{p}_n") - 1) / F.lit(max(2, int(150.0 / per))))
        cols[f"_lng{j}"] = F.when(c(m).isNotNull(), F.coalesce(lng, F.lit(0.0)))
    df = df.withColumns(cols)

    def inside(j):
        return Window.partitionBy(*keys, f"_blk{j}").orderBy(order).rowsBetween(
            Window.unboundedPreceding, 0)

    df = df.withColumns({f"_cum{j}": F.sum(f"_lng{j}").over(inside(j)) for j in groups.values()})
    cols = {}
    for i, (_, x, a, _) in enumerate(specs):
        j = groups[(source[x], a)]
        seed = F.col(f"{masks[source[x]]}_n") == 1
        coef = F.when(seed, F.lit(1.0)).otherwise(F.lit(1.0) - F.exp(F.col(f"_lng{j}")))
        term = F.when(c(x).isNotNull(), coef * c(x) * F.exp(-F.col(f"_cum{j}")))
        cols[f"_loc{i}"] = F.exp(F.col(f"_cum{j}")) * F.sum(term).over(inside(j))
    df = df.withColumns(cols)
    cols = {}
    for i, (_, x, a, _) in enumerate(specs):
        j = groups[(source[x], a)]
        last_of_block = F.lead(f"_blk{j}").over(w) != F.col(f"_blk{j}")
        cols[f"_end{i}"] = F.when(last_of_block, F.col(f"_loc{i}"))
    df = df.withColumns(cols)
    cols = {}
    for i, (out, x, a, need) in enumerate(specs):
        j = groups[(source[x], a)]
        carry = F.coalesce(F.last(f"_end{i}", True).over(before), F.lit(0.0))
        cols[out] = F.when(F.col(f"{masks[source[x]]}_n") >= need,
                           F.col(f"_loc{i}") + F.exp(F.col(f"_cum{j}")) * carry)
    keep = [col for col in df.columns if not col.startswith("_")]
    return df.withColumns(cols).select(*keep, *[s[0] for s in specs])


def strict_chain(df: DataFrame, *layers: dict) -> DataFrame:
    """Add column layers one after another; each may use the layer before."""
    for layer in layers:
        df = df.withColumns(layer)
    return df


def halo_blocks(df: DataFrame, lookback: int, block=512, key=KEY, order=ORDER) -> DataFrame:
    """Split each key into position blocks, each preceded by its last ``lookback`` rows.

    Costly window expressions then run on (key, blk) partitions of at most
    block + lookback rows instead of one task per key. Keep rows with ``own``
    after computing. Adds ``pos``, ``blk`` and ``own``.
    """
    size = max(block, lookback)
    df = df.withColumn("pos", F.row_number().over(ordered(key, order)))
    home = F.floor((F.col("pos") - 1) / F.lit(size))
    near_end = F.col("pos") - 1 >= (home + 1) * size - lookback
    df = df.withColumn("_home", home)
    df = df.withColumn("blk", F.explode(F.when(near_end, F.array("_home", F.col("_home") + 1))
                                        .otherwise(F.array("_home"))))
    return df.withColumn("own", F.col("blk") == F.col("_home")).drop("_home")
