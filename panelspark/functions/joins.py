"""Join helpers: one-row scalars and as-of joins without range conditions."""

from pyspark.sql import DataFrame, Window, functions as F


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a one-row global aggregate to every row.

    Spark folds the constant key away and runs a nested loop against that one row.
    """
    one = F.broadcast(scalars.withColumn("_one", F.lit(1)))        # exactly one row
    return df.withColumn("_one", F.lit(1)).join(one, "_one").drop("_one")


def asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str,
         value: str, out: str, direction="backward", strict=False, block="month") -> DataFrame:
    """Nearest ``right`` value at or before (after) each left time.

    Both sides are unioned and scanned in time order inside (key, time block)
    partitions; a small table of block ends carries values across blocks. A key
    that holds most rows is spread over its blocks, and no side is broadcast or
    range-joined. ``strict`` excludes equal times. Adds ``out`` and ``out_time``.
    ``right`` must be unique on (key, time). A probe without key or time keeps its row
    and finds nothing.
    """
    back = direction == "backward"
    r = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(1).alias("_src"),
                     F.col(right_time).alias("_vt"), F.col(value).alias("_v"))
    lcols = [c for c in left.columns if c != key]
    r = r.withColumns({c: F.lit(None).cast(left.schema[c].dataType) for c in lcols})
    types = dict(r.dtypes)
    u = left.withColumns({"_t": F.col(left_time).cast(types["_t"]), "_src": F.lit(0),
                          "_vt": F.lit(None).cast(types["_vt"]),
                          "_v": F.lit(None).cast(types["_v"])}).unionByName(r)
    u = u.withColumn("_blk", F.date_trunc(block, "_t"))
    # at equal times: rows before probes, or after them when strict
    tie = F.col("_src").asc() if strict else F.col("_src").desc()
    time = F.col("_t").asc() if back else F.col("_t").desc()
    blk = F.col("_blk").asc() if back else F.col("_blk").desc()
    inner = Window.partitionBy(key, "_blk").orderBy(time, tie).rowsBetween(
        Window.unboundedPreceding, 0)
    edge = F.max_by if back else F.min_by
    ends = u.groupBy(key, "_blk").agg(
        (F.max if back else F.min)("_vt").alias("_et"),
        edge("_v", "_vt").alias("_ev"))
    over = Window.partitionBy(key).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    # carry time and value of one and the same row: both from the last block with any
    ends = ends.select(key, "_blk",
                       F.last(F.when(F.col("_et").isNotNull(), F.struct("_et", "_ev")), True)
                       .over(over).alias("_c"))
    scan = u.withColumns({"_lt": F.last("_vt", True).over(inner),
                          "_lv": F.last(F.when(F.col("_src") == 1, F.struct("_v")), True).over(inner)})
    ends = ends.select(F.col(key).alias("_key2"), F.col("_blk").alias("_blk2"), "_c")
    joined = scan.filter("_src = 0").join(
        ends, F.col(key).eqNullSafe(F.col("_key2")) & F.col("_blk").eqNullSafe(F.col("_blk2")))
    local, known = F.col("_lt").isNotNull(), F.col(key).isNotNull() & F.col("_t").isNotNull()
    return joined.select(
        key, *lcols,
        F.when(known, F.when(local, F.col("_lt")).otherwise(F.col("_c._et"))).alias(f"{out}_time"),
        F.when(known, F.when(local, F.col("_lv._v")).otherwise(F.col("_c._ev"))).alias(out))
