"""trailing structure of the primary signal ``s`` in {-1, 0, 1}."""

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import xlogx
from ..functions.windows import (KEY, ORDER, lag, log_return, ordered, rsum, running, sma,
                                 strict, trailing, with_runs)


def flips(s="s"):
    """1 where the value changed, NULL on the first row; NULL differs from all."""
    w = ordered()
    same = F.col(s) == F.lag(s).over(w)
    return F.when(F.row_number().over(w) > 1, F.when(same, 0.0).otherwise(1.0))


def signal_features(df: DataFrame, mr_score=None) -> DataFrame:
    """``df`` has instrument, date, s, close and optionally a counter-trend score."""
    df = with_runs(df, "s")
    w = ordered()
    df = df.withColumns({"_pos": F.row_number().over(w), "_r": log_return(),
                         "_s": F.col("s").cast("double"), "_flip": flips()})
    w20 = trailing(20)

    def share(v):
        return F.count_if(F.col("s") == v).over(w20) / F.lit(20.0)

    entropy = -(xlogx(share(-1)) + xlogx(share(0)) + xlogx(share(1)))
    last_active = F.last(F.when(F.col("s") != 0, F.col("_pos")), True).over(running())
    out = df.withColumns({
        "f5_signal": F.col("_s"), "f5_abs_signal": F.abs("_s"),
        "f5_trailing_run_length": F.col("run_length").cast("double"),
        "f5_days_since_flip": (F.col("run_length") - 1).cast("double"),
        "f5_days_since_nonzero": (F.col("_pos") - last_active).cast("double"),
        "f5_participation_20": sma(F.abs("_s"), 20),
        "f5_participation_60": sma(F.abs("_s"), 60),
        "f5_long_bias_20": sma("_s", 20),
        "f5_signal_entropy_20": F.when(F.count("_s").over(w20) == 20, entropy),
        "f5_flip_rate_60": sma("_flip", 60),
        "signal_cum_pnl_20d": rsum(F.col("_s") * F.col("_r"), 20)})
    if mr_score is not None:
        out = out.withColumn("f5_sign_agree_mr", F.signum("_s") * F.signum(mr_score))
    else:
        out = out.withColumn("f5_sign_agree_mr", F.lit(None).cast("double"))
    return out.select(KEY, ORDER, *[c for c in out.columns if c.startswith("f5_")],
                      "signal_cum_pnl_20d")


def class_balance(df: DataFrame) -> DataFrame:
    """Counts and shares of -1 / 0 / +1 per instrument."""
    n = F.count("s")
    agg = df.groupBy(KEY).agg(
        *[F.count_if(F.col("s") == v).alias(f"n_{k}")
          for k, v in (("short", -1), ("flat", 0), ("long", 1))], n.alias("n"))
    return agg.withColumns({f"{k}_share": F.try_divide(F.col(f"n_{k}"), F.col("n"))
                            for k in ("short", "flat", "long")})


def persistence(df: DataFrame) -> DataFrame:
    """Mean run length by label, flip rate, lag-1 autocorrelation."""
    df = with_runs(df.filter(F.col("s").isNotNull()), "s")
    runs = (df.groupBy(KEY, "run_id").agg(F.max("run_length").alias("len"), F.max("s").alias("s")))
    # the row-weighted mean run length: every row carries the length of its run
    mean_run = runs.groupBy(KEY).agg(*[
        F.try_divide(F.sum(F.when(F.col("s") == v, F.col("len") * F.col("len"))),
                     F.sum(F.when(F.col("s") == v, F.col("len")))).alias(f"mean_run_{k}")
        for k, v in (("short", -1), ("flat", 0), ("long", 1))])
    row = df.withColumns({"_flip": flips(), "_prev": lag("s")})
    rest = row.groupBy(KEY).agg(F.avg("_flip").alias("flip_rate"),
                                F.corr("s", "_prev").alias("lag1_autocorr"))
    return mean_run.join(rest, KEY)


def net_position(df: DataFrame) -> DataFrame:
    """long/short/flat counts and net position per date with a 20-day mean.

    The 20-day mean runs over one row per date, a table bounded by the calendar.
    """
    day = df.groupBy(ORDER).agg(F.count_if(F.col("s") == 1).alias("n_long"),
                                F.count_if(F.col("s") == -1).alias("n_short"),
                                F.count_if(F.col("s") == 0).alias("n_flat"),
                                F.coalesce(F.sum("s"), F.lit(0)).alias("net"))
    day = day.withColumn("_one", F.lit(1))
    return day.withColumn("net_mean_20", strict(F.avg, "net", 20, key="_one")).drop("_one")


def signal_coverage(df: DataFrame) -> DataFrame:
    """Number of instruments with a close on each signal date -> days."""
    day = (df.groupBy(ORDER).agg(F.count("close").alias("n_instruments"),
                                 F.count("s").alias("_s")).filter("_s > 0"))
    return day.groupBy("n_instruments").agg(F.count("*").alias("n_days"))
