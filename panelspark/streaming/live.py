"""Structured Streaming forms of the trailing operators.

The batch library has no stream; these are the same definitions on unbounded
input, with a lateness bound, tested by equality with the batch results.
"""

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.joins import asof
from ..sources.bars import event_order


DELAY = "10 minutes"


def tick_stream(spark: SparkSession, folder: str, glob="events*.parquet", files_per_trigger=None) -> DataFrame:
    """Ticks (instrument, ts, event_id, px) read from files as they arrive."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.parquet(folder)
    return raw.select(F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"),
                      "event_id", F.col("value").alias("px"))


def ohlc():
    first = event_order()
    return [F.min_by("px", first).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
            F.max_by("px", first).alias("close"), F.count("*").alias("n_ticks")]


def window_bars(stream: DataFrame, size="1 hour", slide=None, delay=DELAY) -> DataFrame:
    """Tumbling or sliding OHLC bars; partial aggregates, state bounded by the watermark."""
    win = F.window("ts", size, slide) if slide else F.window("ts", size)
    bars = stream.withWatermark("ts", delay).groupBy("instrument", win.alias("w")).agg(*ohlc())
    return bars.select("instrument", F.col("w.start").alias("bar_ts"), F.col("w.end").alias("bar_end"),
                       "open", "high", "low", "close", "n_ticks")


def session_bars(stream: DataFrame, gap="30 minutes", delay=DELAY) -> DataFrame:
    """Bars per activity session."""
    s = stream.withWatermark("ts", delay).groupBy("instrument", F.session_window("ts", gap).alias("w"))
    return s.agg(*ohlc()).select("instrument", F.col("w.start").alias("bar_ts"),
                                 F.col("w.end").alias("bar_end"), "open", "high", "low", "close", "n_ticks")


def unique_ticks(stream: DataFrame, delay=DELAY) -> DataFrame:
    """Drop re-sent ticks within the lateness bound."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def in_order(batches, time) -> pd.DataFrame:
    """One trigger's bars of one key in time order. A bar grid is unique on (key,
    time unit), so this holds as many rows as time units in the trigger."""
    return pd.concat(list(batches)).sort_values(time)


def cusum_stream(bars: DataFrame, h: float) -> DataFrame:
    """Z3: the CUSUM filter on closed bars as keyed state (last close, both sums).

    Bars of a key must arrive in time order over triggers; windows closed by a
    watermark do.
    """
    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, pos, neg = state.get if state.exists else (None, 0.0, 0.0)
        pdf, side = in_order(batches, "bar_ts"), []
        for px in pdf["close"].to_numpy():
            d = 0.0 if last is None else px - last
            last, pos, neg = float(px), max(0.0, pos + d), min(0.0, neg + d)
            hit = -1 if neg < -h else (1 if pos > h else 0)
            pos, neg = (0.0 if hit > 0 else pos), (0.0 if hit < 0 else neg)
            side.append(hit)
        state.update((last, pos, neg))
        pdf["side"] = side
        yield pdf.loc[pdf["side"] != 0, ["instrument", "bar_ts", "side"]]

    return bars.select("instrument", "bar_ts", "close").groupBy("instrument").applyInPandasWithState(
        update, "instrument string, bar_ts timestamp, side int", "last double, pos double, neg double",
        "append", GroupStateTimeout.NoTimeout)


def run_state_stream(signals: DataFrame) -> DataFrame:
    """Z3: live run length and bars since the last flip of (instrument, bar_ts, s)."""
    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        prev, n = state.get if state.exists else (None, 0)
        pdf, out = in_order(batches, "bar_ts"), []
        for s in pdf["s"].to_numpy():
            n = n + 1 if prev is not None and s == prev else 1
            prev = int(s)
            out.append(n)
        state.update((prev, n))
        pdf["run_length"] = out
        pdf["since_flip"] = pdf["run_length"] - 1
        yield pdf[["instrument", "bar_ts", "s", "run_length", "since_flip"]]

    return signals.groupBy("instrument").applyInPandasWithState(
        update, "instrument string, bar_ts timestamp, s int, run_length long, since_flip long",
        "prev int, n long", "append", GroupStateTimeout.NoTimeout)


def enrich_to_table(stream: DataFrame, levels: DataFrame, root: str) -> DataFrame:
    """Every tick once, with the latest level available at its time.

    Each trigger joins its ticks as-of against the table of levels as it stands then, by
    the batch operator, and writes a folder of its own, so a repeated trigger overwrites
    what it wrote before. Levels must be written before the ticks that may see them.
    """
    def write(batch: DataFrame, number: int) -> None:
        out = asof(batch, levels, "instrument", "ts", "available", "level", "level", block="day")
        out.withColumnRenamed("level_time", "available").write.mode("overwrite").parquet(f"{root}/data/trigger={number}")

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return levels.sparkSession.read.parquet(f"{root}/data").drop("trigger")


def run_to_table(stream: DataFrame, root: str, mode="append") -> DataFrame:
    """Process everything available now into a parquet table and read it back."""
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/data")
         .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/data")


