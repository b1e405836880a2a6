"""Keyed state that folds rows in event-time order, whatever the order they arrive in.

A key's rows wait in RocksDB state until the watermark passes their time; an event-time
timer then folds those that are closed, in time order, into a small state of the key. So
triggers may deliver rows out of order by up to the lateness bound, and the result is the
batch result on all rows that came within it. What waits is kept as Arrow chunks per key and
quarter day, written whenever ``HOLD`` rows of a trigger have come, and folded as many
quarters at a time as make ``HOLD`` rows: state grows with the lateness bound and not with the
stream's length, and a worker holds about ``HOLD`` rows and those of one key's quarter day,
however many a trigger brings.

Rows at or before the watermark are late and dropped; rows after the last watermark wait.
"""

from typing import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MS = 1000       # microseconds
QUARTER = 6 * 3_600_000_000
HOLD = 200_000  # rows


def packed(rows: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class InOrder(StatefulProcessor):
    """Rows with a column ``us`` (microseconds), folded by ``step`` in order of ``order``.

    ``step(state, rows)`` takes the key's state (a tuple, or None at first) and its newly closed
    rows in order, and returns the new state and the rows to emit.
    """

    def __init__(self, step, state: str, order=("us",)):
        self.step, self.schema, self.order = step, state, list(order)

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "quarter bigint, lo bigint, part bigint", "rows binary")
        self.state = handle.getValueState("folded", self.schema)

    def hold(self, rows: pd.DataFrame, part: int) -> None:
        """Keeps rows by quarter day; the key tells the first watermark that closes one of them."""
        rows = rows.sort_values("us", ignore_index=True)
        quarters = rows["us"] // QUARTER
        starts = [0, *(quarters.index[quarters.ne(quarters.shift())][1:]), len(rows)]
        for a, b in zip(starts, starts[1:]):
            piece = rows.iloc[a:b]
            self.held.updateValue((int(quarters.iloc[a]), first_ms(piece), part), (packed(piece),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, part = timerValues.getCurrentWatermarkInMs() * MS, max((k[2] for k in self.held.keys()), default=0)
        waiting, n, first = [], 0, None
        for pdf in rows:
            pdf = pdf[pdf["us"] > mark]
            if not len(pdf):
                continue
            first = first_ms(pdf) if first is None else min(first, first_ms(pdf))
            waiting.append(pdf)
            n += len(pdf)
            if n >= HOLD:
                part += 1
                self.hold(pd.concat(waiting, ignore_index=True), part)
                waiting, n = [], 0
        if n:
            self.hold(pd.concat(waiting, ignore_index=True), part + 1)
        if first is not None:
            self.handle.registerTimer(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        keys = sorted(tuple(k) for k in self.held.keys())
        due, rest = [k for k in keys if k[1] <= mark], [k[1] for k in keys if k[1] > mark]
        if not due:
            return      # another timer of this key was here before
        state = self.state.get() if self.state.exists() else None
        closed, n = [], 0
        for i, k in enumerate(due, 1):
            chunk = unpacked(self.held.getValue(k)[0])
            self.held.removeKey(k)
            now = chunk["us"] <= mark * MS
            if not now.all():
                self.hold(chunk[~now], k[2])
                rest.append(first_ms(chunk[~now]))
            closed.append(chunk[now])
            n += len(closed[-1])
            last = i == len(due)
            if last or n >= HOLD and due[i][0] != k[0]:
                pdf = pd.concat(closed, ignore_index=True).sort_values(self.order, ignore_index=True)
                closed, n = [], 0
                state, out = self.step(state, pdf)
                if len(out):
                    yield out
        self.state.update(state)
        if rest:
            self.handle.registerTimer(min(rest))

    def close(self) -> None:
        pass


def first_ms(rows: pd.DataFrame) -> int:
    """Least watermark (in ms) that closes a row of these."""
    return int(-(-int(rows["us"].min()) // MS))


def in_order(stream: DataFrame, key: str, time: str, step, state: str, out: str, order=("us",)) -> DataFrame:
    """``stream`` has a watermark on ``time``; ``out`` is the schema that ``step`` emits."""
    return stream.withColumn("us", F.unix_micros(time)).groupBy(key).transformWithStateInPandas(
        InOrder(step, state, order), out, "append", "eventTime")


def cusum(bars: DataFrame, h: float, delay: str) -> DataFrame:
    """Z3: the CUSUM filter on bars (instrument, bar_ts, close) that may come late by ``delay``."""
    def step(state, rows):
        last, pos, neg = state or (None, 0.0, 0.0)
        sides = []
        for px in rows["close"].tolist():
            d = 0.0 if last is None else px - last
            last, pos, neg = px, max(0.0, pos + d), min(0.0, neg + d)
            side = -1 if neg < -h else int(pos > h)
            pos, neg = (0.0 if side > 0 else pos), (0.0 if side < 0 else neg)
            sides.append(side)
        rows = rows.assign(side=sides)
        return (last, pos, neg), rows.loc[rows["side"] != 0, ["instrument", "us", "side"]]

    d = bars.select("instrument", "bar_ts", "close").withWatermark("bar_ts", delay)
    d = in_order(d, "instrument", "bar_ts", step, "last double, pos double, neg double", "instrument string, us long, side int")
    return d.select("instrument", F.timestamp_micros("us").alias("bar_ts"), "side")


def run_state(signals: DataFrame, delay: str) -> DataFrame:
    """Z3: live run length and bars since the last flip of (instrument, bar_ts, s), rows late by ``delay``."""
    def step(state, rows):
        before, length = state or (None, 0)
        # a run starts where the value changes; the first may go on from the state
        starts = rows["s"].ne(rows["s"].shift())
        run = rows.groupby(starts.cumsum()).cumcount() + 1
        if rows["s"].iloc[0] == before:
            run = run.where(starts.cumsum() > 1, run + length)
        rows = rows.assign(run_length=run, since_flip=run - 1)
        return ((int(rows["s"].iloc[-1]), int(run.iloc[-1])),
                rows[["instrument", "us", "s", "run_length", "since_flip"]])

    d = in_order(signals.withWatermark("bar_ts", delay), "instrument", "bar_ts", step, "s int, n long",
                 "instrument string, us long, s int, run_length long, since_flip long")
    return d.select("instrument", F.timestamp_micros("us").alias("bar_ts"), "s", "run_length", "since_flip")


def enriched(ticks: DataFrame, levels: DataFrame, delay: str) -> DataFrame:
    """Every tick with the latest level available at its time; both sides are streams.

    Ticks are (instrument, ts, event_id, px), levels (instrument, available, level). The
    watermark is the lesser of the two sides', so a tick waits until the levels it may see
    have arrived, in the same trigger or in a later one.
    """
    def step(state, rows):
        # levels sort before ticks of the same time; a tick keeps the last level so far
        level, at = rows["level"].where(rows["kind"] == 0), rows["us"].astype("Int64").where(rows["kind"] == 0)
        seen, last = (rows["kind"] == 0).cumsum(), state or (None, None)
        pick = seen.where(seen > 0).map(dict(enumerate(zip(at[rows["kind"] == 0], level[rows["kind"] == 0]), 1)))
        got = [last if not isinstance(p, tuple) else (int(p[0]), None if pd.isna(p[1]) else float(p[1])) for p in pick]
        out = rows.assign(at=pd.array([g[0] for g in got], "Int64"), level=pd.array([g[1] for g in got], "Float64"))
        return got[-1], out.loc[out["kind"] == 1, ["instrument", "us", "event_id", "px", "at", "level"]]

    kind = dict(ticks.dtypes)["event_id"]
    t = ticks.withWatermark("ts", delay).select("instrument", "ts", F.lit(1).alias("kind"), "event_id", "px",
                                                F.lit(None).cast("double").alias("level"))
    v = levels.withWatermark("available", delay).select(
        "instrument", F.col("available").alias("ts"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("event_id"),
        F.lit(None).cast("double").alias("px"), F.col("level").cast("double").alias("level"))
    d = in_order(t.union(v), "instrument", "ts", step, "at long, level double",
                 f"instrument string, us long, event_id {kind}, px double, at long, level double", ("us", "kind", "event_id"))
    return d.select("instrument", F.timestamp_micros("us").alias("ts"), "event_id", "px",
                    F.timestamp_micros("at").alias("available"), "level")


def run_to_table(stream: DataFrame, root: str) -> DataFrame:
    """Processes what is available now with state in RocksDB, into a table that is read back."""
    from . import live
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKS)
    try:
        return live.run_to_table(stream, root)
    finally:
        conf.set(name, before)
