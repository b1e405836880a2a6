"""Streams fed by several files equal the batch result."""

import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelspark.operators import labels
from panelspark.sources import bars as B
from panelspark.streaming import live, timed


def test_files_in_order_equal_batch(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").toPandas()
    folder = tmp_path / "in"
    folder.mkdir()
    for i, part in enumerate(np.array_split(np.arange(len(ev)), 4)):
        spark.createDataFrame(ev.iloc[part]).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        src = next((tmp_path / f"w{i}").glob("part*.parquet"))
        (folder / f"events{i}.parquet").write_bytes(src.read_bytes())
        os.utime(folder / f"events{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    s = live.tick_stream(spark, str(folder), files_per_trigger=1)
    root = str(tmp_path / "bars")
    got = live.run_to_table(live.window_bars(s), root)
    batch = B.time_bars(B.events(spark, sf)).withColumn("bar_ts", F.col("bar_ts").cast("timestamp"))
    last = pd.Timestamp(ev.ts.max()) - pd.Timedelta(minutes=70)
    want = batch.filter(F.col("bar_ts") <= F.lit(last).cast("timestamp")).select(
        "instrument", "bar_ts", "open", "high", "low", "close", "n_ticks")
    assert got.count() > 10
    assert got.drop("bar_end").select(*want.columns).exceptAll(want).isEmpty() and got.count() == want.count()
    # the CUSUM state carried over triggers equals the batch filter on the same bars
    pdf = got.orderBy("bar_ts").toPandas()
    closed = tmp_path / "closed"
    closed.mkdir()
    for i, days in enumerate(np.array_split(pdf.bar_ts.unique(), 3)):
        spark.createDataFrame(pdf[pdf.bar_ts.isin(days)]).coalesce(1).write.parquet(str(tmp_path / f"c{i}"))
        src = next((tmp_path / f"c{i}").glob("part*.parquet"))
        (closed / f"bars{i}.parquet").write_bytes(src.read_bytes())
        os.utime(closed / f"bars{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    bars = spark.readStream.schema(got.schema).option("maxFilesPerTrigger", 1).parquet(str(closed))
    cus = live.run_to_table(live.cusum_stream(bars, 60.0), str(tmp_path / "cus"))
    ref = labels.cusum_events(got, "close", 60.0).select(*cus.columns)
    assert cus.count() == ref.count() and cus.exceptAll(ref).isEmpty()


def arrivals(spark, pdf, schema, parts, folder):
    """A stream of one file per trigger: ``parts`` are the row places of each."""
    folder.mkdir()
    for i, rows in enumerate(parts):
        spark.createDataFrame(pdf.iloc[rows], schema).coalesce(1).write.parquet(str(folder.parent / f"{folder.name}-{i}"))
        src = next((folder.parent / f"{folder.name}-{i}").glob("part*.parquet"))
        (folder / f"part{i}.parquet").write_bytes(src.read_bytes())
        os.utime(folder / f"part{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def hourly(n, seed):
    rng = np.random.default_rng(seed)
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "h")
    return pd.DataFrame([(k, t, float(x)) for k in ("a", "b") for t, x in zip(at, np.cumsum(rng.normal(0, 20, n)))],
                        columns=["instrument", "bar_ts", "close"]).sort_values("bar_ts", kind="stable", ignore_index=True)


def test_bars_out_of_order_equal_batch(spark, tmp_path):
    """Bars swapped over triggers, within the lateness bound, fold as if they had come in order."""
    pdf, schema = hourly(60, 1), "instrument string, bar_ts timestamp, close double"
    rng = np.random.default_rng(2)
    # a row comes up to five hours late: its place in the arrivals is its hour and a random delay
    order = np.argsort(pdf.index.to_numpy() // 2 + rng.integers(0, 6, len(pdf)), kind="stable")
    parts = np.array_split(order, 6)
    assert any(pdf.bar_ts.iloc[p].max() > pdf.bar_ts.iloc[q].min() for p, q in zip(parts, parts[1:]))
    closed = pdf.bar_ts.max() - pd.Timedelta("630min")
    stream = arrivals(spark, pdf, schema, parts, tmp_path / "bars")
    got = timed.run_to_table(timed.cusum(stream, 60.0, "630 minutes"), str(tmp_path / "cusum"))
    whole = spark.createDataFrame(pdf, schema)
    want = labels.cusum_events(whole, "close", 60.0).select(*got.columns).filter(F.col("bar_ts") <= F.lit(closed))
    assert want.count() > 5 and sorted(got.collect()) == sorted(want.collect())

    runs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "bars"))
    signal = runs.select("instrument", "bar_ts", F.when(F.col("close") > 0, 1).otherwise(-1).alias("s"))
    got = timed.run_to_table(timed.run_state(signal, "630 minutes"), str(tmp_path / "runs")).collect()
    want = []
    for k, g in pdf.groupby("instrument"):
        before, n = None, 0
        for t, x in zip(g.bar_ts, g.close):
            s = 1 if x > 0 else -1
            n = n + 1 if s == before else 1
            before = s
            if t <= closed:
                want.append((k, t.to_pydatetime(), s, n, n - 1))
    assert sorted(map(tuple, got)) == sorted(want)


def test_late_rows_are_dropped(spark, tmp_path):
    pdf = hourly(12, 3)
    pdf = pdf[pdf.instrument == "a"].reset_index(drop=True)
    schema = "instrument string, bar_ts timestamp, close double"
    parts = [[0, 1, 3, 4, 5], [6, 7, 8], [2, 9, 10, 11]]     # row 2 comes after the watermark passed it
    stream = arrivals(spark, pdf, schema, parts, tmp_path / "late")
    signal = stream.select("instrument", "bar_ts", F.lit(1).alias("s"))
    got = timed.run_to_table(timed.run_state(signal, "90 minutes"), str(tmp_path / "out"))
    hours = [r.bar_ts.hour for r in got.orderBy("bar_ts").collect()]
    assert hours == [0, 1, 3, 4, 5, 6, 7, 8, 9]
    assert [r.run_length for r in got.orderBy("bar_ts").collect()] == list(range(1, 10))


def test_levels_of_the_same_run_are_seen(spark, tmp_path):
    """Ticks that come before the levels they may see, in earlier triggers, wait for them."""
    ticks = hourly(48, 4).rename(columns={"bar_ts": "ts", "close": "px"})
    ticks["event_id"] = np.arange(len(ticks))
    tick_schema = "instrument string, ts timestamp, px double, event_id long"
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta([0, 5, 17, 17, 30, 47], "h")
    levels = pd.DataFrame({"instrument": list("abaabb"), "available": at, "level": [1.0, 2.0, 3.0, None, 5.0, 6.0]})
    levels = levels.drop(index=2).reset_index(drop=True)        # unique on (instrument, available)
    level_schema = "instrument string, available timestamp, level double"
    t = arrivals(spark, ticks, tick_schema, np.array_split(np.arange(len(ticks)), 3), tmp_path / "ticks")
    v = arrivals(spark, levels, level_schema, [[0], [1], [2], [3, 4]], tmp_path / "levels")
    got = timed.run_to_table(timed.enriched(t, v, "30 minutes"), str(tmp_path / "out")).collect()
    want = []
    for r in ticks.itertuples():
        if r.ts > pd.Timestamp("2024-01-02 23:00") - pd.Timedelta("30min"):
            continue
        seen = levels[(levels.instrument == r.instrument) & (levels.available <= r.ts)]
        last = seen.iloc[-1] if len(seen) else None
        want.append((r.event_id, None if last is None else last.available.to_pydatetime(),
                     None if last is None or pd.isna(last.level) else last.level))
    assert sorted((r.event_id, r.available, r.level) for r in got) == sorted(want)


class Kept(dict):
    """Map, list and value state of one key in plain Python."""

    keep = None
    updateValue, getValue, removeKey = dict.__setitem__, dict.__getitem__, dict.__delitem__

    def appendValue(self, value):
        self.keep = (self.keep or []) + [value]

    def put(self, values):
        self.keep = values

    def exists(self):
        return self.keep is not None or bool(len(self))

    def get(self):
        return self.keep

    def update(self, value):
        self.keep = value


class Handle:
    def __init__(self):
        self.timers = []

    getMapState = getListState = getValueState = lambda self, *schema: Kept()

    def registerTimer(self, ms):
        self.timers.append(ms)


class Mark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_one_trigger_with_all_rows_of_a_key_is_folded_in_parts(monkeypatch):
    """However many rows a trigger brings, a fold takes about HOLD of them, all in order of time."""
    monkeypatch.setattr(timed, "HOLD", 100, raising=False)
    rng, n, sizes = np.random.default_rng(2), 5_000, []
    us = rng.integers(1, 20 * 24 * 3_600_000_000, n)
    rows = pd.DataFrame({"us": us, "v": np.arange(n)})

    def step(state, part):
        sizes.append(len(part))
        return ((state or (0,))[0] + len(part),), part

    p = timed.InOrder(step, "n long")
    handle = Handle()
    p.init(handle)
    assert list(p.handleInputRows(None, iter([rows[i:i + 64] for i in range(0, n, 64)]), Mark(0))) == []
    marks, got = [int(np.sort(us)[k] // timed.MS) for k in (1_234, n - 20)], []
    for ms in marks:
        got += list(p.handleExpiredTimer(None, Mark(ms), None))
        assert handle.timers[-1] > ms
    out, want = pd.concat(got, ignore_index=True), rows[us <= marks[1] * timed.MS].sort_values("us", ignore_index=True)
    pd.testing.assert_frame_equal(out, want)
    assert p.state.get() == (len(want),) and max(sizes) < 300
