"""Streaming queries run over the events table with an available-now trigger.

Append mode emits a window once the watermark passes its end, so the twins keep
the windows that end no later than the last tick minus the lateness bound.
"""

import uuid

from pyspark.sql import functions as F

from ..sources.store import shared_dir
from ..streaming import live as Z, timed
from .registry import query
from .sqltext import EVENTS


def run(spark, stream):
    return Z.run_to_table(stream, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")


def bars_sql(starts, size):
    return f"""WITH {EVENTS}, w AS (SELECT instrument, ts, px, {starts} AS bar_ts FROM ev),
b AS (SELECT instrument, bar_ts, bar_ts + INTERVAL {size} AS bar_end, arg_min(px, ts) AS open, max(px) AS high,
  min(px) AS low, arg_max(px, ts) AS close, count(*) AS n_ticks FROM w GROUP BY 1, 2)
SELECT * FROM b WHERE bar_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ev)"""


@query("stream_tumbling_bars", "Z1", bars_sql("date_trunc('hour', ts)", "1 HOUR"))
def stream_tumbling_bars(spark, sf):
    return run(spark, Z.window_bars(Z.tick_stream(spark, sf)))


@query("stream_sliding_bars", "Z1", bars_sql(
    "date_trunc('hour', ts) - to_hours(unnest([0, 1]))", "2 HOUR"))
def stream_sliding_bars(spark, sf):
    return run(spark, Z.window_bars(Z.tick_stream(spark, sf), "2 hours", "1 hour"))


@query("stream_session_bars", "Z2", f"""WITH {EVENTS}, g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL
  THEN 1 ELSE 0 END AS st FROM ev WINDOW w AS (PARTITION BY instrument ORDER BY ts)),
s AS (SELECT *, sum(st) OVER (PARTITION BY instrument ORDER BY ts) AS sid FROM g),
b AS (SELECT instrument, min(ts) AS bar_ts, max(ts) + INTERVAL 30 MINUTE AS bar_end, arg_min(px, ts) AS open, max(px) AS high,
  min(px) AS low, arg_max(px, ts) AS close, count(*) AS n_ticks FROM s GROUP BY instrument, sid)
SELECT * FROM b WHERE bar_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ev)""")
def stream_session_bars(spark, sf):
    return run(spark, Z.session_bars(Z.tick_stream(spark, sf)))


@query("stream_unique_ticks", "Z5", f"WITH {EVENTS} SELECT DISTINCT instrument, ts, event_id, px FROM ev")
def stream_unique_ticks(spark, sf):
    ticks = Z.tick_stream(spark, sf)
    return run(spark, Z.unique_ticks(ticks.union(ticks)))


CLOSED = """hb AS (SELECT * FROM (SELECT instrument, date_trunc('hour', ts) AS bar_ts, arg_max(px, ts) AS close
  FROM ev GROUP BY 1, 2) WHERE bar_ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ev))"""
CUS = """d0 AS (SELECT instrument, bar_ts, row_number() OVER w AS k, coalesce(close - lag(close) OVER w, 0) AS d FROM hb
  WINDOW w AS (PARTITION BY instrument ORDER BY bar_ts)),
cu AS (SELECT instrument, bar_ts, k, 0.0::DOUBLE AS sp, 0.0::DOUBLE AS sn, 0 AS side FROM d0 WHERE k = 1
  UNION ALL SELECT n.instrument, n.bar_ts, n.k,
    CASE WHEN NOT least(0.0, sn + d) < -60 AND greatest(0.0, sp + d) > 60 THEN 0.0 ELSE greatest(0.0, sp + d) END,
    CASE WHEN least(0.0, sn + d) < -60 THEN 0.0 ELSE least(0.0, sn + d) END,
    CASE WHEN least(0.0, sn + d) < -60 THEN -1 WHEN greatest(0.0, sp + d) > 60 THEN 1 ELSE 0 END
  FROM cu c JOIN d0 n ON n.instrument = c.instrument AND n.k = c.k + 1)"""


def closed_bars(spark, sf):
    """A stream over the table of closed bars that a first stream writes: stateful
    operators are chained through a table."""
    root = f"{shared_dir(spark)}/bars-{uuid.uuid4().hex}"
    bars = Z.run_to_table(Z.window_bars(Z.tick_stream(spark, sf)), root)
    return spark.readStream.schema(bars.schema).parquet(f"{root}/data")


@query("stream_cusum", "Z3 L5", f"WITH RECURSIVE {EVENTS}, {CLOSED}, {CUS} SELECT instrument, bar_ts, side FROM cu WHERE side <> 0")
def stream_cusum(spark, sf):
    return run(spark, Z.cusum_stream(closed_bars(spark, sf), 60.0))


@query("stream_run_state", "Z3 F5b", f"""WITH {EVENTS}, {CLOSED}, sg AS (SELECT instrument, bar_ts, CASE WHEN close > 50 THEN 1 ELSE -1 END AS s FROM hb),
c AS (SELECT *, sum(chg) OVER (PARTITION BY instrument ORDER BY bar_ts) AS run FROM (SELECT *, CASE WHEN s = lag(s) OVER
  (PARTITION BY instrument ORDER BY bar_ts) THEN 0 ELSE 1 END AS chg FROM sg)),
n AS (SELECT *, row_number() OVER (PARTITION BY instrument, run ORDER BY bar_ts) AS run_length FROM c)
SELECT instrument, bar_ts, s, run_length, run_length - 1 AS since_flip FROM n""")
def stream_run_state(spark, sf):
    bars = closed_bars(spark, sf)
    sig = bars.select("instrument", "bar_ts", F.when(F.col("close") > 50, 1).otherwise(-1).alias("s"))
    return run(spark, Z.run_state_stream(sig))


@query("stream_asof_enrich", "Z4", f"""WITH {EVENTS}, lv AS (SELECT instrument, date_trunc('day', ts) + INTERVAL 1 DAY AS available, max(px) AS level
  FROM ev GROUP BY 1, 2)
SELECT e.instrument, e.ts, e.event_id, e.px, l.available, l.level FROM ev e
ASOF LEFT JOIN lv l ON l.instrument = e.instrument AND e.ts >= l.available""")
def stream_asof_enrich(spark, sf):
    from ..sources.bars import events
    day = F.date_trunc("day", "ts").cast("timestamp") + F.expr("INTERVAL 1 DAY")
    levels = (events(spark, sf).groupBy("instrument", day.alias("available"))
              .agg(F.max("px").alias("level")))
    folder = f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}"
    levels.write.parquet(folder)
    return Z.enrich_to_table(Z.tick_stream(spark, sf), spark.read.parquet(folder),
                             f"{shared_dir(spark)}/enriched-{uuid.uuid4().hex}")


# Timers fold what the watermark has passed: bars of an hourly grid up to 150 minutes before the last.
LATE = "150 minutes"
PASSED = "bar_ts <= (SELECT max(bar_ts) - INTERVAL 150 MINUTE FROM hb)"


def run_timed(spark, stream):
    return timed.run_to_table(stream, f"{shared_dir(spark)}/timed-{uuid.uuid4().hex}")


@query("stream_cusum_timers", "Z3 L5", f"""WITH RECURSIVE {EVENTS}, {CLOSED}, {CUS}
SELECT instrument, bar_ts, side FROM cu WHERE side <> 0 AND {PASSED}""")
def stream_cusum_timers(spark, sf):
    return run_timed(spark, timed.cusum(closed_bars(spark, sf), 60.0, LATE))


@query("stream_run_state_timers", "Z3 F5b", f"""WITH {EVENTS}, {CLOSED},
sg AS (SELECT instrument, bar_ts, CASE WHEN close > 50 THEN 1 ELSE -1 END AS s FROM hb),
c AS (SELECT *, sum(chg) OVER (PARTITION BY instrument ORDER BY bar_ts) AS run FROM (SELECT *, CASE WHEN s = lag(s) OVER
  (PARTITION BY instrument ORDER BY bar_ts) THEN 0 ELSE 1 END AS chg FROM sg)),
n AS (SELECT *, row_number() OVER (PARTITION BY instrument, run ORDER BY bar_ts) AS run_length FROM c)
SELECT instrument, bar_ts, s, run_length, run_length - 1 AS since_flip FROM n WHERE {PASSED}""")
def stream_run_state_timers(spark, sf):
    bars = closed_bars(spark, sf)
    sig = bars.select("instrument", "bar_ts", F.when(F.col("close") > 50, 1).otherwise(-1).alias("s"))
    return run_timed(spark, timed.run_state(sig, LATE))


@query("stream_asof_two_streams", "Z4", f"""WITH {EVENTS}, lv AS (SELECT instrument, date_trunc('day', ts) + INTERVAL 1 DAY AS available, max(px) AS level
  FROM ev GROUP BY 1, 2)
SELECT e.instrument, e.ts, e.event_id, e.px, l.available, l.level FROM ev e
ASOF LEFT JOIN lv l ON l.instrument = e.instrument AND e.ts >= l.available
WHERE e.ts <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM ev)""")
def stream_asof_two_streams(spark, sf):
    from ..sources.bars import events
    day = F.date_trunc("day", "ts").cast("timestamp") + F.expr("INTERVAL 1 DAY")
    levels = events(spark, sf).groupBy("instrument", day.alias("available")).agg(F.max("px").alias("level"))
    folder = f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}"
    levels.write.parquet(folder)
    arriving = spark.readStream.schema(levels.schema).parquet(folder)
    return run_timed(spark, timed.enriched(Z.tick_stream(spark, sf), arriving, "10 minutes"))
