"""Scans, bars and reshapes."""

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..sources import bars as B
from ..sources.store import build_panel
from .registry import query
from .sqltext import BARS, EVENTS, PANEL


@query("bars_daily", "A12", f"WITH {BARS} SELECT * FROM bars")
def bars_daily(spark, sf):
    return B.bars(spark, sf)


@query("panel_signals", "A1", f"WITH {PANEL} SELECT instrument, date, s FROM panel")
def panel_signals(spark, sf):
    return build_panel(spark, sf).select("instrument", "date", "s")


@query("bars_time", "A12", f"""WITH {EVENTS}
SELECT instrument, date_trunc('hour', ts) AS bar_ts, arg_min(px, row(ts, event_id)) AS open, max(px) AS high,
  min(px) AS low, arg_max(px, row(ts, event_id)) AS close, round(sum(px), 4) AS volume, count(*) AS n_ticks
FROM ev GROUP BY 1, 2""")
def bars_time(spark, sf):
    return B.time_bars(B.events(spark, sf)).withColumn("volume", rnd("volume", 4))


def activity_sql(amount, size):
    return f"""WITH {EVENTS}, t AS (SELECT *, CAST({amount} AS BIGINT) AS amt FROM ev),
cum AS (SELECT *, sum(amt) OVER (PARTITION BY instrument ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - amt AS before FROM t)
SELECT instrument, CAST(before // {size} AS BIGINT) AS bar_id, min(ts) AS ts_open,
  max(ts) AS ts_close, arg_min(px, row(ts, event_id)) AS open, max(px) AS high, min(px) AS low,
  arg_max(px, row(ts, event_id)) AS close, CAST(sum(amt) AS BIGINT) AS amount, count(*) AS n_ticks
FROM cum GROUP BY 1, 2"""


@query("bars_volume", "A12", activity_sql("event_id % 10 + 1", 200))
def bars_volume(spark, sf):
    return B.activity_bars(B.events(spark, sf), F.col("event_id") % 10 + 1, 200)


@query("bars_dollar", "A12", activity_sql("round(px * 100)", 50000))
def bars_dollar(spark, sf):
    return B.activity_bars(B.events(spark, sf), F.round(F.col("px") * 100), 50000)
