"""Bars from ticks, and the derived panels used as inputs everywhere else."""

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.windows import ordered, sma, trailing
from .readers import table

# Calendar and venue assigned to each region of the tick tables.
REGION_VENUES = (
    ("AFRICA", "CMES", "NYMEX"),
    ("AMERICA", "CMES", "COMEX"),
    ("ASIA", "CME_Equity", "CME_EQ"),
    ("EUROPE", "CME_Equity", "CME_EQ"),
    ("MIDDLE EAST", "XEUR", "EUREX"),
)


def region_case(asset_class, index):
    out = F.lit(None).cast("string")
    for row in REGION_VENUES:
        out = F.when(asset_class == row[0], F.lit(row[index])).otherwise(out)
    return out


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instrument dimension: 25 fixed nations, so it may be broadcast."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
            .select("n_nationkey", F.col("n_name").alias("instrument"),
                    F.col("r_name").alias("asset_class"),
                    region_case(F.col("r_name"), 1).alias("calendar"),
                    region_case(F.col("r_name"), 2).alias("venue")))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trade. The supplier side grows with the data, so the join is
    left to Catalyst/AQE (skewed suppliers are split); only the 25-row nation
    dimension is broadcast."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        "l_quantity", "l_linestatus", F.to_date("l_shipdate").alias("date"))
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    dim = F.broadcast(instruments(spark, sf_dir))
    return (li.join(supp, li.l_suppkey == supp.s_suppkey)
            .join(dim, F.col("s_nationkey") == F.col("n_nationkey"))
            .select("instrument", "asset_class", "date",
                    F.col("l_extendedprice").alias("px"), F.col("l_quantity").alias("qty"),
                    "l_linestatus", "l_orderkey", "l_linenumber", "l_partkey"))


# Widths of the order key, checked for every tick: they sum to 38 digits.
ORDER_DIGITS, LINE_DIGITS, PART_DIGITS, PRICE_DIGITS = 13, 2, 12, 11


def tick_order():
    """Total order of ticks as one DECIMAL(38,0): order, line, part, then price.

    A decimal lives in a fixed-width aggregation buffer, so first and last price stay in
    a hash aggregate with map-side combining; a struct key would force a sort of every
    tick. The key only orders: prices are taken from the ticks themselves. Its last
    digits (thousandths around zero, held at the ends of their range) settle ticks that
    share order, line and part. A key part beyond its width stops the query.
    """
    def guarded(name, digits):
        x = F.col(name).cast("decimal(38,0)")
        return F.when(x.between(0, Decimal(10 ** digits - 1)), x).when(x.isNotNull(), F.raise_error(
            F.concat(F.lit(f"{name} is outside 0..10^{digits}: "), x.cast("string"))).cast("decimal(38,0)"))

    half = 5 * 10 ** (PRICE_DIGITS - 1)
    price = F.least(F.greatest(F.floor(F.col("px") * 1000), F.lit(float(-half))), F.lit(float(half - 1)))
    price = (price.cast("decimal(38,0)") + F.lit(Decimal(half))).cast("decimal(38,0)")
    out = guarded("l_orderkey", ORDER_DIGITS)
    for x, digits in ((guarded("l_linenumber", LINE_DIGITS), LINE_DIGITS),
                      (guarded("l_partkey", PART_DIGITS), PART_DIGITS), (price, PRICE_DIGITS)):
        out = (out * F.lit(Decimal(10 ** digits)) + x).cast("decimal(38,0)")
    return out


def daily_bars(tick: DataFrame) -> DataFrame:
    """OHLCV per (instrument, date): one shuffle of partial aggregates."""
    agg = (tick.withColumn("k", tick_order())
           .groupBy("instrument", "asset_class", "date")
           .agg(F.min_by("px", "k").alias("open"), F.max_by("px", "k").alias("close"),
                F.max("px").alias("high"), F.min("px").alias("low"),
                F.sum("qty").alias("volume"),
                F.count_if(F.col("l_linestatus") == "O").alias("oi")))
    return agg.select(
        "instrument", "asset_class", "date", "open", "high", "low", "close", "volume",
        F.when(F.col("oi") > 0, F.col("oi").cast("double")).alias("open_interest"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(ticks(spark, sf_dir))


def add_signal(df: DataFrame) -> DataFrame:
    """Demo primary signal: short above 1.25 x SMA5, long below 0.75 x SMA5."""
    m = sma("close", 5)
    return (df.withColumn("_m", m)
            .withColumn("s", F.when(F.col("_m").isNull(), None)
                        .when(F.col("close") > 1.25 * F.col("_m"), -1)
                        .when(F.col("close") < 0.75 * F.col("_m"), 1).otherwise(0))
            .drop("_m"))


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with planted faults (by row number) and re-sent copies, column ``ord``."""
    df = bars(spark, sf_dir).withColumn("n", F.row_number().over(ordered()))
    n = F.col("n")
    df = df.withColumns({
        "close": F.when(n % 97 != 0, F.col("close")),
        "open": F.when(n % 79 == 0, -F.col("open")).otherwise(F.col("open")),
        "high": F.when(n % 89 == 0, F.col("low") - 1).otherwise(F.col("high")),
        "volume": F.when(n % 83 == 0, 0.0).when(n % 71 == 0, None).otherwise(F.col("volume")),
    })
    copies = F.when(n % 73 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (df.withColumn("ord", F.explode(copies))
            .withColumn("close", F.col("close") + (F.col("ord") - 1))
            .drop("n"))


def macro_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long macro observations (series, release_class, stamp, value) from orders."""
    orders = table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("stamp"), "o_orderpriority", "o_orderstatus",
        "o_totalprice")
    daily = (orders.groupBy(F.col("o_orderpriority").alias("series"), "stamp")
             .agg(F.avg("o_totalprice").alias("value"))
             .withColumn("release_class", F.lit("daily")))
    by_status = (orders.groupBy("o_orderstatus", "stamp")
                 .agg(F.avg("o_totalprice").alias("value")))
    slow = by_status.withColumn("release_class", F.explode(
        F.array(F.lit("weekly"), F.lit("monthly"))))
    slow = slow.withColumn("series", F.concat("release_class", F.lit("_"), "o_orderstatus"))
    cols = ["series", "release_class", "stamp", "value"]
    return daily.select(cols).unionByName(slow.select(cols))


# ---- intraday bars: one event type may hold most rows, so nothing runs per key ----

def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instrument"), F.col("ts"), "event_id",
        F.col("value").alias("px"))


def event_order():
    """(ts, event_id) as one DECIMAL(38,0), so that equal times keep their arrival order.

    Microseconds stay below 10^19 and ids are guarded to 0..10^19, so the fields cannot
    run into each other and the aggregate keeps fixed-width buffers.
    """
    d = "decimal(38,0)"
    i = F.col("event_id").cast(d)
    i = F.when(i >= 0, i).when(i.isNotNull(), F.raise_error(F.lit("event_id is negative")).cast(d))
    return (F.unix_micros(F.col("ts").cast("timestamp")).cast(d) * F.lit(Decimal(10 ** 19)) + i).cast(d)


def time_bars(ev: DataFrame, unit="hour") -> DataFrame:
    """OHLC bars per key and time unit; equal times are ordered by event id."""
    return (ev.withColumn("_k", event_order()).groupBy("instrument", F.date_trunc(unit, "ts").alias("bar_ts"))
            .agg(F.min_by("px", "_k").alias("open"), F.max("px").alias("high"),
                 F.min("px").alias("low"), F.max_by("px", "_k").alias("close"),
                 F.sum("px").alias("volume"), F.count("*").alias("n_ticks")))


def running_total(ev: DataFrame, x: str, out: str, unit="hour") -> DataFrame:
    """Exact running sum per key in two levels, parallel over (key, time block).

    Block totals are a small table (keys x hours); their prefix sum is joined
    back and added to the running sum inside the block. A key holding a third of
    all ticks is therefore spread over as many tasks as it has blocks.
    """
    blocked = ev.withColumn("_blk", F.date_trunc(unit, "ts"))
    totals = blocked.groupBy("instrument", "_blk").agg(F.sum(x).alias("_t"))
    w = Window.partitionBy("instrument").orderBy("_blk").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select("instrument", "_blk",
                            F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_off"))
    order = [c for c in ("ts", "event_id") if c in ev.columns]
    inner = Window.partitionBy("instrument", "_blk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    return (blocked.withColumn("_in", F.sum(x).over(inner))
            .join(offsets, ["instrument", "_blk"])
            .withColumn(out, F.col("_off") + F.col("_in"))
            .drop("_off", "_in", "_blk"))


def activity_bars(ev: DataFrame, amount, size) -> DataFrame:
    """Volume or dollar bars: bar id = floor(total before this tick / size).

    ``amount`` is an integer column so that the running total has no rounding.
    """
    t = running_total(ev.withColumn("_amt", amount.cast("bigint")), "_amt", "_cum")
    t = t.withColumn("bar_id", F.floor((F.col("_cum") - F.col("_amt")) / F.lit(size)))
    return (t.withColumn("_k", event_order()).groupBy("instrument", "bar_id")
            .agg(F.min("ts").alias("ts_open"), F.max("ts").alias("ts_close"),
                 F.min_by("px", "_k").alias("open"), F.max("px").alias("high"),
                 F.min("px").alias("low"), F.max_by("px", "_k").alias("close"),
                 F.sum("_amt").alias("amount"), F.count("*").alias("n_ticks")))
