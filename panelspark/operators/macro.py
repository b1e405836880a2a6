"""point-in-time macro series: cadence, availability, as-of panel, frozen z-scores."""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.joins import asof, with_scalars

# Publication lag class -> momentum horizons in grid rows.
MOMENTUM = {"daily": (5, 20), "weekly": (5, 20), "monthly": (21, 63)}
BUFFER_DAYS = 200


def latest_stamps(obs: DataFrame, ingest="ingest") -> DataFrame:
    """A5: drop NULLs; of duplicate stamps keep the last ingested value."""
    return (obs.filter(F.col("stamp").isNotNull() & F.col("value").isNotNull())
            .groupBy("series", "release_class", "stamp")
            .agg(F.max_by("value", ingest).alias("value")))


def recover_cadence(obs: DataFrame) -> DataFrame:
    """Weekly values at the week-ending Friday, monthly ones at month end."""
    week = F.next_day(F.date_sub("stamp", 1), "Fri")
    stamp = (F.when(F.col("release_class") == "weekly", week)
             .when(F.col("release_class") == "monthly", F.last_day("stamp"))
             .otherwise(F.col("stamp")))
    return (obs.groupBy("series", "release_class", stamp.alias("bin"))
            .agg(F.max_by("value", "stamp").alias("value"))
            .withColumnRenamed("bin", "stamp"))


def with_availability(obs: DataFrame) -> DataFrame:
    """K9: daily +0, weekly Friday +6 days, monthly next business day."""
    s = F.col("stamp")
    step = F.when(F.weekday(s) == 4, 3).when(F.weekday(s) == 5, 2).otherwise(1)
    return obs.withColumn("available", F.when(F.col("release_class") == "weekly", F.date_add(s, 6))
                          .when(F.col("release_class") == "monthly", F.date_add(s, step))
                          .otherwise(s))


def business_grid(trade_dates: DataFrame) -> DataFrame:
    """Weekdays from 200 days before the first trade date, plus all trade dates."""
    span = trade_dates.agg(F.date_sub(F.min("date"), BUFFER_DAYS).alias("a"),
                           F.max("date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("date")).filter(F.weekday("date") < 5)
    return days.union(trade_dates.select("date")).distinct()


def applied_panel(obs: DataFrame, trade_dates: DataFrame) -> DataFrame:
    """Level of every series on the business grid, as known on each day."""
    avail = with_availability(obs)
    # of several stamps available on one day the latest stamp wins
    avail = avail.groupBy("series", "available").agg(F.max_by("value", "stamp").alias("value"))
    grid = business_grid(trade_dates)
    names = obs.select("series", "release_class").distinct()
    span = grid.agg(F.sort_array(F.collect_list("date")).alias("days"))    # one calendar
    left = with_scalars(names, span).select("series", "release_class",
                                            F.explode("days").alias("date"))
    return asof(left, avail, "series", "date", "available", "value", "level",
                block="year").select("series", "release_class", "date", "level")


def macro_features(applied: DataFrame, trade_dates: DataFrame) -> DataFrame:
    """K11 (long form): level and two differences over grid rows, on trade dates."""
    w = Window.partitionBy("series").orderBy("date")

    def chg(i):
        out = None
        for cls, h in MOMENTUM.items():
            cond = F.col("release_class") == cls
            val = F.col("level") - F.lag("level", h[i]).over(w)
            out = F.when(cond, val) if out is None else out.when(cond, val)
        return out

    df = applied.withColumns({"chg_short": chg(0), "chg_long": chg(1)})
    return df.join(F.broadcast(trade_dates.select("date").distinct()), "date", "left_semi")


def with_spreads(applied: DataFrame, pairs) -> DataFrame:
    """The applied levels plus spread series (name, minuend, subtrahend).

    Each row is tagged with its own series and the spreads it takes part in, so
    levels and spreads come from one pass and one aggregation. A spread needs
    both legs.
    """
    legs = [(n, m, sign) for n, a, b in pairs for m, sign in ((a, 1.0), (b, -1.0))]
    own = F.struct(F.col("series").alias("out"), F.lit(1.0).alias("sign"), F.lit(1).alias("need"))
    tags = [own] + [F.when(F.col("series") == m, F.struct(
        F.lit(n).alias("out"), F.lit(sign).alias("sign"), F.lit(2).alias("need"))) for n, m, sign in legs]
    t = applied.withColumn("t", F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())))
    g = t.groupBy(F.col("t.out").alias("series"), "release_class", "date").agg(
        F.sum(F.col("t.sign") * F.col("level")).alias("level"), F.count("level").alias("_n"),
        F.max("t.need").alias("_need"))
    return g.withColumn("level", F.when(F.col("_n") == F.col("_need"), F.col("level"))).drop("_n", "_need")


def macro_wide(long: DataFrame, names) -> DataFrame:
    """Columns f11_<series>_level / _chg_short / _chg_long, one row per date."""
    agg = long.groupBy("date").pivot("series", list(names)).agg(
        *[F.max(c).alias(c) for c in ("level", "chg_short", "chg_long")])
    return agg.select("date", *[F.col(f"`{n}_{c}`").alias(f"f11_{slug(n)}_{c}")
                                for n in names for c in ("level", "chg_short", "chg_long")])


def slug(name):
    return "".join(ch if ch.isalnum() else "_" for ch in name.lower())


def frozen_stats(wide: DataFrame, cols, train) -> DataFrame:
    """One-row train mean and population sd per column (0 or NULL sd -> 1)."""
    fit = wide.filter(train)
    aggs = []
    for c in cols:
        sd = F.stddev_pop(c)
        aggs += [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}__m"),
                 F.when(sd > 0, sd).otherwise(1.0).alias(f"{c}__s")]
    return fit.agg(*aggs)


def frozen_zscore(wide: DataFrame, stats: DataFrame, cols) -> DataFrame:
    """Apply the frozen statistics to every date."""
    df = with_scalars(wide, stats)
    return df.select("date", *[((F.col(c) - F.col(f"{c}__m")) / F.col(f"{c}__s")).alias(c)
                               for c in cols])
