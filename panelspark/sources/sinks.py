"""Sinks. Ordering is applied here and nowhere else.

Everything is computed once: the matrix is written first, and its other forms are
derived from the file.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_matrix(matrix: DataFrame, path: str) -> DataFrame:
    """Parquet by split, dealt by (split, instrument) and sorted by
    (instrument, date) inside a file; a CSV copy of that file. Returns the stored rows."""
    (matrix.repartition("partition", "instrument").sortWithinPartitions("partition", "instrument", "date")
     .write.mode("overwrite").partitionBy("partition").parquet(f"{path}/matrix.parquet"))
    stored = stored_matrix(matrix.sparkSession, path, matrix.schema)
    stored.write.mode("overwrite").option("header", True).csv(f"{path}/matrix.csv")
    return stored


def stored_matrix(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/matrix.parquet").select(*schema.names)


def write_families(stored: DataFrame, path: str, families: dict) -> None:
    """One folder per family keyed by (date, instrument), from the stored matrix."""
    for name, cols in families.items():
        stored.select("date", "instrument", *cols).write.mode("overwrite").parquet(f"{path}/{name}")


def read_families(spark: SparkSession, path: str, families: dict) -> DataFrame:
    """The stored families side by side."""
    out = None
    for name in families:
        f = spark.read.parquet(f"{path}/{name}")
        out = f if out is None else out.join(f, ["date", "instrument"])
    return out


def write_tables(tables: dict, path: str) -> None:
    """Named diagnostic tables as CSV, ordered by their first column."""
    for name, df in tables.items():
        (df.orderBy(df.columns[0]).write.mode("overwrite").option("header", True)
         .csv(f"{path}/{name}"))


def read_tables(spark: SparkSession, tables: dict, path: str) -> DataFrame:
    """(table, line): every stored row as text, its columns by name and NULL as empty."""
    out = None
    for name, df in tables.items():
        t = spark.read.schema(df.schema).option("header", True).csv(f"{path}/{name}")
        t = t.select(F.lit(name).alias("table"), line(t).alias("line"))
        out = t if out is None else out.unionByName(t)
    return out


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def line(df: DataFrame):
    """A row as text: columns by name, doubles as whole millionths, NULL as empty."""
    cols = []
    for c, t in sorted(df.dtypes):
        x = F.round(F.col(c) * 1e6).cast("decimal(38,0)") if t == "double" else F.col(c)
        cols.append(F.coalesce(x.cast("string"), F.lit("")))
    return F.concat_ws("|", *cols)


def fingerprint(df: DataFrame) -> DataFrame:
    """A10: order-free content fingerprint and row count.

    Twelve hex digits of each row's MD5 are combined by XOR and by a sum, so the result
    does not depend on row order and equal pairs of rows still count.
    """
    h = df.select(F.conv(F.substring(F.md5(line(df)), 1, 12), 16, 10).cast("bigint").alias("h"))
    return h.agg(F.count("*").alias("n_rows"), F.bit_xor("h").alias("xor_hash"),
                 F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("sum_hash"))


def write_events(events: DataFrame, meta: DataFrame, path: str) -> DataFrame:
    """A10: events with their per-instrument counts and fingerprint, which is returned."""
    events.write.mode("overwrite").parquet(f"{path}/events.parquet")
    stored = events.sparkSession.read.parquet(f"{path}/events.parquet")
    meta.write.mode("overwrite").json(f"{path}/events_meta")
    found = fingerprint(stored)
    found.write.mode("overwrite").json(f"{path}/events_fingerprint")
    return found


def drift_guard(events: DataFrame, path: str) -> bool:
    """True when ``events`` has the fingerprint stored next to the written file."""
    spark = events.sparkSession
    stored = spark.read.schema("n_rows long, xor_hash long, sum_hash string").json(
        f"{path}/events_fingerprint")
    return stored.exceptAll(fingerprint(events)).isEmpty()
