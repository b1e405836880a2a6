"""Readers for panel files. Schemas are given, never inferred."""

from pyspark.sql import DataFrame, SparkSession, functions as F

PRICE_COLS = ("open", "high", "low", "close")
VALUE_COLS = PRICE_COLS + ("volume", "open_interest")
RAW_SCHEMA = "date STRING, instrument STRING, " + ", ".join(f"{x} STRING" for x in VALUE_COLS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coerce_numeric(df: DataFrame, cols=VALUE_COLS) -> DataFrame:
    """Unparseable or NaN numbers become NULL; dates become DATE."""
    out = {x: F.nanvl(F.col(x).try_cast("double"), F.lit(None).cast("double"))
           for x in cols if x in df.columns}
    out["date"] = F.to_date("date")
    return df.withColumns(out)


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Long OHLCV CSV; every number is read as text and then coerced."""
    return coerce_numeric(spark.read.schema(RAW_SCHEMA).option("header", True).csv(path))


def read_panel_parquet(spark: SparkSession, path: str) -> DataFrame:
    return coerce_numeric(spark.read.parquet(path))


def read_signals_csv(spark: SparkSession, path: str, instruments) -> DataFrame:
    """Wide signal file: a date column and one integer column per instrument."""
    schema = "date DATE, " + ", ".join(f"`{i}` INT" for i in instruments)
    return spark.read.schema(schema).option("header", True).csv(path)
