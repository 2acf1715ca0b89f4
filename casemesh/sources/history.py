"""Labelled complaints as CSV, as inline tables, and back to CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from casemesh.operators.clean import clean_history
from casemesh.schemas import HISTORY

ETA_NAMES = ("eta", "eta_days")


def read_raw_history(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The CSV under its own header, typed by column name instead of by inference.

    Files split, however large they are. ``multi_line`` accepts line breaks inside quotes,
    at the price of one task per file.
    """
    csv = spark.read.option("header", True).option("escape", '"')
    csv = csv.option("multiLine", multi_line)
    header = csv.csv(path).columns
    fields = [
        T.StructField(name, T.DoubleType() if name in ETA_NAMES else T.StringType())
        for name in header
    ]
    return csv.option("enforceSchema", False).schema(T.StructType(fields)).csv(path)


def read_history(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Cleaned history: no null text, and the days under ``eta_days``."""
    return clean_history(read_raw_history(spark, path, multi_line))


def write_history(df: DataFrame, path: str) -> None:
    csv = df.write.mode("overwrite").option("header", True).option("escape", '"')
    csv = csv.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    csv.csv(path)


def inline_history(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """A small literal table from equally long lists per column."""
    if len({len(values) for values in columns.values()}) > 1:
        raise ValueError("all columns must have the same length")
    known = {f.name: f for f in HISTORY.fields} | {"eta": T.StructField("eta", T.DoubleType())}
    schema = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in columns])
    return spark.createDataFrame(list(zip(*columns.values())), schema)
