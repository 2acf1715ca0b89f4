"""Media requests: the paths of uploaded files. Their bytes are never read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemesh.schemas import TRANSCRIPT


def read_media(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``media_path`` of every file below ``path``; the content column is pruned."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    return files.select(F.col("path").alias("media_path"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Output of a speech engine, one row per media path."""
    return spark.read.schema(TRANSCRIPT).parquet(path)
