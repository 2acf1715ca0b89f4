"""Parquet tables of requests, history or vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MOST_SPLITS = 32


def spread_if_narrow(df: DataFrame) -> DataFrame:
    """``df`` over all cores when it has fewer splits than there are cores.

    Text work is heavy per byte, so one small file would keep one core busy. Data with at
    least as many splits as there are cores, or with ``MOST_SPLITS``, is left where it is, so
    only a few splits are ever shuffled. Meant for scans, whose number of splits is known
    without running anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < min(cores, MOST_SPLITS) else df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spread_if_narrow(spark.read.parquet(path))
