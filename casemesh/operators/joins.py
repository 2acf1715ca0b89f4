"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
# Rows without a key match nothing, but would all hash to one task.
NULL_SALTS = 1024


def join_unique(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    left_rows: int | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, which has at most one row per ``key``.

    Keys with more than ``hot_rows`` rows on the left are split over several salts, and
    only those keys are repeated on the right. There are fewer than
    ``rows(left) / hot_rows`` of them, two numbers each, which bounds the broadcast. A
    left side known to have no more than ``hot_rows`` rows cannot have such a key. Rows
    without a key are spread too.
    """
    if how not in ("left", "inner"):
        raise ValueError(how)
    if left_rows is not None and left_rows <= hot_rows:
        return left.join(right, key, how)
    hot = (
        left.groupBy(key)
        .count()
        .where(F.col(key).isNotNull() & (F.col("count") > hot_rows))
        .select(key, F.ceil(F.col("count") / F.lit(hot_rows)).cast("int").alias("_salts"))
    )
    width = F.coalesce(F.col("_salts"), F.lit(1))
    spread = F.xxhash64(*[c for c in left.columns if c != key] or [F.lit(0)])
    salt = F.when(F.col(key).isNull(), F.pmod(spread, F.lit(NULL_SALTS))).when(
        width > 1, F.pmod(spread, width)
    )
    salted = (
        left.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.coalesce(salt, F.lit(0)).cast("int"))
        .drop("_salts")
    )
    repeated = (
        right.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), width - 1)))
        .drop("_salts")
    )
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
