"""Where decisions go."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_results(results: DataFrame, path: str, mode: str = "append") -> dict[str, int]:
    """Writes triage results and returns how many there were, and how many out of scope.

    Both numbers are observed while writing.
    """
    seen = Observation("results")
    scope = F.count(F.when(F.col("status") == "out_of_scope", 1))
    observed = results.observe(
        seen, F.count(F.lit(1)).alias("rows"), scope.alias("out_of_scope")
    )
    observed.write.mode(mode).parquet(path)
    return seen.get
