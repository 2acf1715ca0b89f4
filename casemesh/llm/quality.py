"""Quality of documents: gradient-boosted trees over statistics of the whole text.

The model is fitted on the driver from at most about ``train_rows`` labelled rows that may
teach; their ids are sent to the scan, so training moves no text. Scoring is one pass: the
statistics of a batch and a walk through the flattened trees.

Defined cases: null and empty texts have all statistics zero and are scored like any other;
labels that are null teach nothing and a row with several labels teaches each; without
labels all scores are 0.5; rows without id do not teach; repeated rows all come back; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemesh.llm.boosting import Boosting, Trees, train
from casemesh.llm.learning import Shipped, bounded_sample, held_out, teaches
from casemesh.llm.statistics import statistics
from casemesh.llm.words import slices

TRAIN_ROWS = 20_000


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS
) -> DataFrame:
    """``doc_id, text, label`` of about ``rows`` labelled rows at most that may teach.

    The sampled labels are bounded by ``rows``, so they can go to every task.
    """
    known = labels.where(teaches() & F.col(label).isin(0, 1)).select(
        F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")
    )
    # The limit holds even if one id has very many labels.
    sampled = bounded_sample(known, rows, "doc_id").limit(2 * rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.join(F.broadcast(sampled), "doc_id")


def collect_features(rows: DataFrame, compute) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded table ``doc_id, text, label``, in a fixed order."""

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1)):
                own = slice(part.low, part.high)
                found = compute(part.data, part.bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[own],
                        batch.column(2)[own],
                        pa.array(list(found), pa.list_(pa.float64())),
                    ],
                    ["doc_id", "label", "features"],
                )

    table = rows.select("doc_id", "text", "label").mapInArrow(
        run, "doc_id long, label int, features array<double>"
    ).toArrow()
    if not table.num_rows:
        return np.zeros((0, 1)), np.zeros(0)
    x = np.array(table["features"].to_pylist(), dtype=np.float64)
    y = table["label"].to_numpy()
    order = np.lexsort((*x.T, y, table["doc_id"].to_numpy()))
    return x[order], y[order].astype(np.float64)


def score_column(docs: DataFrame, score) -> DataFrame:
    """``doc_id, score`` of every row; ``score`` maps bytes and bounds of texts to numbers."""

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part.low : part.high],
                        pa.array(score(part.data, part.bounds), pa.float64()),
                    ],
                    ["doc_id", "score"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double"
    )


def fit_quality(
    docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, config: Boosting = Boosting()
) -> Trees:
    return train(*collect_features(labelled_sample(docs, labels, "quality", rows), statistics), config)


def predict_quality(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    sent = Shipped(docs.sparkSession.sparkContext, "quality", model)
    scored = score_column(
        docs, lambda data, bounds: sent.get().probability(statistics(data, bounds))
    )
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
