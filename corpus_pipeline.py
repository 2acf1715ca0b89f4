"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemesh.llm.decontaminate import contaminated
from casemesh.llm.language_id import UNDETERMINED, fit, predict
from casemesh.llm.learning import fresh, settled
from casemesh.llm.line_dedup import drop_duplicate_lines
from casemesh.llm.near_dedup import near_duplicates
from casemesh.llm.packing import pack
from casemesh.llm.queries import packing_config, table
from casemesh.session import materialize, small_batches

# A text of one language scores near 1; one that no language fits scores like a guess.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without letters go."""
    lang, score = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    known = predict(docs, fit(docs), lang, score)
    told = (F.col(lang) != UNDETERMINED) & (F.col(score) >= LEAST_SCORE)
    return known.where(told).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with only the first of every group of similar lines; those that keep no
    text go."""
    return drop_duplicate_lines(docs).where(F.length(F.trim("text")) > 0)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(materialize(gone, "pipeline-duplicates"), "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    with small_batches(spark):
        found = materialize(found, "pipeline-contaminated")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences."""
    return pack(docs, packing_config())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

# Tokens, connected groups and trained scores have no SQL form; tests/llm checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn; what a stage keeps is written and read again for the next one,
    and the tables it made on the way are removed."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, f"pipeline-{name}", partial(stage, spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
