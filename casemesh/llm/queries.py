"""One registered query per operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemesh.llm.decontaminate import contaminated
from casemesh.llm.disclosure import KINDS, disclosure_spans, span_list
from casemesh.llm.hard_negatives import mine_hard_negatives
from casemesh.llm.host_rules import apply_host_rules
from casemesh.llm.language_id import fit, language_table
from casemesh.llm.line_dedup import line_components
from casemesh.llm.near_dedup import NearDedup, near_duplicates
from casemesh.llm.packing import Packing, pack
from casemesh.llm.quality import fit_quality, predict_quality
from casemesh.llm.token_alignment import Alignment, align_tokens
from casemesh.llm.token_files import TokenFiles, read_documents, with_starts, write_token_files
from casemesh.llm.toxicity import fit_toxicity, predict_toxicity
from casemesh.llm.url_reputation import ALLOW, BLOCK, UrlRule, judge_urls
from casemesh.session import scratch_path

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"

# Fixed values of the url query.
URL_RULES = (
    UrlRule(ALLOW, "org", "/"),
    UrlRule(BLOCK, "example.org", "/es/"),
    UrlRule(BLOCK, "example.org", "/en/1"),
    UrlRule(ALLOW, "com", "/fr/"),
    UrlRule(BLOCK, "com", "/de/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packing_config() -> Packing:
    return Packing(tokenizer=public_tokenizers.path(TOKENIZER))


def op1_minimum_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), packing_config())


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(
        table(spark, sf_dir, "documents"), NearDedup(width=3, similarity=85)
    )


def op3_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_components(table(spark, sf_dir, "documents"))


def op4_disclosure_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure_spans(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(span_list("base"), 256).alias("base_sha256"),
        span_list("spans").alias("spans"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op7_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_host_rules(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad if the document of its number has low quality."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad")
    )
    return judge_urls(table(spark, sf_dir, "pages"), labels, URL_RULES).drop("rate")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_table(docs, fit(docs))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = TokenFiles(tokenizer=public_tokenizers.path(BYTE_TOKENIZER))
    path = scratch_path(spark, "token-files")
    index = write_token_files(table(spark, sf_dir, "documents"), path, config)
    digest = F.crc32("ids").alias("ids_crc32")
    found = read_documents(index).select("shard", "doc_id", "before", "n_tokens", digest)
    return with_starts(found, index).select("doc_id", "start", "n_tokens", "ids_crc32")


def op12_bond_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return mine_hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = Alignment(*map(public_tokenizers.path, (BYTE_TOKENIZER, PIECE_TOKENIZER)))
    return align_tokens(table(spark, sf_dir, "documents"), config).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


QUERIES = {
    "op1_minimum_bin_slack_packing": op1_minimum_bin_slack_packing,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_fuzzy_line_dedup": op3_fuzzy_line_dedup,
    "op4_disclosure_sanitisation": op4_disclosure_sanitisation,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_toxicity": op6_toxicity,
    "op7_host_quality_rules": op7_host_quality_rules,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_url_filters": op9_url_filters,
    "op10_language_id": op10_language_id,
    "op11_token_files": op11_token_files,
    "op12_bond_hard_negatives": op12_bond_hard_negatives,
    "op13_token_alignment": op13_token_alignment,
}
