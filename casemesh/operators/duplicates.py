"""Duplicate cases: copies, pairs within a distance, and the groups they form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemesh.operators.features import TOKEN_PATTERN
from casemesh.operators.joins import join_unique
from casemesh.operators.text_join import (
    TextJoin,
    similar_text_links,
    similar_texts,
    text_vectors,
)
from casemesh.session import few_tasks, materialize_counted

# Up to so many edges, two numbers each, a few tasks are enough and the least neighbours go to
# every executor.
SMALL_EDGES = 1 << 17


def word_key(text):
    """Equal for texts with the same words in the same order, whatever case or punctuation."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN_PATTERN})"))
    return F.sha2(F.array_join(words, " "), 256)


def has_words(text):
    """Texts without any word are nobody's copy and near to nothing."""
    return F.coalesce(F.regexp_like(text, F.lit(TOKEN_PATTERN)), F.lit(False))


def split_copies(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(firsts, copies)``: the smallest id of every text, and a link ``a, b`` per other id.

    Comparing every two copies of a text would grow with the square of their number; a
    link to the first says the same in one row each. The smallest ids are aggregated
    before the shuffle, and the join back to them spreads a text many rows share.
    """
    keyed, seen = materialize_counted(
        df.where(has_words(F.col(text_col))).select(
            F.col(id_col).alias("b"), word_key(F.col(text_col)).alias("key")
        ),
        "text-keys",
    )
    firsts = keyed.groupBy("key").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("n"))
    shared = firsts.where(F.col("n") > 1).select("key", "a")
    copies = join_unique(keyed, shared, "key", "inner", left_rows=seen["rows"])
    return firsts.select(F.col("a").alias(id_col)), copies.where("a < b").select("a", "b")


def _distinct_text_vectors(df, id_col, text_col, config: TextJoin):
    """Vectors of the first of every text, weighted by all texts, and the copy links."""
    _, copies = split_copies(df, id_col, text_col)
    return text_vectors(df, id_col, text_col, config.threshold, copies.select("b")), copies


def duplicate_pairs(
    df: DataFrame,
    threshold: float = 0.95,
    id_col: str = "id",
    text_col: str = "complaint_text",
    block: int = TextJoin().block,
) -> DataFrame:
    """``a, b, similarity``: each copy of a text with the first of them, and every pair of
    such firsts whose cosine of weighted words is at least ``threshold``.

    Two copies of one text, and a near copy of a first with that first's copies, are paired
    by way of the first only. Texts without words are in no pair.
    """
    config = TextJoin(threshold, block)
    vectors, copies = _distinct_text_vectors(df, id_col, text_col, config)
    near = similar_texts(vectors, config)
    return near.select("a", "b", (1.0 - F.col("distance")).alias("similarity")).unionByName(
        copies.withColumn("similarity", F.lit(1.0))
    )


def duplicate_groups(
    df: DataFrame,
    threshold: float = 0.95,
    id_col: str = "id",
    text_col: str = "complaint_text",
    block: int = TextJoin().block,
) -> DataFrame:
    """``id_col, cluster``: the groups ``duplicate_pairs`` would connect, without its pairs."""
    config = TextJoin(threshold, block)
    vectors, copies = _distinct_text_vectors(df, id_col, text_col, config)
    groups = duplicate_clusters(similar_text_links(vectors, config).unionByName(copies))
    return groups.withColumnRenamed("id", id_col)


def duplicate_clusters(pairs: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected groups of the pairs ``a, b``: ``id, cluster``, the smallest id of the group.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), which reach a
    star around each smallest id in a logarithmic number of rounds. Each round is written
    to the shared folder, so lineage stays short and a lost executor costs one round.
    """
    edges, state = _settle_edges(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    )
    for _ in range(max_rounds):
        starred = _small_star(_large_star(edges, state["rows"]), state["rows"])
        edges, after = _settle_edges(starred, state["rows"])
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"groups did not settle within {max_rounds} rounds")
    members = edges.select(F.col("v").alias("id"), F.col("u").alias("cluster"))
    roots = edges.select(F.col("u").alias("id"), F.col("u").alias("cluster")).distinct()
    return members.unionByName(roots)


def _settle_edges(edges: DataFrame, rows: int | None = None) -> tuple[DataFrame, dict]:
    """The distinct edges as a table, with marks that for all practical purposes are equal
    only for equal sets of edges."""
    return materialize_counted(
        _gathered(edges.select("v", "u").distinct(), rows),
        "cluster-edges",
        mixed=F.bit_xor(F.xxhash64("v", "u")),
        total=F.sum(F.hash("v", "u").cast("long")),
    )


def _gathered(edges: DataFrame, rows: int | None) -> DataFrame:
    """Few edges in few tasks."""
    return edges if rows is None or rows > SMALL_EDGES else few_tasks(edges, rows, SMALL_EDGES)


def _join_least(edges: DataFrame, least: DataFrame, key: str, rows: int) -> DataFrame:
    """Few edges stay where they are, so no key is hot."""
    if rows <= SMALL_EDGES:
        return edges.join(F.broadcast(least), key)
    return join_unique(edges, least, key, "inner", left_rows=rows)


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node next to it."""
    both = edges.select(F.col("v").alias("node"), F.col("u").alias("next")).unionByName(
        edges.select(F.col("u").alias("node"), F.col("v").alias("next"))
    )
    least = both.groupBy("node").agg(F.min("next").alias("m")).select(
        "node", F.least("m", "node").alias("m")
    )
    larger = both.where(F.col("next") > F.col("node"))
    linked = (
        _join_least(larger, _gathered(least, rows), "node", rows)
        .select(F.col("next").alias("v"), F.col("m").alias("u"))
        .distinct()
    )
    return _gathered(linked, rows)


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = _gathered(edges.groupBy("v").agg(F.min("u").alias("m")), rows)
    moved = _join_least(edges, least, "v", rows)
    return moved.where(F.col("u") > F.col("m")).select(
        F.col("u").alias("v"), F.col("m").alias("u")
    ).unionByName(least.select("v", F.col("m").alias("u")))
