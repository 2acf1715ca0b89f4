import random
from contextlib import contextmanager

import pytest

from casemesh.llm import near_dedup
from casemesh.llm.near_dedup import NearDedup
from casemesh.operators import duplicates
from casemesh.operators.duplicates import duplicate_clusters
from casemesh.session import few_tasks

PARTITIONS = {
    "spark.sql.shuffle.partitions": "64",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


@contextmanager
def many_partitions(spark):
    before = {k: spark.conf.get(k) for k in PARTITIONS}
    try:
        for k, v in PARTITIONS.items():
            spark.conf.set(k, v)
        yield 2 * spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def chains(rng, groups):
    """Links of random trees, and the smallest id of every node's tree."""
    ids = rng.sample(range(10_000), 30 * groups)
    pairs, want = [], {}
    for n in range(groups):
        own = ids[30 * n : 30 * n + 30]
        pairs += [(own[k], own[rng.randrange(k)]) for k in range(1, 30)]
        want.update(dict.fromkeys(own, min(own)))
    return pairs, want


@pytest.mark.parametrize("small", [duplicates.SMALL_EDGES, 0])
def test_rounds_over_few_edges_take_few_tasks(spark, monkeypatch, small):
    monkeypatch.setattr(duplicates, "SMALL_EDGES", small)
    pairs, want = chains(random.Random(4), 6)
    with many_partitions(spark) as least:
        found = duplicate_clusters(spark.createDataFrame(pairs, "a long, b long"))
        assert {r["id"]: r["cluster"] for r in found.collect()} == want
        if small:
            assert len(found.inputFiles()) <= least


def test_few_rows_take_few_python_tasks(spark):
    config = NearDedup()
    with many_partitions(spark) as least:
        firsts = spark.range(100).selectExpr("id a", f"cast(repeat('abcd', {config.values}) as binary) signature")
        pairs = spark.range(1, 100).selectExpr("id a", "id - 1 b")
        left = near_dedup._prune(pairs, firsts, config)
        assert left.rdd.getNumPartitions() <= least
        assert left.count() == 99


def test_many_rows_take_more_tasks(spark):
    rows = spark.range(0, 1000, 1, 50)
    assert few_tasks(rows, 1000, 25).rdd.getNumPartitions() == 40
    assert few_tasks(rows, 1000, 1).rdd.getNumPartitions() == 50
