import random

import pytest

from casemesh.operators.duplicates import (
    duplicate_clusters,
    duplicate_groups,
    duplicate_pairs,
    split_copies,
)


def components(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def clusters(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    return {r.id: r.cluster for r in duplicate_clusters(df).collect()}


@pytest.mark.parametrize(
    "pairs",
    [
        [(i, i + 1) for i in range(40)],  # a chain
        [(0, i) for i in range(1, 60)],  # a star around the smallest
        [(59, i) for i in range(59)],  # a star around the largest
        [(1, 2), (2, 1), (3, 3), (5, 4), (4, 6)],
    ],
)
def test_groups_of_shapes(spark, pairs):
    assert clusters(spark, pairs) == components([p for p in pairs if p[0] != p[1]])


def test_groups_of_random_pairs(spark):
    rng = random.Random(11)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    assert clusters(spark, pairs) == components([p for p in pairs if p[0] != p[1]])


def texts(spark):
    """A third of all rows are copies of one text up to case and punctuation."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(60)]
    near = [t + " w1" for t in base[:10]]
    copies = [base[0].upper() + "!" * (i % 3) for i in range(35)]
    rows = list(enumerate(base + near + copies))
    return spark.createDataFrame(rows, "id long, complaint_text string").repartition(4), len(base)


def test_copies_are_linked_to_their_first(spark):
    df, _ = texts(spark)
    firsts, copies = split_copies(df, "id", "complaint_text")
    assert firsts.count() == 70
    assert sorted(tuple(r) for r in copies.collect()) == [(0, i) for i in range(70, 105)]


@pytest.mark.parametrize("block", [256, 4])
def test_pairs_and_groups_agree(spark, block):
    df, _ = texts(spark)
    pairs = duplicate_pairs(df, 0.95, block=block).collect()
    linked = {(r.a, r.b) for r in pairs}
    assert len(linked) == len(pairs) and {(i, 60 + i) for i in range(10)} <= linked
    groups = duplicate_groups(df, 0.95, block=block).collect()
    assert {r.id: r.cluster for r in groups} == components(linked)
