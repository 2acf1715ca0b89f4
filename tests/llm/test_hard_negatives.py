import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemesh.llm.hard_negatives import Best, Block, HardNegatives, Scan, mine_hard_negatives, window_of

SCHEMA = "vec_id long, embedding array<float>, label int, row string, place string, scores string"


def table(spark, rows, partitions=3):
    return spark.createDataFrame(
        [(*row, "x", "y", "z") for row in rows], SCHEMA
    ).repartition(partitions)


def brute_force(rows, is_anchor, config=HardNegatives()):
    """All pairs, sorted, from the definition."""
    def whole(vector):
        return [math.floor(config.scale * float(np.float32(x))) for x in vector]

    used = [
        (i, label, whole(vector))
        for i, vector, label in rows
        if i is not None and label is not None and vector is not None
        and all(x is not None and math.isfinite(x) for x in vector)
    ]
    out = []
    for n, (anchor, label, vector) in enumerate(used):
        if not is_anchor(anchor):
            continue
        scored = [
            (-sum(x * y for x, y in zip(vector, other)), i, m, own)
            for m, (i, own, other) in enumerate(used)
        ]
        scored.sort()
        positives = [s for s in scored if s[3] == label and s[2] != n][: config.positives]
        for score, positive, _, _ in positives:
            fits = [
                s for s in scored
                if s[3] != label and config.least * -score <= 100 * -s[0] <= config.most * -score
            ]
            for rank, (own, negative, _, _) in enumerate(fits[: config.negatives], 1):
                out.append((anchor, positive, rank, negative, -score, -own))
    return sorted(out)


def mined(spark, rows, config=HardNegatives(), partitions=3):
    found = mine_hard_negatives(table(spark, rows, partitions), F.col("vec_id") % 5 == 0, config)
    assert found.columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score",
    ]
    return sorted(map(tuple, found.collect()))


def random_rows(rng, count, width=12, labels=3):
    centers = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(labels)]
    rows = []
    for i in range(count):
        label = rng.randrange(labels)
        rows.append((i, [c + rng.gauss(0, 0.25) for c in centers[label]], label))
    return rows


@pytest.mark.parametrize("config", [
    HardNegatives(),
    HardNegatives(step=3, block_rows=16, anchor_rows=7),
    HardNegatives(positives=2, negatives=4, least=20, most=99, step=5, block_rows=50),
])
def test_rows_are_those_of_all_pairs(spark, config):
    rows = random_rows(random.Random(1), 150)
    want = brute_force(rows, lambda i: i % 5 == 0, config)
    assert len(want) > 100 and mined(spark, rows, config) == want


def test_ties_and_equal_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.25, 0.5]) for _ in range(4)], i % 2) for i in range(80)]
    want = brute_force(rows, lambda i: i % 5 == 0, HardNegatives(block_rows=9))
    assert want and mined(spark, rows, HardNegatives(block_rows=9)) == want


def test_odd_rows_take_no_part(spark):
    rng = random.Random(3)
    rows = random_rows(rng, 60)
    rows += [
        (100, None, 1), (105, [0.5] * 12, None), (110, [0.5] * 11 + [None], 1), (None, [0.5] * 12, 1),
        (115, [0.5] * 11 + [math.nan], 1), (120, [math.inf] * 12, 1), (125, [-math.inf] * 12, 1),
        (130, [], 1), (135, [0.5] * 5, 1), (140, [0.5] * 20, 2), (145, [-0.0] * 12, 7),
    ]
    assert mined(spark, rows) == brute_force(rows, lambda i: i % 5 == 0)


def test_repeated_ids_are_rows_of_their_own(spark):
    rng = random.Random(4)
    rows = random_rows(rng, 40, width=4)
    rows += [(5, [0.5, 0.5, 0.1, 0.2], 1), rows[10], rows[11], rows[11]]
    assert mined(spark, rows) == brute_force(rows, lambda i: i % 5 == 0)


def test_large_components_stay_exact_or_are_refused(spark):
    rows = [(i, [float(1 << 20) + i, 3.0, -float(1 << 16) * i], i % 2) for i in range(30)]
    assert mined(spark, rows) == brute_force(rows, lambda i: i % 5 == 0)
    with pytest.raises(Exception, match="too large for exact scores"):
        mined(spark, [(i, [1e30, 1.0], i % 2) for i in range(10)])


def test_no_rows_no_anchors_no_other_label(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5], 1), (2, [0.5], 2)]) == []
    assert mined(spark, [(5, [0.5], 1), (10, [0.5], 1), (15, [0.5], 1)]) == []
    assert mined(spark, [(5, [0.5], 1), (11, [0.5], 2)]) == []


def test_windows_are_the_integers_between():
    config = HardNegatives()
    for score in range(-300, 300):
        low, high = window_of(score, config)
        want = [n for n in range(-400, 400) if 50 * score <= 100 * n <= 95 * score]
        assert [n for n in range(-400, 400) if low <= n <= high] == want


def test_bounds_hold_and_dimensions_come_by_magnitude():
    rng = np.random.default_rng(5)
    columns = rng.integers(-50, 50, size=(10, 40)).astype(np.float64)
    block = Block(0, np.arange(40), np.zeros(40), columns, columns.min(axis=1), columns.max(axis=1))
    anchor = rng.integers(-50, 50, size=10)
    exact = anchor @ columns
    scan = Scan(anchor, block, columns, np.arange(40), 3)
    assert (np.diff(np.abs(anchor[scan.order])) <= 0).all()
    width = []
    for lower, upper in scan.steps():
        assert (lower <= exact[scan.alive]).all() and (exact[scan.alive] <= upper).all()
        width.append((upper - lower).max())
        scan.keep(upper >= np.sort(lower)[-5])
    assert width == sorted(width, reverse=True)
    assert set(np.argsort(-exact)[:5]) <= set(scan.alive) and len(scan.alive) < 40
    assert (scan.partial == exact[scan.alive]).all()


def test_best_keeps_the_first_by_score_and_id():
    rng = np.random.default_rng(6)
    best, seen = Best(4), []
    for _ in range(9):
        score, ids = rng.integers(0, 5, 7), rng.integers(0, 50, 7)
        best.offer(score, ids, ids)
        seen += list(zip(-score, ids))
        assert list(zip(-best.score, best.ids)) == sorted(seen)[:4]
