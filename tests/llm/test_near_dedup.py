import random

import numpy as np
import pytest

from casemesh.llm.near_dedup import NearDedup, least_agreements, links_between, near_duplicates, plausible
from helpers import WORD, clash, components, documents, similar_pairs


def shingle_set(text, width):
    own = WORD.findall((text or "").lower())
    if len(own) < width:
        return frozenset([tuple(own)] if own else [])
    return frozenset(tuple(own[i : i + width]) for i in range(len(own) - width + 1))


def expected(ids, texts, config):
    sets = {i: shingle_set(t, config.width) for i, t in zip(ids, texts)}
    groups = components(sets, similar_pairs(sets, config.similarity))
    return {i: (len(s), groups[i], groups[i] == i) for i, s in sets.items()}


def family(rng, size, edits, length=90):
    """A text and copies of it that differ from it, and more from each other."""
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = [" ".join(base)]
    for _ in range(size - 1):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(length)] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("config", [NearDedup(), NearDedup(width=3, similarity=85, block=4)])
def test_classes_are_those_of_all_pairs(spark, config):
    rng = random.Random(config.width)
    texts = []
    for size, edits in ((1, 0), (30, 3), (40, 8), (5, 1), (12, 5)):
        texts += family(rng, size, edits)
    texts += [texts[3]] * 6 + [None, "", " \n ", "short", "Short", "short one", texts[9].upper()]
    rng.shuffle(texts)
    ids = [n * 3 for n in range(len(texts))]
    got = near_duplicates(clash(documents(spark, texts, ids)), config).collect()
    want = expected(ids, texts, config)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want


def test_repeated_missing_and_no_rows(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "x", "a b c d e f"], [5, 5, None, 2])
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_duplicates(docs).collect())
    assert got == [(-1, None, True), (2, 2, True), (5, 2, False), (5, 2, False)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_pruning_keeps_what_reaches_the_threshold():
    config = NearDedup(similarity=85)
    rng = np.random.default_rng(1)
    left = rng.integers(0, 2**32, (2000, config.values), dtype=np.uint32)
    right = np.where(rng.random(left.shape) < 0.85, left, left + np.uint32(1))
    assert len(plausible(left, right, config)) == 2000
    far = np.where(rng.random(left.shape) < 0.4, left, left + np.uint32(1))
    assert len(plausible(left, far, config)) == 0
    assert [m for m, _ in least_agreements(config)] == list(range(24, 145, 24))


def test_blocks_link_each_pair_of_components_once():
    config = NearDedup(bands=2, rows=1, batch=1, similarity=50)
    sets = [np.arange(10, dtype=np.uint64), np.arange(9, dtype=np.uint64), np.arange(50, 60, dtype=np.uint64)]
    sign = np.ones((3, 2), dtype=np.uint32)
    block = np.array([4, 7, 9]), np.array([4, 7, 9]), sign, sets
    assert links_between(block, block, config) == [(7, 4)]


def test_ids_with_different_texts_are_one_document_whatever_the_layout(spark):
    base = " ".join(f"w{n}" for n in range(60))
    other = " ".join(f"x{n}" for n in range(40))
    texts = [base, other, other, base, None, other + " y"]
    ids = [7, 7, 3, 2, 7, 9]
    for partitions in (1, 2, 5):
        rows = near_duplicates(documents(spark, texts, ids, partitions=partitions)).collect()
        # The smaller set of id 7 counts for all of its rows.
        assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [
            (2, 2), (3, 3), (7, 3), (7, 3), (7, 3), (9, 3),
        ]
