"""How many of the links of all pairs the sketch finds, and what else it decides."""

import random

from casemesh.llm.line_dedup import line_components
from helpers import documents
from test_line_shingles import shingles


def similarity(one, two):
    return len(one & two) / len(one | two)


def edited(rng, base, edits, alphabet):
    own = list(base)
    for _ in range(edits):
        at = rng.randrange(len(own))
        own[at : at + rng.randrange(3)] = rng.choices(alphabet, k=rng.randrange(3))
    return "".join(own)


def prose(rng):
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(1, 11))) for _ in range(rng.randrange(8, 60))]
    return " ".join(words)


def unspaced(rng):
    return "".join(rng.choices("日月火水木金土年時分人口手足目耳", k=rng.randrange(60, 300)))


def pairs_near_the_threshold(make, alphabet, count, low, high):
    rng = random.Random(11)
    out = []
    while len(out) < count:
        base = make(rng)
        other = edited(rng, base, rng.randrange(1, 8), alphabet).strip()
        if low <= similarity(shingles(base), shingles(other)) < high:
            out.append((base, other))
    return out


def found(spark, pairs):
    lines = [line for pair in pairs for line in pair]
    first = {r["doc_id"]: r["first_doc"] for r in line_components(documents(spark, lines)).collect()}
    return sum(first[2 * n + 1] == first[2 * n] for n in range(len(pairs)))


def test_recall_near_the_threshold(spark):
    for make, alphabet in ((prose, "klmno "), (unspaced, "休体作図")):
        pairs = pairs_near_the_threshold(make, alphabet, 400, 0.8, 0.85)
        assert found(spark, pairs) >= 0.95 * len(pairs)
        pairs = pairs_near_the_threshold(make, alphabet, 300, 0.9, 1.0)
        assert found(spark, pairs) >= 0.99 * len(pairs)


def test_below_the_threshold_nothing_is_linked(spark):
    for make, alphabet in ((prose, "klmno "), (unspaced, "休体作図")):
        assert found(spark, pairs_near_the_threshold(make, alphabet, 200, 0.7, 0.8)) == 0
