import random

import pytest
from pyspark.sql import functions as F

from casemesh.llm.line_dedup import LineDedup, line_components, shingle_hashes, sketch_hashes, with_bands
from helpers import clash, components, documents, similar_pairs


def shingles(line, width=12):
    """Brute force over all positions."""
    return frozenset(line[i : i + width] for i in range(max(1, len(line) - width + 1)))


def expected(lines, percent=80):
    sets = {(n, 0): shingles(line) for n, line in enumerate(lines)}
    return {n: first for (n, _), (first, _) in components(sets, similar_pairs(sets, percent)).items()}


def got(spark, lines):
    found = line_components(clash(documents(spark, lines))).collect()
    return {r["doc_id"]: r["first_doc"] for r in found}


def test_lines_that_differ_between_long_words_both_stay(spark):
    lines = [
        "Answers: 10 22 31 44 done",
        "Answers: 10 95 77 63 done",
        "government is in the US capital",
        "government is on the US capital",
        "Station 11 42 17 18 90 23 54 61 77",
        "Station 11 42 95 36 90 23 54 61 77",
    ]
    assert got(spark, lines) == {n: n for n in range(len(lines))} == expected(lines)


def test_sets_are_those_of_all_positions(spark):
    rng = random.Random(3)
    lines = ["a", "twelve chars", "eleven char", "a\rb", "日本語" * 9, "🙂" * 3 + "x" * 20]
    lines += ["".join(rng.choices("ab \r\u2028é", k=rng.randrange(5, 60))) for _ in range(40)]
    rows = spark.createDataFrame([(n, line) for n, line in enumerate(lines)], "n int, line string")
    sizes = rows.select("n", F.size(shingle_hashes(F.col("line"), LineDedup())).alias("size")).collect()
    assert {r["n"]: r["size"] for r in sizes} == {n: len(shingles(line)) for n, line in enumerate(lines)}


@pytest.mark.parametrize("alphabet", ["日月火水木金土年時分", "abcdefghij0123456789"])
def test_shifted_copies_without_spaces_are_found(spark, alphabet):
    rng = random.Random(4)
    lines = []
    for _ in range(8):
        base = "".join(rng.choices(alphabet, k=200))
        lines += [base, base[1:], "x" + base, base[:3] + base[4:], base[:9] + "y" + base[9:]]
    want = expected(lines)
    assert want == {n: n - n % 5 for n in range(len(lines))}
    assert got(spark, lines) == want


def test_edited_words_match_brute_force(spark):
    rng = random.Random(8)
    lines = []
    for _ in range(40):
        base = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(30)]
        for edits in (0, 1, 1):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(30)] = "xyz"
            lines.append(" ".join(own))
    assert got(spark, lines) == expected(lines)


def test_bands_begin_behind_fixed_points(spark):
    rows = spark.createDataFrame([(" ".join(f"word{n * n}" for n in range(40)),)], "line string")
    config = LineDedup()
    sketch = rows.select(sketch_hashes(F.col("line"), config).alias("own"), F.lit(1).alias("n"))
    row = sketch.join(with_bands(sketch, config), "n").first()
    own, step = row["own"], (1 << 64) // config.bands
    starts = {sum(h < n * step - (1 << 63) for h in own) % len(own) for n in range(config.bands)}
    ring = own + own[: config.rows]
    slices = spark.createDataFrame([ring[i : i + config.rows] for i in starts], "a long, b long, c long, d long")
    assert set(row["bands"]) == {r[0] for r in slices.select(F.xxhash64("a", "b", "c", "d")).collect()}


def test_sketches_begin_at_words_and_inside_long_runs(spark):
    rng = random.Random(6)
    lines = ["a", "two words", "日本語" * 9, "x" * 40 + " y", "a  b\tc \u2028d", "end of a very-long-run-of-characters so"]
    lines += ["".join(rng.choices("abc  日", k=rng.randrange(1, 80))).strip() or "x" for _ in range(40)]

    def anchored(line):
        blank = " \t\n\x0b\f\r"
        runs = [0] * len(line)
        for at in range(1, len(line)):
            runs[at] = 0 if line[at - 1] in blank else runs[at - 1] + 1
        return {
            line[at : at + 12] for at in range(len(line))
            if line[at] not in blank and (runs[at] == 0 or runs[at] >= 12)
        }

    rows = spark.createDataFrame([(n, line) for n, line in enumerate(lines)], "n int, line string")
    got = rows.select("n", sketch_hashes(F.col("line"), LineDedup()).alias("own")).collect()
    pieces = [(n, piece) for n, line in enumerate(lines) for piece in anchored(line)]
    want: dict = {}
    for n, code in spark.createDataFrame(pieces, "n int, s string").select("n", F.xxhash64("s")).collect():
        want.setdefault(n, set()).add(code)
    assert {r["n"]: set(r["own"]) for r in got} == want
