import random
import re

from pyspark.sql import functions as F

from casemesh.functions import text as tx
from casemesh.functions.hashing import is_held_out

WORDS = ["fire", "burn", "pipe"]


def column(spark, values, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i long, t string").repartition(3)
    return [r[1] for r in sorted(df.select("i", expression.alias("x")).collect())]


def random_texts(n=400, seed=7):
    rng = random.Random(seed)
    pieces = ["fire", "Fire", "burn", "burnt", "pipe", "pipeline", "é", "_", "-", " ", "\n", "\t",
              "　", " ", "\x1c", "3", "日本", "!", ".", "Error:", "x"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) for _ in range(n)]


def test_blank_is_what_strip_leaves_nothing_of(spark):
    texts = random_texts() + ["", " ", "  ", "​", "\x1d\x1e\x1f", "\x85", None]
    got = column(spark, texts, tx.is_blank(F.col("t")))
    assert got == [t is None or t.strip() == "" for t in texts]


def test_gibberish_and_error(spark):
    texts = random_texts() + ["!!! ???", "日本語", "Error: x", " Error: x", "", None]
    got = column(spark, texts, tx.is_gibberish(F.col("t")))
    assert got == [not re.search("[a-zA-Z0-9]", t or "") for t in texts]
    got = column(spark, texts, tx.is_error(F.col("t")))
    assert got == [(t or "").startswith("Error:") for t in texts]
    any_script = column(spark, ["日本語", "!!"], tx.is_gibberish(F.col("t"), r"\p{L}\p{N}"))
    assert any_script == [False, True]


def test_keywords_match_whole_words_like_word_boundaries(spark):
    texts = random_texts()
    got = column(spark, texts, tx.keyword_any(F.col("t"), WORDS))
    want = [any(re.search(rf"\b{w}\b", t.lower()) for w in WORDS) for t in texts]
    assert got == want and any(want) and not all(want)


def test_keywords_with_symbols_and_long_lists(spark):
    texts = ["see #top now", "x#top", "c++ code", "c++x", "a.b", "aXb", "say \\E end"]
    words = ["#top", "c++", "a.b", "\\E"]
    got = column(spark, texts, tx.keyword_any(F.col("t"), words))
    want = [any(re.search(rf"\b{re.escape(w.lower())}\b", t.lower()) for w in words) for t in texts]
    assert got == want
    many = [f"word{i}" for i in range(50)]
    assert column(spark, ["has word49.", "word", "word490"], tx.keyword_any(F.col("t"), many)) == [
        True, False, False,
    ]
    assert column(spark, ["anything"], tx.keyword_any(F.col("t"), [])) == [False]


def test_numbers_are_formatted_as_python_does(spark):
    rng = random.Random(3)
    values = [2.25, 0.35, 1.45, 0.05, 0.0, 12.0, 1234.56, 0.25, 1.55, 2.0] + [
        rng.uniform(0, 2000) for _ in range(200)
    ]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select(
        "x", tx.days_label(F.col("x")).alias("d"), tx.distance_label(F.col("x")).alias("e")
    ).collect()
    assert all(r.d == f"{r.x:.1f} Days" and r.e == f"{r.x:.4f}" for r in rows)


def test_forced_eta_wins(spark):
    df = spark.createDataFrame([("0.1 Days", 3.0), (None, 3.0)], "f string, x double")
    got = [r[0] for r in df.select(tx.eta_label(F.col("f"), F.col("x"))).collect()]
    assert got == ["0.1 Days", "3.0 Days"]


def test_held_out_rows_do_not_depend_on_partitioning(spark):
    ids = spark.range(4000)
    one = {r.id for r in ids.repartition(1).where(is_held_out(F.col("id"))).collect()}
    many = {r.id for r in ids.repartition(7).where(is_held_out(F.col("id"))).collect()}
    assert one == many and 0.22 < len(one) / 4000 < 0.28
