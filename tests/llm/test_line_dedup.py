import random

from casemesh.llm.line_dedup import LineDedup, drop_duplicate_lines, line_components
from helpers import clash, components, documents, similar_pairs
from test_line_shingles import shingles


def expected(ids, texts, percent=80):
    lines = {}
    for i, text in zip(ids, texts):
        for n, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.strip(" \t\r\f\v"):
                lines[i, n] = line.strip(" \t\r\f\v")
    first = {}
    for place in sorted(lines):
        first.setdefault(lines[place], place)
    sets = {place: shingles(line) for line, place in first.items()}
    groups = components(sets, similar_pairs(sets, percent))
    return {place: groups[first[line]] for place, line in lines.items()}


def texts_with_families(rng):
    lines = []
    for length, copies, edits in ((40, 25, 4), (12, 10, 1), (60, 30, 9), (3, 4, 1)):
        base = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(length)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(length)] = "".join(rng.choices("xyz", k=4))
            lines.append(" ".join(own))
    lines += [lines[0]] * 5 + ["", "  ", "日本語のとても長い行" * 3, "日本語のとても長い行" * 3, "!"]
    rng.shuffle(lines)
    return ["\n".join(lines[k : k + 6]) for k in range(0, len(lines), 6)]


def test_classes_are_those_of_all_pairs(spark):
    texts = texts_with_families(random.Random(5))
    got = line_components(clash(documents(spark, texts)), LineDedup(block=4)).collect()
    want = expected(range(len(texts)), texts)
    assert {(r["doc_id"], r["line_no"]): (r["first_doc"], r["first_line"]) for r in got} == want
    assert all(r["kept"] == (want[r["doc_id"], r["line_no"]] == (r["doc_id"], r["line_no"])) for r in got)


def test_texts_keep_first_lines_and_blank_lines(spark):
    long = "one line that is long enough to be told apart from others"
    texts = [f"{long}\n\nsecond", f" {long}\nthird\n", None, "", long, "plain"]
    docs = clash(documents(spark, texts, [0, 1, 2, 3, 4, None]))
    got = {r["doc_id"]: r["text"] for r in drop_duplicate_lines(docs).collect()}
    assert got == {0: f"{long}\n\nsecond", 1: "third\n", 2: None, 3: "", 4: "", None: "plain"}
    assert drop_duplicate_lines(docs).columns == docs.columns


def test_repeated_rows_and_no_rows(spark):
    docs = documents(spark, ["a line", "a line", "other words"], [1, 1, 2])
    assert drop_duplicate_lines(docs).where("text = 'a line'").count() == 2
    assert line_components(docs.limit(0)).count() == 0
    assert drop_duplicate_lines(docs.limit(0)).count() == 0


def test_very_long_lines_of_short_words(spark):
    texts = ["be " * 50_000, "be " * 50_000, "x" * 300_000, " ".join(f"word{n}" for n in range(30_000))]
    got = line_components(documents(spark, texts)).collect()
    assert sorted((r["doc_id"], r["first_doc"]) for r in got) == [(0, 0), (1, 0), (2, 2), (3, 3)]


def test_main_path_has_no_python(spark):
    docs = documents(spark, ["some line of words\nanother line"])
    plan = line_components(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
