import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from casemesh.llm.decontaminate import Decontamination, benchmark_blocks, contaminated, tile, windows
from casemesh.llm.disclosure import base_spans, disclosure_spans, generalise, mail_spans, sanitise
from casemesh.llm.host_rules import HostRules, apply_host_rules, beta_prior
from casemesh.llm.url_reputation import UrlRule, judge_urls
from helpers import WORD, clash, documents

MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


# Host rules


def measured(text):
    text = text or ""
    own = WORD.findall(text)
    windows_of = Counter(zip(own, own[1:], own[2:]))
    marked = set()
    for n in range(len(own) - 2):
        if windows_of[tuple(own[n : n + 3])] > 1:
            marked |= {n, n + 1, n + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(marked),
    )


def test_measures_and_host_verdicts(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["a", "bé", "#x", "日", "d\n", "e"], k=rng.randrange(80))) for _ in range(60)]
    good = " ".join(f"word{n}" for n in range(60))
    texts += [good] * 40 + ["x"] * 40 + [good, None, ""]
    sources = ["mixed"] * 60 + ["fine"] * 40 + ["bad"] * 40 + ["bad", None, None]
    rows = apply_host_rules(
        clash(documents(spark, texts, sources=sources)), HostRules(max_rate=0.9)
    ).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts)
    for n, text in enumerate(texts):
        own = measured(text)
        r = got[n]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == own
        assert r["base_failed"] == (own[0] < 50 or 2 * own[4] > own[0])
    assert got[60]["kept"] and not got[100]["kept"]
    assert not got[140]["base_failed"] and got[140]["host_rate"] > 0.9 and got[140]["kept"] is False
    assert apply_host_rules(documents(spark, ["a"]).limit(0)).count() == 0


def test_prior_is_strong_where_hosts_do_not_differ():
    alpha, beta = beta_prior(3, 300.0, 30.0, 30000.0, 3.0, 10000.0)
    assert (round(alpha), round(beta)) == (1000, 9000)
    alpha, beta = beta_prior(2, 200.0, 100.0, 20000.0, 81 + 1, 10000.0)
    assert alpha == beta and alpha + beta < 3


# Url filters


def test_rules_and_reputation(spark):
    rules = (
        UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"),
        UrlRule("block", "example.org", "/en/1"),
    )
    urls = [
        None, "", "no scheme", "http://A.Example.ORG/es/x?q", "https://example.org/en/12", "http://x.org",
        "http://org/", "http://notexample.org/es/1", "http://bad.spam.net/1", "http://good.spam.net/#/es/",
        "http://new.spam.net/?a=/", "http://ok.com/a#b?c", "x://h/p://q",
    ]
    urls += ["http://bad.spam.net/1"] * 40 + ["http://ok.com/2"] * 40
    pages = spark.createDataFrame([(n, u, "") for n, u in enumerate(urls)], "page_id long, url string, html string")
    labels = spark.createDataFrame(
        [(n, int("bad" in (u or ""))) for n, u in enumerate(urls) if n > 8] + [(3, None), (None, 1)],
        "page_id long, bad int",
    )
    got = {r["page_id"]: tuple(r)[1:5] for r in judge_urls(clash(pages), labels, rules).collect()}
    assert len(got) == len(urls)
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[4] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[5] == ("x.org", "", None, "allow")
    assert got[6] == ("org", "/", "org/", "allow")
    assert got[7] == ("notexample.org", "/es/1", "org/", "allow")
    assert got[8][3] == "block" and got[9] == ("good.spam.net", "/", None, got[9][3])
    assert got[11] == ("ok.com", "/a", None, "allow") and got[12][:2] == ("h", "/p://q")
    assert judge_urls(pages.limit(0), labels, rules).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, labels.limit(0), ()).collect()} == {"allow"}


# Decontamination


def slow_tiles(item, doc, least):
    free_item, free_doc = [True] * len(item), [True] * len(doc)
    covered = 0
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while (
                    i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k]
                    and free_item[i + k] and free_doc[j + k]
                ):
                    k += 1
                if k >= least and (best is None or (-k, i, j) < best):
                    best = (-k, i, j)
        if best is None:
            return covered
        for k in range(-best[0]):
            free_item[best[1] + k] = free_doc[best[2] + k] = False
        covered -= best[0]


@given(st.lists(st.integers(0, 4), max_size=18), st.lists(st.integers(0, 4), max_size=30))
@settings(max_examples=150, deadline=None)
def test_tiles_are_the_longest_first(item, doc):
    own = tile(np.array(item, np.uint64), np.array(doc, np.uint64), 3) if item and doc else []
    assert sum(t[2] for t in own) == slow_tiles(item, doc, 3)
    for i, j, length in own:
        assert item[i : i + length] == doc[j : j + length]


@given(st.lists(st.integers(0, 3), min_size=1, max_size=20), st.integers(1, 12))
@settings(max_examples=100, deadline=None)
def test_window_codes_name_windows(tokens, length):
    code = windows(np.array(tokens, np.uint64) * np.uint64(977) + np.uint64(5), length)
    assert len(code) == max(0, len(tokens) - length + 1)
    for a in range(len(code)):
        for b in range(a):
            assert (code[a] == code[b]) == (tokens[a : a + length] == tokens[b : b + length])


def test_passages_are_found_in_any_order(spark):
    rng = random.Random(8)
    item = [f"q{n}" for n in range(30)]
    noise = [f"n{rng.randrange(999)}" for _ in range(200)]
    texts = [
        " ".join(noise + item), " ".join(item[15:] + noise + item[:15]), " ".join(noise + item[:20]),
        " ".join(item).upper().replace(" ", ", "), None, "", " ".join(noise), " ".join(item[:15] * 9),
    ]
    docs = clash(documents(spark, texts))
    bench = spark.createDataFrame(
        [(1, " ".join(item)), (2, "too short"), (3, None), (None, " ".join(item)), (4, " ".join(item))],
        "item_id long, text string",
    )
    for block in (10, 10**6):
        rows = contaminated(docs, bench, Decontamination(block_tokens=block)).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(d, i) for d in (0, 1, 3) for i in (1, 4)]
        assert all(r["coverage"] == 1.0 for r in rows)
    assert len(list(benchmark_blocks(bench, Decontamination(block_tokens=10)))) == 2
    assert contaminated(docs, bench.limit(0)).count() == 0
    assert contaminated(docs.limit(0), bench).count() == 0


# Disclosure


@given(st.text("a@.-+ 1é\n", max_size=40))
@settings(max_examples=300, deadline=None)
def test_mail_spans_are_those_of_the_pattern(text):
    assert mail_spans(text) == [m.span() for m in MAIL.finditer(text)]


def test_base_spans():
    text = "é x@y.co 1.2.3.4 1.2.3.256 4111 1111-1111 1111 4111111111111112 +1 (202) 555-0100 +123"
    kinds = [(k, text[a:b]) for k, a, b in base_spans(text)]
    assert kinds == [
        ("email", "x@y.co"), ("ip", "1.2.3.4"), ("card", "4111 1111-1111 1111"),
        ("phone", "+1 (202) 555-0100"),
    ] or ("email", "x@y.co") in kinds
    assert base_spans("") == [] and base_spans("1" * 5000) == []


def test_disclosing_terms_and_sanitised_text(spark):
    rng = random.Random(6)
    common = [f"c{n}" for n in range(20)]
    texts = [" ".join(rng.choices(common, k=12)) for _ in range(60)]
    for n in range(5):
        texts[n] += " from Zorblax 77 reach ann@site.org " + rng.choice(common) + " Zorblax"
    texts += [None, "", "ann@site.org", texts[0]]
    docs = documents(spark, texts, [*range(63), 0])
    found = disclosure_spans(clash(docs)).collect()
    assert len(found) == len(texts)
    by_id = {r["doc_id"]: r for r in found}
    text = texts[1]
    added = {text[s["start"] : s["end"]] for s in by_id[1]["spans"] if s["kind"] == "term"}
    assert added >= {"Zorblax", "from", "77", "reach"} and not added & set(common)
    assert len([s for s in by_id[1]["spans"] if text[s["start"] : s["end"]] == "Zorblax"]) == 2
    assert [s["kind"] for s in by_id[1]["base"]] == ["email"]
    assert by_id[60]["spans"] == by_id[61]["spans"] == []
    starts = [(s["start"], s["end"]) for s in by_id[1]["spans"]]
    assert starts == sorted(starts)
    one = docs.where("doc_id = 1")
    clean = sanitise(one, disclosure_spans(docs).where("doc_id = 1")).first()["text"]
    assert "Zorblax" not in clean and "[EMAIL]" in clean and "[NUMBER]" in clean
    assert disclosure_spans(docs.limit(0)).count() == 0


def test_generalise_merges_overlaps():
    assert generalise("abcdef", [("card", 1, 4), ("phone", 2, 5), ("term", 5, 6)]) == "a[CARD]"
