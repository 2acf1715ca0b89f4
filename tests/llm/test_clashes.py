"""Extra columns named like anything the operators use inside."""

import pathlib
import re

from pyspark.sql import functions as F

import casemesh.llm.disclosure as disclosure
import casemesh.llm.language_id as language_id
import casemesh.llm.line_dedup as line_dedup
import corpus_pipeline
from casemesh.llm.learning import fresh
from helpers import documents

OWN = {"doc_id", "text", "lang", "source", "n_chars"}


def internal_names():
    """Every quoted word of the modules that could be a column."""
    found = set()
    for module in (disclosure, language_id, line_dedup):
        source = pathlib.Path(module.__file__).read_text()
        found |= set(re.findall(r'"(_?[a-z][a-z0-9_]{0,20})"', source))
    found |= {f"_{name}" for name in found}
    return sorted(found - OWN)


def wide(docs):
    return docs.withColumns({name: F.lit(7.5) for name in internal_names()})


TEXTS = ["one line of words that repeats itself\nother", "one line of words that repeats itself", "mail ann@site.org now"]


def test_lines_keep_all_columns(spark):
    docs = wide(documents(spark, TEXTS))
    got = line_dedup.drop_duplicate_lines(docs)
    assert got.columns == docs.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[1]["text"] == "" and all(rows[0][name] == 7.5 for name in internal_names())


def test_sanitising_keeps_all_columns(spark):
    docs = wide(documents(spark, TEXTS))
    got = disclosure.sanitise(docs, disclosure.disclosure_spans(docs))
    assert got.columns == docs.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert "[EMAIL]" in rows[2]["text"] and all(rows[2][name] == 7.5 for name in internal_names())


def test_language_stage_keeps_values_of_the_user(spark):
    docs = wide(documents(spark, TEXTS, langs=["en"] * 3))
    got = corpus_pipeline.language_id(spark, docs, "")
    assert got.columns == docs.columns
    assert all(r["score"] == r["lang_pred"] == 7.5 for r in got.collect())
    assert fresh("score", docs.columns) not in docs.columns
