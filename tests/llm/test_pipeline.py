import os

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from casemesh.llm.decontaminate import contaminated  # noqa: E402
from casemesh.llm.queries import QUERIES  # noqa: E402
from helpers import documents  # noqa: E402

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor"
FOREIGN = "schöne grüße aus der stadt und ein langer weg nach hause über die brücke"


@pytest.fixture
def folder(spark, tmp_path):
    texts = [f"{WORDS} number{n} " + " ".join(f"own{n}x{k}" for k in range(40)) for n in range(30)]
    langs = ["la"] * 30
    texts += [f"{FOREIGN} zahl{n} " + " ".join(f"öig{n}ü{k}" for k in range(40)) for n in range(30)]
    langs += ["de"] * 30
    texts[7] = texts[8]
    texts[9] += "\nshared closing line of several documents"
    texts[11] += "\nshared closing line of several documents"
    passage = " ".join(f"test{k}" for k in range(25))
    texts[13] += " " + passage
    texts += ["12345 !!", None]
    langs += ["de", None]
    documents(spark, texts, langs=langs).write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), texts


def test_stages_take_effect_and_keep_columns(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    everything = set(range(60))
    assert set(kept["language_id"]) == everything
    assert set(kept["line_dedup"]) == everything - {8}
    assert kept["line_dedup"][9].endswith("documents") and kept["line_dedup"][11] == texts[11].split("\n")[0]
    assert set(kept["minhash_near_dedup"]) == everything - {8}
    assert set(kept["benchmark_decontamination"]) == everything - {8, 13}
    packed = corpus_pipeline.run(spark, path)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == everything - {8, 13}


def test_stages_take_empty_tables(spark, folder):
    path, _ = folder
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0


def test_one_query_per_operator_and_registration():
    import __spark_entry__

    registered = __spark_entry__.queries()
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and registered["pipeline"] is corpus_pipeline.run
    assert set(QUERIES) <= set(registered)


SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")
def test_whole_items_in_documents_are_reported(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    holds = docs.alias("d").join(bench.alias("b"), F.expr("contains(d.text, b.text)"))
    want = {tuple(r) for r in holds.select("doc_id", "item_id").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}
    assert want and want <= got
