"""Operators on workers that cannot import this package."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from casemesh.llm.learning import fresh, settled
from helpers import documents

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF_DIR = "/root/testdata/sf0.001"

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false")
    .config("spark.executor.memory", "800m").config("spark.checkpoint.dir", {scratch!r})
    .config("spark.sql.shuffle.partitions", "4").getOrCreate()
)

def importable(rows):
    for _ in rows:
        try:
            import casemesh  # noqa: F401
            yield 1
        except ModuleNotFoundError:
            yield 0

assert spark.sparkContext.parallelize([1], 1).mapPartitions(importable).collect() == [0]
from casemesh.llm.queries import QUERIES
for name in {names!r}:
    assert QUERIES[name](spark, {sf_dir!r}).count() > 0, name
print("all ran")
"""


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")
def test_workers_need_no_package(tmp_path):
    names = [
        "op5_quality_classifier", "op6_toxicity", "op8_benchmark_decontamination", "op10_language_id",
        "op11_token_files", "op12_bond_hard_negatives", "op13_token_alignment",
    ]
    script = tmp_path / "job.py"
    scratch = f"file://{tmp_path}/scratch"
    script.write_text(textwrap.dedent(SCRIPT.format(root=ROOT, scratch=scratch, names=names, sf_dir=SF_DIR)))
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=600
    )
    assert "all ran" in done.stdout, done.stderr[-3000:]


def test_fresh_names_are_not_taken():
    taken = ["_gone", "_GONE_", "text"]
    assert fresh("gone", taken).lower() not in {c.lower() for c in taken}
    assert fresh("other", taken) == "_other"


def test_settled_keeps_the_result_alone(spark):
    from casemesh.session import materialize, scratch_root

    made = []

    def build():
        inner = materialize(documents(spark, ["a", "b"]), "inner-table")
        made.append(inner.inputFiles()[0])
        return inner.where(F.col("doc_id") == 1)

    kept = settled(spark, "outer-table", build)
    assert [r["text"] for r in kept.collect()] == ["b"]
    assert not os.path.exists(made[0].removeprefix("file://")) and scratch_root(spark)
