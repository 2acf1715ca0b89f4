"""What vector joins leave on disk: no table is shuffled to be read, no shuffle outlives its table."""

import time

import numpy as np
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from casemesh.checks import queries as checks
from casemesh.operators.cells import Layout
from casemesh.operators.neighbours import k_nearest
from casemesh.session import CLEANUP_CONF, shuffles_dropped


def shuffled_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    kept = [files.apply(n) for n in range(files.size())]
    return sum(file.length() for file in kept if file.getName().startswith("shuffle_"))


def settles_at(spark, most):
    """Shuffle files go a moment after the query that made them."""
    for _ in range(50):
        if shuffled_bytes(spark) <= most:
            return True
        time.sleep(0.1)
    return False


def vectors(spark, rows=300, width=4):
    x = np.random.default_rng(3).normal(size=(rows, width)).astype(float)
    rows = [(i, [float(v) for v in row], i % 3) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_shuffles_go_with_the_writing_of_their_tables(spark, monkeypatch):
    written, write = {}, DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        name = path.rsplit("/", 1)[-1].rsplit("-", 1)[0]
        written[name] = spark.conf.get(CLEANUP_CONF)
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    table = vectors(spark)
    layout = Layout(block_rows=20, query_rows=30, broadcast_bytes=0)
    near = k_nearest(table, table, 2, query_id="vec_id", index_id="vec_id", layout=layout)
    assert near.count() == 600
    assert {written[name] for name in ("chunks", "query-slices", "query-bounds")} == {"true"}


def test_a_written_table_leaves_no_shuffle(spark, tmp_path):
    before = shuffled_bytes(spark)
    with shuffles_dropped(spark):
        spark.range(100_000).select(F.rand(1).alias("x")).repartition(3).write.parquet(str(tmp_path / "t"))
    assert settles_at(spark, before)


def test_the_setting_is_put_back(spark):
    old = spark.conf.get(CLEANUP_CONF)
    with shuffles_dropped(spark):
        with shuffles_dropped(spark):
            assert spark.conf.get(CLEANUP_CONF) == "true"
        assert spark.conf.get(CLEANUP_CONF) == "true"
    assert spark.conf.get(CLEANUP_CONF) == old


def test_a_narrow_table_is_not_shuffled_for_each_reading(spark, tmp_path, monkeypatch):
    vectors(spark).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    read = []
    monkeypatch.setattr(checks, "k_nearest", lambda queries, index, *a, **k: read.append((queries, index)))
    for layout in (Layout(), checks.FEW_ROWS):
        checks._nearest_vectors(spark, str(tmp_path), 2, layout=layout)
    spread = [["Repartition" in df._jdf.queryExecution().logical().toString() for df in both] for both in read]
    assert spread == [[True, False], [False, False]]
