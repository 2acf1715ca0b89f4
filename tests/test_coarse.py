"""Nearest entries by single precision first: the same answers, and bounds that travel from block to block."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter

from casemesh.operators import blocks as bl
from casemesh.operators import cells as ce
from casemesh.operators.cells import Layout
from casemesh.operators.neighbours import k_nearest
from casemesh.session import BATCH_BYTES, BATCH_CONF


def column(x):
    return pa.array([list(map(float, row)) for row in x], pa.list_(pa.float64()))


def sides(draw, scale, crowd):
    """Points of which many are as good as equal, and queries near them."""
    x = draw.normal(size=(150, 24))
    x[40 : 40 + crowd] = x[39] + draw.normal(size=(crowd, 24)) * 1e-8
    x[100:110] = x[0]
    queries = np.concatenate([x[:45] + draw.normal(size=(45, 24)) * 1e-3, draw.normal(size=(20, 24)), np.zeros((1, 24))])
    left = {"qkey": np.arange(66), "qid": np.arange(66), "vec": column(queries * scale)}
    return pa.table(left), pa.table({"ids": pa.array([[i] for i in range(150)]), "vec": column(x * scale)})


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
@pytest.mark.parametrize("scale", [1.0, 1e-20, 1e-3, 1e6, 1e17])
@pytest.mark.parametrize("crowd", [3, 55])
def test_single_precision_changes_no_answer(monkeypatch, metric, scale, crowd):
    draw = np.random.default_rng([crowd, 5])
    left, right = sides(draw, scale, crowd)
    seen, group = draw.random((66, 3)) < 0.7, np.arange(150) % 3
    for k, self_too in ((1, False), (3, True)):
        compare = bl.k_nearest_in_block(metric, k, self_too)
        for shown, of in ((None, None), (seen, group)):
            found = []
            for limit in (bl.SINGLE_LIMIT, 0.0):
                monkeypatch.setattr(bl, "SINGLE_LIMIT", limit)
                found.append(compare(left, right, shown, of))
                monkeypatch.undo()
            assert found[0].equals(found[1]) and found[0].num_rows > 60
            # With the distance of the last as a limit nothing is lost.
            last = bl.tightened(np.full(66, np.inf), np.arange(66), found[0], k, metric)
            assert compare(left, right, shown, of, last).equals(found[0])


def vectors(spark):
    x = np.random.default_rng(3).normal(size=(300, 4))
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<float>")


def test_a_limit_leaves_out_what_is_further(spark):
    """What a block found bounds what the next ones may give."""
    draw = np.random.default_rng(9)
    left, right = sides(draw, 1.0, 3)
    compare = bl.k_nearest_in_block("l2sq", 2, False)
    first = compare(left, right.slice(0, 75))
    limit = bl.tightened(np.full(66, np.inf), np.arange(66), first, 2, "l2sq")
    second = compare(left, right.slice(75), limit=limit)
    assert second.num_rows < 0.75 * first.num_rows
    whole = bl.best_of(pa.concat_tables([first, second]), 2)
    assert whole.equals(bl.best_of(compare(left, right), 2))


def test_slices_and_chunks_go_to_python_in_small_batches(spark, monkeypatch):
    sent, write = {}, DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        sent[path.rsplit("/", 1)[-1].rsplit("-", 1)[0]] = spark.conf.get(BATCH_CONF)
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    monkeypatch.setattr(ce, "SLICE_NUMBERS", 400)
    monkeypatch.setattr(ce, "PART_BYTES", 3000)
    table = vectors(spark)
    near = k_nearest(table, table, 2, layout=Layout(block_rows=20, query_rows=30, broadcast_bytes=0))
    assert near.count() == 600
    assert {sent[name] for name in ("query-bounds", "query-reach", "nearest-of-chunks")} == {str(BATCH_BYTES)}
