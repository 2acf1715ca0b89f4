import numpy as np
import pytest
from pyspark.sql import functions as F

from casemesh.functions import vectors as vx
from casemesh.operators.cells import Layout, load_cells
from casemesh.operators.joins import join_unique
from casemesh.operators.evaluate import recall_against
from casemesh.operators.neighbours import (
    distance_percentile,
    k_nearest,
    links_within,
    pairs_within,
    prepare_cells,
    stop_share,
)
from casemesh.session import scratch_path

SMALL = Layout(block_rows=20, query_rows=15, broadcast_bytes=0)
LAYOUTS = [Layout(), SMALL]


def points(n=150, width=6, seed=1, clusters=5, zeros=3, copies=0):
    """Clustered vectors, so that cells can be skipped, with copies and zero vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width)) * 4
    x = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, width))
    x[: zeros] = 0.0
    if copies:
        x[-copies:] = x[n // 2]
    return np.round(x, 3)


def frame(spark, x, prefix=None):
    rows = [(f"{prefix}{i}" if prefix else i, [float(v) for v in row]) for i, row in enumerate(x)]
    kind = "string" if prefix else "long"
    return spark.createDataFrame(rows, f"id {kind}, embedding array<double>").repartition(5)


def distances(a, b, metric):
    if metric == "l2sq":
        return np.round(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1), 9)
    norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return np.round(1 - np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms > 0), 9)


def brute(a, b, k, metric, exclude_self=False, name=int):
    d = distances(a, b, metric)
    out = {}
    for i in range(len(a)):
        near = sorted((d[i, j], name(j)) for j in range(len(b)) if not (exclude_self and i == j))
        out[i] = [j for _, j in near[:k]]
    return out


def found(df, key="qid"):
    out = {}
    for r in df.orderBy(key, "rank").collect():
        out.setdefault(r[key], []).append(r["id"])
    return out


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
@pytest.mark.parametrize("layout", LAYOUTS)
def test_k_nearest_equals_brute_force(spark, metric, layout):
    x, q = points(copies=40), points(60, seed=2)
    queries = frame(spark, q).withColumnRenamed("id", "qid")
    got = k_nearest(queries, frame(spark, x), 3, query_id="qid", metric=metric, layout=layout)
    assert found(got) == brute(q, x, 3, metric)
    nearest = got.where("rank = 1").agg(F.sum("distance")).first()[0]
    assert abs(nearest - distances(q, x, metric).min(axis=1).sum()) < 1e-6


@pytest.mark.parametrize("layout", LAYOUTS)
def test_self_join_leaves_out_the_row_itself(spark, layout):
    x = points(120, copies=40)  # a third of the rows are one vector
    df = frame(spark, x).withColumnRenamed("id", "qid")
    got = k_nearest(
        df, frame(spark, x), 2, query_id="qid", exclude_self=True, layout=layout
    )
    assert found(got) == brute(x, x, 2, "l2sq", exclude_self=True)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_text_ids_and_ties_by_id(spark, layout):
    x = points(60, copies=30)
    queries = frame(spark, x[-2:]).withColumnRenamed("id", "qid")
    got = k_nearest(queries, frame(spark, x, "id_"), 4, query_id="qid", layout=layout)
    assert found(got) == brute(x[-2:], x, 4, "l2sq", name=lambda j: f"id_{j}")


@pytest.mark.parametrize("layout", LAYOUTS)
def test_small_and_empty_indexes(spark, layout):
    queries = frame(spark, points(10)).withColumnRenamed("id", "qid")
    two = frame(spark, points(2, zeros=0))
    got = k_nearest(queries, two, 5, query_id="qid", layout=layout)
    assert {len(v) for v in found(got).values()} == {2}
    assert k_nearest(queries, two.limit(0), 5, query_id="qid", layout=layout).count() == 0
    assert k_nearest(queries.limit(0), two, 5, query_id="qid", layout=layout).count() == 0


def test_probing_every_cell_is_exact_and_fewer_are_not_better(spark):
    x, q = points(200), points(50, seed=4)
    queries = frame(spark, q).withColumnRenamed("id", "qid")
    index = frame(spark, x)
    want = brute(q, x, 3, "l2sq")
    everything = k_nearest(queries, index, 3, query_id="qid", nprobe=99, layout=SMALL)
    assert found(everything) == want
    one = found(k_nearest(queries, index, 3, query_id="qid", nprobe=1, layout=SMALL))
    hits = sum(len(set(one.get(i, [])) & set(want[i])) for i in want)
    assert 0 < hits <= 150


def test_prepared_cells_answer_repeated_joins(spark):
    x, q = points(150, copies=50), points(30, seed=5)
    path = scratch_path(spark, "cells")
    prepare_cells(frame(spark, x), path, max_k=3, layout=SMALL)
    queries = frame(spark, q).withColumnRenamed("id", "qid")
    cells = load_cells(spark, path, SMALL)
    assert found(k_nearest(queries, cells, 3, query_id="qid")) == brute(q, x, 3, "l2sq")
    with pytest.raises(ValueError):
        k_nearest(queries, cells, 9, query_id="qid")
    with pytest.raises(ValueError):
        k_nearest(queries, cells, 2, query_id="qid", metric="cosine")


@pytest.mark.parametrize("metric,limit", [("cosine", 0.02), ("l2sq", 1.5)])
@pytest.mark.parametrize("layout", LAYOUTS)
def test_pairs_and_links_within_a_radius(spark, metric, limit, layout):
    x = points(140, copies=45)
    d = distances(x, x, metric)
    want = {(i, j) for i in range(140) for j in range(i + 1, 140) if d[i, j] <= limit}
    df = frame(spark, x)
    pairs = pairs_within(df, limit, metric=metric, layout=layout).collect()
    assert len(pairs) == len(want) and {(r.a, r.b) for r in pairs} == want
    links = [(r.a, r.b) for r in links_within(df, limit, metric=metric, layout=layout).collect()]
    assert all(a < b for a, b in links)
    assert components(links) == components(want)


def components(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_column_distances_agree(spark):
    x = points(20)
    df = frame(spark, x)
    both = df.select(F.col("id").alias("i"), F.col("embedding").alias("a")).join(
        df.select(F.col("id").alias("j"), F.col("embedding").alias("b")), F.col("j") >= F.col("i")
    )
    rows = both.select(
        "i", "j", vx.l2sq(F.col("a"), F.col("b")).alias("l"),
        vx.cosine_distance(F.col("a"), F.col("b")).alias("c"),
    ).collect()
    for metric, name in (("l2sq", "l"), ("cosine", "c")):
        d = distances(x, x, metric)
        assert max(abs(r[name] - d[r.i, r.j]) for r in rows) < 1e-6


def test_join_on_a_hot_key_and_on_no_key(spark):
    left = spark.range(900).select(
        "id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k")
    )
    right = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = {tuple(r) for r in left.join(right, "k", "left").select("id", "k", "v").collect()}
    for rows in (None, 900):
        got = join_unique(left, right, "k", hot_rows=50, left_rows=rows).select("id", "k", "v")
        assert got.count() == 900 and {tuple(r) for r in got.collect()} == plain
    inner = join_unique(left, right, "k", "inner", hot_rows=50)
    assert inner.count() == 600


def test_gate_percentile(spark):
    df = spark.range(1, 101).select((F.col("id") / 100).alias("distance"))
    assert distance_percentile(df, 0.9).first()["gate"] == 0.9


@pytest.mark.parametrize("vectors", [[[1.0, 2.0], [1.0]], [[1.0, None], [1.0, 2.0]]])
def test_ragged_vectors_are_refused(vectors):
    import pyarrow as pa

    from casemesh.operators.blocks import matrix_of

    with pytest.raises(ValueError):
        matrix_of(pa.array(vectors), "l2sq", "index")


def test_repeated_query_ids_and_probing_return_k_rows_each(spark):
    from casemesh.operators.neighbours import Layout, k_nearest

    rows = [(n, [float(n), float(n % 7)]) for n in range(60)]
    index = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = spark.createDataFrame(
        [("a", [1.0, 1.0]), ("a", [50.0, 1.0]), ("a", [1.0, 1.0])], "qid string, embedding array<double>"
    )
    few = Layout(block_rows=4, broadcast_bytes=0)

    def answers(**options):
        found = k_nearest(queries, index, 3, query_id="qid", **options).collect()
        return sorted((r["rank"], r["id"], r["distance"]) for r in found)

    assert len(answers()) == 9 and answers() == answers(layout=few)
    assert len(answers(layout=few, nprobe=1)) == 9


def test_the_size_of_the_index_is_that_of_all_rows(spark):
    from casemesh.operators.neighbours import _measure

    df = spark.createDataFrame([("a", []), ("bcd", [1.0] * 100)], "id string, vec array<double>")
    assert _measure(df) == (2, 804)


def test_share_to_stop_at_clears_the_target():
    rng = np.random.default_rng(4)
    query, needed = np.repeat(np.arange(300), 10), rng.uniform(0, 1, 3000) ** 2
    share = stop_share(needed, query, 0.9)
    assert 0.9 <= (needed <= share).mean() < 0.93
    assert stop_share(needed, query, 1.0) >= needed.max()
    assert stop_share(np.zeros(10), np.zeros(10, int), 0.9) < 1e-3
    assert stop_share(np.full(20, 2.0), np.arange(20), 0.9) == 1.0


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
@pytest.mark.parametrize("clusters", [1, 8])
def test_recall_is_the_parameter(spark, metric, clusters):
    x, q = points(900, width=10, clusters=clusters), points(300, width=10, seed=3, clusters=clusters)
    queries = frame(spark, q).withColumnRenamed("id", "qid")
    wide = {"query_id": "qid", "metric": metric}
    exact = k_nearest(queries, frame(spark, x), 5, **wide)
    got = k_nearest(queries, frame(spark, x), 5, recall=0.9, layout=SMALL, **wide)
    assert got.count() == 1500
    assert recall_against(exact, got, "qid").first()["recall"] >= 0.9
    cells = prepare_cells(frame(spark, x), metric=metric, layout=SMALL)
    again = k_nearest(queries, cells, 5, recall=0.9, **wide)
    assert recall_against(exact, again, "qid").first()["recall"] >= 0.9


def test_recall_needs_no_queries_and_excludes_nprobe(spark):
    x = frame(spark, points(50))
    none = x.limit(0).withColumnRenamed("id", "qid")
    assert k_nearest(none, x, 2, query_id="qid", recall=0.9, layout=SMALL).count() == 0
    with pytest.raises(ValueError):
        k_nearest(x, x, 2, recall=0.9, nprobe=2)


def test_what_leaves_the_tasks_does_not_grow_with_the_cells_visited(spark):
    """Every query visits every cell, and a task gives its k best and not k of each cell."""
    from casemesh.operators import cells as ce
    from casemesh.operators.blocks import k_nearest_in_block

    x = points(400, copies=40)
    index = prepare_cells(frame(spark, x), max_k=3, layout=Layout(block_rows=10, broadcast_bytes=0))
    assert len(index.stats["cell"]) > 10
    queries = frame(spark, x).select(
        F.col("id").alias("qkey"), F.col("id").alias("qid"), F.col("embedding").alias("vec")
    )
    visits = ce.Visits(index, probing=True)
    slices = ce.query_slices(queries, index, visits, 400, 3, nprobe=1000)
    schema = "qkey long, qid long, rank int, id long, distance double"
    found = ce.compare_slices(slices, 400, index, visits, k_nearest_in_block("l2sq", 3, False), schema, 3)
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
    _, parts = ce.tasks_of(400, index)
    assert found.count() == 3 * 400 * parts == 1200


def test_vectors_are_shuffled_and_stored_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("casemesh.session.scratch_root", lambda _: str(tmp_path))
    x = points(200, copies=20)
    queries = frame(spark, x).withColumnRenamed("id", "qid")
    got = k_nearest(queries, frame(spark, x), 2, query_id="qid", layout=SMALL)
    assert found(got) == brute(x, x, 2, "l2sq")
    tables = [
        path for path in tmp_path.rglob("*")
        if path.is_dir() and any(part.stat().st_size > 4000 for part in path.glob("*.parquet"))
    ]
    assert sorted(path.relative_to(tmp_path).parts[0].rsplit("-", 1)[0] for path in tables) == [
        "index-cells", "query-slices"
    ]


def test_copies_in_several_batches(spark):
    """Batches end within the copies of a vector, and a batch may hold nothing else."""
    x = points(120, copies=50)
    df = frame(spark, x).withColumnRenamed("id", "qid")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = k_nearest(df, frame(spark, x), 3, query_id="qid", exclude_self=True, layout=SMALL)
        assert found(got) == brute(x, x, 3, "l2sq", exclude_self=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
