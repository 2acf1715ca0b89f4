"""Exact and approximate vector joins: k nearest, all within a radius, linked groups.

No pair of rows is ever a row of its own. A small index (its size is checked) goes to
every executor and the queries stay where they are. A larger one is cut into cells and
stored in chunks (see ``cells``), which meet stored slices of the queries in a product.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casemesh.operators import cells as ce
from casemesh.operators.blocks import (
    DECIMALS,
    best_of,
    k_nearest_in_block,
    links_in_block,
    matrix_of,
    pairs_in_block,
    square_distances,
    tightened,
)
from casemesh.operators.cells import CHUNK_NUMBERS, CellIndex, Layout
from casemesh.operators.joins import join_unique
from casemesh.session import materialize, materialize_counted, shuffles_dropped, small_batches

METRICS = ("l2sq", "cosine")
# Queries whose exact answers tell how far others have to look, and how many standard errors
# below its mean their recall must still reach the target.
RECALL_QUERIES = 400
RECALL_ERRORS = 2.0
BYTES_PER_NUMBER = 8


def _vectors(df: DataFrame, key: str, vec: str, alias: str) -> DataFrame:
    return df.where(F.col(vec).isNotNull()).select(
        F.col(key).alias(alias), F.col(vec).alias("vec")
    )


def _measure(index: DataFrame) -> tuple[int, int]:
    """Rows of ``index`` (``id, vec``), and their bytes with vectors counted as doubles."""
    size = F.sum(F.size("vec") * BYTES_PER_NUMBER + F.octet_length(F.col("id").cast("string")))
    found = index.agg(F.count(F.lit(1)).alias("rows"), size.alias("bytes")).first()
    return found["rows"], found["bytes"] or 0


def _against_broadcast(
    queries: DataFrame, index: DataFrame, compare, schema: str, layout: Layout,
    k: int | None = None, metric: str = "l2sq",
) -> DataFrame:
    """Compares the queries, partition by partition, with an index sent to every executor.

    The index is compared block by block, so a task holds one block as numbers; with ``k``
    the best of the blocks are put together before they leave the task.
    """
    rows_here = index.toArrow().combine_chunks()
    width = len(rows_here["vec"][0]) if rows_here.num_rows else 1
    block_rows, query_rows = max(1, CHUNK_NUMBERS // max(width, 1)), layout.query_rows
    whole = index.sparkSession.sparkContext.broadcast(rows_here)

    def run(batches):
        table = whole.value
        index_blocks = [table.slice(at, block_rows) for at in range(0, table.num_rows, block_rows)]
        for batch in batches:
            for at in range(0, batch.num_rows, query_rows):
                part = pa.Table.from_batches([batch.slice(at, query_rows)])
                if k is None:
                    for block in index_blocks:
                        yield from compare(part, block).to_batches()
                elif index_blocks:
                    part = part.add_column(0, "qkey", pa.array(np.arange(part.num_rows)))
                    keys, found = np.arange(part.num_rows), []
                    limit = np.full(part.num_rows, np.inf)
                    for block in index_blocks:
                        found.append(compare(part, block, limit=limit))
                        limit = tightened(limit, keys, found[-1], k, metric)
                    best = best_of(pa.concat_tables(found), k) if len(found) > 1 else found[0]
                    yield from best.drop_columns(["qkey"]).to_batches()

    return queries.mapInArrow(run, schema)


# --- k nearest ---------------------------------------------------------------------


def prepare_cells(
    index: DataFrame,
    path: str | None = None,
    *,
    index_id: str = "id",
    index_vec: str = "embedding",
    metric: str = "l2sq",
    max_k: int = 10,
    layout: Layout = Layout(),
) -> CellIndex:
    """Cuts a large index once, for joins that come again and again (a stream's batches)."""
    right = _vectors(index, index_id, index_vec, "id")
    return ce.build_cells(right, right.count(), metric, max_k + 1, layout, path)


def k_nearest(
    queries: DataFrame,
    index: DataFrame | CellIndex,
    k: int = 2,
    *,
    query_id: str = "id",
    query_vec: str = "embedding",
    index_id: str = "id",
    index_vec: str = "embedding",
    metric: str = "l2sq",
    exclude_self: bool = False,
    nprobe: int | None = None,
    recall: float | None = None,
    layout: Layout = Layout(),
) -> DataFrame:
    """The k nearest index entries of every query: ``query_id, rank, id, distance``.

    Exact by default; ``nprobe`` looks only into that many nearest cells. With ``recall``
    each query stops by its own evidence: it leaves out cells that begin beyond a share of
    the k-th distance it has already, and that share is fitted on the exact answers of a
    hashed sample of the queries, so that the share of exact matches found is ``recall`` at
    least. An index small enough to be broadcast is searched exactly all the same. Ties are broken
    by ``index_id``. Each query row has its own answer, ids that repeat included. Both
    inputs may be read more than once: hand in
    tables, or ``materialize`` what is costly to derive.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if recall is not None and (nprobe is not None or not 0.0 < recall <= 1.0):
        raise ValueError("recall is a share, and instead of nprobe")
    left = _vectors(queries, query_id, query_vec, "qid")
    depth = k + 1 if exclude_self else k
    compare = k_nearest_in_block(metric, k, exclude_self)
    qid_type = left.schema["qid"].dataType.simpleString()

    if isinstance(index, CellIndex):
        if index.metric != metric or index.depth < depth:
            raise ValueError(f"cells were prepared for {index.metric}, k < {index.depth}")
        schema = f"qid {qid_type}, rank int, id {index.id_type}, distance double"
        found = _through_cells(left, index, k, depth, nprobe, recall, compare, schema)
    else:
        right = _vectors(index, index_id, index_vec, "id")
        id_type = right.schema["id"].dataType.simpleString()
        schema = f"qid {qid_type}, rank int, id {id_type}, distance double"
        rows, size = _measure(right)
        if nprobe is None and size <= layout.broadcast_bytes:
            single = right.select(F.array("id").alias("ids"), "vec")
            found = _against_broadcast(left, single, compare, schema, layout, k, metric)
        elif rows == 0:
            found = left.sparkSession.createDataFrame([], schema)
        else:
            cells = ce.build_cells(right, rows, metric, depth, layout)
            found = _through_cells(left, cells, k, depth, nprobe, recall, compare, schema)
    return found.select(F.col("qid").alias(query_id), "rank", "id", "distance")


def _through_cells(left, cells: CellIndex, k, depth, nprobe, recall, compare, schema) -> DataFrame:
    # Rows are told apart by a number of their own; it is written with the slices.
    rows = left.count()
    left = left.withColumn("qkey", F.monotonically_increasing_id())
    schema = f"qkey long, {schema}"
    if nprobe is not None:
        visits = ce.Visits(cells, probing=True)
        slices = ce.query_slices(left, cells, visits, rows, depth, nprobe=nprobe)
        return _best_of(slices, rows, cells, visits, k, compare, schema)
    share = 1.0
    if recall is not None:
        share = _fitted_share(left, rows, cells, k, depth, recall, compare, schema)
    slices, visits = _bounded(left, rows, cells, k, depth, compare, schema, share)
    return _best_of(slices, rows, cells, visits, k, compare, schema)


def _best_of(slices, rows, cells: CellIndex, visits, k: int, compare, schema: str) -> DataFrame:
    partial = ce.compare_slices(slices, rows, cells, visits, compare, schema, k)
    if not ce.fits_a_part(rows, cells):
        # Every pair holds a slice and a chunk, so few of them are sent to Python at once.
        with shuffles_dropped(slices.sparkSession), small_batches(slices.sparkSession):
            partial = materialize(partial, "nearest-of-chunks")
    ranked = Window.partitionBy("qkey").orderBy("distance", "id")
    merged = partial.withColumn("rank", F.row_number().over(ranked))
    return merged.where(F.col("rank") <= k).drop("qkey")


def _fitted_share(queries, rows, cells: CellIndex, k, depth, recall, compare, schema) -> float:
    """The smallest share of their useful distance that sampled queries could have stopped at.

    The sample and its answers, at most ``RECALL_QUERIES`` times k rows, come to the driver.
    """
    scale = 1 << 40
    chosen = F.pmod(F.xxhash64("qkey", F.lit(2)), F.lit(scale))
    few = queries.where(chosen < int(scale * min(1.0, 2 * RECALL_QUERIES / max(rows, 1))))
    few = materialize(few.orderBy(chosen, "qkey").limit(RECALL_QUERIES), "recall-queries")
    slices, visits = _bounded(few, RECALL_QUERIES, cells, k, depth, compare, schema)
    exact = ce.compare_slices(slices, RECALL_QUERIES, cells, visits, compare, schema, k)
    ranked = Window.partitionBy("qkey").orderBy("distance", "id")
    exact = exact.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    with small_batches(queries.sparkSession):
        exact = materialize(exact.select("qkey", "id"), "recall-answers")
    wanted = F.broadcast(exact.select("id").distinct())
    homes = ce.cells_of_ids(cells).join(wanted, "id", "left_semi")
    found = exact.join(F.broadcast(homes), "id").toPandas()
    if not len(found):
        return 1.0
    sample = ce.unpacked(slices)
    pivots = cells.pivots[cells.stats["cell"]]
    vectors = matrix_of(sample["vec"], cells.metric, "query")
    to_pivot = np.sqrt(square_distances(vectors, pivots))
    home = to_pivot.argmin(axis=1)
    own = np.arange(len(home))
    gap = ce.cell_gaps(to_pivot, pivots, cells.stats, to_pivot[own, home], pivots[home])
    gap = np.maximum(gap, 0.0)
    gap[own, home] = 0.0
    reach = sample["reach"].to_numpy()
    row = {key: n for n, key in enumerate(sample["qkey"].to_pylist())}
    place = {cell: n for n, cell in enumerate(cells.stats["cell"].tolist())}
    at = found["qkey"].map(row).to_numpy(), found["cell"].map(place).to_numpy()
    needed = gap[at] / np.maximum(reach[at[0]], ce.SLACK)
    return stop_share(needed, at[0], recall)


def stop_share(needed: np.ndarray, query: np.ndarray, recall: float) -> float:
    """The smallest share with which enough answers are found: ``needed`` is what each answer
    asks for, ``query`` whose it is. The mean over the queries has to clear the target by
    ``RECALL_ERRORS`` standard errors."""
    _, query = np.unique(query, return_inverse=True)
    all_of = np.bincount(query)
    for share in np.unique(np.clip(needed, 0.0, 1.0)):
        found = np.bincount(query, needed <= share + ce.SLACK) / all_of
        error = found.std(ddof=1) / np.sqrt(len(found)) if len(found) > 1 else 0.0
        if found.mean() - RECALL_ERRORS * error >= recall:
            return float(share) + ce.SLACK
    return 1.0


def _bounded(queries, rows, cells: CellIndex, k, depth, compare, schema, share: float = 1.0):
    """Slices whose queries reach no further than the k-th distance in their nearest cell,
    and what they visit.

    Any k entries bound the answer from above; those of the nearest cell do so tightly,
    which is what lets the second pass skip cells. Fewer than k leave the bound open.
    """
    home = ce.Visits(cells, home_only=True)
    slices = ce.query_slices(queries, cells, home, rows, depth)
    seen = ce.compare_slices(slices, rows, cells, home, compare, schema, k, carry_slice=True)
    scale = 2.0 if cells.metric == "cosine" else 1.0
    # A cell that lies in several chunks may give several bounds, and the least one holds.
    bound = seen.where(F.col("rank") == k).groupBy("slice", "qkey").agg(
        F.sqrt(F.min("distance") * scale).alias("bound")
    )
    visits = ce.Visits(cells, share=share)
    with shuffles_dropped(queries.sparkSession), small_batches(queries.sparkSession):
        bound = materialize(bound, "query-bounds")
    return ce.bounded_slices(slices, bound, rows, cells, visits), visits


# --- within a radius ---------------------------------------------------------------


def _self_join(df, id_col, vec_col, metric, limit, layout, compare, schema) -> DataFrame:
    left = _vectors(df, id_col, vec_col, "qid")
    right = _vectors(df, id_col, vec_col, "id")
    rows, size = _measure(right)
    if size <= layout.broadcast_bytes:
        single = right.select(F.array("id").alias("ids"), "vec")
        return _against_broadcast(left, single, compare, schema, layout)
    cells = ce.build_cells(right, rows, metric, None, layout)
    radius = math.sqrt(max(limit, 0.0) * (2.0 if metric == "cosine" else 1.0))
    numbered = left.withColumn("qkey", F.monotonically_increasing_id())
    visits = ce.Visits(cells)
    slices = ce.query_slices(numbered, cells, visits, rows, radius=radius)
    return ce.compare_slices(slices, rows, cells, visits, compare, schema)


def pairs_within(
    df: DataFrame,
    limit: float,
    *,
    id_col: str = "id",
    vec_col: str = "embedding",
    metric: str = "cosine",
    layout: Layout = Layout(),
) -> DataFrame:
    """All pairs of rows at most ``limit`` apart: ``a, b, distance`` with ``a < b``."""
    kind = df.schema[id_col].dataType.simpleString()
    compare = pairs_in_block(metric, round(limit, DECIMALS))
    schema = f"a {kind}, b {kind}, distance double"
    return _self_join(df, id_col, vec_col, metric, limit, layout, compare, schema)


def links_within(
    df: DataFrame,
    limit: float,
    *,
    id_col: str = "id",
    vec_col: str = "embedding",
    metric: str = "cosine",
    layout: Layout = Layout(),
) -> DataFrame:
    """Links ``a, b`` (``a < b``) whose connected groups are those of ``pairs_within``.

    Their number grows with rows times visited blocks, never with the number of pairs.
    """
    kind = df.schema[id_col].dataType.simpleString()
    compare = links_in_block(metric, round(limit, DECIMALS))
    return _self_join(df, id_col, vec_col, metric, limit, layout, compare, f"a {kind}, b {kind}")


# --- around a join -----------------------------------------------------------------


def with_payload(matches: DataFrame, index: DataFrame, index_id: str = "id") -> DataFrame:
    """Joins each match to its index row. Some case may match a large share of requests.

    The matches are written first: they are costly, and counting the hot ones reads them.
    """
    payload = index.withColumnRenamed(index_id, "id") if index_id != "id" else index
    with shuffles_dropped(matches.sparkSession):
        found, seen = materialize_counted(matches, "matches")
    return join_unique(found, payload, "id", "inner", left_rows=seen["rows"])


def distance_percentile(distances: DataFrame, share: float, column: str = "distance") -> DataFrame:
    """A gate tuned to an encoder: the distance that ``share`` of known cases stay within."""
    return distances.agg(F.percentile_approx(column, share, 10_000).alias("gate"))
