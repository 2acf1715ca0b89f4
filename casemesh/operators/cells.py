"""An index cut into cells around pivot vectors, and stored in chunks of bounded size.

Queries, ordered by their nearest pivot, are stored in slices, entries, ordered by cell, in
chunks. Slices and chunks meet in a Cartesian product, which reads both tables where they
lie: no vector is shuffled or written per cell it is compared with. A pair is passed on only
if the triangle inequality leaves some cell of the chunk open to some query of the slice, and
within it only the open cells of each query count.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemesh.operators.blocks import best_of, matrix_of, square_distances, strips_of, tightened
from casemesh.session import materialize, scratch_path, shuffles_dropped, small_batches

# Numbers in the vectors of one slice of queries and of one chunk of the index.
SLICE_NUMBERS = 1 << 20
CHUNK_NUMBERS = 1 << 20
# Bytes of vectors in a partition of either side, and multiplications in a task.
PART_BYTES = 64 << 20
TASK_WORK = 1 << 35
# Results of a slice that are held until they are reduced to the best.
HELD_RESULTS = 1 << 20
# Bounds (20 bytes a query) of so many queries are broadcast; more meet in a shuffle.
BROADCAST_BOUNDS = 2_000_000
# Slack of the pruning test, far above rounding noise.
SLACK = 1e-6
# What the pivots, which the driver holds and every executor gets, may take as doubles.
PIVOT_BYTES = 64 << 20


@dataclass(frozen=True)
class Layout:
    """Sizes that bound one task's share of a join."""

    # Entries of a cell, on average, and queries compared at once.
    block_rows: int = 4096
    query_rows: int = 8192
    max_cells: int = 16_384
    # An index of at most so many bytes is sent to every executor instead.
    broadcast_bytes: int = 64 << 20


@dataclass(frozen=True)
class CellIndex:
    """A prepared index: chunks of entries ``ids, vec, cell, radius`` (Arrow streams) with
    figures of their cells, pivots, and figures per cell.

    ``depth`` is how many ids sharing one vector were kept, so the largest k it answers.
    """

    chunks: DataFrame
    id_type: str
    pivots: np.ndarray
    stats: dict[str, np.ndarray]
    metric: str
    depth: int
    layout: Layout


def _first_copies(batch: pa.RecordBatch, depth: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The ``depth`` smallest ids of each vector of a batch, vectors in a row, and where each begins.

    Ties go to the smaller id, so no later copy can appear in an answer: this loses nothing,
    and a vector shared by a third of all rows shrinks to a few rows a batch. Vectors are known
    by 128 bits of hash.
    """
    order = pc.sort_indices(batch, [(name, "ascending") for name in ("h", "g", "id")])
    batch = batch.take(order)
    h, g = batch["h"].to_numpy(), batch["g"].to_numpy()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    place = np.arange(len(h))
    keep = place - np.maximum.accumulate(np.where(new, place, 0)) < depth
    return batch.filter(pa.array(keep)), np.flatnonzero(new[keep])


def _choose_pivots(index: DataFrame, rows: int, metric: str, layout: Layout) -> np.ndarray:
    """Distinct index vectors, chosen by hashed id: one per block's worth of rows, and no
    more than ``max_cells`` or than fit ``PIVOT_BYTES``."""
    width = index.select(F.size("vec")).first()[0]
    cells = min(math.ceil(rows / layout.block_rows), PIVOT_BYTES // (8 * max(width, 1)))
    cells = max(1, min(cells, layout.max_cells))
    # A hash threshold leaves about twice as many rows as are needed, and only they are ordered.
    scale = 1 << 40
    share = min(1.0, (2 * cells + 100) / rows)
    few = index.where(F.pmod(F.xxhash64("id"), F.lit(scale)) < int(scale * share))
    chosen = few.orderBy(F.xxhash64("id"), "id").limit(cells).select("vec").toArrow()["vec"]
    return np.unique(matrix_of(chosen, metric, "index"), axis=0)


def _by_strips(batches, pivots: np.ndarray, metric: str, side: str):
    """Each batch in parts, with the distances of its vectors to all pivots: small matrices
    however many pivots there are."""
    for batch in batches:
        vectors = matrix_of(batch["vec"], metric, side)
        for strip in strips_of(len(vectors), len(pivots)):
            part = batch.slice(strip.start, strip.stop - strip.start)
            yield part, np.sqrt(square_distances(vectors[strip], pivots))


def _with_home(index: DataFrame, pivots, metric: str, depth: int | None) -> DataFrame:
    """``index`` (``id, vec, h, g``) with the nearest pivot ``cell`` and the distance ``radius``
    to it; copies beyond ``depth`` in a batch go."""
    schema = T.StructType(
        index.schema.fields
        + [T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())]
    )

    def assign(batches):
        if depth is not None:
            batches = (_first_copies(batch, depth)[0] for batch in batches if batch.num_rows)
        for batch, to_pivot in _by_strips(batches, pivots.value, metric, "index"):
            cell = to_pivot.argmin(axis=1)
            radius = to_pivot[np.arange(len(cell)), cell]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(radius)],
                names=[*batch.schema.names, "cell", "radius"],
            )

    return index.mapInArrow(assign, schema)


def _cell_stats(chunks: DataFrame) -> dict[str, np.ndarray]:
    """Rows and radius range per cell: at most ``max_cells`` rows, whatever the index holds."""
    rows = chunks.select(F.explode(F.arrays_zip("chunk_cells", "n", "low", "high")).alias("c"))
    rows = rows.groupBy(F.col("c.chunk_cells").alias("cell")).agg(
        F.sum("c.n").alias("n"), F.min("c.low").alias("low"), F.max("c.high").alias("high")
    )
    found = rows.orderBy("cell").toPandas()
    return {name: found[name].to_numpy() for name in ("cell", "n", "low", "high")}


def _stream_of(part: pa.RecordBatch) -> bytes:
    # Compressed, as vectors of texts hold many zeros.
    sink, packing = pa.BufferOutputStream(), pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, part.schema, options=packing) as stream:
        stream.write_batch(part)
    return sink.getvalue().to_pybytes()


def _table_of(stream: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(stream.as_buffer()).read_all()


def _parts(rows: int, width: int) -> int:
    return max(1, math.ceil(rows * width * 8 / PART_BYTES))


CHUNK = "chunk_cells array<int>, n array<long>, low array<double>, high array<double>, chunk binary"


def _packed_entries(homed: DataFrame, rows: int, width: int, depth: int | None) -> DataFrame:
    """Entries of neighbouring cells as Arrow streams, with the figures of their cells.

    A batch that ends within the copies of a vector makes two entries of it, each with
    its smallest ids.
    """
    step = max(1, CHUNK_NUMBERS // width)

    def entries_of(batch: pa.RecordBatch) -> pa.Table:
        if depth is None:
            starts = np.arange(batch.num_rows)
        else:
            batch, starts = _first_copies(batch, depth)
        offsets = pa.array(np.append(starts, batch.num_rows).astype(np.int32))
        firsts = batch.take(pa.array(starts)).select(["vec", "cell", "radius"])
        entries = pa.Table.from_batches([firsts])
        entries = entries.add_column(0, "ids", pa.ListArray.from_arrays(offsets, batch["id"]))
        return entries.sort_by("cell").combine_chunks()

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            entries = entries_of(batch)
            for at in range(0, entries.num_rows, step):
                part = entries.slice(at, step).combine_chunks().to_batches()[0]
                radius = part["radius"].to_numpy()
                cells, first, n = np.unique(
                    part["cell"].to_numpy(), return_index=True, return_counts=True
                )
                low, high = np.minimum.reduceat(radius, first), np.maximum.reduceat(radius, first)
                figures = [pa.array([cells], pa.list_(pa.int32())), pa.array([n], pa.list_(pa.int64()))]
                figures += [pa.array([values], pa.list_(pa.float64())) for values in (low, high)]
                yield pa.RecordBatch.from_arrays(
                    [*figures, pa.array([_stream_of(part)], pa.binary())],
                    ["chunk_cells", "n", "low", "high", "chunk"],
                )

    # Copies have one hash, so they meet in a partition, and those of a cell lie in a row.
    dealt = homed.repartitionByRange(_parts(rows, width), "cell", "h")
    return dealt.sortWithinPartitions("cell", "h", "g").mapInArrow(pack, CHUNK)


def cells_of_ids(cells: CellIndex) -> DataFrame:
    """``id, cell`` of all entries."""

    def unpack(batches):
        for batch in batches:
            for stream in batch["chunk"]:
                table = _table_of(stream)
                ids = table["ids"].combine_chunks()
                cell = table["cell"].combine_chunks().take(pc.list_parent_indices(ids))
                yield pa.RecordBatch.from_arrays([ids.flatten(), cell], ["id", "cell"])

    return cells.chunks.select("chunk").mapInArrow(unpack, f"id {cells.id_type}, cell int")


def build_cells(
    index: DataFrame,
    rows: int,
    metric: str,
    depth: int | None,
    layout: Layout = Layout(),
    path: str | None = None,
) -> CellIndex:
    """Cuts ``index`` (``id, vec``) into cells; kept at ``path`` it serves many joins.

    Vectors are shuffled once, and stored once. With ``depth=None`` copies of a vector stay
    entries of their own.
    """
    spark = index.sparkSession
    pivots = _choose_pivots(index, rows, metric, layout)
    known = "vec" if depth is not None else "id"
    hashed = index.select(
        "id", "vec", F.xxhash64(known).alias("h"), F.xxhash64(F.lit(1), known).alias("g")
    )
    kept = path or scratch_path(spark, "index-cells")
    homed = _with_home(hashed, spark.sparkContext.broadcast(pivots), metric, depth)
    packed = _packed_entries(homed, rows, pivots.shape[1], depth)
    with shuffles_dropped(spark):
        packed.write.parquet(f"{kept}/chunks")
    id_type = index.schema["id"].dataType.simpleString()
    if path is not None:
        table = pa.table({"cell": np.arange(len(pivots)), "pivot": list(pivots)})
        spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/pivots")
        facts = [(metric, depth or 1, id_type)]
        facts = spark.createDataFrame(facts, "metric string, depth int, id_type string")
        facts.coalesce(1).write.parquet(f"{path}/facts")
    chunks = spark.read.schema(packed.schema).parquet(f"{kept}/chunks")
    return CellIndex(chunks, id_type, pivots, _cell_stats(chunks), metric, depth or 1, layout)


def load_cells(spark: SparkSession, path: str, layout: Layout = Layout()) -> CellIndex:
    chunks = spark.read.schema(CHUNK).parquet(f"{path}/chunks")
    pivots = spark.read.parquet(f"{path}/pivots").orderBy("cell").toArrow()["pivot"]
    facts = spark.read.parquet(f"{path}/facts").first()
    return CellIndex(
        chunks, facts["id_type"], matrix_of(pivots, "l2sq", "index"), _cell_stats(chunks),
        facts["metric"], facts["depth"], layout,
    )


# --- which cells a query must visit -----------------------------------------------------


def useful_distance(to_pivot: np.ndarray, stats: dict, need: int) -> np.ndarray:
    """The distance no answer of a query lies beyond, as the cell radii alone guarantee it
    for ``need`` entries."""
    full = stats["n"] >= need
    if not full.any():
        return np.full(len(to_pivot), np.inf)
    return (to_pivot + stats["high"])[:, full].min(axis=1)


def probed_distance(to_pivot: np.ndarray, stats: dict, need: int, nprobe: int) -> np.ndarray:
    """How far the pivots of the nearest ``nprobe`` cells are, and of more cells where those
    hold fewer than ``need`` entries."""
    near = np.argsort(to_pivot, axis=1, kind="stable")
    enough = (np.cumsum(stats["n"][near], axis=1) < need).sum(axis=1) + 1
    last = np.minimum(np.maximum(nprobe, enough), near.shape[1]) - 1
    rows = np.arange(len(near))
    return to_pivot[rows, near[rows, last]]


def cell_gaps(to_pivot, pivots, stats: dict, nearest, home_pivots) -> np.ndarray:
    """How far from each query each cell begins, at least: by its radii, and by the plane
    between the query's own pivot and that of the cell, beyond which its entries lie."""
    gap = np.maximum(to_pivot - stats["high"], stats["low"] - to_pivot)
    between = 2.0 * np.sqrt(square_distances(home_pivots, pivots))
    ahead = to_pivot**2 - nearest[:, None] ** 2
    beyond = np.divide(ahead, between, out=np.zeros_like(ahead), where=between > SLACK)
    return np.maximum(gap, beyond, out=gap)


class Visits:
    """Tells which of some cells each query visits; used inside tasks.

    Queries have ``home``, the place of their nearest pivot, its distance ``nearest``, and
    ``reach``: the largest useful distance, or with ``probing`` that of the last pivot to be
    looked at. A ``share`` below 1 leaves out cells that begin further away than that share
    of the reach, but never the query's own.
    """

    def __init__(self, cells: CellIndex, probing: bool = False, share: float = 1.0, home_only: bool = False):
        places = cells.stats["cell"]
        self.pivots = cells.chunks.sparkSession.sparkContext.broadcast(cells.pivots[places])
        self.stats, self.metric = cells.stats, cells.metric
        self.probing, self.share, self.home_only = probing, share, home_only

    def of(self, queries: dict, places: np.ndarray) -> np.ndarray:
        """A row per query, a column per cell (``places`` among the cells with entries)."""
        home = queries["home"][:, None] == places[None, :]
        if self.home_only:
            return home
        pivots = self.pivots.value
        to_pivot = np.sqrt(square_distances(queries["vec"], pivots[places]))
        reach = queries["reach"][:, None]
        if self.probing:
            return home | (to_pivot <= reach + SLACK)
        stats = {name: values[places] for name, values in self.stats.items()}
        gap = cell_gaps(to_pivot, pivots[places], stats, queries["nearest"], pivots[queries["home"]])
        return home | (gap <= self.share * reach + SLACK)

    def cells_of(self, queries: dict) -> np.ndarray:
        """All cells that some of the queries visit."""
        ids = self.stats["cell"]
        if self.home_only:
            return ids[np.unique(queries["home"])]
        places, open_to = np.arange(len(ids)), np.zeros(len(ids), dtype=bool)
        for strip in strips_of(len(queries["vec"]), len(ids)):
            open_to |= self.of({k: v[strip] for k, v in queries.items()}, places).any(axis=0)
        return ids[open_to]


def _queries_of(table, metric: str) -> dict:
    found = {name: table[name].to_numpy() for name in ("home", "nearest", "reach")}
    return found | {"vec": matrix_of(table["vec"], metric, "query")}


def query_slices(
    queries: DataFrame,
    cells: CellIndex,
    visits: Visits,
    rows: int,
    need: int = 1,
    nprobe: int | None = None,
    radius: float | None = None,
) -> DataFrame:
    """``slice, cells, data``: the queries with ``home, nearest, reach``, ordered by their
    nearest pivot, in slices (Arrow streams), each with the cells it visits."""
    metric, stats, pivots = cells.metric, cells.stats, visits.pivots
    added = [("home", T.IntegerType()), ("nearest", T.DoubleType()), ("reach", T.DoubleType())]
    schema = T.StructType(queries.schema.fields + [T.StructField(*field) for field in added])

    def settle(batches):
        for part, to_pivot in _by_strips(batches, pivots.value, metric, "query"):
            home = to_pivot.argmin(axis=1)
            if radius is not None:
                reach = np.full(len(home), float(radius))
            elif nprobe is not None:
                reach = probed_distance(to_pivot, stats, need, nprobe)
            else:
                reach = useful_distance(to_pivot, stats, need)
            nearest = to_pivot[np.arange(len(home)), home]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(home.astype(np.int32)), pa.array(nearest), pa.array(reach)],
                names=schema.fieldNames(),
            )

    width = cells.pivots.shape[1]
    step = max(1, min(cells.layout.query_rows, SLICE_NUMBERS // width))

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield _slice_row(part["qkey"][0].as_py(), visits.cells_of(_queries_of(part, metric)), part)

    left, _ = tasks_of(rows, cells)
    dealt = queries.mapInArrow(settle, schema).repartitionByRange(left, "home", F.xxhash64("qkey"))
    packed = dealt.sortWithinPartitions("home").mapInArrow(pack, SLICE)
    with shuffles_dropped(queries.sparkSession):
        return materialize(packed, "query-slices")


SLICE = "slice long, cells array<int>, data binary"


def _slice_row(key: int, cells: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([key], pa.int64()),
            pa.array([cells], pa.list_(pa.int32())),
            pa.array([_stream_of(part)], pa.binary()),
        ],
        ["slice", "cells", "data"],
    )


BOUNDED = "slice long, cells array<int>, reach array<double>"


def bounded_slices(slices: DataFrame, bounds: DataFrame, rows: int, cells: CellIndex, visits: Visits) -> DataFrame:
    """The slices with the ``reach`` of their queries cut to ``bounds`` (``slice, qkey, bound``),
    and the cells that are left. Vectors are not written again."""
    metric = cells.metric

    def beside(small: DataFrame) -> DataFrame:
        return F.broadcast(small) if rows <= BROADCAST_BOUNDS else small

    of_slice = bounds.groupBy("slice").agg(
        F.collect_list(F.struct("qkey", "bound")).alias("bounds")
    )

    def cut(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                table = _table_of(batch["data"][row])
                queries = _queries_of(table, metric)
                known = batch["bounds"][row].values
                if known is not None:
                    keys = table["qkey"].to_numpy()
                    order = np.argsort(keys)
                    at = order[np.searchsorted(keys, known.field("qkey").to_numpy(), sorter=order)]
                    reach = queries["reach"].copy()
                    reach[at] = np.minimum(reach[at], known.field("bound").to_numpy())
                    queries["reach"] = reach
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["slice"].slice(row, 1),
                        pa.array([visits.cells_of(queries)], pa.list_(pa.int32())),
                        pa.array([queries["reach"]], pa.list_(pa.float64())),
                    ],
                    ["slice", "cells", "reach"],
                )

    joined = slices.join(beside(of_slice), "slice", "left").select("slice", "data", "bounds")
    with small_batches(slices.sparkSession):
        bounded = materialize(joined.mapInArrow(cut, BOUNDED), "query-reach")
    return slices.drop("cells").join(beside(bounded), "slice")


def unpacked(slices: DataFrame) -> pa.Table:
    """The rows of a few bounded slices, on the driver."""
    found = slices.select("data", "reach").toArrow()
    tables = []
    for stream, reach in zip(found["data"], found["reach"]):
        table = _table_of(stream)
        tables.append(table.set_column(table.schema.get_field_index("reach"), "reach", reach.values))
    return pa.concat_tables(tables)


def tasks_of(rows: int, cells: CellIndex) -> tuple[int, int]:
    """Partitions of slices and of chunks: bounded bytes in each, bounded work in each pair."""
    width, entries = cells.pivots.shape[1], int(cells.stats["n"].sum())
    right = _parts(entries, width)
    work = rows * entries * (width + 64)
    left = max(_parts(rows, width), math.ceil(work / (right * TASK_WORK)))
    return max(1, min(left, math.ceil(rows / 256))), right


def fits_a_part(rows: int, cells: CellIndex) -> bool:
    """Whether queries and entries are few enough to be in a task together."""
    width = cells.pivots.shape[1]
    return _parts(rows, width) == _parts(int(cells.stats["n"].sum()), width) == 1


def compare_slices(
    slices: DataFrame, rows: int, cells: CellIndex, visits: Visits, compare, schema: str,
    k: int | None = None, carry_slice: bool = False,
) -> DataFrame:
    """What ``compare`` finds for each slice in the chunks it visits.

    The product reads both tables as they are stored, so nothing but results is shuffled.
    With ``k``, results of a slice are reduced to the best k of each query before they leave
    the task; ``carry_slice`` adds the slice they are from.
    """
    left, right = tasks_of(rows, cells)
    metric, ids = cells.metric, cells.stats["cell"]
    # With cells left out on purpose, what bounds the answers may be in one of those.
    limited = not (visits.probing or visits.home_only) and visits.share >= 1.0
    pairs = (
        slices.coalesce(left).hint("shuffle_replicate_nl")
        .join(cells.chunks.coalesce(right), F.arrays_overlap("cells", "chunk_cells"))
        .select("slice", "data", "chunk", *[c for c in slices.columns if c == "reach"])
    )
    if carry_slice:
        schema = f"slice long, {schema}"

    def meet(table, queries, entries):
        cell_places, of_row = np.unique(
            np.searchsorted(ids, entries["cell"].to_numpy()), return_inverse=True
        )
        seen = visits.of(queries, cell_places)
        rows_met, cells_met = seen.any(axis=1), seen.any(axis=0)
        if not rows_met.any():
            return None
        if not rows_met.all():
            table, seen = table.filter(pa.array(rows_met)), seen[rows_met]
        if not cells_met.all():
            columns = cells_met[of_row]
            entries, of_row = entries.filter(pa.array(columns)), of_row[columns]
        entries = entries.drop_columns(["cell", "radius"])
        limit = queries["worst"][rows_met] if k is not None else None
        return compare(table, entries, None if seen[:, cells_met].all() else seen, of_row, limit)

    def run(batches):
        current, table, queries, held, count = None, None, None, [], 0

        def reduced():
            found = pa.concat_tables(held)
            found = best_of(found, k) if k is not None else found
            if carry_slice:
                found = found.add_column(0, "slice", pa.array(np.full(found.num_rows, current)))
            return found

        for batch in batches:
            for row in range(batch.num_rows):
                key = batch["slice"][row].as_py()
                if key != current:
                    if held:
                        yield from reduced().to_batches()
                    held, count, current = [], 0, key
                    table = _table_of(batch["data"][row])
                    queries = _queries_of(table, metric)
                    if "reach" in batch.schema.names:
                        queries["reach"] = batch["reach"][row].values.to_numpy()
                    if k is not None:
                        order = np.argsort(table["qkey"].to_numpy())
                        keys = table["qkey"].to_numpy()[order]
                        queries["worst"] = queries["reach"] if limited else np.full(len(order), np.inf)
                found = meet(table, queries, _table_of(batch["chunk"][row]))
                if found is None or not found.num_rows:
                    continue
                held.append(found)
                count += found.num_rows
                if k is not None:
                    # Nothing beyond the k-th of what a query has can be among its nearest.
                    worst = queries["worst"].copy()
                    worst[order] = tightened(worst[order], keys, found, k, metric)
                    queries["worst"] = worst
                    if limited:
                        queries["reach"] = worst
                if count >= HELD_RESULTS:
                    if k is None:
                        yield from reduced().to_batches()
                        held, count = [], 0
                    else:
                        held = [best_of(pa.concat_tables(held), k)]
                        count = held[0].num_rows
        if held:
            yield from reduced().to_batches()

    return pairs.mapInArrow(run, schema)
