"""Hard negatives of anchor vectors, by vertical scans that drop candidates by bounds.

Vectors are cut into blocks stored by column: for every dimension the values of all rows of
the block, and their minimum and maximum. An anchor reads the dimensions of a block in the
descending order of its own magnitudes. After each step, the dimensions not yet read can add
no less and no more to a partial score than the block's minima and maxima allow; candidates
whose bounds can't reach the place they would have to take leave the bitmap, and what is
left after the last step has its exact score.

1. Positives: the ``positives`` best rows of the anchor's own label. A candidate goes when
   its upper bound is below the lower bound, or the score, of as many others.
2. Negatives: for each positive the ``negatives`` best rows of other labels whose scores lie
   between ``least`` and ``most`` hundredths of the positive's. A candidate goes when its
   bounds lie outside of every window, or below the rows that fill it already.

Anchors are the stated query set: they are sent to the tasks in chunks of at most
``anchor_rows``, and each task keeps the best of its own blocks, so a chunk costs a scan of
the stored columns and a few rows per anchor and task. Scores are integers and exact.

Defined cases: rows without id or label, without a vector, or with a component that is null
or not finite take no part; vectors of unequal width are filled up with zeros; rows that
repeat an id are rows of their own, as candidates and as anchors, and the row itself is never
its own positive; ties go to the smaller id, then to the row stored first; other columns are
ignored; an empty table gives no rows. Components too large for exact 64-bit scores raise
``OverflowError``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casemesh.session import materialize, materialize_counted

ROW_BITS = 36
EXACT_FLOAT = 1 << 52
EXACT_LONG = 1 << 62
BLOCKS_SCHEMA = (
    "first long, width int, kind string, ids array<long>, labels array<long>, "
    "asks array<boolean>, columns array<binary>, lows array<long>, highs array<long>"
)
ANCHORS_SCHEMA = "row long, anchor_id long, label long, vector array<long>"
POSITIVES_SCHEMA = "row long, positive_id long, positive_row long, positive_score long"
NEGATIVES_SCHEMA = "row long, place int, negative_id long, negative_row long, negative_score long"


class HardNegatives(NamedTuple):
    """``least`` and ``most`` are hundredths of a positive's score; components are multiplied
    by ``scale`` and rounded down; ``step`` dimensions are read between two looks."""

    positives: int = 5
    negatives: int = 3
    least: int = 50
    most: int = 95
    scale: int = 256
    step: int = 8
    block_rows: int = 16_384
    anchor_rows: int = 16_384


class Block(NamedTuple):
    """Rows sorted by label. ``columns[d]`` are the values of dimension ``d``."""

    first: int
    ids: np.ndarray
    labels: np.ndarray
    columns: np.ndarray
    lows: np.ndarray
    highs: np.ndarray


def quantised(vectors: DataFrame, is_anchor: Column, scale: int) -> DataFrame:
    """``vec_id, label, asks, vector`` of the rows that take part; components as integers."""

    def odd(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | F.coalesce(F.abs(x) == float("inf"), F.lit(False))

    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return vectors.where(
        "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL"
    ).where(~F.exists("embedding", odd)).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        whole.alias("vector"),
    )


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of a matrix, short ones filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _column_blocks(rows: DataFrame, config: HardNegatives) -> DataFrame:
    """The rows by column, in blocks of at most ``block_rows``."""

    def block(first: int, part: pa.Table) -> dict:
        part = part.sort_by([("label", "ascending"), ("vec_id", "ascending")]).combine_chunks()
        matrix = _matrix(part["vector"].chunk(0))
        lows, highs = matrix.min(axis=0), matrix.max(axis=0)
        kind = next(
            kind
            for kind in ("<i2", "<i4", "<i8")
            if not matrix.size
            or (lows.min() >= np.iinfo(kind).min and highs.max() <= np.iinfo(kind).max)
        )
        return {
            "first": first,
            "width": matrix.shape[1],
            "kind": kind,
            "ids": part["vec_id"].to_numpy(),
            "labels": part["label"].to_numpy(),
            "asks": part["asks"].to_numpy(),
            "columns": [matrix[:, d].astype(kind).tobytes() for d in range(matrix.shape[1])],
            "lows": lows,
            "highs": highs,
        }

    schema = pa.schema([
        ("first", pa.int64()), ("width", pa.int32()), ("kind", pa.string()),
        ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())),
        ("asks", pa.list_(pa.bool_())), ("columns", pa.list_(pa.binary())),
        ("lows", pa.list_(pa.int64())), ("highs", pa.list_(pa.int64())),
    ])

    def run(batches):
        first = TaskContext.get().partitionId() << ROW_BITS
        held, count = [], 0

        def cut(size: int) -> pa.RecordBatch:
            nonlocal held, count, first
            whole = pa.Table.from_batches(held)
            out = pa.RecordBatch.from_pylist([block(first, whole.slice(0, size))], schema)
            held = whole.slice(size).to_batches()
            first, count = first + size, count - size
            return out

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= config.block_rows:
                yield cut(config.block_rows)
        if count:
            yield cut(count)

    return rows.mapInArrow(run, BLOCKS_SCHEMA)


def _load(batch: pa.RecordBatch, row: int) -> Block:
    own = {name: batch.column(name)[row] for name in batch.schema.names}
    lows, highs = (np.array(own[name].values, dtype=np.int64) for name in ("lows", "highs"))
    ids, labels = (own[name].values.to_numpy(zero_copy_only=False) for name in ("ids", "labels"))
    columns = np.empty((own["width"].as_py(), len(ids)), dtype=np.dtype(own["kind"].as_py()))
    for d, values in enumerate(own["columns"].values):
        columns[d] = np.frombuffer(values.as_buffer(), dtype=columns.dtype)
    return Block(own["first"].as_py(), ids, labels, columns, lows, highs)


def _anchors(blocks: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for number in range(batch.num_rows):
                own = _load(batch, number)
                asks = np.flatnonzero(batch.column("asks")[number].values.to_numpy(zero_copy_only=False))
                vectors = own.columns[:, asks].T.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own.first + asks),
                        pa.array(own.ids[asks]),
                        pa.array(own.labels[asks]),
                        pa.array(list(vectors), pa.list_(pa.int64())),
                    ],
                    ["row", "anchor_id", "label", "vector"],
                )

    return blocks.mapInArrow(run, ANCHORS_SCHEMA)


def exact_kind(anchor: np.ndarray, block: Block) -> type:
    """The number type in which all sums of products are exact."""
    width = min(len(anchor), len(block.lows))
    if not width:
        return np.float64
    most = int(np.abs(anchor[:width]).max()) * max(
        abs(int(block.lows[:width].min())), abs(int(block.highs[:width].max()))
    )
    if most * width < EXACT_FLOAT:
        return np.float64
    if most * width < EXACT_LONG:
        return np.int64
    raise OverflowError("components are too large for exact scores")


class Scan:
    """The partial scores of one anchor with the candidates of a block, as bounds."""

    def __init__(self, anchor: np.ndarray, block: Block, columns: np.ndarray, alive: np.ndarray, step: int):
        width = min(len(anchor), len(columns))
        anchor = anchor[:width].astype(columns.dtype)
        self.columns, self.alive, self.step = columns, alive, step
        self.order = np.argsort(-np.abs(anchor), kind="stable")
        self.weights = anchor[self.order]
        least = (self.weights * block.lows[self.order]).astype(columns.dtype)
        most = (self.weights * block.highs[self.order]).astype(columns.dtype)
        none = np.zeros(1, dtype=columns.dtype)
        # What the dimensions from a place on can still add, at least and at most.
        self.rest_low = np.append(np.cumsum(np.minimum(least, most)[::-1])[::-1], none)
        self.rest_high = np.append(np.cumsum(np.maximum(least, most)[::-1])[::-1], none)
        self.partial = np.zeros(len(alive), dtype=columns.dtype)
        self.read = 0

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Lower and upper bounds of the candidates still alive, before each further step."""
        while self.read < len(self.order) and len(self.alive):
            yield self.partial + self.rest_low[self.read], self.partial + self.rest_high[self.read]
            if not len(self.alive):
                return
            high = min(self.read + self.step, len(self.order))
            chosen = self.order[self.read : high]
            weights = self.weights[self.read : high]
            if 2 * len(self.alive) > self.columns.shape[1]:
                added = (weights @ self.columns[chosen])[self.alive]
            else:
                added = weights @ self.columns[chosen[:, None], self.alive]
            self.partial = self.partial + added
            self.read = high

    def keep(self, bitmap: np.ndarray) -> None:
        if not bitmap.all():
            self.alive, self.partial = self.alive[bitmap], self.partial[bitmap]


def nth_largest(values: np.ndarray, n: int):
    return np.partition(values, len(values) - n)[len(values) - n]


class Best:
    """The first ``size`` rows by score, id and row, of all that were offered."""

    def __init__(self, size: int):
        self.size = size
        self.score = self.ids = self.rows = np.zeros(0, dtype=np.int64)

    def least(self) -> int | None:
        """A score below this is of no use any more."""
        return int(self.score[-1]) if len(self.score) == self.size else None

    def offer(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(score) > self.size:
            near = score >= nth_largest(score, self.size)
            score, ids, rows = score[near], ids[near], rows[near]
        score = np.concatenate([self.score, score.astype(np.int64)])
        ids, rows = np.concatenate([self.ids, ids]), np.concatenate([self.rows, rows])
        order = np.lexsort((rows, ids, -score))[: self.size]
        self.score, self.ids, self.rows = score[order], ids[order], rows[order]


def scan_positives(anchor, row, label, block: Block, columns, best: Best, step: int) -> None:
    """Offers to ``best`` what a block holds of the anchor's own label."""
    low, high = np.searchsorted(block.labels, [label, label + 1])
    alive = np.arange(low, high)
    place = row - block.first
    if low <= place < high:
        alive = alive[alive != place]
    if not len(alive):
        return
    scan = Scan(anchor, block, columns, alive, step)
    for lower, upper in scan.steps():
        need = best.least()
        if len(lower) >= best.size:
            sure = nth_largest(lower, best.size)
            need = sure if need is None else max(need, sure)
        if need is not None:
            scan.keep(upper >= need)
    best.offer(scan.partial, block.ids[scan.alive], block.first + scan.alive)


def scan_negatives(
    anchor, label, windows: list[tuple[int, int]], block: Block, columns, found: list[Best], step: int
) -> None:
    """Offers to the ``Best`` of every window the rows of other labels that lie in it."""
    open_windows = [n for n, (low, high) in enumerate(windows) if low <= high]
    if not open_windows:
        return
    low, high = np.searchsorted(block.labels, [label, label + 1])
    alive = np.concatenate([np.arange(low), np.arange(high, len(block.labels))])
    scan = Scan(anchor, block, columns, alive, step)
    for lower, upper in scan.steps():
        useful = np.zeros(len(lower), dtype=bool)
        for n in open_windows:
            least, most = windows[n]
            taken = found[n].least()
            need = least if taken is None else max(least, taken)
            sure = lower[(lower >= need) & (upper <= most)]
            if len(sure) >= found[n].size:
                need = max(need, nth_largest(sure, found[n].size))
            useful |= (upper >= need) & (lower <= most)
        scan.keep(useful)
    for n in open_windows:
        inside = (scan.partial >= windows[n][0]) & (scan.partial <= windows[n][1])
        if inside.any():
            chosen = scan.alive[inside]
            found[n].offer(scan.partial[inside], block.ids[chosen], block.first + chosen)


def _columns_as(block: Block, anchors: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(block.columns, dtype=exact_kind(np.abs(anchors).max(axis=0), block))


def window_of(score: int, config: HardNegatives) -> tuple[int, int]:
    """The integers from ``least`` to ``most`` hundredths of ``score``."""
    return -(-config.least * score // 100), config.most * score // 100


def _rows_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [n for n, _ in fields]
    )


def _first_positives(blocks: DataFrame, chunk: pa.Table, config: HardNegatives) -> DataFrame:
    """The best rows of each anchor's label, of every task."""
    sent = blocks.sparkSession.sparkContext.broadcast((
        chunk["row"].to_pylist(), chunk["label"].to_pylist(),
        _matrix(chunk["vector"].combine_chunks()),
    ))

    def run(batches):
        rows, labels, vectors = sent.value
        best = [Best(config.positives) for _ in rows]
        for batch in batches:
            for number in range(batch.num_rows):
                block = _load(batch, number)
                columns = _columns_as(block, vectors)
                for anchor, row, label, own in zip(vectors, rows, labels, best):
                    scan_positives(anchor, row, label, block, columns, own, config.step)
        yield _rows_of(POSITIVES_SCHEMA, [
            (row, *found)
            for row, own in zip(rows, best)
            for found in zip(own.ids.tolist(), own.rows.tolist(), own.score.tolist())
        ])

    return blocks.mapInArrow(run, POSITIVES_SCHEMA)


def _first_negatives(blocks: DataFrame, chunk: pa.Table, config: HardNegatives) -> DataFrame:
    """The best rows of each window of each anchor, of every task."""
    sent = blocks.sparkSession.sparkContext.broadcast((
        chunk["row"].to_pylist(), chunk["label"].to_pylist(),
        _matrix(chunk["vector"].combine_chunks()), chunk["scores"].to_pylist(),
    ))

    def run(batches):
        rows, labels, vectors, scores = sent.value
        windows = [[window_of(score, config) for score in own] for own in scores]
        best = [[Best(config.negatives) for _ in own] for own in scores]
        for batch in batches:
            for number in range(batch.num_rows):
                block = _load(batch, number)
                columns = _columns_as(block, vectors)
                for anchor, label, own, found in zip(vectors, labels, windows, best):
                    scan_negatives(anchor, label, own, block, columns, found, config.step)
        yield _rows_of(NEGATIVES_SCHEMA, [
            (row, place, *one)
            for row, own in zip(rows, best)
            for place, found in enumerate(own, 1)
            for one in zip(found.ids.tolist(), found.rows.tolist(), found.score.tolist())
        ])

    return blocks.mapInArrow(run, NEGATIVES_SCHEMA)


def _numbered(rows: DataFrame, keys: list[str], kind: str, size: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(
        F.desc(f"{kind}_score"), F.asc(f"{kind}_id"), F.asc(f"{kind}_row")
    )
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= size)


def _each_chunk(blocks: DataFrame, anchors: DataFrame, chunks: int, scan, name: str) -> DataFrame:
    """What ``scan`` finds for every chunk of anchors, one written table after the other."""
    out = None
    for n in range(chunks):
        chunk = anchors.where(F.col("chunk") == n).drop("chunk").toArrow()
        if chunk.num_rows:
            found = materialize(scan(blocks, chunk), name)
            out = found if out is None else out.unionByName(found)
    return out


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, config: HardNegatives = HardNegatives()
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for
    ``vectors`` with ``vec_id, label, embedding``; ``is_anchor`` tells the query rows."""
    spark = vectors.sparkSession
    ready = quantised(vectors, is_anchor, config.scale)
    narrow = max(-(-vectors.count() // config.block_rows), spark.sparkContext.defaultParallelism)
    blocks = materialize(_column_blocks(ready.coalesce(narrow), config), "negative-blocks")
    anchors, seen = materialize_counted(_anchors(blocks), "negative-anchors")
    chunks = max(1, -(-seen["rows"] // config.anchor_rows))
    anchors = anchors.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    found = _each_chunk(
        blocks, anchors, chunks, lambda b, c: _first_positives(b, c, config), "negative-positives"
    )
    if found is None:
        return spark.createDataFrame([], _RESULT)
    positives = materialize(
        _numbered(found, ["row"], "positive", config.positives, "place"), "negative-first-positives"
    )
    scores = positives.groupBy("row").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("place", "positive_score"))),
            lambda one: one["positive_score"],
        ).alias("scores")
    )
    asked = materialize(anchors.join(scores, "row"), "negative-asked")
    found = _each_chunk(
        blocks, asked, chunks, lambda b, c: _first_negatives(b, c, config), "negative-found"
    )
    if found is None:
        return spark.createDataFrame([], _RESULT)
    ranked = _numbered(found, ["row", "place"], "negative", config.negatives, "rank")
    return (
        ranked.join(positives.drop("positive_row"), ["row", "place"])
        .join(anchors.select("row", "anchor_id"), "row")
        .select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
            "positive_score", "negative_score",
        )
    )


_RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
    "negative_score long"
)
