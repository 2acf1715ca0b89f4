"""Benchmark passages in documents, found by greedy string tiling.

Benchmark items are read in blocks of at most ``block_tokens`` tokens, and each block is
sent to every task: its size is bounded whatever the benchmark holds, and every document
meets every block. A document and an item share seeds, runs of ``least`` equal tokens. Where
the seeds can cover enough of the item, the two are tiled: windows of falling length are
looked up by their rolling Karp-Rabin codes, matches are extended, and the longest ones
that do not overlap what is marked are marked first. The marked share of the item decides,
so passages that were cut up and put together in another order are found too.

Tokens are runs of letters, digits and non-ASCII characters, in lower case.

Defined cases: null and empty texts match nothing; items with fewer than ``least`` tokens
match nothing; items without id are skipped; items that repeat are reported each; repeated
documents all come back; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemesh.llm.learning import Shipped
from casemesh.llm.words import BASE, PUNCTUATION, slices, words

FOUND_SCHEMA = (
    "doc_id long, item_id long, item_tokens long, covered long, coverage double, "
    "tiles array<struct<item_start: int, doc_start: int, length: int>>"
)


class Decontamination(NamedTuple):
    least: int = 5
    coverage: float = 0.8
    block_tokens: int = 1_000_000


class Block(NamedTuple):
    """Items as token codes, and the seeds of all of them, sorted by code."""

    ids: list[int]
    tokens: list[np.ndarray]
    seeds: np.ndarray
    seed_item: np.ndarray
    seed_place: np.ndarray


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def tokens_of(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for part in slices(lowered(pa.array(texts, pa.large_string()))):
        found = words(part.data, part.bounds, separator=PUNCTUATION)
        out += np.split(found.code, found.first[1:-1])
    return out


def make_block(ids: list[int], tokens: list[np.ndarray], least: int) -> Block:
    codes, items, places = [np.zeros(0, np.uint64)], [], []
    for item, own in enumerate(tokens):
        code = windows(own, least)
        codes.append(code)
        items.append(np.full(len(code), item))
        places.append(np.arange(len(code)))
    code = np.concatenate(codes)
    order = np.argsort(code, kind="stable")
    empty = [np.zeros(0, np.int64)]
    return Block(
        ids, tokens, code[order], np.concatenate(items or empty)[order],
        np.concatenate(places or empty)[order],
    )


def benchmark_blocks(benchmark: DataFrame, config: Decontamination) -> Iterator[Block]:
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    ids, tokens, size = [], [], 0
    for row in rows.where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        own = tokens_of([row["text"]])[0]
        if len(own) < config.least:
            continue
        if size and size + len(own) > config.block_tokens:
            yield make_block(ids, tokens, config.least)
            ids, tokens, size = [], [], 0
        ids.append(row["item_id"])
        tokens.append(own)
        size += len(own)
    if ids:
        yield make_block(ids, tokens, config.least)


def windows(tokens: np.ndarray, length: int) -> np.ndarray:
    """Rolling Karp-Rabin codes of all windows of ``length`` tokens."""
    count = len(tokens) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    code = np.zeros(count, dtype=np.uint64)
    done, power, unit = 0, tokens, BASE
    # Windows of doubled lengths are put together from two halves; the binary digits of
    # the length say which of them a window is made of.
    with np.errstate(over="ignore"):
        for digit in range(length.bit_length()):
            if length >> digit & 1:
                code = code * unit + power[done : done + count]
                done += 1 << digit
            if done < length:
                half = 1 << digit
                power = power[:-half] * unit + power[half:]
                unit = unit * unit
    return code


def diagonals(item: np.ndarray, doc: np.ndarray, length: int, free_item, free_doc):
    """Maximal runs ``(-length, item_start, doc_start)`` of equal unmarked windows."""
    in_item, in_doc = windows(item, length), windows(doc, length)
    open_item = np.convolve(free_item, np.ones(length, int), "valid") == length
    clear = np.concatenate([[0], np.cumsum(free_doc)])
    open_doc = clear[length:] - clear[:-length] == length
    at_item = np.flatnonzero(open_item)
    order = at_item[np.argsort(in_item[at_item], kind="stable")]
    codes = in_item[order]
    at_doc = np.flatnonzero(open_doc & np.isin(in_doc, codes))
    low = np.searchsorted(codes, in_doc[at_doc], "left")
    many = np.searchsorted(codes, in_doc[at_doc], "right") - low
    places = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    i, j = order[places], np.repeat(at_doc, many)
    if not len(i):
        return []
    turn = np.lexsort((i, j - i))
    i, j = i[turn], j[turn]
    new = np.flatnonzero(np.r_[True, (np.diff(j - i) != 0) | (np.diff(i) != 1)])
    spans = np.diff(np.r_[new, len(i)]) + length - 1
    return list(zip((-spans).tolist(), i[new].tolist(), j[new].tolist()))


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: ``(item_start, doc_start, length)`` of the tiles, longest first."""
    free_item, free_doc = np.ones(len(item), int), np.ones(len(doc), int)
    tiles = []
    length = max(least, min(len(item), len(doc)) // 2)
    while True:
        queue = diagonals(item, doc, length, free_item, free_doc)
        heapify(queue)
        while queue:
            span, i, j = heappop(queue)
            both = free_item[i : i - span] & free_doc[j : j - span]
            if both.all():
                free_item[i : i - span] = 0
                free_doc[j : j - span] = 0
                tiles.append((i, j, -span))
                continue
            edge = np.flatnonzero(np.diff(np.r_[0, both, 0]))
            for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if end - start >= length:
                    heappush(queue, (start - end, i + start, j + start))
        if length == least:
            return sorted(tiles, key=lambda t: (-t[2], t[0], t[1]))
        length = max(least, length // 2)


def reachable(block: Block, codes: np.ndarray, config: Decontamination) -> list[int]:
    """Items of which the seeds shared with a document could cover enough."""
    codes = np.unique(codes)
    low = np.searchsorted(block.seeds, codes, "left")
    many = np.searchsorted(block.seeds, codes, "right") - low
    at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    found = []
    for item in np.unique(block.seed_item[at]):
        places = block.seed_place[at[block.seed_item[at] == item]]
        size = len(block.tokens[item])
        marked = np.zeros(size, dtype=bool)
        for step in range(config.least):
            marked[places + step] = True
        if marked.sum() >= config.coverage * size:
            found.append(int(item))
    return found


def contaminated(
    docs: DataFrame, benchmark: DataFrame, config: Decontamination = Decontamination()
) -> DataFrame:
    """One row per document and benchmark item that it holds: the covered tokens and tiles."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spark = docs.sparkSession
    found = None
    for block in benchmark_blocks(benchmark, config):
        own = docs.mapInArrow(_matcher(Shipped(spark.sparkContext, "decontaminate", block), config), FOUND_SCHEMA)
        found = own if found is None else found.unionAll(own)
    return spark.createDataFrame([], FOUND_SCHEMA) if found is None else found


def _matcher(sent, config: Decontamination):
    kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("item_start", "doc_start", "length")]))

    def run(batches):
        block = sent.get()
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for part in slices(lowered(batch.column(1))):
                found = words(part.data, part.bounds, separator=PUNCTUATION)
                code = windows(found.code, config.least)
                near = np.minimum(np.searchsorted(block.seeds, code), len(block.seeds) - 1)
                whole = found.text[: len(code)] == found.text[len(found.text) - len(code) :]
                hits = np.flatnonzero((block.seeds[near] == code) & whole)
                for text in np.unique(found.text[hits]):
                    own = hits[found.text[hits] == text]
                    doc = found.code[found.first[text] : found.first[text + 1]]
                    for item in reachable(block, code[own], config):
                        size = len(block.tokens[item])
                        tiles = tile(block.tokens[item], doc, config.least)
                        covered = sum(length for _, _, length in tiles)
                        if covered >= config.coverage * size:
                            rows.append((
                                ids[part.low + int(text)], block.ids[item], size, covered,
                                covered / size, [dict(zip(kind.value_type.names, t)) for t in tiles],
                            ))
            if rows:
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 4 + [pa.float64(), kind]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["doc_id", "item_id", "item_tokens", "covered", "coverage", "tiles"],
                )

    return run
