"""How the tokens of two vocabularies line up, over a whole corpus, in Arrow tables.

Every text is cut by a byte-level vocabulary (A) and a piece vocabulary (B). Where a token of
both ends at the same byte, a group ends; tokens that share a group are linked.

In a task, slice by slice: the lists of ids are flattened and keep the index of their parent,
cumulative sums of byte lengths inside each document give the ends of tokens, an Acero hash
join of the two sides on (document, end) finds the shared ends, a second one on groups makes
the links, and ``Table.group_by`` counts them. Documents are gathered into blocks of about
``block_links`` different links. A block holds its id pairs once, with the number of its
documents that link each; documents refer to them by place.

Spark sums the partial counts of all blocks per id pair. The sums go back to each block once
per pair, where the links of its documents are added up. No row per link ever leaves a task,
and a pair that every document links is one row per block.

Defined cases: texts that are null or empty, and those whose tokens do not spell the text
again in either vocabulary, have no tokens; strings of special tokens are plain text; rows
without id and rows that repeat an id are documents of their own; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemesh.llm.byte_pairs import Encoder, token_bytes
from casemesh.llm.learning import worker_state
from casemesh.llm.words import slices
from casemesh.operators.joins import join_unique
from casemesh.session import materialize

GROUP_CHARS = 1 << 19
BLOCK_BITS = 32
PIECE_BLANK = "▁"
# Groups with more links than this count equal ids first.
LARGE_GROUP = 1024
DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
WRITTEN = (
    f"block long, {DOCUMENT}, places array<int>, times array<int>, "
    "pairs array<long>, holders array<long>"
)
RESULT = f"{DOCUMENT}, n_best long, count_sum long"


class Alignment(NamedTuple):
    """Paths of the two vocabularies, the same on all machines."""

    bytes_path: str
    pieces_path: str
    block_links: int = 1_000_000


class Side(NamedTuple):
    """The tokens of one vocabulary in a slice: ids, and the document and byte end of each."""

    ids: np.ndarray
    doc: np.ndarray
    end: np.ndarray
    counts: np.ndarray


class Tokenizers:
    def __init__(self, config: Alignment):
        import sentencepiece

        self.encoder = Encoder(config.bytes_path, plain_specials=True)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=config.pieces_path)
        self.bytes_a = pa.array(token_bytes(self.encoder.tokenizer), pa.large_binary())
        self.bytes_b = pa.array(
            [self._piece(n) for n in range(self.pieces.get_piece_size())], pa.large_binary()
        )
        self.size_a, self.size_b = pc.binary_length(self.bytes_a), pc.binary_length(self.bytes_b)
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.written = pa.array([f"{n}{c}" for n in range(most) for c in ",|;"], pa.large_binary())

    def _piece(self, number: int) -> bytes:
        piece = self.pieces.id_to_piece(number)
        if self.pieces.is_byte(number):
            return bytes([int(piece[1:-1], 16)])
        return piece.replace(PIECE_BLANK, " ").encode()

    def lists(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """The ids of both vocabularies; an empty text has none."""
        encoded = self.encoder.encode([" " + text if text else "" for text in texts])
        offsets = np.cumsum([0, *map(len, encoded)]) // 4
        a = pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(encoded), "<i4"))
        )
        b = pa.array(self.pieces.encode(texts, num_threads=1), pa.list_(pa.int32()))
        return a, b


def spelled(lists: pa.ListArray, token: pa.Array) -> pa.Array:
    """The joined bytes of the tokens of each list."""
    flat = token.take(pc.list_flatten(lists))
    _, ends, body = flat.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    edges = pa.py_buffer(np.ascontiguousarray(ends[lists.offsets.to_numpy()]))
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, edges, body])


def side(lists: pa.ListArray, size: pa.Array, whole: np.ndarray) -> Side:
    """Flattened tokens with segmented cumulative sums; lists that are not ``whole`` have none."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    counts = np.where(whole, np.diff(lists.offsets.to_numpy()), 0)
    if not whole.all():
        kept = pa.array(whole).take(doc)
        ids, doc = ids.filter(kept), doc.filter(kept)
    sums = pc.cumulative_sum(size.take(ids).cast(pa.int64()))
    before = np.append(0, sums.to_numpy())[np.cumsum(counts) - counts]
    end = pc.subtract(sums, pa.array(before).take(doc))
    return Side(*(x.to_numpy() for x in (ids, doc, end)), counts)


def shared_ends(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """For each token of both sides, 1 if a token of the other side ends there too."""
    def keyed(own: Side, at: str) -> pa.Table:
        key = (own.doc.astype(np.int64) << BLOCK_BITS) + own.end
        return pa.table({"key": key, at: np.arange(len(key))})

    met = keyed(a, "a").join(keyed(b, "b"), "key", join_type="inner", use_threads=False)
    flags = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    for name, flag in zip("ab", flags):
        flag[met[name].to_numpy()] = 1
    return flags


def written_groups(a: Side, b: Side, flags, groups, sizes, names: pa.Array) -> list[str]:
    """For each document the checksum of its groups, written as decimal ids."""
    # Tokens in order of group, A before B; the token that ends a group says so.
    at_a = np.arange(len(a.ids)) + (np.cumsum(sizes[1]) - sizes[1])[groups[0]]
    at_b = np.arange(len(b.ids)) + np.cumsum(sizes[0])[groups[1]]
    code = np.empty(len(a.ids) + len(b.ids), np.int64)
    code[at_a] = a.ids.astype(np.int64) * 3 + flags[0]
    code[at_b] = b.ids.astype(np.int64) * 3 + 2 * flags[1]
    if not len(code):
        return [""] * len(a.counts)
    text = names.take(pa.array(code))
    _, ends, body = text.buffers()
    ends, body = np.frombuffer(ends, np.int64), memoryview(body)
    edges = ends[np.append(0, np.cumsum(a.counts + b.counts))].tolist()
    return [
        hashlib.sha256(body[low : high - 1]).hexdigest() if high > low else ""
        for low, high in zip(edges[:-1], edges[1:])
    ]


def _members(own: Side, group: np.ndarray, large: np.ndarray, name: str) -> pa.Table:
    """``group, name, n``: tokens, those of large groups counted per id."""
    many = large[group]
    table = pa.table({"group": group, name: own.ids.astype(np.int64)})
    if not many.any():
        return table.append_column("n", pa.array(np.ones(len(group), np.int64)))
    few = table.filter(pa.array(~many))
    few = few.append_column("n", pa.array(np.ones(few.num_rows, np.int64)))
    counted = table.filter(pa.array(many)).group_by(["group", name], use_threads=False)
    counted = counted.aggregate([([], "count_all")]).rename_columns(["group", name, "n"])
    return pa.concat_tables([few, counted.select(few.column_names)])


def linked_pairs(a: Side, b: Side, groups, sizes, group_doc: np.ndarray) -> pa.Table:
    """``doc, pair, times``: the different links of each document."""
    large = sizes[0] * sizes[1] > LARGE_GROUP
    left = _members(a, groups[0], large, "a")
    right = _members(b, groups[1], large, "b").rename_columns(["group", "b", "m"])
    links = left.join(right, "group", join_type="inner", use_threads=False)
    table = pa.table({
        "doc": group_doc[links["group"].to_numpy()],
        "pair": (links["a"].to_numpy() << BLOCK_BITS) + links["b"].to_numpy(),
        "times": links["n"].to_numpy() * links["m"].to_numpy(),
    })
    found = table.group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")])
    return found.rename_columns(["doc", "pair", "times"])


def align(texts: list[str], tools: Tokenizers) -> tuple[dict[str, list], pa.Table]:
    """The figures of each text, and its links as ``doc, pair, times``."""
    lists_a, lists_b = tools.lists(texts)
    want = pa.array([b" " + text.encode() if text else b"" for text in texts], pa.large_binary())
    whole = np.logical_and.reduce([
        pc.equal(spelled(lists, token), want).to_numpy(zero_copy_only=False)
        for lists, token in ((lists_a, tools.bytes_a), (lists_b, tools.bytes_b))
    ])
    a, b = side(lists_a, tools.size_a, whole), side(lists_b, tools.size_b, whole)
    flags = shared_ends(a, b)
    groups = [np.cumsum(flag) - flag for flag in flags]
    group_doc = a.doc[flags[0] == 1]
    sizes = [np.bincount(group, minlength=len(group_doc)) for group in groups]
    n_groups = np.bincount(group_doc, minlength=len(texts))
    links = np.append(0, np.cumsum(sizes[0] * sizes[1]))
    edges = np.append(0, np.cumsum(n_groups))
    figures = {
        "n_a": a.counts,
        "n_b": b.counts,
        "n_groups": n_groups,
        "n_links": np.diff(links[edges]),
        "groups_sha256": written_groups(a, b, flags, groups, sizes, tools.written),
    }
    return figures, linked_pairs(a, b, groups, sizes, group_doc)


class _Block:
    """Documents and their links until the block is written."""

    def __init__(self, number: int):
        self.number, self.documents, self.links, self.rows = number, [], [], 0

    def add(self, ids: pa.Array, figures: dict, links: pa.Table) -> None:
        before = sum(map(len, self.documents))
        columns = {name: pa.array(values) for name, values in figures.items()}
        self.documents.append(pa.table({"doc_id": ids, **columns}))
        self.links.append(links.set_column(0, "doc", pc.add(links["doc"], before)))
        self.rows += links.num_rows

    def close(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        documents = pa.concat_tables(self.documents).combine_chunks()
        links = pa.concat_tables(self.links).sort_by("doc").combine_chunks()
        places = links["pair"].chunk(0).dictionary_encode() if links.num_rows else None
        pairs = places.dictionary if places is not None else pa.array([], pa.int64())
        place = places.indices if places is not None else pa.array([], pa.int32())
        holders = np.bincount(place.to_numpy(), minlength=len(pairs))
        edges = np.searchsorted(links["doc"].to_numpy(), np.arange(documents.num_rows + 1))
        edges = pa.array(edges, pa.int32())

        def of_document(values) -> pa.Array:
            return pa.ListArray.from_arrays(edges, pa.array(values).cast(pa.int32()))

        own = {name: documents[name] for name in documents.column_names} | {
            "block": pa.array([self.number] * documents.num_rows, pa.int64()),
            "places": of_document(place),
            "times": of_document(links["times"].to_numpy()),
        }
        shared = {
            "block": pa.array([self.number]),
            "pairs": pa.array([pairs.to_numpy()], pa.list_(pa.int64())),
            "holders": pa.array([holders], pa.list_(pa.int64())),
        }
        for rows in (own, shared):
            size = len(rows["block"])
            columns = [rows.get(f.name, pa.nulls(size, f.type)) for f in schema]
            yield from pa.table(columns, schema=schema).to_batches(max_chunksize=4096)


_LISTS = {"places": pa.int32(), "times": pa.int32(), "pairs": pa.int64(), "holders": pa.int64()}


def _schema(fields: str) -> pa.Schema:
    names = [field.split()[0] for field in fields.split(", ")]
    kinds = {name: pa.list_(kind) for name, kind in _LISTS.items()} | {"groups_sha256": pa.string()}
    return pa.schema([(name, kinds.get(name, pa.int64())) for name in names])


def aligned_blocks(docs: DataFrame, config: Alignment) -> DataFrame:
    """One row per document, and one per block with its id pairs and how many of its
    documents link each."""
    schema = _schema(WRITTEN)

    def run(batches):
        state = worker_state("alignment")
        if state.get("config") != tuple(config):
            state.update(config=tuple(config), tools=Tokenizers(config))
        number = TaskContext.get().partitionId() << BLOCK_BITS
        block = _Block(number)
        for batch in batches:
            for part in slices(batch.column(1), GROUP_CHARS):
                texts = batch.column(1)[part.low : part.high].to_pylist()
                figures, links = align([text or "" for text in texts], state["tools"])
                block.add(batch.column(0)[part.low : part.high], figures, links)
                if block.rows >= config.block_links:
                    yield from block.close(schema)
                    number += 1
                    block = _Block(number)
        if block.documents:
            yield from block.close(schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, WRITTEN
    )


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``block, place, pair, holders`` of ``aligned_blocks``."""
    both = F.arrays_zip("pairs", "holders")
    return blocks.where("pairs IS NOT NULL").select(
        "block", F.posexplode(both).alias("place", "own")
    ).select("block", "place", "own.pairs", "own.holders").withColumnRenamed("pairs", "pair")


def corpus_counts(counts: DataFrame) -> DataFrame:
    """``pair, count, top``: documents of the corpus that link the pair, and whether no other
    pair of its A id has more. There is one maximum per id of the vocabulary at most."""
    total = materialize(
        counts.groupBy("pair").agg(F.sum("holders").alias("count")), "alignment-counts"
    ).withColumn("a", F.shiftright("pair", BLOCK_BITS))
    best = total.groupBy("a").agg(F.max("count").alias("most"))
    return total.join(F.broadcast(best), "a").select(
        "pair", "count", (F.col("count") == F.col("most")).alias("top")
    )


def _summed(documents: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one block with the sums of the counts of their links."""
    documents = documents.combine_chunks()
    size = documents.num_rows
    count, top = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
    place = counts["place"].to_numpy()
    count[place], top[place] = counts["count"].to_numpy(), counts["top"].to_numpy()
    sums = {"n_best": np.zeros(size, np.int64), "count_sum": np.zeros(size, np.int64)}
    if counts.num_rows:
        lists = documents["places"].combine_chunks()
        own = pc.list_flatten(lists).to_numpy()
        times = pc.list_flatten(documents["times"].combine_chunks()).to_numpy().astype(np.int64)
        edges = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
        for name, value in (("n_best", top), ("count_sum", count)):
            sums[name] = np.diff(np.append(0, np.cumsum(value[own] * times))[edges])
    names = [field.split()[0] for field in RESULT.split(", ")]
    columns = {name: documents[name] for name in names if name not in sums} | sums
    return pa.table([columns[name] for name in names], schema=_schema(RESULT))


def align_tokens(docs: DataFrame, config: Alignment) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` per row."""
    blocks = materialize(aligned_blocks(docs, config), "alignment-blocks")
    counts = pair_counts(blocks)
    scored = materialize(corpus_counts(counts), "alignment-scores")
    back = join_unique(counts.select("block", "place", "pair"), scored, "pair", "inner")
    documents = blocks.where("pairs IS NULL").drop("pairs", "holders")
    return (
        documents.groupBy("block")
        .cogroup(back.select(F.col("block").alias("of"), "place", "count", "top").groupBy("of"))
        .applyInArrow(_summed, RESULT)
    )
