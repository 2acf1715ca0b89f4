"""Token sequences of fixed capacity, packed by minimum bin slack.

Texts are tokenized once. A document is cut into whole windows of ``capacity`` tokens and a
remainder; a whole window is a sequence of its own. Remainders are dealt into shards of
about ``shard_rows`` pieces, and each shard packs its own: while pieces are left, a window
takes the longest one, a bitset of reachable sums over the remaining lengths finds how close
to the capacity the others can fill it, and walking the bitsets back says how many pieces
of each length that takes. A window that can be repeated is repeated at once.

Only lengths and checksums leave the tokenizing tasks, and a shard never holds texts.

Defined cases: null texts count as empty, and an empty text is the end token alone; rows
that repeat an id are documents of their own; rows without id are packed like others; other
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemesh.llm.learning import worker_state
from casemesh.llm.words import slices
from casemesh.session import materialize_counted, small_batches

ID_BYTES = 4
# Pieces kept in each of two generations; what the older one alone holds and nobody asks for goes.
CACHE_ENTRIES = 150_000
GROUP_CHARS = 1 << 20
PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
# Fixed value: how the vocabulary's own file cuts usual characters in lower case into words.
LETTER = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
WORD_PATTERN = re.compile(rf"[{LETTER}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^{LETTER}0-9\s]+")
# Characters for which Python and the tokenizer may differ in case, class or composition.
UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")
SPECIAL = "<|"
WORD_END = "</w>"


class Packing(NamedTuple):
    """``tokenizer``: path of a tokenizer file, the same on all machines."""

    tokenizer: str
    capacity: int = 2048
    end_id: int = 1
    shard_rows: int = 4096


class _Encoder:
    """Ids of whole texts as bytes.

    A text of usual characters is cut at white space and looked up piece by piece. Of pieces
    not seen before, those that are no word are cut into words, and new words are encoded
    together by the model of the tokenizer alone: they are in lower case and composed
    already. Every other text goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(size, dtype=bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[number] = token.endswith(WORD_END)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _missing(self, pieces: set[str]) -> set[str]:
        """The pieces that no generation has; those of the older one come into the new one."""
        if self.before:
            self.known.update((piece, self.before[piece]) for piece in pieces if piece in self.before)
        return {piece for piece in pieces if piece not in self.known}

    def _learn(self, words: list[str]) -> None:
        text = self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(text[0].ids, dtype="<u4")
        edges = ((np.flatnonzero(self.ends[ids]) + 1) * ID_BYTES).tolist()
        if len(edges) != len(words):
            raise ValueError("the tokenizer does not end every word")
        known, packed, low = self.known, ids.tobytes(), 0
        for word, high in zip(words, edges):
            known[word] = packed[low:high]
            low = high

    def _whole(self, text: str) -> bytes:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found[0].ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts that together should be of moderate size: their pieces are held at once."""
        if len(self.known) > CACHE_ENTRIES:
            self.known, self.before = {}, self.known
        known = self.known
        usual = [not UNUSUAL.search(text) and SPECIAL not in text for text in texts]
        cut = [text.lower().split() if plain else [] for text, plain in zip(texts, usual)]
        new = self._missing({piece for found in cut for piece in found if piece not in known})
        mixed = {piece: WORD_PATTERN.findall(piece) for piece in new if not piece.isalpha()}
        words = {piece for piece in new if piece not in mixed}
        words |= self._missing({word for found in mixed.values() for word in found if word not in known})
        if words:
            self._learn(list(words))
        for piece, found in mixed.items():
            known[piece] = b"".join([known[word] for word in found])
        return [
            b"".join(map(known.__getitem__, found)) if plain else self._whole(text)
            for text, found, plain in zip(texts, cut, usual)
        ]


def token_pieces(docs: DataFrame, config: Packing) -> DataFrame:
    """Every document in windows of ``capacity`` and a remainder, with checksums of the ids."""
    end = np.array([config.end_id], dtype="<u4").tobytes()
    step = config.capacity * ID_BYTES

    def run(batches):
        state = worker_state("packing")
        if state.get("path") != config.tokenizer:
            state.update(path=config.tokenizer, encoder=_Encoder(config.tokenizer))
        encoder = state["encoder"]
        for batch in batches:
            rows = []
            for part in slices(batch.column(1), GROUP_CHARS):
                texts = batch.column(1)[part.low : part.high].to_pylist()
                encoded = encoder.encode([text or "" for text in texts])
                for doc_id, ids in zip(batch.column(0)[part.low : part.high].to_pylist(), encoded):
                    ids += end
                    for low in range(0, len(ids), step):
                        own = ids[low : low + step]
                        rows.append((
                            doc_id, low // ID_BYTES, len(own) // ID_BYTES, zlib.crc32(own),
                            len(ids) // ID_BYTES,
                        ))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, PIECES_SCHEMA
    )


def fill(counts: np.ndarray, room: int) -> dict[int, int]:
    """How many pieces of each length fill ``room`` best. ``counts[l]`` pieces are there.

    ``reach[k]`` is the set of sums, as bits, that the ``k`` longest lengths can make; a
    length of which n are there enters in groups of 1, 2, 4, ... pieces.
    """
    mask = (1 << (room + 1)) - 1
    reach, used = [1], []
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, group = min(int(counts[length]), room // length), 1
        while left:
            group = min(group, left)
            used.append((length, group))
            reach.append((reach[-1] | reach[-1] << length * group) & mask)
            left -= group
            group *= 2
        if reach[-1] >> room & 1:
            break
    best, chosen = reach[-1].bit_length() - 1, {}
    for (length, group), before in zip(reversed(used), reversed(reach[:-1])):
        if not before >> best & 1:
            best -= length * group
            chosen[length] = chosen.get(length, 0) + group
    return chosen


def windows(lengths: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """Windows, each as pieces per length, that together take every length."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    out = []
    longest = capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return out
        counts[longest] -= 1
        window = fill(counts, capacity - longest)
        counts[longest] += 1
        window[longest] = window.get(longest, 0) + 1
        times = min(int(counts[length]) // n for length, n in window.items())
        for length, n in window.items():
            counts[length] -= n * times
        out += [window] * times


def pack_shard(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Adds ``sequence`` (0, 1, ... inside the shard) and ``offset`` to the pieces."""
    order = pieces.sort_values(["length", "doc_id", "start", "row"], kind="stable")
    length = order["length"].to_numpy()
    at = {int(n): int(np.searchsorted(length, n)) for n in np.unique(length)}
    sequence, offset = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    for number, window in enumerate(windows(length, capacity)):
        filled = 0
        for own in sorted(window, reverse=True):
            for place in range(at[own], at[own] + window[own]):
                sequence[place], offset[place] = number, filled
                filled += own
            at[own] += window[own]
    return order.assign(sequence=sequence, offset=offset)


def pack(docs: DataFrame, config: Packing) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``. Sequence ids are unique and not gapless: shards count for themselves."""
    with small_batches(docs.sparkSession):
        pieces, seen = materialize_counted(token_pieces(docs, config), "pack-pieces")
    capacity = config.capacity
    # The written table is read in the same splits each time, which makes row ids lasting.
    numbered = pieces.withColumn("row", F.monotonically_increasing_id())
    shards = max(1, seen["rows"] // config.shard_rows)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = numbered.where(F.col("length") == capacity).select(
        *names, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = numbered.where(F.col("length") < capacity).withColumn(
        "shard", F.pmod(F.xxhash64("row"), F.lit(shards))
    )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        packed = pack_shard(frame, capacity)
        packed["sequence_id"] = packed["shard"] * (1 << 32) + packed["sequence"]
        return packed[[*names, "sequence_id", "offset"]]

    schema = PIECES_SCHEMA + ", sequence_id long, offset long"
    return rest.groupBy("shard").applyInPandas(run, schema).unionByName(whole)
