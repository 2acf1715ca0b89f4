"""Words and shingles of whole Arrow columns, as 64-bit hashes in numpy.

A column of texts is cut into slices of about ``SLICE_BYTES`` so that the arrays made from
it stay small whatever the batch holds; a text is never cut. Equal words have equal hashes
in every task, as all constants come from one fixed seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
SPACES = b" \t\n\v\f\r"


def mix(values: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def constants(count: int, seed: int) -> np.ndarray:
    """``count`` odd 64-bit numbers, always the same ones for a seed."""
    steps = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    offset = np.array([seed], dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    return mix(steps + offset) | np.uint64(1)


BYTE_VALUES = constants(256, 1)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
BASE = np.uint64(0xD6E8FEB86659FD93)
PLACES = constants(16, 2)

WHITE = np.zeros(256, dtype=bool)
WHITE[list(SPACES)] = True
# Everything in ASCII but letters and digits; longer characters belong to words.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


class Words(NamedTuple):
    """Words of the texts of one slice: byte positions, hash, and the text each is in.

    ``first[t]`` to ``first[t + 1]`` are the words of text ``t``.
    """

    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    text: np.ndarray
    first: np.ndarray


class Slice(NamedTuple):
    """Texts ``low`` to ``high`` of a column: their bytes, and where each begins and ends."""

    low: int
    high: int
    data: np.ndarray
    bounds: np.ndarray


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column in slices of about ``size`` bytes, at least one text each. Null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    rows = len(column)
    if not rows:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + rows + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    low = 0
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1
        high = min(max(high, low + 1), rows)
        bounds = offsets[low : high + 1] - offsets[low]
        yield Slice(low, high, data[offsets[low] : offsets[high]], bounds)
        low = high


def words(data, bounds, separator=WHITE, values=BYTE_VALUES) -> Words:
    """All maximal runs of bytes that are no ``separator``; no word crosses two texts."""
    size, texts = len(data), len(bounds) - 1
    inside = ~separator[data]
    cut = np.zeros(size + 1, dtype=bool)
    cut[bounds] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:size]
    ends[:-1] &= ~inside[1:] | cut[1:size]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    if not len(start):
        empty = np.zeros(0, dtype=np.int64)
        return Words(start, end, np.zeros(0, np.uint64), empty, np.zeros(texts + 1, np.int64))
    span = np.diff(np.append(start, size))
    place = np.arange(start[0], size) - np.repeat(start, span)
    powers = np.full(int((end - start).max()), BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    terms = np.where(inside[start[0] :], values[data[start[0] :]], np.uint64(0))
    terms *= powers[np.minimum(place, len(powers) - 1)]
    code = mix(np.add.reduceat(terms, start - start[0]))
    first = np.searchsorted(start, bounds)
    text = np.repeat(np.arange(texts), np.diff(first))
    return Words(start, end, code, text, first)


def shingles(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs of ``width`` words inside a text, and the index of each first word."""
    count = len(found.code) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.zeros(count, dtype=np.uint64)
    for place in range(width):
        code += found.code[place : place + count] * PLACES[place]
    at = np.flatnonzero(found.text[:count] == found.text[width - 1 :])
    return mix(code[at]), at


def shingle_sets(found: Words, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles; fewer words than ``width`` are one
    shingle, no words none."""
    code, at = shingles(found, width)
    edges = np.searchsorted(at, found.first)
    for text in range(len(found.first) - 1):
        low, high = edges[text], edges[text + 1]
        if high > low:
            yield np.unique(code[low:high])
            continue
        own = found.code[found.first[text] : found.first[text + 1]]
        if len(own):
            whole = (own * PLACES[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
            yield mix(np.array([whole], dtype=np.uint64))
        else:
            yield own
