"""Dense statistics of whole texts, computed for a slice of a column at a time."""

from __future__ import annotations

import numpy as np

from casemesh.llm.host_rules import NEWLINE, per_text
from casemesh.llm.words import WHITE, Words, mix, shingles, words


def _table(test) -> np.ndarray:
    return np.array([c < 128 and test(chr(c)) for c in range(256)])


UPPER = _table(str.isupper)
LOWER = _table(str.islower)
DIGIT = _table(str.isdigit)
PUNCT = _table(lambda c: not c.isalnum() and c > " ")
SENTENCE = _table(lambda c: c in ".?")
SHOUT = _table(lambda c: c == "!")
MARKUP = _table(lambda c: c in "#*$%&|<>{}[]=_~^\\/")
BULLET = _table(lambda c: c in "-*#|>")
LONG = np.arange(256) >= 128

NAMES = (
    "log_chars", "log_words", "mean_word", "long_words", "upper", "digit", "punct", "sentence",
    "shout", "markup", "beyond_ascii", "distinct_words", "top_word", "repeated_trigrams",
    "upper_words", "marked_words", "repeated_words", "log_lines", "mean_line", "repeated_lines",
    "ended_lines", "bullet_lines", "short_lines",
)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _flags(found: Words, mask: np.ndarray, texts: int) -> np.ndarray:
    return np.bincount(found.text[mask], minlength=texts)


def _repetition(code: np.ndarray, owner: np.ndarray, texts: int):
    """Distinct codes per text, and how often the commonest one is there."""
    keys, first, counts = np.unique(
        code ^ mix(owner.astype(np.uint64)), return_index=True, return_counts=True
    )
    del keys
    top = np.zeros(texts, dtype=np.int64)
    np.maximum.at(top, owner[first], counts)
    return np.bincount(owner[first], minlength=texts), top


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row per text, the columns of ``NAMES``. Empty texts are all zeros."""
    texts = len(bounds) - 1
    found = words(data, bounds)
    lines = words(data, bounds, separator=NEWLINE)
    chars = per_text((data & 0xC0) != 0x80, bounds)
    n_words, n_lines = np.diff(found.first), np.diff(lines.first)
    length = found.end - found.start

    def share(flags: np.ndarray) -> np.ndarray:
        return _share(per_text(flags[data], bounds), chars)

    upper, lower, punct = (np.r_[0, np.cumsum(t[data])] for t in (UPPER, LOWER, PUNCT))
    ups = upper[found.end] - upper[found.start]
    shouted = (ups > 1) & (lower[found.end] == lower[found.start])
    marked = punct[found.end] - punct[found.start] > 1
    distinct, top = _repetition(found.code, found.text, texts)
    code, at = shingles(found, 3)
    different, _ = _repetition(code, found.text[at], texts)
    windows = np.bincount(found.text[at], minlength=texts)
    same = np.zeros(len(found.code), dtype=bool)
    same[1:] = (found.code[1:] == found.code[:-1]) & (found.text[1:] == found.text[:-1])
    line_kinds, _ = _repetition(lines.code, lines.text, texts)
    last, first = data[lines.end - 1], data[lines.start]
    spans = lines.end - lines.start
    columns = [
        np.log1p(chars), np.log1p(n_words), _share(per_text(~WHITE[data], bounds), n_words),
        _share(_flags(found, length > 20, texts), n_words), share(UPPER), share(DIGIT),
        share(PUNCT), share(SENTENCE), share(SHOUT), share(MARKUP), share(LONG),
        _share(distinct, n_words), _share(top, n_words), _share(windows - different, windows),
        _share(_flags(found, shouted, texts), n_words), _share(_flags(found, marked, texts), n_words),
        _share(_flags(found, same, texts), n_words), np.log1p(n_lines), _share(chars, n_lines),
        _share(n_lines - line_kinds, n_lines), _share(_flags(lines, SENTENCE[last], texts), n_lines),
        _share(_flags(lines, BULLET[first], texts), n_lines),
        _share(_flags(lines, spans < 20, texts), n_lines),
    ]
    return np.stack(columns, axis=1).astype(np.float64)
