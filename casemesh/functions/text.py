"""Text predicates and formats, all native column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace a strip() removes, and the characters of a "word".
BLANK_CLASS = (
    r"\t-\r\x1c-\x20\x85\xa0"
    r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD_CLASS = r"\p{L}\p{N}_"
# What counts as content, and how a broken input announces itself.
CONTENT_CLASS = "a-zA-Z0-9"
ERROR_PREFIX = "Error:"
MAX_PLAIN_WORDS = 16


def is_blank(text: Column) -> Column:
    """Null, or nothing but whitespace (Unicode whitespace included)."""
    return F.coalesce(~text.rlike(f"[^{BLANK_CLASS}]"), F.lit(True))


def is_error(text: Column) -> Column:
    return F.coalesce(text.startswith(ERROR_PREFIX), F.lit(False))


def is_gibberish(text: Column, content_class: str = CONTENT_CLASS) -> Column:
    """No character of ``content_class`` is left. Pass ``\\p{L}\\p{N}`` for any script."""
    return F.coalesce(~text.rlike(f"[{content_class}]"), F.lit(True))


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _bounded(keyword: str) -> str:
    """One keyword between word boundaries, written as lookarounds.

    A boundary is a change between word and non-word characters, so a keyword that
    itself starts (ends) with a symbol needs a word character before (after) it.
    """
    before = f"(?<![{WORD_CLASS}])" if _is_word(keyword[0]) else f"(?<=[{WORD_CLASS}])"
    after = f"(?![{WORD_CLASS}])" if _is_word(keyword[-1]) else f"(?=[{WORD_CLASS}])"
    return before + "\\Q" + keyword.replace("\\E", "\\E\\\\E\\Q") + "\\E" + after


def keyword_pattern(keywords: Iterable[str]) -> str:
    """A single alternation, so one pass over the text tests the whole list."""
    words = [w.lower() for w in keywords if w]
    if not words:
        return "(?!)"
    if all(_is_word(c) for w in words for c in w):
        return f"(?<![{WORD_CLASS}])(?:{'|'.join(words)})(?![{WORD_CLASS}])"
    return "|".join(_bounded(w) for w in words)


def keyword_any(text: Column, keywords: Iterable[str], lowered: bool = False) -> Column:
    """Any keyword occurs in ``text`` as a whole word, whatever its case.

    A short list is first searched as plain substrings, which is far cheaper than the
    pattern; only texts that pass are held against the word boundaries.
    """
    words = [w.lower() for w in keywords if w]
    column = text if lowered else F.lower(text)
    hit = column.rlike(keyword_pattern(words))
    if 0 < len(words) <= MAX_PLAIN_WORDS:
        hit = reduce(or_, [column.contains(w) for w in words]) & hit
    return F.coalesce(hit, F.lit(False))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _formatted(number: Column, pattern: str) -> Column:
    return F.call_function("format_number", number, F.lit(pattern))


def days_label(days: Column, suffix: str = " Days") -> Column:
    """``2.25`` becomes ``2.2 Days``: one place, halves to even as the binary value says."""
    return F.concat(_formatted(days, "0.0"), F.lit(suffix))


def distance_label(distance: Column) -> Column:
    return _formatted(distance, "0.0000")


def eta_label(forced: Column, days: Column) -> Column:
    """A ready-made label wins over a number of days."""
    return F.coalesce(forced, days_label(days))
