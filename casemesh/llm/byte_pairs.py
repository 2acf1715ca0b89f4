"""Ids of whole texts from a byte-level vocabulary file, most words looked up and not encoded.

The pattern such vocabularies cut texts with never joins the end of a word with the white
space or punctuation behind it. So a text is cut into units, such as a run of white space
and the word after it, whose ids do not depend on their neighbours, and each worker keeps
the units it has seen.
"""

from __future__ import annotations

import os
import re

import numpy as np

ID_BYTES = 4
# Units kept in each of two generations; what the older one alone holds and nobody asks for goes.
CACHE_ENTRIES = 320_000
# Longer units hardly ever come again.
LONGEST_UNIT = 48
# Fixed value: the white space of the vocabulary's own pattern.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters whose run ends at ASCII punctuation or digits, where the pattern always cuts; so it
# does between a single line end and a letter. A run of letters is looked at once.
LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
WORD = rf"[{LETTER}]++(?:(?=[!-@\[-`{{-~])|[^{BLANK}]*+)"
UNIT = re.compile(rf"\n(?=[{LETTER}])|[{BLANK}]*+(?:{WORD}|[^{BLANK}]++)|[{BLANK}]++")
USUAL = re.compile(f"[{LETTER}]+")


def byte_values() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, by the public
    rule: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def load_tokenizer(path: str, plain_specials: bool):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain_specials
    return tokenizer


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes each id stands for."""
    values = byte_values()
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    out = [b""] * size
    for token, number in tokenizer.get_vocab(with_added_tokens=True).items():
        if all(c in values for c in token):
            out[number] = bytes(values[c] for c in token)
        else:
            out[number] = token.encode()
    return out


def uncut(unit: str) -> bool:
    """Whether the pattern takes ``unit`` as one piece: letters, with a space before or not."""
    word = unit[1:] if unit[0] == " " else unit
    return word.isalpha() and (word.isascii() or USUAL.fullmatch(word) is not None)


class Encoder:
    """``plain_specials``: strings of special tokens inside texts are ordinary text."""

    def __init__(self, path: str, plain_specials: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = load_tokenizer(path, plain_specials)
        self.specials = [
            token.content
            for token in self.tokenizer.get_added_tokens_decoder().values()
            if not plain_specials
        ]
        # The model alone: words are written in its own characters, split at blanks.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = {byte: letter for letter, byte in byte_values().items()} | {0: " "}
        self.sizes = np.array([len(b) for b in token_bytes(self.tokenizer)], dtype=np.int64)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, dtype="<u4").tobytes() for one in found]

    def _learn(self, units: list[str]) -> None:
        """Units the pattern does not cut any more are encoded together, without it."""
        whole = [unit for unit in units if uncut(unit)]
        if whole:
            text = "\0".join(whole).encode().decode("latin-1").translate(self.letters)
            ids = self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids
            packed = np.array(ids, dtype="<u4")
            ends = np.cumsum(self.sizes[packed])
            sizes = np.cumsum(list(map(len, text.split(" "))))
            cuts = np.searchsorted(ends, sizes)
            if cuts[-1] != len(ends) - 1 or (ends[cuts] != sizes).any():
                raise ValueError("the vocabulary is not byte-level")
            packed, highs = packed.tobytes(), ((cuts + 1) * ID_BYTES).tolist()
            self.known.update(zip(whole, map(packed.__getitem__, map(slice, [0, *highs], highs))))
        if len(whole) < len(units):
            others = [unit for unit in units if unit not in self.known]
            self.known.update(zip(others, self._ids(others)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHE_ENTRIES:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        cut = [
            [text] if any(special in text for special in self.specials) else UNIT.findall(text)
            for text in texts
        ]
        missed = [unit for unit in set().union(*cut) if unit not in known]
        if before:
            known.update((unit, before[unit]) for unit in missed if unit in before)
            missed = [unit for unit in missed if unit not in known]
        once = {unit for unit in missed if len(unit) > LONGEST_UNIT}
        own = dict(zip(once, self._ids(list(once))))
        if missed:
            self._learn([unit for unit in missed if unit not in once])
        if own:
            return [b"".join([known.get(unit) or own[unit] for unit in found]) for found in cut]
        return [b"".join(map(known.__getitem__, found)) for found in cut]
