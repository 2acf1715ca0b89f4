import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from casemesh.llm.packing import Packing, _Encoder, fill, pack, windows  # noqa: E402
from helpers import clash, documents  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ODD = [
    "It's we'll THEY'RE 'stop x's' don't", "a_b__c 12 3.5% (x), \"q\"...", "Été İstanbul ǅ ﬁne Straße",
    "² ½ ª µ", "日本語 text", "<|endoftext|> and <| x", "e\u0301 a\u0300b", "tab\x1cone\x85two\xa0three",
    "", " \n ", "Σίσυφος", "x" * 3000,
]


def ids_of(text):
    return np.array(WHOLE.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")


def test_ids_are_those_of_the_tokenizer():
    encoder = _Encoder(PATH)
    for group in (ODD, ODD[::-1], ["".join(chr(c) for c in range(1, 0x250))]):
        got = encoder.encode(group)
        assert [g + b"\1\0\0\0" for g in got] == [ids_of(t).tobytes() for t in group]


@given(st.text("aÀ'st_ ,.9éİß\u0301ſ", max_size=25))
@settings(max_examples=200, deadline=None)
def test_any_text_is_encoded_alike(text):
    assert _ENCODER.encode([text])[0] == ids_of(text)[:-1].tobytes()


_ENCODER = _Encoder(PATH)


@given(st.lists(st.integers(1, 40), max_size=9), st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_fill_comes_closest(lengths, room):
    sums = {0}
    for length in lengths:
        sums |= {s + length for s in sums if s + length <= room}
    counts = np.bincount(lengths, minlength=61)
    chosen = fill(counts, room)
    assert sum(length * n for length, n in chosen.items()) == max(sums)
    assert all(0 < n <= counts[length] for length, n in chosen.items())


def test_windows_take_every_piece_with_little_padding():
    rng = random.Random(3)
    lengths = np.array([rng.randrange(1, 2048) for _ in range(3000)])
    found = windows(lengths, 2048)
    taken = np.zeros(2049, int)
    for window in found:
        assert sum(length * n for length, n in window.items()) <= 2048
        for length, n in window.items():
            taken[length] += n
    assert (taken == np.bincount(lengths, minlength=2049)).all()
    assert len(found) * 2048 - lengths.sum() < 0.01 * lengths.sum()


def test_pieces_and_sequences(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(400))) for _ in range(60)]
    texts += [None, "", texts[0], " ".join(["word"] * 1500)]
    docs = clash(documents(spark, texts, [*range(62), 0, None]))
    rows = pack(docs, Packing(PATH, capacity=256, shard_rows=32)).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for number, own in by_doc.items():
        ids = ids_of(texts[63] if number is None else texts[number])
        copies = 2 if number == 0 else 1
        assert sum(r["length"] for r in own) == copies * len(ids)
        for r in own:
            cut = ids[r["start"] : r["start"] + r["length"]].tobytes()
            assert (zlib.crc32(cut), len(ids)) == (r["ids_crc32"], r["doc_tokens"])
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:n]) for n in range(len(own))]
        assert sum(r["length"] for r in own) <= 256
    assert set(by_doc) == {*range(62), None}
    assert pack(docs.limit(0), Packing(PATH)).count() == 0
