import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
import zstandard  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from casemesh.llm.byte_pairs import Encoder  # noqa: E402
from casemesh.llm.token_files import (  # noqa: E402
    DamagedFrame,
    TokenFile,
    TokenFiles,
    find_documents,
    open_index,
    read_documents,
    with_starts,
    write_token_files,
)
from helpers import clash, documents  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
ODD = [
    "It's we'll_ don't-stop a1b2 c,d;e (x)y  z\n\n w \r\n v\t", "naïve,́ éá.b", "日本語 text。 次",
    "a<|endoftext|> b<|endoftext|>", "\x1c \x85x\xa0y　z᠎", "", " ", "x" * 5000, "🙂 🙂🙂",
]


def ids_of(text):
    return np.array(WHOLE.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")


def test_ids_are_those_of_the_tokenizer():
    encoder = Encoder(PATH)
    for group in (ODD, ODD[::-1]):
        assert [e + b"\0" * 4 for e in encoder.encode(group)] == [ids_of(t).tobytes() for t in group]


def test_units_are_cut_where_the_pattern_cuts_for_every_character():
    encoder = Encoder(PATH)
    every = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b a{c} {c}b!{c}! {c}{c} {c}\n{c}  b{c}1{c}'s, {c}" for c in every]
    want = [one.ids for one in WHOLE.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(e, "<u4").tolist() for e in encoder.encode(texts)] == want


_ENCODER = Encoder(PATH)


@given(st.text("aZé'st_ \n\t\xa0,.9日́-", max_size=30))
@settings(max_examples=300, deadline=None)
def test_any_text_is_encoded_alike(text):
    assert _ENCODER.encode([text])[0] == ids_of(text)[:-1].tobytes()


def brute_force(spark, rows):
    """``(doc_id, start, n_tokens, crc)`` in ascending order of id, then hash."""
    marked = spark.createDataFrame(rows, "i long, t string").select("i", "t", F.xxhash64("t")).collect()
    marked.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    encoded = [(i, ids_of(text)) for i, text, _ in marked]
    out, start = [], 0
    for i, ids in encoded:
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def result(found, index):
    rows = with_starts(found, index).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    return sorted(map(tuple, rows), key=lambda r: (r[1], r[2]))


@pytest.fixture
def written(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(300))) for _ in range(50)]
    texts += [*ODD, None, "", texts[0], texts[0], "other"]
    ids = [7 * n % 101 for n in range(len(texts) - 5)] + [7, 7, 7, None, None]
    docs = clash(documents(spark, texts, ids))
    config = TokenFiles(PATH, frame_tokens=64, file_bytes=4000, file_documents=20)
    path = str(tmp_path / "files")
    write_token_files(docs, path, config)
    return path, list(zip(ids, texts))


def test_files_hold_every_document_in_order(spark, written):
    path, rows = written
    index = open_index(spark, path)
    want = brute_force(spark, rows)
    assert result(read_documents(index), index) == sorted(want, key=lambda r: (r[1], r[2]))
    assert index.select("file").distinct().count() > 3


def test_requested_documents_alone_are_read(spark, written):
    path, rows = written
    index = open_index(spark, path)
    wanted = spark.createDataFrame([(7,), (7,), (14,), (9999,), (None,)], "doc_id long")
    located = find_documents(index, wanted)
    want = [r for r in brute_force(spark, rows) if r[0] in (7, 14)]
    assert result(read_documents(located), index) == want


def files_of(path):
    import pathlib

    return sorted(pathlib.Path(path, "data").glob("*.tok"))


def test_a_file_can_be_read_alone_and_by_any_decoder(written):
    path, rows = written
    by_id = {}
    for i, text in rows:
        by_id.setdefault(i, []).append(ids_of(text).tolist())
    for name in files_of(path):
        data = name.read_bytes()
        file = TokenFile(pa.BufferReader(data))
        for place, told in enumerate(file.documents):
            assert file.document(place).tolist() in by_id[int(told["doc_id"]) if told["known"] else None]
        whole, at = b"", 0
        for packed in file.entries["packed"].tolist():
            whole += zstandard.ZstdDecompressor().decompress(data[at : at + packed])
            at += packed
        ids = np.frombuffer(whole[: 2 * int(file.documents["tokens"].sum())], "<u2")
        assert ids.tolist() == [i for p in range(len(file.documents)) for i in file.document(p)]


def test_only_frames_of_the_document_are_fetched(written):
    class Counting(pa.BufferReader):
        seen = []

        def read_at(self, size, offset):
            self.seen.append((offset, size))
            return super().read_at(size, offset)

    file = TokenFile(Counting(files_of(written[0])[0].read_bytes()))
    Counting.seen.clear()
    file.document(3)
    first, end = file.first_frames[3:5]
    assert Counting.seen == [(file.offsets[first], file.offsets[end] - file.offsets[first])]


def test_damage_is_noticed(written):
    data = bytearray(files_of(written[0])[0].read_bytes())
    file = TokenFile(pa.BufferReader(bytes(data)))
    place = int(np.argmax(file.documents["tokens"] > 3))
    data[int(file.offsets[file.first_frames[place]]) + 9] ^= 1
    damaged = TokenFile(pa.BufferReader(bytes(data)))
    with pytest.raises(DamagedFrame):
        damaged.document(place)
    for cut in (bytes(data[:-1]), bytes(data[-20:]), b""):
        with pytest.raises(DamagedFrame):
            TokenFile(pa.BufferReader(cut))


def test_wide_ids_take_four_bytes(tmp_path):
    from casemesh.llm.token_files import TokenFileWriter

    out = pa.BufferOutputStream()
    writer = TokenFileWriter(out, TokenFiles("", frame_tokens=3), 4)
    for i in range(4):
        writer.add(i, np.arange(i * 5, dtype="<u4") + 70_000)
    writer.close()
    file = TokenFile(pa.BufferReader(out.getvalue()))
    assert [file.document(i).tolist() for i in range(4)] == [
        [70_000 + k for k in range(i * 5)] for i in range(4)
    ]


def test_no_rows(spark, tmp_path):
    docs = documents(spark, ["x"]).limit(0)
    index = write_token_files(docs, str(tmp_path / "none"), TokenFiles(PATH))
    assert with_starts(read_documents(index), index).count() == 0


def test_very_long_text(spark, tmp_path):
    text = "word " * 200_000 + "x" * 100_000
    index = write_token_files(documents(spark, [text, "b"]), str(tmp_path / "long"), TokenFiles(PATH))
    assert result(read_documents(index), index) == brute_force(spark, [(0, text), (1, "b")])
