import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from casemesh.llm import near_dedup, packing  # noqa: E402
from casemesh.llm.words import slices  # noqa: E402
from casemesh.session import BATCH_BYTES, BATCH_CONF, shuffles_dropped, small_batches  # noqa: E402
from helpers import documents  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_workers_get_texts_in_batches_of_bounded_bytes(spark, monkeypatch):
    def bounded(column, size=1 << 19):
        assert column.nbytes < 2 * BATCH_BYTES
        return slices(column, size)

    monkeypatch.setattr(packing, "slices", bounded)
    monkeypatch.setattr(near_dedup, "slices", bounded)
    docs = documents(spark, ["word " * 2000] * 2000, partitions=1)
    pieces = packing.pack(docs, packing.Packing(PATH)).agg({"length": "sum"}).first()
    assert pieces[0] == 2000 * 2001
    assert near_dedup.near_duplicates(docs).where("kept").count() == 1


def test_the_setting_is_put_back(spark):
    before = spark.conf.get(BATCH_CONF, None)
    with small_batches(spark), shuffles_dropped(spark), small_batches(spark):
        assert spark.conf.get(BATCH_CONF) == str(BATCH_BYTES)
    assert spark.conf.get(BATCH_CONF, None) == before


def test_pieces_that_come_again_outlive_the_others(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 50)
    encoder, text = packing._Encoder(PATH), "often it's n0"
    wanted = packing._Encoder(PATH).encode([text])[0]
    for n in range(40):
        others = [f"w{chr(97 + n % 26)}{chr(97 + k)}" for k in range(20)]
        assert encoder.encode([" ".join([text, *others])])[0].startswith(wanted)
        assert len(encoder.known) + len(encoder.before) < 200
    assert encoder.before and "often" in encoder.known
