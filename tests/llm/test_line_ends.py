import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from casemesh.llm.byte_pairs import UNIT, Encoder  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_words_behind_a_line_end_are_no_case_for_the_whole_tokenizer():
    encoder, asked = Encoder(PATH), []
    ids = encoder._ids
    encoder._ids = lambda texts: asked.extend(texts) or ids(texts)
    encoder.encode(["One two\nThree four\nfünf six"])
    assert asked == ["\n"]


def test_units_keep_the_ids_of_the_library():
    rng, whole, encoder = random.Random(5), Tokenizer.from_file(PATH), Encoder(PATH)
    parts = [*"ab Zé\t\r.,'-_{~09ßɏɐİ日́\x85\xa0　½", "\n", "\n", "\n\n", " \n", "\n ", "'ll", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(5000)]
    want = [np.array(found.ids, "<u4").tobytes() for found in whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want
    assert all("".join(UNIT.findall(text)) == text for text in texts)
