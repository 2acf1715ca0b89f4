import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from casemesh.llm.words import FOLDED_VALUES, shingle_sets, slices, words
from helpers import WORD

TEXTS = st.lists(st.one_of(st.none(), st.text("aAbé日 \t\n\r.", max_size=30)), max_size=8)


@given(TEXTS, st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_words_are_those_of_the_pattern(texts, size):
    found = []
    for part in slices(pa.array(texts, pa.string()), size):
        own = words(part.data, part.bounds)
        for text in range(part.high - part.low):
            span = range(own.first[text], own.first[text + 1])
            found.append([bytes(part.data[own.start[k] : own.end[k]]).decode() for k in span])
    assert found == [WORD.findall(t or "") for t in texts]


@given(TEXTS)
@settings(max_examples=100, deadline=None)
def test_equal_words_have_equal_codes(texts):
    code_of = {}
    for part in slices(pa.array(texts, pa.string())):
        own = words(part.data, part.bounds, values=FOLDED_VALUES)
        for start, end, code in zip(own.start, own.end, own.code):
            word = bytes(part.data[start:end]).decode().translate({65: "a", 66: "b"})
            assert code_of.setdefault(word, code) == code
    assert len(set(code_of.values())) == len(code_of)


def test_shingle_sets_of_short_and_empty_texts():
    texts = pa.array(["a b c d", "b c", "", None, "c b", "a b c a b c"])
    (part,) = slices(texts)
    sets = list(shingle_sets(words(part.data, part.bounds), 3))
    assert [len(s) for s in sets] == [2, 1, 0, 0, 1, 3]
    assert not np.array_equal(sets[1], sets[4])
    assert np.isin(sets[0][:1], sets[5]).all() or np.isin(sets[0][1:], sets[5]).all()


def test_sliced_arrays_keep_their_offsets():
    texts = pa.array(["one two", "three", "four five six"]).slice(1)
    parts = list(slices(texts, 1))
    assert [bytes(p.data).decode() for p in parts] == ["three", "four five six"]
    assert list(slices(pa.array([], pa.string()))) == []
