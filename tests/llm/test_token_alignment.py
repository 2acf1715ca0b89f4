import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from casemesh.llm import token_alignment  # noqa: E402
from casemesh.llm.token_alignment import Alignment, Tokenizers, align, align_tokens  # noqa: E402
from helpers import clash, documents  # noqa: E402

CONFIG = Alignment(
    public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
)
A = Tokenizer.from_file(CONFIG.bytes_path)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=CONFIG.pieces_path)
NAMES = {n: t for t, n in A.get_vocab().items()}
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {chr(b): b for b in PLAIN}
BYTES |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in PLAIN)}
ODD = [
    "It's  two   spaces\n\nand\ttabs ", " leading", "日本語のテキスト、次", "🙂🙃 é́ naïve", "a<|endoftext|>b <s> </s> <0x41>",
    "a▁b", "▁", "", None, " ", "x" * 900, "ab" * 700, "\x00\x01 nul", "İstanbul ﬁne   x", "\r\n",
]


def sides(text):
    if not text:
        return [], []
    whole = (" " + text).encode()
    a = [(n, bytes(BYTES[c] for c in NAMES[n])) for n in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for n in B.encode(text):
        piece = B.id_to_piece(n)
        b.append((n, bytes([int(piece[3:5], 16)]) if B.is_byte(n) else piece.replace("▁", " ").encode()))
    good = all(b"".join(x for _, x in own) == whole for own in (a, b))
    return (a, b) if good else ([], [])


def groups_of(text):
    a, b = sides(text)
    out, left, right, size_a, size_b = [], [], [], 0, 0
    a, b = list(a), list(b)
    while a or b:
        if size_a <= size_b:
            n, own = a.pop(0)
            left, size_a = [*left, n], size_a + len(own)
        else:
            n, own = b.pop(0)
            right, size_b = [*right, n], size_b + len(own)
        if size_a == size_b:
            out.append((left, right))
            left, right = [], []
    return out


def brute_force(rows):
    made = [(i, groups_of(text)) for i, text in rows]
    counts = {}
    for _, groups in made:
        for pair in {(x, y) for left, right in groups for x in left for y in right}:
            counts[pair] = counts.get(pair, 0) + 1
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for i, groups in made:
        links = [(x, y) for left, right in groups for x in left for y in right]
        text = ";".join(f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in groups)
        out.append((
            i, sum(len(left) for left, _ in groups), sum(len(right) for _, right in groups), len(groups),
            len(links), hashlib.sha256(text.encode()).hexdigest() if groups else "",
            sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
        ))
    return sorted(out, key=str)


def rows_of(rng, count):
    words = ["".join(rng.choices("abcdeéß日,.-' ", k=rng.randrange(1, 12))) for _ in range(60)]
    return [" ".join(rng.choices(words, k=rng.randrange(1, 80))) for _ in range(count)]


@pytest.mark.parametrize("block_links", [2_000_000, 150])
def test_figures_are_those_of_the_definition(spark, block_links):
    texts = [*rows_of(random.Random(1), 40), *ODD, "same words", "same words"]
    ids = [*range(len(texts) - 4), 3, 3, None, None]
    docs = clash(documents(spark, texts, ids))
    got = align_tokens(docs, CONFIG._replace(block_links=block_links)).collect()
    assert sorted(map(tuple, got), key=str) == brute_force(list(zip(ids, texts)))


def test_some_odd_texts_have_tokens_and_some_have_none():
    figures, _ = align([text or "" for text in ODD], Tokenizers(CONFIG))
    some = [bool(n) for n in figures["n_a"]]
    assert some == [bool(sides(text)[0]) for text in ODD] and True in some and False in some


def test_large_groups_count_equal_ids_first(monkeypatch):
    texts = ["ab" * 300, "x" * 500, "日本" * 50, "one two"]
    tools = Tokenizers(CONFIG)
    figures, links = align(texts, tools)
    monkeypatch.setattr(token_alignment, "LARGE_GROUP", 1)
    again, counted = align(texts, tools)
    assert {tuple(r.values()) for r in links.to_pylist()} == {tuple(r.values()) for r in counted.to_pylist()}
    assert figures["n_links"].tolist() == again["n_links"].tolist()
    for doc, text in enumerate(texts):
        want = {}
        for left, right in groups_of(text):
            for x in left:
                for y in right:
                    want[(x << 32) + y] = want.get((x << 32) + y, 0) + 1
        assert {r["pair"]: r["times"] for r in links.to_pylist() if r["doc"] == doc} == want


def test_slices_do_not_change_results(monkeypatch, spark):
    texts = [*rows_of(random.Random(2), 20), *ODD]
    monkeypatch.setattr(token_alignment, "GROUP_CHARS", 64)
    got = align_tokens(documents(spark, texts), CONFIG).collect()
    assert sorted(map(tuple, got), key=str) == brute_force(list(enumerate(texts)))


def test_no_rows_and_no_tokens(spark):
    docs = documents(spark, ["a"])
    assert align_tokens(docs.limit(0), CONFIG).count() == 0
    got = align_tokens(documents(spark, [None, ""]), CONFIG).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 0, 0, 0, "", 0, 0), (1, 0, 0, 0, 0, "", 0, 0)]


def test_very_long_text(spark):
    text = "long words, repeated " * 20_000
    got = align_tokens(documents(spark, [text, "words"]), CONFIG).collect()
    assert sorted(map(tuple, got), key=str) == brute_force([(0, text), (1, "words")])
