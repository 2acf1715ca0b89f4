"""Toxicity of documents: trees over dense features, calibrated by isotonic regression.

A lexicon is learned from the labelled sample: words, and beginnings of words, that are in
toxic documents far more often than in clean ones, each with its log odds. The features of a
text are how densely it holds lexicon entries, plain and after common character
substitutions are undone; how near they are to words that address a reader; and rates of
capitals, punctuation and obfuscated words.

What the trees learn from must not know the labels of its own row, so the lexicon for one
half of the sample comes from the other half. Calibration uses scores of folds a model has
not seen. The sample has about ``train_rows`` rows at most, the lexicon ``entries``.

Defined cases: as for quality; without labels the lexicon is empty and all scores are 0.5.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemesh.llm.boosting import Boosting, Isotonic, Trees, isotonic, train
from casemesh.llm.host_rules import per_text
from casemesh.llm.learning import Shipped, held_out
from casemesh.llm.quality import TRAIN_ROWS, collect_features, labelled_sample, score_column
from casemesh.llm.statistics import DIGIT, LOWER, PUNCT, SHOUT, UPPER
from casemesh.llm.words import (
    BYTE_VALUES, FOLDED_VALUES, PUNCTUATION, Words, constants, mix, slices, words,
)

# Words that address a reader, in the languages of the corpus.
SECOND_PERSON = (
    "you your yours yourself u ur "
    "tu te toi ton ta tes vous votre vos "
    "du dich dir dein deine ihr euch euer "
    "tú ti usted ustedes vosotros vuestro"
).split()
# Characters written in place of letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
BEGINNINGS = (4, 5)
NEAR_WORDS = 6

UNMASKED_VALUES = FOLDED_VALUES.copy()
for _mask, _letter in STAND_INS.items():
    UNMASKED_VALUES[ord(_mask)] = BYTE_VALUES[ord(_letter)]
UNMASKED_SEPARATOR = PUNCTUATION.copy()
UNMASKED_SEPARATOR[[ord(c) for c in "@$!"]] = False
KINDS = constants(len(BEGINNINGS) + 1, 5)


class Toxicity(NamedTuple):
    entries: int = 2000
    least_documents: int = 3
    least_odds: float = 2.0
    boosting: Boosting = Boosting(trees=50, depth=4)
    folds: int = 3


class Lexicon(NamedTuple):
    """Sorted codes and the log odds of each."""

    code: np.ndarray
    odds: np.ndarray

    def look(self, code: np.ndarray) -> np.ndarray:
        if not len(self.code):
            return np.zeros(len(code))
        near = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[near] == code, self.odds[near], 0.0)


class ToxicityModel(NamedTuple):
    lexicon: Lexicon
    trees: Trees
    calibration: Isotonic


def _code_of(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return words(data, np.array([0, len(data)]), PUNCTUATION, FOLDED_VALUES).code[0]


ADDRESSING = np.array(sorted(_code_of(word) for word in SECOND_PERSON), dtype=np.uint64)


def _forms(data, bounds, separator=PUNCTUATION, values=FOLDED_VALUES) -> tuple[Words, list]:
    """The words, and per kind the code of each word or of its beginning."""
    found = words(data, bounds, separator, values)
    codes = [found.code]
    for size in BEGINNINGS:
        short = _beginnings(found, data, values, size)
        longer = found.end - found.start > size
        codes.append(np.where(longer, short, np.uint64(0)))
    return found, [np.where(c == 0, c, c ^ kind) for c, kind in zip(codes, KINDS)]


def _beginnings(found: Words, data, values, size: int) -> np.ndarray:
    """A code of the first ``size`` bytes of every word."""
    places = constants(size, 4)
    code = np.zeros(len(found.start), dtype=np.uint64)
    for place in range(size):
        at = np.minimum(found.start + place, found.end - 1)
        code += values[data[at]] * places[place]
    return mix(code)


def _entry_counts(rows: DataFrame) -> DataFrame:
    """``half, code, toxic, clean``: labelled documents that hold each entry."""

    def run(batches):
        for batch in batches:
            labels = batch.column(2).to_numpy()
            halves = batch.column(0).to_numpy()
            for part in slices(batch.column(1)):
                found, kinds = _forms(part.data, part.bounds)
                if not len(found.code):
                    continue
                own = {"half": [], "code": [], "toxic": [], "clean": []}
                for codes in kinds:
                    used = codes != 0
                    code, text = codes[used], found.text[used]
                    _, first = np.unique(code ^ mix(text.astype(np.uint64)), return_index=True)
                    label = labels[part.low + text[first]]
                    half = halves[part.low + text[first]]
                    for side in (0, 1):
                        mine = half == side
                        entry, inverse = np.unique(code[first][mine], return_inverse=True)
                        toxic = np.bincount(inverse, label[mine], len(entry)).astype(np.int64)
                        own["half"].append(np.full(len(entry), side))
                        own["code"].append(entry.view(np.int64))
                        own["toxic"].append(toxic)
                        own["clean"].append(np.bincount(inverse, minlength=len(entry)) - toxic)
                yield pa.RecordBatch.from_pydict(
                    {name: pa.array(np.concatenate(c), pa.int64()) for name, c in own.items()}
                )

    return (
        rows.select("half", "text", "label")
        .mapInArrow(run, "half long, code long, toxic long, clean long")
        .groupBy("half", "code")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def _lexicon(counts: DataFrame, toxic: int, clean: int, config: Toxicity) -> Lexicon:
    """The entries with the largest share of the evidence; at most ``config.entries``."""
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log(
        (F.col("clean") + 0.5) / (clean + 1.0)
    )
    best = (
        counts.where(F.col("toxic") >= config.least_documents)
        .select("code", "toxic", odds.alias("odds"))
        .where(F.col("odds") >= config.least_odds)
        .orderBy(F.desc(F.col("toxic") * F.col("odds")), "code")
        .limit(config.entries)
        .toArrow()
    )
    code = best["code"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(code)
    return Lexicon(code[order], best["odds"].to_numpy().astype(np.float64)[order])


def _near(found: Words, hit: np.ndarray, texts: int) -> np.ndarray:
    """Hits per text that have an addressing word within ``NEAR_WORDS`` words."""
    place = np.minimum(np.searchsorted(ADDRESSING, found.code), len(ADDRESSING) - 1)
    you = np.r_[0, np.cumsum(ADDRESSING[place] == found.code)]
    at = np.flatnonzero(hit)
    low = np.maximum(at - NEAR_WORDS, found.first[found.text[at]])
    high = np.minimum(at + NEAR_WORDS + 1, found.first[found.text[at] + 1])
    return np.bincount(found.text[at][you[high] > you[low]], minlength=texts)


def toxic_features(data: np.ndarray, bounds: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    texts = len(bounds) - 1
    found, kinds = _forms(data, bounds)
    plain = [lexicon.look(codes) for codes in kinds]
    odds = np.maximum.reduce(plain) if len(found.code) else np.zeros(0)
    masked, masked_kinds = _forms(data, bounds, UNMASKED_SEPARATOR, UNMASKED_VALUES)
    masked_odds = lexicon.look(masked_kinds[0])
    flags = [np.r_[0, np.cumsum(t[data])] for t in (UPPER, LOWER, DIGIT, PUNCT)]
    inside = [f[masked.end] - f[masked.start] for f in flags]
    letters = inside[0] + inside[1]
    hidden = (letters > 0) & (inside[2] + inside[3] > 0)
    upper = [f[found.end] - f[found.start] for f in flags[:2]]
    shouted = (upper[0] > 1) & (upper[1] == 0)
    total = np.maximum(np.diff(found.first), 1)
    chars = np.maximum(per_text((data & 0xC0) != 0x80, bounds), 1)

    def count(mask, words_of=found):
        return np.bincount(words_of.text[mask], minlength=texts)

    def weigh(values, words_of=found):
        return np.bincount(words_of.text, values, minlength=texts)

    hits = count(odds > 0)
    top = np.zeros(texts)
    np.maximum.at(top, found.text, odds)
    masked_top = np.zeros(texts)
    np.maximum.at(masked_top, masked.text, masked_odds)
    columns = [
        hits / total, np.log1p(hits), weigh(odds) / total, np.log1p(weigh(odds)), top,
        np.log1p(count(plain[0] > 0)), np.log1p(count(plain[1] > 0)), np.log1p(count(plain[2] > 0)),
        np.log1p(count((masked_odds > 0), masked)), masked_top,
        np.log1p(count((masked_odds > 0) & hidden, masked)),
        _near(found, odds > 0, texts) / total, count(shouted) / total,
        count(shouted & (odds > 0)) / total, count(hidden, masked) / total,
        per_text(UPPER[data], bounds) / chars, per_text(PUNCT[data], bounds) / chars,
        per_text(SHOUT[data], bounds) / chars, np.log1p(np.diff(found.first)),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, config: Toxicity = Toxicity()
) -> ToxicityModel:
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).alias("half")
    sample = labelled_sample(docs, labels, "toxic", rows).select("doc_id", "text", "label", half)
    sample = sample.persist()
    try:
        sizes = {
            (r["half"], r["label"]): r["count"]
            for r in sample.groupBy("half", "label").count().collect()
        }
        counts = _entry_counts(sample).persist()
        x, y = [], []
        for side in (0, 1):
            other = counts.where(F.col("half") != side)
            lexicon = _lexicon(
                other, sizes.get((1 - side, 1), 0), sizes.get((1 - side, 0), 0), config
            )
            mine = sample.where(F.col("half") == side)
            own = collect_features(mine, lambda d, b, known=lexicon: toxic_features(d, b, known))
            if len(own[1]):
                x.append(own[0])
                y.append(own[1])
        whole = counts.groupBy("code").agg(
            F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
        )
        toxic, clean = (sum(n for (_, v), n in sizes.items() if v == k) for k in (1, 0))
        lexicon = _lexicon(whole, toxic, clean, config)
        counts.unpersist()
    finally:
        sample.unpersist()
    if not x:
        return ToxicityModel(lexicon, train(np.zeros((0, 1)), np.zeros(0)), isotonic(*np.zeros((2, 0))))
    x, y = np.concatenate(x), np.concatenate(y)
    unseen = np.zeros(len(y))
    fold = np.arange(len(y)) % config.folds
    for own in range(config.folds):
        part = train(x[fold != own], y[fold != own], config.boosting)
        unseen[fold == own] = part.probability(x[fold == own])
    return ToxicityModel(lexicon, train(x, y, config.boosting), isotonic(unseen, y))


def predict_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    sent = Shipped(docs.sparkSession.sparkContext, "toxicity", model)

    def score(data, bounds):
        own = sent.get()
        return own.calibration(own.trees.probability(toxic_features(data, bounds, own.lexicon)))

    return score_column(docs, score).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
