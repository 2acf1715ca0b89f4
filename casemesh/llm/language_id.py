"""Language of whole texts: known words first, character n-grams for the others.

Training counts words, and the character n-grams of words between blanks, per language. A
known word scores its log frequency in every language. An unseen word scores by its longest
n-grams that are known at all, averaged; shorter n-grams are asked only where no longer one
is known. A text scores the mean over its words.

The model is fitted on a bounded sample of the labelled rows (``train_rows`` per language)
and holds the ``max_entries`` most frequent words of each language and as many n-grams.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is
everything if nothing teaches; languages that are null teach nothing, and every other one
that teaches at all can be predicted; rows without id
neither teach nor are held out; repeated rows all come back; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from casemesh.llm.learning import Shipped, held_out, teaches, worker_state
from casemesh.llm.words import slices

LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
LONGEST = 5
SMOOTHING = 0.1
# Words a score is worth at most: keeps long texts from all scoring exactly 1.
EVIDENCE = 8.0
CACHE_WORDS = 300_000


class LanguageModel(NamedTuple):
    """``words`` and ``grams``: row of each entry in the score matrix of its kind."""

    languages: tuple[str, ...]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray


def grams_of(word: str, size: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


def _count(docs: DataFrame) -> DataFrame:
    """``size, entry, lang, n``: words have size 0. One row per task, language and entry."""

    def run(batches):
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        for lang, counts in found.items():
            for size in range(LONGEST + 1):
                if size:
                    entries: Counter = Counter()
                    for word, n in counts.items():
                        for gram in grams_of(word, size):
                            entries[gram] += n
                else:
                    entries = counts
                yield pa.RecordBatch.from_pydict({
                    "size": pa.array([size] * len(entries), pa.int32()),
                    "entry": pa.array(list(entries), pa.string()),
                    "lang": pa.array([lang] * len(entries), pa.string()),
                    "n": pa.array(list(entries.values()), pa.int64()),
                })

    return docs.select("lang", "text").mapInArrow(run, "size int, entry string, lang string, n long")


def _most_frequent(counts: DataFrame, quota: int) -> DataFrame:
    """``entry``: the ``quota`` most frequent entries of every language; ties go to the first
    in order, so no class of equal counts comes or goes at once."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "entry"))
    return counts.withColumn("place", place).where(F.col("place") <= quota).select("entry").distinct()


def _sample(labelled: DataFrame, quota: int) -> DataFrame:
    """About ``quota`` rows of every language, chosen by hash; all rows of smaller ones."""
    scale = 1 << 30
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    bound = F.least(F.lit(scale), F.floor(F.lit(float(scale)) * quota / F.col("rows"))).cast("long")
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < F.col("bound")
    return labelled.join(sizes.select("lang", bound.alias("bound")), "lang").where(chosen).drop("bound")


def _scores(rows: pa.Table, languages: tuple[str, ...]) -> tuple[dict[str, int], np.ndarray]:
    place = {lang: i for i, lang in enumerate(languages)}
    index: dict[str, int] = {}
    entries, langs, counts = (rows[c].to_pylist() for c in ("entry", "lang", "n"))
    for entry in entries:
        index.setdefault(entry, len(index))
    table = np.full((max(len(index), 1), len(languages)), SMOOTHING)
    for entry, lang, n in zip(entries, langs, counts):
        table[index[entry], place[lang]] += n
    return index, np.log(table / table.sum(axis=0)).astype(np.float32)


def fit(docs: DataFrame, train_rows: int = 5_000, max_entries: int = 25_000) -> LanguageModel:
    """Learns from the rows of ``docs`` that may teach. Only the bounded model is collected.

    Both bounds hold for each language of its own, so that a rare one is learned as well
    beside one that has most of the rows.
    """
    labelled = docs.where(teaches() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = _sample(labelled.select("doc_id", "lang", "text"), train_rows)
    counts = _count(sample).groupBy("size", "entry", "lang").agg(F.sum("n").alias("n")).persist()
    try:
        languages = tuple(sorted(r["lang"] for r in counts.select("lang").distinct().collect()))
        kinds = []
        for kind in (F.col("size") == 0, F.col("size") > 0):
            own = counts.where(kind)
            kept = _most_frequent(own, max_entries)
            rows = own.join(kept, "entry", "left_semi").select("entry", "lang", "n").toArrow()
            kinds += _scores(rows, languages)
    finally:
        counts.unpersist()
    return LanguageModel(languages, *kinds)


class _Memo:
    """Scores of the words seen by this worker, started anew when it is full."""

    def __init__(self, model: LanguageModel):
        self.model = model
        # Few numbers per gram: plain tuples are quicker to average than small arrays.
        scores = list(map(tuple, model.gram_scores.tolist()))
        self.grams = {gram: scores[row] for gram, row in model.grams.items()}
        self.clear()

    def word_score(self, word: str):
        row = self.model.words.get(word)
        if row is not None:
            return self.model.word_scores[row]
        for size in range(min(LONGEST, len(word) + 2), 0, -1):
            rows = [r for r in map(self.grams.get, grams_of(word, size)) if r is not None]
            if rows:
                return [sum(column) / len(rows) for column in zip(*rows)]
        return 0.0

    def clear(self):
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.languages)), dtype=np.float32)

    def means(self, found: list[str]) -> np.ndarray:
        if len(self.rows) > CACHE_WORDS:
            self.clear()
        rows = self.rows
        for word in {word for word in found if word not in rows}:
            if len(rows) == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[len(rows)] = self.word_score(word)
            rows[word] = len(rows)
        return self.table[[rows[word] for word in found]].mean(axis=0, dtype=np.float64)


def identify(text: str | None, memo: _Memo) -> tuple[str, float]:
    found = LETTERS.findall(text.lower()) if text else []
    lettered = any(any(map(str.isalpha, word)) for word in found)
    if not lettered or not memo.model.languages:
        return UNDETERMINED, 0.0
    mean = memo.means(found) * min(EVIDENCE, len(found))
    best = int(mean.argmax())
    return memo.model.languages[best], float(1.0 / np.exp(mean - mean[best]).sum())


def predict(
    docs: DataFrame, model: LanguageModel, lang: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """``docs`` with the columns ``lang`` and ``score``, names it must not have; all others
    stay."""
    names = docs.columns
    if {lang.lower(), score.lower()} & {c.lower() for c in names}:
        raise ValueError(f"the table has a column named {lang} or {score}")
    sent = Shipped(docs.sparkSession.sparkContext, "language", model)
    at = names.index("text")

    def run(batches):
        model = sent.get()
        state = worker_state("language")
        if "memo" not in state:
            state["memo"] = _Memo(model)
        for batch in batches:
            found = [
                identify(text, state["memo"])
                for part in slices(batch.column(at))
                for text in batch.column(at)[part.low : part.high].to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([lang for lang, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                ],
                [*names, lang, score],
            )

    added = T.StructType().add(lang, "string").add(score, "double")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


def language_table(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )
