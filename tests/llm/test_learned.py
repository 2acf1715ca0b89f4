import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemesh.llm.boosting import Boosting, isotonic, train
from casemesh.llm.language_id import _Memo, fit, grams_of, language_table
from casemesh.llm.learning import bounded_sample
from casemesh.llm.quality import fit_quality, predict_quality
from casemesh.llm.statistics import NAMES, statistics
from casemesh.llm.toxicity import fit_toxicity, predict_toxicity
from helpers import clash, documents

SYLLABLES = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "ung", "ver", "eit"], "cc": ["ção", "lho", "ém", "ués"]}


def sentence(rng, lang, words=30):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    texts, langs, labels = [], [], []
    for n in range(400):
        lang = rng.choice(list(SYLLABLES))
        text = sentence(rng, lang, rng.randrange(20, 60))
        good, toxic = int(rng.random() > 0.3), int(rng.random() < 0.3)
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            own = text.split()
            for _ in range(4):
                own.insert(rng.randrange(len(own)), rng.choice(["meanie", "m3anie", "villain"]))
            text = " ".join(own)
        texts.append(text)
        langs.append(lang if n % 9 else None)
        labels.append((n, good, toxic))
    texts += [None, "", "123 !!", "²³"]
    langs += ["aa", "bb", None, None]
    docs = documents(spark, texts, [*range(403), None], langs)
    labels += [(1, 1, None), (2, None, 0), (None, 1, 1), (9999, 0, 1)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), texts, langs


def test_language_of_held_out_texts(corpus):
    docs, _, texts, langs = corpus
    rows = language_table(clash(docs), fit(docs)).collect()
    assert len(rows) == len(texts)
    known = [r for r in rows if r["held_out"] and langs[r["doc_id"]] and r["doc_id"] < 400]
    right = [r["lang_pred"] == langs[r["doc_id"]] for r in known]
    assert len(right) > 80 and np.mean(right) == 1.0
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows if r["doc_id"] is None or r["doc_id"] >= 400}
    assert odd == dict.fromkeys([400, 401, 402, None], ("und", 0.0))


def test_language_without_teachers_and_rows(corpus):
    docs = corpus[0]
    model = fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_table(docs, model).collect()} == {"und"}
    assert language_table(docs.limit(0), fit(docs.limit(0))).count() == 0


def test_unseen_words_back_off_to_the_longest_known_grams(corpus):
    model = fit(corpus[0])
    word = "schungxq"
    longest = max(s for s in range(1, 6) if any(g in model.grams for g in grams_of(word, s)))
    rows = [model.grams[g] for g in grams_of(word, longest) if g in model.grams]
    assert word not in model.words and longest == 5
    assert np.allclose(_Memo(model).word_score(word), model.gram_scores[rows].mean(axis=0))


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(corpus, kind):
    docs, labels, texts, _ = corpus
    fitted, apply = (fit_quality, predict_quality) if kind == "quality" else (fit_toxicity, predict_toxicity)
    rows = apply(clash(docs), fitted(docs, labels)).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
    truth = {r["doc_id"]: r[kind] for r in labels.where("doc_id < 400").collect() if r[kind] is not None}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in held]) > 0.95
    if kind == "toxic":
        assert not any(a and not b for a, b in held)
    none = apply(docs, fitted(docs, labels.limit(0))).collect()
    assert {r["score"] for r in none} == {0.5}
    assert apply(docs.limit(0), fitted(docs, labels.limit(0))).count() == 0


def test_bounded_sample(spark):
    df = spark.range(10000)
    assert 400 < bounded_sample(df, 500, "id").count() < 600
    assert bounded_sample(df, 10000, "id").count() == 10000


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = train(x[:2000], y[:2000], Boosting(trees=40, depth=3))
    assert np.mean((model.probability(x[2000:]) > 0.5) == y[2000:]) > 0.97

    def walk(row):
        total = model.base
        for tree in range(len(model.feature)):
            node = 0
            while node < model.feature.shape[1]:
                node = 2 * node + 1 + (row[model.feature[tree, node]] > model.threshold[tree, node])
            total += model.leaf[tree, node - model.feature.shape[1]]
        return total

    assert np.allclose(model.raw(x[:50]), [walk(row) for row in x[:50]])


def test_isotonic_is_the_best_monotone_fit():
    score = np.array([0.1, 0.2, 0.2, 0.3, 0.4, 0.5])
    y = np.array([0.0, 1.0, 1.0, 0.0, 0.0, 1.0])
    assert np.allclose(isotonic(score, y)(score), [0, 0.5, 0.5, 0.5, 0.5, 1])
    assert (isotonic(np.zeros(0), np.zeros(0))(score) == score).all()


def test_statistics_of_odd_texts():
    texts = ["", "A a a", "x\n\nx\n", "日本 語"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    bounds = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    rows = statistics(data, bounds)
    assert rows.shape == (4, len(NAMES)) and np.isfinite(rows).all() and not rows[0].any()
    assert rows[1][NAMES.index("repeated_words")] == pytest.approx(1 / 3)
    assert rows[2][NAMES.index("repeated_lines")] == 0.5


def test_a_rare_language_is_learned_beside_a_common_one(spark):
    from casemesh.llm.language_id import fit, predict

    rng = random.Random(4)
    common = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(900)]
    rare = ["".join(rng.choices("opqrstuv", k=rng.randrange(2, 9))) for _ in range(60)]
    texts = [" ".join(rng.choices(common, k=30)) for _ in range(600)]
    texts += [" ".join(rng.choices(rare, k=30)) for _ in range(9)]
    docs = documents(spark, texts, langs=["xx"] * 600 + ["yy"] * 9)
    model = fit(docs, train_rows=20, max_entries=50)
    assert model.languages == ("xx", "yy") and len(model.words) <= 100
    rows = predict(docs, model).collect()
    assert all(r["lang_pred"] == r["lang"] for r in rows)


def test_scores_are_those_of_a_plain_model(spark):
    """The model again in a few lines: words first, then the longest n-grams that are known."""
    import math
    import re
    import zlib

    from casemesh.llm.language_id import EVIDENCE, LONGEST, SMOOTHING, fit, predict

    rng = random.Random(8)
    spoken = {lang: ["".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(40)]
              for lang, letters in (("aa", "abcdef"), ("bb", "defghi"), ("cc", "ghiabc"))}
    texts, langs = [], []
    for n in range(90):
        lang = rng.choice(sorted(spoken))
        texts.append(" ".join(rng.choices(spoken[lang], k=rng.randrange(1, 12))) + f" x{n}")
        langs.append(lang)
    docs = documents(spark, texts, langs=langs)
    words, grams = {}, {}
    for n, (text, lang) in enumerate(zip(texts, langs)):
        if zlib.crc32(str(n).encode()) % 3 == 1:
            continue
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            words.setdefault(word, dict.fromkeys(spoken, 0))[lang] += 1
            padded = f" {word} "
            for size in range(1, LONGEST + 1):
                for i in range(len(padded) - size + 1):
                    grams.setdefault(padded[i : i + size], dict.fromkeys(spoken, 0))[lang] += 1

    def logs(table):
        total = {lang: sum(own[lang] + SMOOTHING for own in table.values()) for lang in spoken}
        return {e: {lang: math.log((n + SMOOTHING) / total[lang]) for lang, n in own.items()} for e, own in table.items()}

    words, grams = logs(words), logs(grams)

    def scores(word):
        if word in words:
            return words[word]
        padded = f" {word} "
        for size in range(min(LONGEST, len(padded)), 0, -1):
            known = [grams[g] for i in range(len(padded) - size + 1) if (g := padded[i : i + size]) in grams]
            if known:
                return {lang: sum(k[lang] for k in known) / len(known) for lang in spoken}
        return dict.fromkeys(spoken, 0.0)

    for r in predict(docs, fit(docs)).collect():
        found = re.findall(r"[^\W\d_]+", r["text"].lower())
        means = {lang: sum(scores(w)[lang] for w in found) / len(found) * min(EVIDENCE, len(found)) for lang in spoken}
        best = max(means.values())
        want = 1 / sum(math.exp(m - best) for m in means.values())
        assert means[r["lang_pred"]] > best - 1e-3 and abs(r["score"] - want) < 1e-3
