"""Classifiers: held-out accuracy on texts whose rule is known, and odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from clickloom.llm.language import UNKNOWN, LanguageOptions, _gradients, fit, identify, keep_identified, window_probabilities
from clickloom.llm.quality import QualityOptions, rate_quality, thresholds
from clickloom.llm.toxicity import ToxicityOptions, score_toxicity
from clickloom.llm.toxicity import fit as fit_toxicity
from llm_texts import sentence


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


# --- toxicity ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pairs_corpus():
    """Toxic if an insult and a group are named; either alone is not."""
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(2400):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = sentence(rng, 30, 60).split()
        for there, terms in ((insult, ["idiot", "Moron"]), (group, ["martians", "venusians"])):
            if there:
                words.insert(rng.randrange(len(words)), rng.choice(terms))
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    return rows, labels


def test_machine_learns_what_only_a_pair_of_terms_shows(spark, make_docs, pairs_corpus, odd_texts):
    rows, labels = pairs_corpus
    docs = make_docs(rows + [(10_000 + i, t) for i, t in enumerate(odd_texts)] + [(1, rows[1][1]), (None, "idiot martians")])
    ratings = spark.createDataFrame([*labels, (5, None), (7, 7), (None, 1), labels[0]], "doc_id long, toxic int")
    found = score_toxicity(docs.withColumnRenamed("lang", "score"), ratings, ToxicityOptions(epochs=40)).collect()
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r for r in found}
    held = [i for i, _ in labels if is_held_out(i)]
    assert all(by_id[i]["held_out"] for i in held) and not by_id[None]["held_out"]
    right = np.mean([by_id[i]["predicted"] == labels[i][1] for i in held])
    assert right > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert by_id[10_000]["score"] == by_id[10_001]["score"] == by_id[10_002]["score"]


def test_machine_learns_pairs_of_terms_that_are_balanced_alone(spark, make_docs):
    """Toxic for A with B and for C with D, clean for A with D and C with B."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(2400):
        terms = rng.choice(["terma", "termc"]), rng.choice(["termb", "termd"])
        words = sentence(rng, 30, 60).split()
        for term in terms:
            words.insert(rng.randrange(len(words)), term)
        rows.append((i, " ".join(words)))
        labels.append((i, int(terms in (("terma", "termb"), ("termc", "termd")))))
    found = {r["doc_id"]: r["predicted"] for r in score_toxicity(make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert np.mean([found[i] == toxic for i, toxic in labels if is_held_out(i)]) > 0.97


def test_machine_uses_rare_terms_of_toxic_documents_alone():
    rng = random.Random(4)
    rows = [(i, int(i % 2), [int(t) for t in {rng.randrange(60) for _ in range(20)}]) for i in range(2400)]
    insults = [(i, toxic, 1.0, terms + [100 + (i // 2) % 120] * toxic) for i, toxic, terms in rows]  # 10 documents each
    model = fit_toxicity(pd.DataFrame(insults, columns=["id", "toxic", "weight", "terms"]), ToxicityOptions())
    assert model["used"][100:220].all() and (model["linear"][100:220] > 0.3).all()


def test_toxicity_without_labels_or_rows(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = make_docs([(1, "a b"), (2, None)])
    assert [r["score"] for r in score_toxicity(docs, none).collect()] == [0.5, 0.5]
    assert score_toxicity(make_docs([]), none).count() == 0


# --- quality ----------------------------------------------------------------------------------


def graded(rng, grade):
    """Better texts have fewer marks and repetitions."""
    words = sentence(rng, 40, 300).split()
    return " ".join(w + "!!" if rng.random() < 0.4 - 0.13 * grade else w for w in words)


def test_quality_orders_four_grades(spark, make_docs, odd_texts):
    rng = random.Random(1)
    labels = [(i, rng.randrange(4)) for i in range(2000)]
    rows = [(i, graded(rng, g)) for i, g in labels]
    docs = make_docs(rows + [(10_000 + i, t) for i, t in enumerate(odd_texts)])
    ratings = spark.createDataFrame([*labels, (1, None), labels[3]], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in rate_quality(docs.withColumnRenamed("lang", "tail"), ratings, QualityOptions(tail_grade=2)).collect()}
    held = [(i, g) for i, g in labels if is_held_out(i)]
    means = [np.mean([found[i]["grade"] for i, h in held if h == g]) for g in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 1.2
    assert np.mean([(found[i]["tail"] >= 0.5) == (g >= 2) for i, g in held]) > 0.85
    assert all(0 <= r["grade"] <= 3 and 0 <= r["tail"] <= 1 and r["selected"] == (r["tail"] >= 0.5) for r in found.values())
    assert len(found) == len(rows) + len(odd_texts)


def test_thresholds_stay_in_order():
    cuts = thresholds({"first": np.array([0.5]), "steps": np.array([-9.0, 2.0])})
    assert (np.diff(cuts) > 0).all()


def test_quality_of_nothing_and_of_one_grade(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = make_docs([(1, "a b"), (2, None)])
    assert [tuple(r) for r in rate_quality(docs, none).select("grade", "tail", "selected").collect()] == [(None,) * 3] * 2
    one = spark.createDataFrame([(1, 4)], "doc_id long, quality int")
    assert [tuple(r) for r in rate_quality(docs, one).select("grade", "tail").collect()] == [(4.0, 1.0)] * 2
    assert rate_quality(make_docs([]), none).count() == 0


# --- language ---------------------------------------------------------------------------------

SYLLABLES = {"xx": ["tha", "ing", "ow"], "yy": ["sch", "ung", "ö"], "zz": ["ción", "ña", "el"]}


def spoken(rng, language, words):
    return " ".join("".join(rng.choices(SYLLABLES[language], k=rng.randint(1, 3))) for _ in range(words))


def test_network_knows_held_out_texts(make_docs, odd_texts):
    rng = random.Random(2)
    rows = [(i, spoken(rng, lang := rng.choice(list(SYLLABLES)), rng.choice([4, 30, 200])), lang) for i in range(600)]
    rows += [(10_000 + i, t, rng.choice([None, "xx"])) for i, t in enumerate(odd_texts)]
    docs = make_docs(rows + [rows[0]]).withColumnRenamed("source", "score")
    found = identify(docs, LanguageOptions(epochs=3, per_language=100))
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(rows) + 1
    assert np.mean([by_id[i]["lang_pred"] == lang for i, _, lang in rows[:600] if is_held_out(i)]) > 0.97
    for i in (10_000, 10_001, 10_002, 10_003):  # null, empty, blank, without a letter
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == (UNKNOWN, 0.0)
    assert all(r["lang_pred"] in SYLLABLES for i, r in by_id.items() if i not in range(10_000, 10_004))
    kept = keep_identified(docs, LanguageOptions(epochs=3, per_language=100))
    assert kept.columns == docs.columns and set(kept.where("doc_id < 600").toPandas()["score"]) == {None}
    assert kept.where("doc_id between 10000 and 10003").count() == 0 and kept.count() >= 598


def test_language_of_nothing(make_docs):
    assert identify(make_docs([])).count() == 0
    assert [r["lang_pred"] for r in identify(make_docs([(1, "abc")])).collect()] == [UNKNOWN]


def test_gradients_are_those_of_the_loss():
    options = LanguageOptions(window=10, embedding=3, filters=2, epochs=0)
    rows = __import__("pandas").DataFrame({"id": [1, 2], "text": ["abcabcabca", "xyzxyzxyzx"], "lang": ["a", "b"]})
    weights = {k: v.astype(np.float64) for k, v in fit(rows, options).items() if k != "languages"}
    weights["bias"] += 1
    windows, target = np.frombuffer(b"abcabbabcaxyzxyxxyzx", np.uint8).reshape(2, 10), np.array([0, 1])

    def loss():
        return -np.log(window_probabilities(windows, weights, options)[[0, 1], target]).mean()

    gradients = _gradients(windows, target, weights, options)
    for name, at in (("embedding", (98, 1)), ("filters", (4, 3)), ("out", (2, 1)), ("bias", (1,)), ("out_bias", (0,))):
        step = 1e-6
        weights[name][at] += step
        up = loss()
        weights[name][at] -= 2 * step
        down = loss()
        weights[name][at] += step
        assert gradients[name][at] == pytest.approx((up - down) / (2 * step), abs=1e-5), name


def test_windows_cover_the_whole_text():
    from clickloom.llm.language import document_scores

    options = LanguageOptions(window=16, epochs=0)
    rows = __import__("pandas").DataFrame({"id": [1, 2], "text": ["a", "b"], "lang": ["a", "b"]})
    weights = fit(rows, options)
    text = "abc" * 200
    whole = document_scores(pa.array([text]), weights, options)
    changed = document_scores(pa.array([text[:-3] + "zzz"]), weights, options)
    assert not np.allclose(whole, changed, atol=1e-9)
    assert np.allclose(document_scores(pa.array(["x", text, None]), weights, options)[1], whole[0], atol=1e-6)
