import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodex.llm import langid, quality, toxicity, words
from lodex.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
ODD = [(None, None), (90_001, ""), (90_002, " \n "), (90_003, "x" * 50_000), (90_004, "!!! ??? ..."), (90_005, "12 34")]


def labelled(n=900, seed=1):
    """Texts of made-up words; one in five holds an insult in one of its sentences."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("an", "er", "tion", "de", "la", "ing", "ou", "st")) for _ in range(rng.randint(1, 4)))
    out = []
    for _ in range(n):
        sentences = [[word() for _ in range(rng.randint(3, 10))] for _ in range(rng.randint(1, 12))]
        bad = rng.random() < 0.2
        if bad:
            s = rng.choice(sentences)
            s.insert(rng.randrange(len(s)), rng.choice(("zwuckel", "Grobzwuck!", "zwuckig")))
        out.append((". ".join(" ".join(s) for s in sentences) + ".", int(bad)))
    return out


def test_word_features_are_their_own():
    some = ["Don't", "stop!!", "STOP", "naïve", "日本語", "a", "x-y", "***", "\U00020000b", "İ"]
    together = words.word_scores(some, np.random.default_rng(0).random(words.DIM))
    alone = [words.word_scores([w], np.random.default_rng(0).random(words.DIM))[0] for w in some]
    assert np.allclose(together, alone)


def test_sentences_by_hand():
    which, bounds, names = toxicity.words_of(pa.array([b"a b. c", b"", b"d " * 100], pa.binary()))
    number, by_doc = toxicity.sentence_numbers(which, bounds, names)
    assert number[:3].tolist() == [0, 0, 1] and by_doc.tolist() == [0, 2, 2, 5]


def test_noisy_or_finds_the_sentence(spark):
    texts = labelled()
    model = toxicity.fit([t for t, _ in texts[:600]], np.array([y for _, y in texts[:600]]))
    docs = spark.createDataFrame([(k, t, "clash") for k, (t, _) in enumerate(texts[600:])] + [(d, t, "clash") for d, t in ODD], "doc_id long, text string, score string").repartition(3)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    right = sum((rows[k].score >= 0.5) == (y == 1) for k, (_, y) in enumerate(texts[600:]))
    assert right >= 290
    for k, (t, y) in enumerate(texts[600:]):
        r = rows[k]
        if y and r.score >= 0.5:
            assert "zwuck" in r.worst_text.lower() and "zwuck" in " ".join(t.split()[r.worst_first_word : r.worst_first_word + r.worst_words]).lower()
    assert rows[90_001].score == 0 and rows[90_002].sentences == 0 and rows[None].score == 0
    # noisy-or over the sentences is the document's score
    u = words.word_scores(texts[600][0].split(), model.weights)
    which, bounds, names = toxicity.words_of(pa.array([texts[600][0].encode()], pa.binary()))
    number, _ = toxicity.sentence_numbers(which, bounds, names)
    p = [1 / (1 + np.exp(-(u[number == s].sum() + model.bias))) for s in range(number.max() + 1)]
    assert abs(rows[0].score - (1 - np.prod([1 - x for x in p]))) < 1e-6


@pytest.mark.parametrize("labels", [[], [0, 0], [1, 1]])
def test_toxicity_of_one_label(labels):
    model = toxicity.fit(["a b"] * len(labels), np.array(labels))
    assert (model.bias > 0) == (labels == [1, 1])


def test_ordinal_grades_are_ordered(spark):
    rng = random.Random(2)
    grades = [k % 4 for k in range(800)]
    texts = [" ".join(rng.choice(("junk", "trash", "spam") if rng.random() > g / 3 else ("fine", "clear", "sound")) for _ in range(60)) for g in grades]
    model = quality.fit(texts[:500], np.array(grades[:500]))
    assert model.grades == [0, 1, 2, 3] and (np.diff(model.thresholds) > 0).all()
    docs = spark.createDataFrame([(k, t, 9.0) for k, t in enumerate(texts[500:])] + [(d, t, 9.0) for d, t in ODD], "doc_id long, text string, tail double").repartition(3)
    rows = quality.grade(docs, model, at_least=2).collect()
    assert len(rows) == 300 + len(ODD) and all(0 <= r.expected_grade <= 3 and 0 <= r.tail <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    means = [np.mean([by[k].expected_grade for k in range(300) if grades[500 + k] == g]) for g in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 1.5
    assert np.mean([(by[k].tail >= 0.5) == (grades[500 + k] >= 2) for k in range(300)]) > 0.85
    assert {r.doc_id for r in quality.select_quality(docs, model, 2).collect()} == {r.doc_id for r in rows if r.tail >= 0.5}
    assert quality.grade(docs.limit(0), model, 2).count() == 0
    assert quality.fit([], np.array([])).grades == [0] and quality.fit(["a"], np.array([3])).grades == [3]


def test_language_words_first_then_shorter_grams(spark):
    texts = [("the house and the garden", "en"), ("the cat and the dog", "en"), ("das haus und der garten", "de"), ("die katze und der hund", "de")] * 10
    train = spark.createDataFrame([(k, t, lang, "s") for k, (t, lang) in enumerate(texts)] + [(1000, None, "de", "s"), (1001, "zzz", None, "s")], "doc_id long, text string, lang string, n string")
    model = langid.train(train)
    assert model.languages == ["de", "en"]
    docs = spark.createDataFrame([(1, "THE garden!"), (2, "hunde"), (3, "qqqq"), *ODD], "doc_id long, text string")
    rows = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert rows[1].lang_pred == "en" and rows[2].lang_pred == "de" and rows[3].lang_pred in ("de", "en")
    assert [rows[k].lang_pred for k in (None, 90_001, 90_002, 90_004, 90_005)] == ["und"] * 5 and rows[90_005].score == 0
    none = langid.train(train.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


def remainder(doc, n):
    return zlib.crc32(str(doc).encode()) % n


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    lang = QUERIES["op7_language_id"](spark, SF).collect()
    assert len(lang) == len(docs) and all(r.held_out == (remainder(r.doc_id, 4) == 2) for r in lang)
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in lang if r.held_out]) > 0.99
    toxic = QUERIES["op3_toxicity_mil"](spark, SF).collect()
    held = [r for r in toxic if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) for r in toxic)
    assert np.mean([r.predicted for r in held if labels[r.doc_id].toxic == 1]) > 0.8
    assert np.mean([r.predicted for r in held if labels[r.doc_id].toxic == 0]) < 0.01
    graded = [r for r in QUERIES["op4_quality_ordinal"](spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.kept for r in graded if labels[r.doc_id].quality == 1]) > 0.98
    assert np.mean([r.kept for r in graded if labels[r.doc_id].quality == 0]) < 0.15
