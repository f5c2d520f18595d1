from test_long_words import _prose

from lodex.llm import langid


def test_small_language_keeps_its_words(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_WORDS", 60)
    monkeypatch.setattr(langid, "MOST_GRAMS", 60)
    a, b = _prose("abcdefg", 1, 950), _prose("defghij", 2, 60)
    docs = spark.createDataFrame([(k, " ".join(w), lang) for k, (w, lang) in enumerate([(w, "aa") for w in a] + [(w, "bb") for w in b[:50]])], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert {w for d in b[:50] for w in d} <= set(model.known_words)
    got = langid.predict(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(b[50:])], "doc_id long, text string"), model).collect()
    assert {r.lang_pred for r in got} == {"bb"}
