import random
from collections import Counter

from lodex.llm import langid


def _prose(letters, seed, many):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(60)]
    return [[rng.choice(vocabulary) for _ in range(30)] for _ in range(many)]


def test_language_of_the_middle_of_an_unspaced_text(spark):
    a, b = _prose("abcdefg", 1, 60), _prose("defghij", 2, 60)
    docs = spark.createDataFrame([(k, " ".join(w), lang) for k, (w, lang) in enumerate([(w, "aa") for w in a[:50]] + [(w, "bb") for w in b[:50]])], "doc_id long, text string, lang string")
    model = langid.train(docs)
    middle = [w for d in b[50:] for w in d]
    texts = {1: joint.join(a[50] + middle + a[51]) for joint in [""]} | {2: ",".join(a[52] + middle + a[53]), 3: " ".join(a[54] + middle + a[55]), 4: "".join(middle) + " " + " ".join(a[56][:20])}
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    assert got == {1: "bb", 2: "bb", 3: "bb", 4: "bb"}


def test_grams_of_a_long_word_are_those_in_it():
    rng = random.Random(3)
    for size in (*range(40, 60), 64, 65, 80, 500, 1003):
        word = "".join(rng.choice("abcdefgh") for _ in range(size))
        for n in range(1, langid.LONGEST + 1):
            found = Counter(g for _, held, places in langid.pieces(word) for g in langid.grams(held, n, places))
            assert found == Counter(f"<{word}>"[k : k + n] for k in range(size + 3 - n)), (size, n)
    assert "".join(core for core, _, _ in langid.pieces("Ab-" * 40)) == "ab" * 40
