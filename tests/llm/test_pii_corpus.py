import random

from lodex.llm import pii

SF = "/root/testdata/sf0.01"


def test_spans_are_added_on_real_texts(spark):
    """Secrets that the corpus holds are found, base spans stay, and what is added is right nearly always."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = pii.train(docs)
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    added, planted = [], 0
    for r in pii.find(docs, model).collect():
        text = texts[r.doc_id]
        base = {pii.told([s]) for s in pii.base_spans(text)}
        every = set(r.spans.split(",")) - {""}
        assert base <= every and r.n_spans == len(every)
        assert r.n_secret == sum(s.startswith("secret:") for s in every)
        added += [(text, s) for s in every - base]
        planted += sum(text.lower().count(f'token{gap}"') for gap in (" = ", "="))
    secrets = sum(s.startswith("secret:") and text[: int(s.split(":")[1])].lower().rstrip("\"'").rstrip().endswith("=") for text, s in added)
    cards = sum(s.startswith("card:") and pii.luhn(pii.digits_of(text[int(s.split(":")[1]) : int(s.split(":")[2])])) for text, s in added)  # in runs of digits that the rule drops
    assert planted and secrets >= 0.95 * planted and secrets + cards >= 0.95 * len(added)


def test_hand_made_cases(spark):
    model = pii.train(spark.read.parquet(f"{SF}/documents.parquet"))
    cases = [("call (555) 123-4567 now", "phone:5:19"), ("mail bob [at] site [dot] com please", "email:5:27"), ('api_key = "9f86d081884c7d659a2feaa0c55ad015"', "secret:11:43"), ("ip 10 . 20 . 30 . 40 is up", "ip:3:20"), ("commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", ""), ("on 2021-03-04 we met", ""), ("order 4041894974608796 came", ""), ("see pages 12-34 and 56.78", "")]
    right = sum(pii.told(model.spans(text)[1]) == want for text, want in cases)
    assert right >= 7, [(text, pii.told(model.spans(text)[1])) for text, _ in cases]


def test_long_digit_runs_and_odd_tables(spark):
    for text in ("0" * 5000 + "1.1.1.1", "9" * 20_000 + ".1.1.1", "token = '" + "a1" * 40_000 + "'", "1 " * 50_000 + "1.2.3.4"):
        base, every = pii.redactor().spans(text)
        assert set(base) <= set(every)
    rows = [(1, "mail a@b.co"), (1, "mail a@b.co"), (None, None), (2, "")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_spans int")
    got = pii.find(df, pii.train(df)).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_spans) for r in got) == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 0, 0)]
    assert pii.find(df.limit(0), pii.train(df.limit(0))).count() == 0


def test_picked_spans_dont_overlap():
    rng = random.Random(4)
    for _ in range(300):
        text = " ".join(rng.choice(("555-123-4567", "10 . 1 . 2 . 3", 'key="a1b2c3d4e5f6a7b8c9d0"', "4111/1111/1111/1111", "x@y.com", "the")) for _ in range(12))
        base, every = pii.redactor().spans(text)
        added = sorted((s, e) for k, s, e in set(every) - set(base))
        assert all(a[1] <= b[0] for a, b in zip(added, added[1:], strict=False))


def test_long_things_are_taken_whole(spark):
    """Secrets of hundreds and thousands of characters, addresses with long parts: candidates and redactions reach their ends."""
    rng, model = random.Random(2), pii.train(spark.read.parquet(f"{SF}/documents.parquet"))
    letters = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = 0
    for size in (40, 150, 300, 2000) * 5:
        secret = "7a" + "".join(rng.choice(letters) for _ in range(size - 2))
        head = f"set {rng.choice(('token', 'api_key', 'secret'))} = \""
        text = f'{head}{secret}" and go on'
        assert (4, len(head), len(head) + size) in pii.candidates(text)
        added = {s for s in model.spans(text)[1] if s[0] == 4}
        assert all(len(text) - 11 - len('"') <= e for _, _, e in added)  # none ends within
        found += (4, len(head), len(head) + size) in added
    assert found >= 18
    local, host = "x" * 70 + ".y" * 10, "h" * 80
    text = f"mail {local} [at] {host} [dot] a [dot] bb [dot] cc [dot] dd [dot] ee [dot] com now"
    text = text.replace(" [dot] a ", " [dot] aa ")
    assert (0, 5, len(text) - 4) in pii.candidates(text)
    assert len(pii.candidates("a" * 200_000 + " [at] " + "b-" * 100_000)) <= 2
