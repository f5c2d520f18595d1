from lodex.llm import words


def test_one_long_text_does_not_thin_the_sample(spark):
    docs = spark.createDataFrame([(k, f"text {k} " * 10) for k in range(200)] + [(200, "x " * 500_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(201)], "doc_id long, label int")
    assert set(words.labelled_sample(docs, labels, 6000, 100_000).doc_id) >= set(range(200))
