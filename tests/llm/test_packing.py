import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodex.llm import packing


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_plan_holds_each_piece_once_and_never_overflows(counts):
    histogram = np.zeros(65, dtype=np.int64)
    for n, c in counts.items():
        histogram[n] = c
    held = np.zeros(65, dtype=np.int64)
    for lengths, many in packing.plan_sequences(histogram, 64):
        assert sum(lengths) <= 64
        for n in lengths:
            held[n] += many
    assert (held == histogram).all()


def test_plan_is_near_the_bound():
    lengths = np.clip(np.random.default_rng(0).lognormal(6.5, 1, 50_000).astype(int) + 1, 1, 2048)
    histogram = np.bincount(lengths, minlength=2049)
    used = sum(n for _, n in packing.plan_sequences(histogram, 2048))
    best = sum(n for _, n in packing.best_fit(histogram, 2048))
    assert used <= 1.002 * best


def check(rows, docs, capacity, tokenizer):
    """Pieces cover each document's ids, sequences are gapless."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in pieces] == [(k, min(capacity, len(ids) - k)) for k in range(0, len(ids), capacity)]
        assert [r.ids_crc32 for r in pieces] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces]
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_pack_against_the_tokenizer(spark):
    words = "the quick İstanbul fox's 3.14 naïve don't <|endoftext|> ǅ 日本  x straße".split(" ")
    docs = [(k, " ".join(words[j % len(words)] for j in range(k * 7 % 90))) for k in range(60)] + [(60, None), (61, ""), (62, " \n\t "), (63, "long " * 3000), (64, "a" * 5000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, part string, length int").repartition(3)
    rows = packing.pack(df, capacity=128).collect()
    check(rows, docs, 128, Tokenizer.from_file(packing.default_tokenizer()))


def test_repeated_rows_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(1, "same text")] * 5 + [(None, "other")], "doc_id long, text string")
    rows = packing.pack(df, capacity=16).collect()
    assert len(rows) == 6 and sum(r.doc_id is None for r in rows) == 1
    assert len({(r.sequence_id, r.offset) for r in rows}) == 6
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("capacity", [1, 7])
def test_small_capacities(spark, capacity):
    docs = [(k, "a b c " * k) for k in range(9)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), capacity=capacity).collect()
    check(rows, docs, capacity, Tokenizer.from_file(packing.default_tokenizer()))
