import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodex.llm import ordered
from lodex.llm.ordered import cheapest, default_tokenizer, encoder, pack_in_order, places, tokens_of, window_ends

ODD = ["<|endoftext|> a <|endoftext|>", "a\xa0 b", "a　 b   c", "x  \n\n y\t ", "  ", " ", "fin\xa0", "à", "don't 'll I'd", "123 4567 ?!?! ...", "日本語 テキスト です。", "🙂 🙂x", " lead", "\n\nlead", "a\x85 b", "", "ab " * 3000, "x" * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer()[0])


@pytest.mark.parametrize("ranks", [True, False])
def test_ids_are_the_tokenizers(tokenizer, ranks):
    every = [f"x{chr(c)}y {chr(c)}z{chr(c)} {chr(c)}{chr(c)} 1{chr(c)}2 {chr(c)}" for c in range(1, 0x260)] if ranks else []
    texts = ODD + every
    path, table = default_tokenizer()
    ids, ends, stops = tokens_of(pa.array([t.encode() for t in texts], pa.binary()), encoder(path, table if ranks else None), 1)
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert not len(np.intersect1d(stops, [0])) and (stops < len(ids)).all()


def test_cuts_cost_as_little_as_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(40):
        capacity = int(rng.choice([8, 13, 32]))
        ends = np.unique(rng.integers(1, 150, rng.integers(1, 12)))
        stops = np.unique(rng.integers(1, ends[-1] + 1, 10))
        where, charge = places(ends, stops, int(ends[-1]), capacity)
        best, _ = cheapest(where, charge, capacity)
        want = [0.0]
        for j in range(1, len(where)):
            lengths = where[j] - where[:j]
            pads = np.where((lengths & (lengths - 1)) == 0, 0, capacity - lengths)
            want.append(min(w + p for w, p, n in zip(want, pads, lengths, strict=True) if n <= capacity) + charge[j])
        assert best.tolist() == want
        cut = window_ends(where, charge, capacity, last=True)
        lengths = np.diff(np.concatenate([[0], cut]))
        assert lengths.max() <= capacity and cut[-1] == ends[-1]
        assert sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths.tolist()) + charge[np.searchsorted(where, cut)].sum() == want[-1]


def test_pieces_hold_each_id_once(spark, tokenizer, monkeypatch):
    long = "Una frase larga que sigue. " * 2000
    rows = [(k, t, "clash") for k, t in enumerate([*ODD, None, long, long, "", "w"])] + [(3, "again", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").repartition(3)
    got = pack_in_order(docs).toPandas()
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t, _ in rows if k not in (3, None)}
    for doc, own in got[got.doc_id.notna() & (got.doc_id != 3)].groupby("doc_id"):
        own, at = own.sort_values("start"), 0
        for r in own.itertuples():
            assert r.start == at and r.doc_tokens == len(ids[doc])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[doc][at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids[doc])
    assert got.doc_id.isna().sum() == 1 and set(got.doc_id.dropna()) == set(range(len(rows) - 2))
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.length.sum() <= 2048 and (seq.offset == seq.length.cumsum() - seq.length).all()


def test_spans_carry_open_documents_over(spark, monkeypatch):
    """A document goes on in the next span; nothing is lost where spans meet, and order holds."""
    monkeypatch.setattr(ordered, "SPAN", 500)
    stream, rng, out, docs = ordered.Stream(64, 7), np.random.default_rng(1), [], {}
    for k in range(60):
        ids = rng.integers(0, 1000, int(rng.integers(1, 200))).astype("<u4")
        docs[k] = ids
        stream.add([k], ids, np.array([len(ids)]), np.arange(10, len(ids), 10))
        if stream.held >= ordered.SPAN:
            out += list(stream.cut(False))
    got = pa.Table.from_batches(out + list(stream.cut(True))).to_pandas()
    assert not list(stream.cut(True))
    assert got.length.sum() == sum(map(len, docs.values())) and got.doc_id.is_monotonic_increasing and got.sequence_id.min() == 7
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(docs[r.doc_id][r.start : r.start + r.length].tobytes())
    assert got.groupby("sequence_id").length.sum().max() <= 64


def test_empty_table_and_little_padding(spark):
    assert pack_in_order(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = pack_in_order(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    size = got.groupby("sequence_id").length.sum()
    assert size[(size & (size - 1)) != 0].rsub(2048).sum() < 0.01 * size.sum()
