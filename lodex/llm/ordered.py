"""Packing documents in their order: windows are cut at ends of documents or sentences by dynamic programming.

The tokens of a task's documents, end to end, are cut into windows of at most `capacity` tokens. A window costs the padding
that fills it up to the capacity (none if its length is a power of two), a small fee, and a penalty by where it ends: none
at the end of a document, little after a sentence, more elsewhere. The cheapest cuts up to a place follow from those of the
places within reach before it; a monotone queue keeps the one that is best for a padded window, so each place is
looked at once, however many lie within reach. Documents are neither moved nor shuffled.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodex.llm.support import only, small_batches, text_slices

#: What a window costs beside its padding: for being one, and by its end after a sentence or elsewhere in a document. In tokens of padding.
FEE, AFTER_SENTENCE, ELSEWHERE = 2, 3, 12
#: Between two ends further apart than this, windows may end at every so many tokens.
STRIDE = 32
#: Tokens that are cut at a time; a worker holds about so many, or those of a single longer text.
SPAN = 1 << 21
#: Sequences of one task at most.
ROOM = 1 << 40
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes that a unit may have for the table of ranks to be asked: those of ASCII and of letters up to U+024F.
PLAIN = 0xC9

_tokenizers: dict[tuple, Encoder] = {}


class Encoder:
    """Token ids of units, which are a run of white space and what follows up to the next: no token goes beyond one.

    Units of plain letters are encoded many at a time by the same vocabulary as a table of ranks, all others, and all without
    such a table, by the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = None
        if ranks:
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.lengths = np.zeros(max(table.values()) + 1, dtype=np.int64)
            for token, k in table.items():
                self.lengths[k] = len(token)

    def __call__(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all units, not in their order; where each unit's begin, and how many it has."""
        data, bounds = raw(units)
        begin, counts, pool, held = np.zeros(len(units), dtype=np.int64), np.zeros(len(units), dtype=np.int64), [], 0
        plain = np.zeros(len(units), dtype=bool)
        if self.ranked is not None and len(units):
            last = data[bounds[1:] - 1]
            plain = (np.maximum.reduceat(data, bounds[:-1]) <= PLAIN) & ~WHITE[last] & (last != 0xA0) & (last != 0x85)
            for s in self.special:
                plain &= ~np.asarray(pc.match_substring(units, s))
        spaced = WHITE[data[bounds[:-1]]]
        for which, lead in ((plain & spaced, b""), (plain & ~spaced, b"\n")):
            at = np.flatnonzero(which)
            if len(at):  # a unit without white space is held apart from the one before by a line's end, a token of its own
                some, cuts = raw(units.filter(pa.array(which)))
                joined = some.tobytes() if not lead else b"".join(lead + some[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                cuts = cuts + len(lead) * np.arange(len(cuts))
                ids = np.array(self.ranked.encode_ordinary(joined.decode()), dtype="<u4")
                ends = np.searchsorted(np.cumsum(self.lengths[ids]), cuts[1:]) + 1
                starts = np.concatenate([[0], ends[:-1]]) + len(lead)
                begin[at], counts[at] = starts + held, ends - starts
                pool.append(ids)
                held += len(ids)
        at = np.flatnonzero(~plain)
        texts = [data[bounds[k] : bounds[k + 1]].tobytes().decode("utf-8", "replace") for k in at.tolist()]
        for k, coded in zip(at.tolist(), self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            begin[k], counts[k] = held, len(coded.ids)
            pool.append(np.array(coded.ids, dtype="<u4"))
            held += len(coded.ids)
        return np.concatenate([np.zeros(0, dtype="<u4"), *pool]), begin, counts


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values in a row, and each one's bounds."""
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def encoder(path: str, ranks: str | None) -> Encoder:
    """This worker's encoder."""
    if (path, ranks) not in _tokenizers:
        _tokenizers[path, ranks] = Encoder(path, ranks)
    return _tokenizers[path, ranks]


def unit_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where units begin: at a text's start, and at white space of ASCII after what isn't white space of any kind. Empty texts have none."""
    at = np.flatnonzero(WHITE[data])
    at = at[at > 0]
    a, b, c = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    wide = ((b == 0xC2) & ((a == 0xA0) | (a == 0x85))) | ((c == 0xE1) & (b == 0x9A) & (a == 0x80)) | ((c == 0xE3) & (b == 0x80) & (a == 0x80))
    wide |= (c == 0xE2) & (((b == 0x80) & (((a >= 0x80) & (a <= 0x8A)) | np.isin(a, [0xA8, 0xA9, 0xAF]))) | ((b == 0x81) & (a == 0x9F)))
    begins = np.zeros(len(data), dtype=bool)
    begins[at[~WHITE[a] & ~wide]] = True
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    return np.flatnonzero(begins)


def tokens_of(texts: pa.Array, encode: Encoder, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of all texts in a row, each with end_id after it; where each text ends; and where sentences end in texts."""
    data, bounds = raw(texts)
    starts = unit_starts(data, bounds)
    offsets = np.append(starts, len(data)).astype(np.int64 if pa.types.is_large_binary(texts.type) else np.int32)
    units = pa.Array.from_buffers(texts.type, len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    pool, begin, counts = encode(units.dictionary)
    after = np.searchsorted(starts, bounds[1:])  # units before each text's end
    pool, begin, counts = np.append(pool, np.uint32(end_id)), np.append(begin, len(pool)), np.append(counts, 1)
    which = np.insert(np.asarray(units.indices, dtype=np.int64), after, len(counts) - 1)
    many = counts[which]
    ends = np.cumsum(many)
    total = int(ends[-1]) if len(ends) else 0
    ids = pool[np.repeat(begin[which] - (ends - many), many) + np.arange(total)]
    last, first = data[offsets[1:] - 1] if len(starts) else data[:0], data[starts]
    stop = (last == 33) | (last == 46) | (last == 63)
    stop[:-1] |= (first[1:] == 10) | (first[1:] == 13)
    own = np.ones(len(which), dtype=bool)
    own[after + np.arange(len(after))] = False
    return ids, ends[~own], ends[own][stop]


def places(ends: np.ndarray, stops: np.ndarray, total: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end, ascending from 0, and the charge of each."""
    where = np.unique(np.concatenate([[0], ends, stops, [total]]))
    wide = np.flatnonzero(np.diff(where) > min(STRIDE, capacity))
    more = [np.arange(where[k] + min(STRIDE, capacity), where[k + 1], min(STRIDE, capacity)) for k in wide.tolist()]
    every = np.union1d(where, np.concatenate([np.zeros(0, dtype=np.int64), *more]))
    charge = np.where(np.isin(every, ends), 0, np.where(np.isin(every, stops), AFTER_SENTENCE, ELSEWHERE))
    return every, charge + FEE


def cheapest(where: np.ndarray, charge: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The least cost of cutting up to each place, and the place before it; no two neighbours lie further apart than the capacity."""
    hit_at, hit_from = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for k in range(capacity.bit_length()):
        if 1 << k < capacity:  # a window of this length needs no padding
            back = np.searchsorted(where, where - (1 << k))
            same = where[back] == where - (1 << k)
            hit_at.append(np.flatnonzero(same))
            hit_from.append(back[same])
    order = np.argsort(np.concatenate(hit_at), kind="stable")
    at, before = np.concatenate(hit_at)[order].tolist() + [-1], np.concatenate(hit_from)[order].tolist()
    pos, fees = where.tolist(), charge.tolist()
    best, prev = [0] * len(pos), [0] * len(pos)
    queue, keys, head, h = [0], [pos[0]], 0, 0
    for j in range(1, len(pos)):
        p = pos[j]
        while pos[queue[head]] < p - capacity:
            head += 1
        i, c = queue[head], keys[head] + capacity - p
        while at[h] == j:
            if best[before[h]] < c:
                i, c = before[h], best[before[h]]
            h += 1
        c += fees[j]
        best[j], prev[j] = c, i
        c += p
        while len(keys) > head and keys[-1] >= c:
            keys.pop()
            queue.pop()
        keys.append(c)
        queue.append(j)
    return np.array(best), np.array(prev)


def window_ends(where: np.ndarray, charge: np.ndarray, capacity: int, last: bool) -> np.ndarray:
    """Ends of the windows; if more tokens follow, the last one is the cheapest of those that reach into the last `capacity` tokens."""
    best, prev = cheapest(where, charge, capacity)
    k = len(where) - 1
    if not last:
        near = np.flatnonzero((where > where[-1] - capacity) & (where > 0))
        k = int(near[best[near].argmin()])
    out = []
    while k:
        out.append(where[k])
        k = int(prev[k])
    return np.array(out[::-1], dtype=np.int64)


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Stream:
    """The tokens of a task that aren't in windows yet, with their documents, and how many sequences there are."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.ids, self.held = [], 0
        self.docs, self.begins, self.sizes, self.stops = [], [], [], []

    def add(self, docs: list, ids: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> None:
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        self.docs.extend(docs)
        self.begins.append(begins + self.held)
        self.sizes.append(ends - begins)
        self.stops.append(stops + self.held)
        self.ids.append(ids)
        self.held += len(ids)

    def cut(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Pieces of the windows that are settled."""
        if not self.held:
            return
        ids, begins, sizes, stops = (np.concatenate(x) for x in (self.ids, self.begins, self.sizes, self.stops))
        ends = window_ends(*places(begins + sizes, stops, self.held, self.capacity), self.capacity, last)
        total = int(ends[-1])
        windows = np.concatenate([[0], ends[:-1]])
        starts = np.union1d(windows, begins[(begins > 0) & (begins < total)])
        lengths = np.diff(np.append(starts, total))
        doc, window = np.searchsorted(begins, starts, side="right") - 1, np.searchsorted(windows, starts, side="right") - 1
        data = memoryview(ids).cast("B")
        sums = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
        columns = [pa.array([self.docs[k] for k in doc.tolist()], pa.int64()), starts - begins[doc], lengths, sums, sizes[doc], window + self.sequence, starts - windows[window]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in PACKED.split(", ")])
        self.sequence += len(windows)
        open_ = begins + sizes > total
        self.docs = [self.docs[k] for k in np.flatnonzero(open_).tolist()]
        self.begins, self.sizes, self.stops, self.ids = [begins[open_] - total], [sizes[open_]], [stops[stops > total] - total], [ids[total:].copy()]
        self.held -= total


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pack_in_order(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, ranks: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: the pieces of all documents, in order within each task.

    Each id of a document, end_id after its last, lies in one piece. Null and empty texts are end_id alone. A null id stays null.
    Repeated rows are packed each on its own. Very long texts are cut like others; the tokens of one are held at once. Of cuts that
    cost alike the one found first is taken, so reruns over the same files agree. An empty table gives no rows. Other columns aren't read.
    tokenizer: a file of one that cuts texts before white space, as byte-level ones with the usual pattern do. ranks: the same vocabulary
    as ranks, which is faster for plain letters; none is asked for if only a tokenizer is given.
    """
    small_batches(docs.sparkSession)
    if tokenizer is None:
        tokenizer, ranks = default_tokenizer()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, stream = encoder(tokenizer, ranks), Stream(capacity, TaskContext.get().partitionId() * ROOM)
        for rows, texts in text_slices(batches):
            stream.add(rows.column("doc_id").cast(pa.int64()).to_pylist(), *tokens_of(texts, encode, end_id))
            if stream.held >= SPAN:
                yield from stream.cut(False)
        yield from stream.cut(True)

    return only(docs, doc_id=id_col, text=text_col).mapInArrow(pack, PACKED)
