"""Packing token pieces into sequences by fitting length patterns to the length histogram.

Patterns are multisets of at most four lengths that fill a sequence. Non-negative least squares
fits how often to repeat each one to the histogram of piece lengths; the counts are rounded down
to what the histogram holds, and what is left is packed best-fit, longest first. All that happens on
the histogram, which has at most `capacity` entries however large the corpus is. Pieces then
find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodex.llm.support import only, small_batches, stage, text_slices, words_of

#: Passes of the non-negative least squares fit, and how many partners each length gets in a pattern.
NNLS_STEPS, PARTNERS = 400, 24
#: Bytes that a Python worker spends on the token ids of words it has met, and what a word takes there besides its own text and ids.
WORD_BYTES, WORD_EXTRA = 32 << 20, 150
#: What tokens at the end of a word end with, and how many words of letters are encoded as one text.
WORD_END, GROUP = "</w>", 64
#: Signs that the tokenizer cuts from letters before them.
SIGNS = ".,;:!?"

_tokenizers: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class KnownWords(dict):
    """Token ids by word, of the words that came first, within WORD_BYTES: a worker keeps them for its life, and a machine has many."""

    left = WORD_BYTES

    def add(self, word: str, ids: bytes) -> None:
        self.left -= 2 * len(word) + len(ids) + WORD_EXTRA
        if self.left >= 0:
            self[word] = ids


def _loaded(path: str) -> tuple:
    """The tokenizer, which tokens end a word, and the words known to this worker."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
        ends[[k for token, k in tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True
        _tokenizers[path] = tokenizer, ends, KnownWords()
    return _tokenizers[path]


def _parts(words: list[str]) -> tuple[list[str], list[str]]:
    """Each word without the signs at its end, in lower case, and these signs. Words that aren't letters before them stay whole."""
    heads, tails = [], []
    for w in words:
        head = w.rstrip(SIGNS)
        if head.isascii() and head.isalpha():
            heads.append(head.lower())
            tails.append(w[len(head) :])
        else:
            whole = head.isalpha()
            heads.append(head if whole else w)
            tails.append(w[len(head) :] if whole else "")
    return heads, tails


def word_ids(path: str, words: list[str]) -> list[bytes]:
    """Each word's token ids as little-endian 32-bit numbers.

    The tokenizer cuts at white space before all else, so a text's ids are those of its words in a row. It cuts letters from
    the signs after them as well and makes all letters small, so words that differ in these alone are encoded once.
    """
    tokenizer, ends, known = _loaded(path)
    heads, tails = _parts(words)
    got = list(map(known.get, heads))
    signs = {t: known.get(t) for t in set(tails)}
    found: dict[str, bytes | None] = dict.fromkeys([h for h, ids in zip(heads, got, strict=True) if ids is None] + [t for t, ids in signs.items() if ids is None])
    plain = [w for w in found if w.isalpha()]  # one token each ends such a word, so many can go as one text
    for first in range(0, len(plain), GROUP):
        some = plain[first : first + GROUP]
        coded = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = (np.flatnonzero(ends[coded]) + 1) * 4
        if len(cuts) == len(some):
            data, at = coded.tobytes(), 0
            for w, cut in zip(some, cuts.tolist(), strict=True):
                found[w], at = data[at:cut], cut
    alone = [w for w, ids in found.items() if ids is None]
    for first in range(0, len(alone), 20_000):
        some = alone[first : first + 20_000]
        for w, coded in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
            found[w] = np.array(coded.ids, dtype="<u4").tobytes()
    if known.left > 0:
        for w, ids in found.items():
            known.add(w, ids)
    signs = {t: found[t] if ids is None else ids for t, ids in signs.items()}
    return [(found[h] if ids is None else ids) + signs[t] for h, t, ids in zip(heads, tails, got, strict=True)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut_pieces(docs: DataFrame, capacity: int, tokenizer: str) -> DataFrame:
    """Pieces of each document's tokens; nth counts the pieces of a length within a task (part)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for rows, texts in text_slices(batches):
            which, bounds, words = words_of(texts)
            ids = word_ids(tokenizer, words)
            out: list[tuple] = []
            for k, doc in enumerate(rows.column("doc_id").to_pylist()):
                tokens = b"".join([ids[w] for w in which[bounds[k] : bounds[k + 1]].tolist()]) + bytes(4)
                for piece, begin in enumerate(range(0, len(tokens), 4 * capacity)):
                    held = tokens[begin : begin + 4 * capacity]
                    n = len(held) // 4
                    out.append((doc, piece, begin // 4, n, zlib.crc32(held), part, int(seen[n])))
                    seen[n] += 1
            names = [x.split()[0] for x in PIECES.split(", ")]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return docs.mapInArrow(cut, PIECES)


def patterns_for(lengths: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Multisets of one to four of the present lengths that fill a sequence as well as these can."""
    present = np.sort(lengths)
    below = lambda room: present[np.searchsorted(present, room, side="right") - 1]
    found: set[tuple[int, ...]] = {(int(x),) for x in present}
    spread = np.unique(present[np.linspace(0, len(present) - 1, PARTNERS).astype(int)])
    least = present[0]
    for a in present:
        room = capacity - a
        if room < least:
            continue
        at = int(np.searchsorted(present, room, side="right"))
        for b in present[max(0, at - 4) : at]:
            found.add(tuple(sorted((int(a), int(b)))))
        for b in spread[spread <= room - least]:
            left = room - b
            found.add(tuple(sorted((int(a), int(b), int(below(left))))))
            for c in spread[:: PARTNERS // 6 or 1]:
                if c <= left - least:
                    found.add(tuple(sorted((int(a), int(b), int(c), int(below(left - c))))))
    return sorted(found)


def fit_repeats(patterns: list[tuple[int, ...]], histogram: np.ndarray, capacity: int) -> np.ndarray:
    """Non-negative repeats x that bring the patterns' lengths near the histogram (accelerated projected gradients).

    A small linear cost for unfilled room makes full patterns win where several fit alike.
    """
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.concatenate([np.array(p) for p in patterns])
    scale = 1 / np.sqrt(np.maximum(histogram, 1.0))
    value = scale[row]
    target = histogram * scale
    slack = np.array([capacity - sum(p) for p in patterns]) / capacity
    forward = lambda x: np.bincount(row, value * x[col], minlength=len(histogram))
    back = lambda r: np.bincount(col, value * r[row], minlength=len(patterns))
    probe = np.ones(len(patterns))
    for _ in range(20):
        probe = back(forward(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    cost = 0.5 * slack * np.sqrt(histogram.max())
    for _ in range(NNLS_STEPS):
        new = np.maximum(0, y - (back(forward(y) - target) + cost) / (1.01 * norm))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x


def plan_sequences(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that hold exactly histogram[n] pieces of each length n."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    present = np.flatnonzero(left)
    if not len(present):
        return plan
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
        present = present[present != capacity]
    if len(present):
        patterns = [p for p in patterns_for(present, capacity)]
        repeats = fit_repeats(patterns, left.astype(float), capacity)
        slack = np.array([capacity - sum(p) for p in patterns])
        for k in np.lexsort((-repeats, slack)):
            if slack[k] > capacity // 100:  # poorly filled sequences are left to the best-fit step
                break
            n = int(repeats[k] + 1e-6)
            if n:
                need = {x: patterns[k].count(x) for x in patterns[k]}
                n = min([n, *(int(left[x]) // m for x, m in need.items())])
                if n:
                    plan.append((patterns[k], n))
                    for x, m in need.items():
                        left[x] -= n * m
    return plan + best_fit(left, capacity)


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest open sequence that still has room; alike sequences move together."""
    left = histogram.copy()
    shut: list[tuple[tuple[int, ...], int]] = []
    opened: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]  # by room
    rooms = np.zeros(capacity + 1, dtype=bool)
    for x in np.flatnonzero(left)[::-1]:
        x, n = int(x), int(left[x])
        while n:
            fit = np.flatnonzero(rooms[x:])
            room = x + int(fit[0]) if len(fit) else capacity
            if len(fit):
                held, many = next(iter(opened[room].items()))
                used = min(n, many)
                if used == many:
                    del opened[room][held]
                    rooms[room] = bool(opened[room])
                else:
                    opened[room][held] = many - used
            else:
                held, per = (), capacity // x
                used = n // per if n >= per > 1 else n if per == 1 else 1
                if per > 1 and n >= per:  # whole sequences of this length alone
                    full = (x,) * per
                    opened[capacity - x * per][full] = opened[capacity - x * per].get(full, 0) + used
                    rooms[capacity - x * per] = True
                    n -= used * per
                    continue
            now = (*held, x)
            opened[room - x][now] = opened[room - x].get(now, 0) + used
            rooms[room - x] = True
            n -= used
    for group in opened:
        shut.extend(group.items())
    return shut


def slots(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Sorted rows (length, first rank, first sequence, offset): the rank's distance from the first is added to the sequence."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, many in plan:
        offset = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + many
            offset += x
        sequence += many
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    Null and empty texts are one piece of the single end token. A null id stays null. Repeated rows are
    packed each on its own. An empty table gives no rows. Other columns aren't read.
    tokenizer: a file of one whose words end at white space and leave no trace of it.
    """
    small_batches(docs.sparkSession)
    pieces = stage(cut_pieces(only(docs, doc_id=id_col, text=text_col), capacity, tokenizer or default_tokenizer()), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("many"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for x, n in counts.groupBy("length").agg(F.sum("many")).collect():  # at most `capacity` rows
        histogram[x] = n
    table = slots(plan_sequences(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("length", "part", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("ahead"))
    ranked = pieces.join(ahead, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("nth")).alias("rank"))
    key = (table[:, 0] << 48) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            length, rank = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = table[np.searchsorted(key, (length << 48) + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*rows.columns[:5], pa.array(at[:, 2] + rank - at[:, 1]), pa.array(at[:, 3])], names=[x.split()[0] for x in PACKED.split(", ")])

    return ranked.mapInArrow(place, PACKED)
