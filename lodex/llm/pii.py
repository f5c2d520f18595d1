"""Personal data: sure matches by rule, and further spans by boosted trees over candidates.

Rules give the base spans, which always stay. High-recall generators propose more, overlapping spans: phone
numbers without a plus, grouped or spaced addresses, written-out mail addresses, and secrets: long runs of letters
and digits, alone or with their quotes and what they are assigned to. Gradient-boosted trees score each candidate by its
format and context; scores are calibrated on documents held back, each kind's threshold is where the calibrated
precision is high enough, and overlaps go to the highest score.

No text has labels, so the trees learn from what is sure in the corpus. Base spans are rewritten in place in a form that the rules
don't know, and these are right; candidates that fail their kind's test (Luhn, parts up to 255, number of digits) are
wrong. Of long runs those assigned to a name like token are right, others are wrong, and in half of the right ones that
name is masked, as it gave the label away. Examples made here add forms that the corpus lacks.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodex.llm.support import only, small_batches, stage, text_slices

#: Those of the base rules, and then those that only candidates have.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Bounds of the sample that is learned from: documents, and candidates in them.
SAMPLE_DOCS, SAMPLE_CANDIDATES = 20_000, 60_000
Span = tuple[int, int, int]  # kind, start, end
SPACES = " \t\n\r\x0b\x0c"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# runs of digits are taken whole: a match that fails from a run's first digit fails from the others too
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Matches by rule, leftmost and not overlapping within a kind; those that fail a kind's test are dropped."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:  # the part before @ can't hold one, so each @ has one longest start
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (found := DOMAIN.match(text, at + 1)):
            out.append((0, start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    if not any(c in text for c in "0123456789"):
        return out
    for m in IP.finditer(text):
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in (x.lstrip("0") for x in m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


AT, DOT = r"(?:@|[ ]?[\[(](?:at|AT)[\])][ ]?|[ ]at[ ])", r"(?:\.|[ ]?[\[(](?:dot|DOT)[\])][ ]?|[ ]dot[ ])"
GENERATORS = (
    (0, re.compile(rf"(?<![\w.%+-])[\w.%+-]++{AT}[\w-]++(?:{DOT}[\w-]{{2,}}+)++", re.ASCII)),
    (1, re.compile(r"(?<![\w.])\d{1,3}(?:[ ]?[.][ ]?\d{1,3}){3}(?![\w])", re.ASCII)),
    (1, re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    (2, re.compile(r"(?<!\w)\d{4}(?:[ ./_-]{1,3}\d{4}){3}(?!\w)", re.ASCII)),
    (2, re.compile(r"(?<!\w)\d{13,19}(?!\w)", re.ASCII)),
    (3, re.compile(r"(?<![\w+])\(?(?:00\d{1,3}[ ]?)?\(?\d{2,5}\)?(?:[ ./-]{1,2}\d{2,5}){1,4}(?!\w)", re.ASCII)),
    (3, re.compile(r"(?<![\w+])0\d{8,12}(?!\w)", re.ASCII)),
    (4, re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+={0,2}(?![A-Za-z0-9])")),
    (4, re.compile(r"[A-Za-z_-]{3,20}[ ]?[=:][ ]?[\"']?(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+={0,2}[\"']?")),
)
WRITTEN = re.compile(r"[\[( ](?:at|AT)[\]) ]")
HAS_DIGIT = re.compile(r"[0-9]")
HINTS = (
    frozenset("mail email e-mail address contact write reply mailto courriel correo".split()),
    frozenset("ip host server address addr client login ping".split()),
    frozenset("card visa mastercard amex credit payment pay paid carte tarjeta karte".split()),
    frozenset("phone tel telephone call mobile cell fax whatsapp sms téléphone teléfono telefon".split()),
    frozenset("token secret password passwd pwd key apikey api_key access_key credential auth bearer".split()),
    frozenset("version v ver release section chapter page pages isbn order invoice no number id ref date year build score ratio on from".split()),
)
#: A name that is given a secret: what tells the sure ones of the corpus.
NAMED = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|(?:api|access|secret|private)[ _-]?key|credential)s?[ ]?[=:][ ]?[\"']?$", re.IGNORECASE)


def candidates(text: str) -> list[Span]:
    """All proposals, overlapping ones too."""
    digit, written = HAS_DIGIT.search(text), "@" in text or WRITTEN.search(text)
    return [(kind, m.start(), m.end()) for kind, pattern in GENERATORS if (written if kind == 0 else digit) for m in pattern.finditer(text)]


#: Characters of a secret, by which its counts are told.
SHOWN = 48
HEX, QUOTES = frozenset("0123456789abcdefABCDEF"), "\"'`"


def _surprise(s: str) -> float:
    """Bits a character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, start, end = span
    s, d = text[start:end], digits_of(text[start:end])
    groups = re.findall(r"[0-9]+", s)
    words = re.findall(r"[^\W\d_][\w-]*", text[max(0, start - 40) : start].lower())[-3:]
    before, after = text[start - 1 : start], text[end : end + 1]
    whole = "@" in s or bool(re.search(r"[\[(](?:at|AT)[\])]", s))
    dots = bool(re.search(r"\.|[\[(](?:dot|DOT)[\])]", s))
    parts = [int(g) for g in groups if len(g) < 10]
    tail = re.split(r"[^A-Za-z]+", s.strip())[-1]
    # a longer secret is told like one of this length that is made up alike
    part = min(1.0, SHOWN / len(s)) if kind == 4 else 1.0
    date = len(groups) == 3 and len(parts) == 3 and (1900 <= parts[0] <= 2100 or 1900 <= parts[2] <= 2100)
    return [
        float(kind), len(s) * part, len(d) * part, len(groups) * part, float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(luhn(d)) if d else 0.0, float(len(parts) == 4 and max(parts) <= 255), float(whole), float(dots), float(len(tail)),
        float(s.count(" ")), float(s.count(".")), s.count("-") * part, s.count("/") * part, float("(" in s), float(s.startswith("00")), float(s.startswith("0")),
        float(date), float(len(set(d)) if d else 0), float(bool(before) and before not in SPACES), float(bool(after) and after not in SPACES + ".,;:!?)"),
        float(any(w in HINTS[kind] for w in words)), float(any(w in HINTS[5] for w in words)), sum(c.isupper() for c in s) * part, float(":" in s),
        _surprise(s), sum(c in HEX for c in s) / len(s), len(d) / len(s), float(sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))) / len(s), float(before in QUOTES and after in QUOTES and bool(before)), float(text[max(0, start - 3) : start].rstrip("\"' ")[-1:] in ("=", ":")), float("=" in s.rstrip("=") or '"' in s),
    ]


def _filler(rng: random.Random) -> str:
    return "".join(rng.choice(("an", "er", "tion", "de", "la", "ing", "ou", "st", "en", "que")) for _ in range(rng.randint(1, 3)))


def examples(many: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Descriptions of candidates in generated texts, and whether they are personal data."""
    rng = random.Random(seed)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(valid: bool) -> str:
        while luhn(d := rng.choice("3456") + num(15)) != valid:
            pass
        return d

    def one() -> tuple[str, str, bool]:
        """Hint before it, the thing, whether it is personal."""
        kind, good = rng.randrange(5), rng.random() < 0.5
        if kind == 4:
            signs = rng.choice(("0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            run = "7a" + "".join(rng.choice(signs) for _ in range(rng.choice((22, 30, 38, 46))))
            if good:
                return "@" + rng.choice(("token = ", "password: ", "api_key=", "secret = ", "access_key: ", "Token=", "auth = ", "bearer ")) + rng.choice(('"', "'", "")), run, True
            return rng.choice(("commit", "revision", "sha1", "digest", "checksum", "file", "")), rng.choice((run, f"{num(8)}-{num(4)}-{num(4)}-a{num(3)}-{num(12)}", "_".join(_filler(rng) + num(2) for _ in range(4)), "-".join([*(_filler(rng) for _ in range(4)), num(4)]), _filler(rng) + "/" + _filler(rng) + "/" + _filler(rng) + num(9))), False
        if kind == 0:
            name, host, top = _filler(rng) + rng.choice(("", ".", "_")) + _filler(rng), _filler(rng), rng.choice(("com", "org", "net", "de", "fr"))
            if good:
                at, dot = rng.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" at ", " dot "), ("(AT)", "(DOT)")))
                return rng.choice(("mail", "contact", "write", "", "reply")), name + at + host + dot + top, True
            return rng.choice(("", "is", "was")), f"{_filler(rng)} at {_filler(rng)}.{_filler(rng)}", False
        if kind == 1:
            if good:
                sep = rng.choice((" . ", ". ", " ."))
                return rng.choice(("ip", "host", "server", "client")), sep.join(str(rng.randint(1, 255)) for _ in range(4)) if rng.random() < 0.6 else ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(8)), True
            parts = [str(rng.randint(0, 255)) for _ in range(4)]
            parts[rng.randrange(4)] = str(rng.randint(256, 999))
            return rng.choice(("version", "section", "build", "", "ip", "host", "server")), ".".join(parts), False
        if kind == 2:
            sep = rng.choice((". ", "/", "_", " - ", "--"))
            if good:
                d = card(True)
                return rng.choice(("card", "visa", "credit", "payment")), sep.join(d[k : k + 4] for k in range(0, 16, 4)), True
            d = card(False)
            return rng.choice(("order", "ref", "id", "", "isbn", "")), d if rng.random() < 0.6 else sep.join(d[k : k + 4] for k in range(0, 16, 4)), False
        if good:
            made = rng.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"00{num(2)} {num(3)} {num(3)} {num(4)}", f"0{num(9)}", f"{num(3)}.{num(3)}.{num(4)}"))
            return rng.choice(("phone", "tel", "call", "mobile", "fax")), made, True
        made = rng.choice((f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(1, 28):02}/{rng.randint(1, 12):02}/{rng.randint(1900, 2099)}", f"{num(2)}-{num(2)}", f"{num(4)}/{num(4)}", f"{num(3)} {num(3)}", f"{num(2)}.{num(2)}.{num(2)}", f"0{num(10)}", f"{num(3)}-{num(2)}-{num(5)}-{num(3)}-{num(2)}"))
        return rng.choice(("page", "date", "order", "isbn", "year", "score", "", "")), made, False

    x, y = [], []
    while len(y) < many:  # the last text may give one more
        hint, thing, good = one()
        close = hint[-1:] if hint[-1:] in ("\"", "'") else ""
        lead = hint[1:] if hint.startswith("@") else hint + rng.choice((" ", ": ")) if hint else ""
        head = " ".join([_filler(rng) for _ in range(4)]) + " " + lead
        text = f"{head}{thing}{close}{rng.choice((' ', '. ', ', '))}{_filler(rng)}"
        begin = len(head)
        for span in candidates(text):
            exact = span[1] == begin and span[2] == begin + len(thing)
            if span[2] > begin and span[1] < begin + len(thing):
                x.append(describe(text, span))
                y.append(good and exact)
    return np.array(x), np.array(y, dtype=float)


def disguised(kind: int, thing: str, rng: random.Random) -> str:
    """A base span in a form that no rule finds."""
    d = digits_of(thing)
    if kind == 0:
        at, dot = rng.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" at ", " dot "), ("(AT)", "(DOT)")))
        return thing.replace("@", at).replace(".", dot)
    if kind == 1:
        return thing.replace(".", rng.choice((" . ", ". ", " .")))
    if kind == 2:
        return rng.choice((". ", "/", "_", " - ", "--")).join(d[k : k + 4] for k in range(0, len(d), 4))
    d = d[-rng.choice((9, 10)) :]
    return rng.choice((f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"0{d[:2]} {d[2:4]} {d[4:6]} {d[6:]}", f"0{d[:9]}"))


def fails(kind: int, thing: str) -> bool:
    """Whether a candidate can't be of its kind."""
    d = digits_of(thing)
    if kind == 1:
        return ":" not in thing and any(len(g) > 3 or int(g) > 255 for g in re.findall(r"[0-9]+", thing))
    if kind == 2:
        return not (13 <= len(d) <= 19 and luhn(d))
    if kind == 3:
        return not 7 <= len(d) <= 15 or bool(re.fullmatch(r"(?:(?:19|20)[0-9]{2}[ ./-][0-9]{1,2}[ ./-][0-9]{1,2}|[0-9]{1,2}[ ./-][0-9]{1,2}[ ./-](?:19|20)[0-9]{2})", thing))
    return False


def corpus_examples(text: str, seed: int) -> list[tuple[list[float], float]]:
    """Descriptions of a text's sure candidates, right (1) and wrong (0)."""
    rng, out, at, spans = random.Random(seed), [], 0, []
    parts: list[str] = []
    size = 0
    for kind, start, end in sorted(base_spans(text), key=lambda s: s[1]):
        if start < at:
            continue
        thing = disguised(kind, text[start:end], rng)
        parts += [text[at:start], thing]
        size += start - at
        spans.append((kind, size, size + len(thing)))
        size, at = size + len(thing), end
    text = "".join([*parts, text[at:]])
    right = {(s, e): kind for kind, s, e in spans}
    starts = [s for _, s, _ in spans]
    for span in candidates(text):
        kind, start, end = span
        near = bisect_left(starts, end) - 1
        touches = near >= 0 and spans[near][2] > start
        if kind == 4:
            if touches:
                continue
            named = NAMED.search(text[max(0, start - 40) : start])
            if named and rng.random() < 0.5:  # mask the name
                shown = text[max(0, start - 80) : max(0, start - 40) + named.start()] + "value" + named[0].lstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_-")
                out.append((describe(shown + text[start : end + 8], (4, len(shown), len(shown) + end - start)), 1.0))
            else:
                out.append((describe(text, span), float(bool(named))))
        elif right.get((start, end)) == kind:
            out.append((describe(text, span), 1.0))
        elif touches or fails(kind, text[start:end]):
            out.append((describe(text, span), 0.0))
    return out


class Boosted:
    """Logistic gradient boosting of small trees over binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.3, bins: int = 24):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.trees: list[list[tuple[int, float, float]]] = []  # a full binary tree each: (feature, bound, value)
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        bounds = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        coded = [np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bounds)]
        self.start = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
        z = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p) + 1e-9
            tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * ((1 << (self.depth + 1)) - 1)
            rows = {0: np.arange(len(y))}
            for node in range(len(tree)):
                if (here := rows.pop(node, None)) is None:
                    continue
                tree[node] = (-1, 0.0, self.rate * g[here].sum() / (h[here].sum() + 1))
                if 2 * node + 2 >= len(tree) or len(here) < 20:
                    continue
                best, choice = 1e-6, None
                whole, weight = g[here].sum(), h[here].sum()
                for f, c in enumerate(coded):
                    gs, hs = (np.cumsum(np.bincount(c[here], v[here], minlength=len(bounds[f]) + 1))[:-1] for v in (g, h))
                    gain = gs**2 / (hs + 1) + (whole - gs) ** 2 / (weight - hs + 1) - whole**2 / (weight + 1)
                    if len(gain) and gain.max() > best:
                        best, choice = gain.max(), (f, int(gain.argmax()))
                if choice:
                    f, k = choice
                    tree[node] = (f, float(bounds[f][k]), 0.0)
                    left = coded[f][here] <= k
                    rows[2 * node + 1], rows[2 * node + 2] = here[left], here[~left]
            self.trees.append(tree)
            z += self._tree(tree, x)
        return self

    @staticmethod
    def _tree(tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
        feature, bound, value = (np.array(c) for c in zip(*tree, strict=True))
        at = np.zeros(len(x), dtype=np.int64)
        while (open_ := feature[at] >= 0).any():
            rows = np.flatnonzero(open_)
            at[rows] = 2 * at[rows] + 1 + (x[rows, feature[at[rows]]] > bound[at[rows]])
        return value[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self._tree(t, x) for t in self.trees) if len(x) else np.zeros(0)


class Redactor:
    """Trees, their calibration (a logistic curve over the raw score) and each kind's threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, precision: float = 0.99):
        """held: the rows that the trees don't learn from, but the calibration and the thresholds do."""
        self.trees = Boosted().fit(x[~held], y[~held])
        z = self.trees.raw(x[held])
        self.slope, self.shift = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(self.slope * z + self.shift)))
            self.slope -= 0.05 * ((p - y[held]) * z).mean()
            self.shift -= 0.05 * (p - y[held]).mean()
        p = self.chance(x[held])
        self.thresholds = []
        for kind in range(len(KINDS)):
            of = x[held, 0] == kind
            order = np.argsort(-p[of], kind="stable")
            right = np.cumsum(y[held][of][order]) / np.arange(1, of.sum() + 1)
            good = np.flatnonzero(right >= precision)
            self.thresholds.append(max(0.5, float(p[of][order][good[-1]])) if len(good) else 1.1)

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.raw(x) + self.shift)))

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all: with those the trees add. An added span overlaps no other."""
        base = sorted(base_spans(text))
        found = candidates(text)
        if base and found:
            found = _apart(found, base)
        if not found:
            return base, base
        p = self.chance(np.array([describe(text, c) for c in found]))
        picked: list[tuple[int, int, int]] = []  # start, end, kind, in order; they don't overlap
        for k in np.lexsort(([c[1] for c in found], -p)):
            kind, start, end = found[k]
            if p[k] < self.thresholds[kind]:
                continue
            at = bisect_left(picked, (start, start))
            if (at == 0 or picked[at - 1][1] <= start) and (at == len(picked) or picked[at][0] >= end):
                insort(picked, (start, end, kind))
        return base, sorted([*base, *((kind, start, end) for start, end, kind in picked)])


def _apart(found: list[Span], base: list[Span]) -> list[Span]:
    """The found spans that overlap no base span."""
    taken = sorted((b[1], b[2]) for b in base)
    ends = np.maximum.accumulate([e for _, e in taken])
    starts = np.array([s for s, _ in taken])
    return [c for c in found if (k := int(np.searchsorted(starts, c[2]))) == 0 or ends[k - 1] <= c[1]]


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, made: int = 6000) -> Redactor:
    """From so many examples that are made here, a third held back, and the given ones."""
    own_x, own_y = examples(made)
    own_held = np.arange(made) % 3 == 0
    if not len(y):
        return Redactor(own_x[:made], own_y[:made], own_held)
    return Redactor(np.concatenate([own_x[:made], x]), np.concatenate([own_y[:made], y]), np.concatenate([own_held, held]))


@lru_cache(maxsize=1)
def redactor() -> Redactor:
    """Fitted without a corpus; the same in every process."""
    return fit(np.zeros((0, 0)), np.zeros(0), np.zeros(0, dtype=bool))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_candidates: int = SAMPLE_CANDIDATES) -> Redactor:
    """Learn from the sure candidates of about sample_docs documents, sample_candidates of them at most, both chosen by hash.

    A third of the documents is held back for calibration. Null texts give nothing; an empty table leaves the examples made here.
    """
    small_batches(docs.sparkSession)
    docs = only(docs, doc_id=id_col, text=text_col).where("text is not null").withColumn("h", F.xxhash64("doc_id", "text"))
    share = min(1.0, sample_docs / max(1, docs.count()))
    # texts without a digit or a written-out address have no candidates
    some = docs.where((F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))) & F.col("text").rlike(r"[0-9]|@|[\[( ](?:at|AT)[\]) ]"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            for h, value in zip(rows.column("h").to_pylist(), texts, strict=True):
                found = corpus_examples(value.as_py().decode("utf-8", "replace"), h)
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array([x for x, _ in found], pa.list_(pa.float64())), pa.array([y for _, y in found], pa.float64())], names=["h", "nth", "x", "y"])

    made = stage(some.mapInArrow(make, "h long, nth int, x array<double>, y double"), "candidates")
    got = made.orderBy(F.xxhash64("h", "nth"), "h", "nth").limit(sample_candidates).toPandas()
    if not len(got):
        return redactor()
    return fit(np.array(got["x"].tolist()), got["y"].to_numpy(), (got["h"].to_numpy() % 3 == 0))


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping ones the first is kept whole."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_secret long, redacted string"


def find(docs: DataFrame, model: Redactor | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Base counts by kind, the base spans' digest, all spans (kind:start:end in code points), their number, that of secrets, and the text without them.

    model: what train returned; without it, one that has seen no corpus.
    Null texts count as empty: no spans, and an empty redacted text. Repeated rows each give a row; null ids stay null; an
    empty table gives no rows. Other columns aren't read. redacted is null without with_text.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or redactor())  # a few thousand numbers

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, texts in text_slices(batches):
            counts, sha, spans, clean = [], [], [], []
            for value in texts:
                text = value.as_py().decode("utf-8", "replace")
                base, every = model.spans(text)
                counts.append([*np.bincount([s[0] for s in base], minlength=len(BASE_KINDS)).tolist(), len(every), sum(s[0] == 4 for s in every)])
                sha.append(hashlib.sha256(told(base).encode()).hexdigest())
                spans.append(told(every))
                clean.append(redacted(text, every) if with_text else None)
            by_kind = [pa.array(c) for c in np.array(counts, dtype=np.int64).reshape(len(rows), -1).T]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), *by_kind[:4], pa.array(sha, pa.string()), pa.array(spans, pa.string()), *by_kind[4:], pa.array(clean, pa.string())], names=[c.split()[0] for c in FOUND.split(", ")])

    return only(docs, doc_id=id_col, text=text_col).mapInArrow(make, FOUND)
