import hashlib
from itertools import product

import numpy as np
import pytest

from lodex.llm import dialogue
from lodex.llm.dialogue import NEXT, digests, repair, search

KINDS = "suaxSUAXD"


def plain_search(turns, after=0, last=True):
    """The same by going through all rows and roles in order."""
    now = {after: (0, "")}

    def put_in(held):
        for _ in range(3):
            for s, (c, e) in list(held.items()):
                t = NEXT[s][dialogue.MADE[s]]
                held[t] = min(held.get(t, (10**9, "")), (c + 2, e + "I"))
        return held

    for turn in turns:
        then = {}
        for s, (c, e) in put_in(dict(now)).items():
            ways = [(s, c + 3, e + "D")]
            if turn != "D":
                ways.append((NEXT[s][dialogue.MADE[s]], c + 2 + turn.isupper(), e + "R"))
                if turn.lower() in NEXT[s]:
                    ways.append((NEXT[s][turn.lower()], c + turn.isupper(), e + "K"))
            for t, c2, e2 in ways:
                then[t] = min(then.get(t, (10**9, "")), (c2, e2))
        now = then
    if not last:
        return now
    now = put_in(dict(now))
    return min(now[s] for s in (0, 3) if s in now)


def test_search_finds_the_cheapest_and_least_edits():
    for n in range(4):
        for turns in product(KINDS, repeat=n):
            turns = "".join(turns)
            assert list(search(turns, 0, True).values()) == [plain_search(turns)], turns
    rng = np.random.default_rng(2)
    for _ in range(300):
        turns = "".join(rng.choice(list(KINDS), rng.integers(4, 30)))
        after = int(rng.integers(4))
        assert list(search(turns, after, True).values()) == [plain_search(turns, after)]
        assert search(turns, after, False) == plain_search(turns, after, False)


def by_hand(rows):
    """conv_id -> all that repair and digests say."""
    white, out, held = " \t\n\v\f\r", {}, {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, own in held.items():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.sha256(f"{t[1]}\0{t[2]}".encode()).hexdigest()))
        code, faults, seen = "", dict.fromkeys(("blank", "duplicate", "truncated"), 0), set()
        for _, role, text in own:
            fault = "blank" if not text.strip(white) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(white)[-1] not in ".!?" else ""
            seen.add((role, text))
            faults |= {fault: faults[fault] + 1} if fault else {}
            kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
            code += "D" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        numbers = {t[0] for t in own} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = plain_search(code)
        turns, state, rest = [], 0, iter(own)
        for e in audit:
            _, role, text = next(rest) if e != "I" else (0, "", "")
            if e != "D":
                letter = role[0] if e == "K" else dialogue.MADE[state]
                turns.append(f"{role if e == 'K' else {'u': 'user', 'a': 'assistant'}[letter]}:{text}")
                state = NEXT[state][letter]
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())
    return out


def told(spark, rows, parts):
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(parts)
    summary, kept = repair(turns)
    sha = {r.conv_id: r.sha256 for r in digests(kept).collect()}
    got = summary.collect()
    assert len(got) == len(sha) == len({r.conv_id for r in got})
    return {r.conv_id: (*(r[c] for c in dialogue.COUNTS), r.audit, sha[r.conv_id]) for r in got}


@pytest.mark.parametrize(("most", "size"), [(1000, 4 << 20), (3, 4 << 20), (1000, 40)])
def test_repair_is_what_brute_force_finds(spark, monkeypatch, most, size):
    """Whole conversations and chains of segments: nulls, blanks, ties, repeated rows, odd roles, a conversation with a third of all turns."""
    monkeypatch.setattr(dialogue, "TURNS", most)
    monkeypatch.setattr(dialogue, "BYTES", size)
    rng = np.random.default_rng(9)
    texts = ["Yes.", "No", "", " \n", None, "Why? ", "And then", "Ärger!", "x "]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "admin"]
    pick = lambda some: some[rng.integers(len(some))]
    rows = [(int(c), int(rng.integers(0, 9)) if rng.random() < 0.9 else None, pick(roles), pick(texts)) for c in rng.integers(0, 40, 200)]
    rows += [(77, int(k // 2), pick(roles), f"{k % 30}." if k % 3 else pick(texts)) for k in range(100)]
    rows += [(None, 1, "user", "hi."), (None, 2, "assistant", "x" * 100_000), (5, 3, "user", "Yes.")] + [(6, None, "user", "same.")] * 12
    assert told(spark, rows, 5) == by_hand(rows)


def test_empty_table(spark):
    summary, turns = repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert summary.count() == turns.count() == digests(turns).count() == 0
