import numpy as np
import xxhash

from lodex.llm import near

SF = "/root/testdata/sf0.1"


def brute_components(texts, at_least=0.8):
    """Component of each text by exact similarities of all pairs that share a shingle, and how many pairs of different shingle sets are similar."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(xxhash.xxh64_intdigest(b" ".join(w[k : k + 5])) for k in range(max(1, len(w) - 4))) if w else frozenset())
    different = list(dict.fromkeys(sets))
    size = np.array([len(s) for s in different])
    holders: dict[int, list[int]] = {}
    root, links = list(range(len(different))), 0

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k, s in enumerate(different):
        held = [holders[h] for h in s if h in holders]
        if held:
            common = np.bincount(np.concatenate([np.array(x) for x in held]), minlength=k)
            for j in np.flatnonzero(common >= at_least * (size[:k] + len(s) - common)).tolist():
                links += 1
                root[max(top(k), top(j))] = min(top(k), top(j))
        for h in s:
            holders.setdefault(h, []).append(k)
    number = {s: k for k, s in enumerate(different)}
    return [top(number[s]) for s in sets], links


def test_no_pair_is_lost_on_a_whole_table(spark):
    """All rows of a table with copies, near copies and shared passages: the components are those of all pairs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    of, links = brute_components([r.text for r in rows])
    least: dict[int, int] = {}
    for r, c in zip(rows, of, strict=True):
        least[c] = min(r.doc_id, least.get(c, r.doc_id))
    want = {r.doc_id: least[c] for r, c in zip(rows, of, strict=True)}
    got = {r.doc_id: r.component_id for r in near.near_copies(docs).collect()}
    assert links > 30 and got == want
