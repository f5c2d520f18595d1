import random
import re

import pytest

from lodex.operators import patterns, retrieval

PATTERNS = ["abc", "abc|xyz", "a(bc|cd)+e", "(?i)ABC", "foo.*bar", "[ab]cd", "colou?r", "^abc$", "a", "", "x{2,3}yz", "(abc)?def", r"\bcab\b", "(?:ab|cd)(?:ef|gh)ij", "äöü", "a.c", "(ab|cd|ef|gh|ij|kl)(ab|cd|ef|gh|ij|kl)(ab|cd|ef|gh|ij|kl)", "(?=abc)a", "abc(?!d)", r"\d+abc", "[^x]abc[^y]", "ab\\ncd"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_a_matching_line_holds_what_its_pattern_needs(pattern):
    rng, needs = random.Random(3), patterns.needed(pattern)
    parts = ["abc", "ABC", "xyz", "foo", "bar", "cde", "color", "colour", "xxyz", "def", "cab", "abefij", "cdghij", "äöü", " ", "d", "e", "7", "abcdef", "klab", "acd"]
    hits = 0
    for _ in range(3000):
        line = "".join(rng.choice(parts) for _ in range(rng.randrange(7)))
        if re.search(pattern, line, re.IGNORECASE | re.ASCII) and needs is not None:
            held = set(patterns.codes(line.encode()).tolist())
            assert any(n <= held for n in needs), line
            hits += 1
    assert hits or needs is None or "n" in pattern or "x" in pattern


def test_which_patterns_help():
    assert patterns.needed("a") is None and patterns.needed("abc|x") is None and patterns.needed("(?x)a b c") is None
    assert len(patterns.needed("license|copyright")) == 2 and len(patterns.needed("licen[cs]e")) == 2


@pytest.mark.parametrize("pattern", ["needle", "hay|pin", "n.*e", "^Needle", "x"])
def test_indexed_search_is_the_search(spark, pattern):
    rng = random.Random(8)
    rows = [(f"f{k}", "\n".join(" ".join(rng.choice(["hay", "straw", "Needle", "pin", "né", "x"]) for _ in range(4)) for _ in range(rng.randrange(4)))) for k in range(60)] + [("none", None), ("empty", ""), ("far", "nee\ndle")]
    files = spark.createDataFrame(rows, "path string, text string")
    index = patterns.grams(files)
    for first in (True, False):
        key = lambda df: sorted(map(tuple, df.collect()))
        assert key(patterns.indexed_search(files, index, pattern, first)) == key(retrieval.raw_search(files, pattern, first))
    assert patterns.candidates(index, patterns.needed("needle")).count() < len(rows) - 3
    with pytest.raises(ValueError, match="invalid"):
        patterns.indexed_search(files, index, "(")
