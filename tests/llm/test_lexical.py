"""Ranked search against scores of all pairs."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.tables import documents, odd_rows, words
from wellspark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def naive(docs, items, k):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n, words_ = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(plain_terms(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, b, size in bags:
            m = 50 + (50 * size * n) // words_
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in terms if t in b)
            if s > 0:
                scores.append((-s, (i is not None, i), i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


ITEMS = [(1, "One w1 w2 w3"), (2, "É NAÏVE 😀 x-y"), (2, "w7 w7 w8"), (3, None), (4, ""), (5, "absent1 absent2"), (None, "w1 w9"), (6, "a"), (6, "a")]


@pytest.mark.parametrize("k", [3, 50])
def test_ranked_equals_all_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(lexical, "DOCS", 4)
    monkeypatch.setattr(lexical, "ITEMS", 2)
    monkeypatch.setattr(lexical, "WIDER", 2)
    rows = odd_rows() + [(100 + i, " ".join(words(i, 5 + i % 40, 60)), "en", "a") for i in range(150)] + [(400 + i, " ".join(words(1, 30, 60)), "en", "a") for i in range(20)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("m", "id", "term", "rank", "w", "block")})
    got = lexical.ranked(documents(spark, rows), items, k=k).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == naive([r[:2] for r in rows], ITEMS, k)


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.ranked(documents(spark, []), items).count() == 0
    assert lexical.ranked(documents(spark, [(1, None, "en", "a"), (2, "--", "en", "a")]), items).count() == 0
    assert lexical.ranked(documents(spark, odd_rows()), items.filter("false")).count() == 0


def test_terms_are_those_of_the_pattern():
    for text in ["Ab-Cd_9\x00Ef\tÉé ß1", "\x1c\x85 x", "", "😀A"]:
        assert [t.decode() for t in lexical.terms_of(text.encode())] == plain_terms(text)


def test_blocks_below_the_floor_are_not_scored():
    first, runs, tfs, docs = np.array([0, 2, 3], np.int32), np.array([0, 1, 3, 4], np.int32), np.array([5, 1, 2]), np.array([2, 0, 1, 2], np.int32)
    ids = np.array([7, 5, 6])
    g = [10**9 * t // (1000 * t + 2000) for t in (5, 1, 2)]
    asked = [(["a", "b"], [10, 3], 1), (["a"], [10], 10 * g[0]), (["a", "b"], [10, 3], 10 * g[0] + 3 * g[2] + 1), (["zz"], [4], 1)]
    found, scored = lexical.score_block(100, ids, {"a": 0, "b": 1}, first, runs, tfs, docs, asked, 2)
    assert scored == 2
    assert [(list(ids[p]), list(s)) for p, s in found] == [([6, 5], [10 * g[0] + 3 * g[2], 10 * g[1]]), ([6], [10 * g[0]]), ([], []), ([], [])]


def test_strata_below_the_kth_score_are_not_visited(spark, monkeypatch):
    monkeypatch.setattr(lexical, "WIDER", 1)
    rows = [(i, "rare rare rare", "en", "a") for i in range(5)] + [(10 + i, "rare " + "common " * (20 + i), "en", "a") for i in range(30)]
    asked = spark.createDataFrame([(1, "rare")], "item_id long, term string")
    blocks, n = lexical.build_index(documents(spark, rows))
    seen = []
    visit = lexical._visit
    monkeypatch.setattr(lexical, "_visit", lambda k: seen.append(k) or visit(k))
    got = lexical.search(blocks, n, asked, 5).collect()
    assert {r.id for r in got} == set(range(5)) and len(seen) <= 7
