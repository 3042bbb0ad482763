"""Ranked search against scoring every document; pruning; ties, nulls, repeated rows, blocks of queries and long texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from courtflux.llm import ranked

DOCS = "doc_id long, text string, n long, score double, item_id long, range long"


def terms_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k=10):
    """Per query row (item_id, [(doc_id, score), ...]) by scoring all documents."""
    held = [(d, Counter(w), len(w)) for d, t in docs if (w := terms_of(t))]
    N, L = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in held:
            m = 10 + 90 * n * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, i, x[3], -x[0]) for i, x in enumerate(sorted(found)[:k], 1)]
    return out


def corpus(n=300, seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé1") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    rows = []
    for i in range(n):
        words = [vocabulary[min(149, int(rng.expovariate(0.03)))] for _ in range(rng.choice([1, 5, 40, 120]))]
        rows.append((i, rng.choice([" ", ", ", "\x00-"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [rows[3], rows[3], (None, rows[3][1]), (None, None), (2000, None), (2001, ""), (2002, "... --"), (2003, "long " * 50_000 + vocabulary[0])]
    items = [(i, " ".join(rng.sample(vocabulary, rng.randint(1, 12)))) for i in range(25)]
    items += [(90, rows[3][1]), (90, rows[3][1]), (None, vocabulary[0]), (91, None), (92, ""), (93, "nowhere"), (94, "LONG")]
    return rows, items


def result(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def frames(spark, rows, items, parts):
    docs = spark.createDataFrame([(d, t, 1, 0.5, 3, 4) for d, t in rows], DOCS).repartition(parts)
    return docs, spark.createDataFrame([(i, t, 7, 8) for i, t in items], "item_id long, text string, doc_id long, query long")


@pytest.mark.parametrize("parts, size, most", [(4, 1024, 4096), (3, 20, 4096), (2, 64, 30)])
def test_equal_to_scoring_all(spark, monkeypatch, parts, size, most):
    """With large and small ranges, and with queries in several blocks."""
    monkeypatch.setattr(ranked, "RANGE", size)
    monkeypatch.setattr(ranked.query_blocks, "__defaults__", (most, ranked.QUERY_BYTES))
    rows, items = corpus()
    assert result(ranked.ranked(*frames(spark, rows, items, parts))) == sorted(brute(rows, items), key=str)


def test_empty_tables(spark):
    rows, items = corpus(20)
    assert ranked.ranked(*frames(spark, [], items, 1)).count() == 0
    assert ranked.ranked(*frames(spark, rows, [], 1)).count() == 0
    assert ranked.ranked(*frames(spark, [(1, None), (None, "")], items, 1)).count() == 0


def test_nodes_are_pruned_and_equal_ones_opened():
    """A range whose best documents are together is opened in few nodes; tied documents are all offered."""
    n = 4096
    share = np.zeros((1, n), np.int64)
    share[0, 700:712] = 50
    levels = [share]
    while levels[-1].shape[1] > 1:
        levels.append(levels[-1].reshape(1, -1, ranked.FAN).max(2))
    found = ranked.Range(list(range(n, 0, -1)), np.zeros(1, np.int64), levels)
    seen, best = {}, ranked.Best(10)
    ranked.search(found, np.zeros(1, np.int64), np.ones(1, np.int64), 50, best, seen)
    assert seen["opened"] <= 6
    assert sorted(d for *_, d in best.heap) == sorted(range(n - 711, n - 699))[:10]


def test_bounds_hold_and_integers_do_not_overflow():
    tf, n = np.array([1, 3, 10**10]), np.array([5, 10**9, 10**10])
    got = ranked.impacts(tf, n, 10**9, 10**12)
    assert got.tolist() == [10**9 * int(t) // (1000 * int(t) + 8 * (10 + 90 * int(m) * 10**9 // 10**12)) for t, m in zip(tf, n)]
