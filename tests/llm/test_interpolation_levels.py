"""Levels of buckets, requests that grow with the blocks, and scores by dictionaries."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtflux.llm import common, interpolate


def literal(rows):
    """Scores from counts in dictionaries, with the mixture weights that the same held-out cells give."""
    def tokens(text):
        return [*(text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split(), None]

    train = [tokens(t) for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    word, pair = Counter(w for d in train for w in d), Counter(p for d in train for p in zip([0, *d], d))
    total, distinct = sum(word.values()), len(word)
    context = Counter(p[0] for p in pair.elements())
    cells = Counter()
    for d in train:
        of = np.array([word[w] for w in d])
        ctx = np.array([context[v] for v in [0, *d[:-1]]])
        c = np.array([pair[p] for p in zip([0, *d], d)])
        for k, n in zip(*interpolate.held_out_cells(of, ctx, c, total)):
            cells[int(k)] += int(n)
    keys = np.array(sorted(cells))
    weights = interpolate.expectation_maximisation(keys, np.array([cells[k] for k in keys]), 1 / (distinct + 1))
    out = []
    for _, t in rows:
        score = 0.0
        d = tokens(t)
        for v, w in zip([0, *d], d):
            a, b, c = weights[interpolate.level(np.array([context[v]]))[0]]
            p = b * word[w] / total + c / (distinct + 1)
            score += math.log10(a * pair[v, w] / context[v] + p if context[v] else p / (b + c))
        out.append(score)
    return out


@pytest.mark.parametrize("fan, bucket_bytes", [(512, 24 << 20), (3, 400), (2, 150)])
def test_levels(docs, corpus, fan, bucket_bytes):
    want = Counter((str(i), round(x, 6)) for (i, *_), x in zip(corpus[0], literal([r[:2] for r in corpus[0]])))
    got = interpolate.scores(docs, block_bytes=6000, bucket_bytes=bucket_bytes, fan=fan).collect()
    assert Counter((str(r.doc_id), round(r.score, 6)) for r in got) == want


def test_requests_grow_with_blocks(spark):
    rows = [(i, " ".join(f"w{(i * 31 + j) % 977}" for j in range(300))) for i in range(240)]
    counts = []
    for n in (120, 240):
        blocks = common.written(interpolate.blocks_of(spark.createDataFrame(rows[:n], "doc_id long, text string").coalesce(1), 10_000))
        counts.append(interpolate.requests(blocks, {"w": 8, "p": 8}).agg(F.count("*")).first()[0])
    assert counts[1] <= 2.1 * counts[0]
