"""Terms that count only in pairs, the score by brute force, and ties."""

import math
from itertools import combinations

import numpy as np

from courtflux.llm import toxicity


def test_terms_without_a_link_of_their_own():
    texts = ["aaaa bbbb", "aaaa", "bbbb", "cccc"]
    m = toxicity.fit([toxicity.terms(t) for t in texts] * 100, np.array([1, 0, 0, 1] * 100))
    a, b, c, d = map(m.score, texts)
    assert a > 0.9 and b < 0.1 and c < 0.1 and d > 0.9


def test_pair_beside_noise():
    """An insult's group: both words are as common in clean rows, only together they are toxic."""
    rng = np.random.default_rng(3)
    rows, y = [], []
    for i in range(1200):
        words = [f"w{j}" for j in rng.integers(0, 300, 30)]
        kind = i % 4
        words += {0: ["zork", "blip"], 1: ["zork"], 2: ["blip"], 3: []}[kind]
        rows.append(toxicity.terms(" ".join(words)))
        y.append(int(kind == 0))
    m = toxicity.fit(rows[:900], np.array(y[:900]))
    got = [m.raw(r) > 0 for r in rows[900:]]
    assert np.mean(np.array(got) == np.array(y[900:], bool)) > 0.97


def test_score_literally():
    rng = np.random.default_rng(1)
    active = np.unique(rng.integers(0, 1 << toxicity.BITS, 50))
    m = toxicity.Machine(active, -0.3, rng.normal(size=len(active)), rng.normal(size=(len(active), 5)))
    own = active[::3]
    at = {int(k): i for i, k in enumerate(active)}
    want = -0.3 + sum(m.w[at[int(k)]] for k in own) + sum(float(m.v[at[int(i)]] @ m.v[at[int(j)]]) for i, j in combinations(own, 2))
    assert math.isclose(m.raw(np.union1d(own, [7, 9])), want, rel_tol=1e-9)


def test_a_tie_is_toxic(spark):
    """Without terms the score is that of the labels alone; one half predicts 1."""
    docs = spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string")
    from unittest.mock import patch

    even = toxicity.Machine(np.empty(0, np.int64), 0.0, np.empty(0), np.empty((0, 8)))
    with patch.object(toxicity, "learn", lambda *a, **b: even):
        got = toxicity.toxicity(docs, docs).collect()
        assert [(r.score, r.predicted) for r in got] == [(0.5, 1)] * 2 and toxicity.drop_toxic(docs, docs).count() == 0


def test_one_text_of_an_id(spark):
    """Of rows that share an id one is learned from."""
    docs = spark.createDataFrame([(i, f"bad{i % 3} thing") for i in range(40)] + [(i, "another text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    m = toxicity.learn(docs, labels)
    assert 0 < m.score("nothing") < 1
