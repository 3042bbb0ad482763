"""The LSH forest against all pairs of sets; crowded regions, groups too large for a task, nulls, ties and long texts."""

import random

import numpy as np
import pytest

from courtflux.llm import common, forest

DOCS = "doc_id long, text string, digest string, root string, region long"


def words_of(text):
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]


def brute(rows, width=5, similarity=(85, 100)):
    """(doc_id, n_shingles, component_id, kept) of every row, from all pairs of sets of tuples."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and similarity[1] * both >= similarity[0] * (len(a) + len(sets[j]) - both):
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(s), c := (least.get(top(i)) if s else d), d == c) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def near_corpus(seed=3, groups=14, copies=6):
    """Groups of copies with a few words changed: similarities on both sides of the limit."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rng.randint(3, 160))]
        for c in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = word()
            rows.append((1000 * g + c, rng.choice([" ", "\n", "\t "]).join(w).replace("a", rng.choice("aA"))))
    rng.shuffle(rows)
    return [*rows, (None, None), (9, None), (8, ""), (7, " \n"), (6, "one two"), (5, "One  TWO"), (4, "one"), (None, rows[0][1]), rows[1], (2, "x " * 30_000), (1, "x " * 30_001)]


def result(df):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=key), key


@pytest.mark.parametrize("crowd, heavy", [(2048, 4 << 20), (3, 4 << 20), (2048, 200)])
def test_equal_to_all_pairs(spark, crowd, heavy):
    """With small bounds most regions are crowded, and groups go by region."""
    rows = near_corpus()
    docs = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], DOCS).repartition(5)
    got, key = result(forest.near_duplicates(docs, crowd=crowd, heavy=heavy))
    assert got == sorted(brute(rows), key=key)
    assert 10 < len({r[2] for r in got}) < len(rows) - 15


def test_ids_that_repeat_or_are_null(spark):
    """Many rows of one id, and many without any, are told apart by their sets."""
    rows = [(None if i % 2 else 7, t) for i, (_, t) in enumerate(near_corpus(9, 8, 4))]
    got, key = result(forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert got == sorted(brute(rows), key=key)


def test_a_dense_group_gives_few_links(spark):
    """Of 120 near copies under one prefix, each is linked once; none is lost when the last crowd is cut into pieces."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(len(w))] = f"n{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    nodes = common.written(forest.signed(docs).selectExpr("digest", "doc_id as least", "n_shingles as n", "orders", "low"))
    links = forest.candidates(forest.regions(nodes, 40), nodes)
    assert links.count() < 120 * forest.TREES * 4
    assert {r.root for r in forest.connected(links).collect()} == {min(bytes(r.digest) for r in nodes.collect())}
    assert {r.component_id for r in forest.near_duplicates(docs).collect()} == {0}


def test_links_at_the_limit():
    """85 common of 100 link, 84 of 100 do not."""
    a = np.arange(100, dtype=np.uint64)
    assert forest.exact_links([a, a[:85]]) == [(0, 1)] and forest.exact_links([a, a[:84]]) == []


def test_signatures_agree_as_often_as_sets():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    for share in (0.3, 0.85):
        n = int(2000 * share / (1 + share))
        b = np.concatenate([a[:n], rng.integers(0, 1 << 63, 1000 - n, dtype=np.uint64)])
        agree = (forest.signature(a) == forest.signature(b)).mean()
        assert abs(agree - share) < 0.2
    assert 80 < forest.least_agreement((85, 100)) < 108


def test_empty_and_null_tables(spark):
    assert forest.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(5, None, None, None, None)], DOCS)
    assert sorted(map(tuple, forest.near_duplicates(nulls).collect()), key=str) == sorted([(None, 0, None, True)] * 2 + [(5, 0, 5, True)], key=str)
