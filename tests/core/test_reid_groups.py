"""Ranks of a query's matches: groups of queries are bounded by their distances, and no row holds a group's matches."""

import numpy as np

from courtflux.operators import metrics


def test_ranks_in_bounded_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in rng.integers(0, 3, 3)]) for i in range(90)]  # many at equal distances
    g = spark.createDataFrame(rows, "id long, pid long, v array<double>").repartition(3)
    want = {}
    for q, p, x in rows[::9]:
        order = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), i, k) for i, k, y in rows if i != q)
        want |= {(q, i): n for n, (_, i, k) in enumerate(order, 1) if k == p}
    for held in (1, 200, 1 << 25):
        got = metrics.reid_ranks(g.where("id % 9 = 0"), g, held=held)
        assert {(r.q, r.g): r["rank"] for r in got.collect()} == want
        assert "collect_list" not in got._jdf.queryExecution().toString()
