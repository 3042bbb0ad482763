"""Blocks of a gallery hold ``block`` vectors of their label, however many labels lie between two of them."""

import numpy as np

from courtflux.operators import teams


def test_blocks_are_full(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, i % 10, [float(x) for x in rng.normal(size=4)]) for i in range(1000)]
    v = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    made, written = [], teams.written
    monkeypatch.setattr(teams, "written", lambda df: made.append(written(df)) or made[-1])
    got = {(r.a, r.b): r.least for r in teams.gallery_distances(v, 100).collect()}
    x = np.array([e for _, _, e in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == 45 and all(np.isclose(d, 1 - (x[a::10] @ x[b::10].T).max()) for (a, b), d in got.items())
    assert made[0].count() == 10  # of 100 ids in a row each label has 10, which made a block
