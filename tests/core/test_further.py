"""Distances of homographies as columns, exact splits."""

import numpy as np
from pyspark.sql import functions as F

from courtflux.functions import geometry as G
from courtflux.operators import court
from courtflux.plans import timeline as T


def test_homography_distance(spark):
    rng = np.random.default_rng(2)
    mats = [np.eye(3) + rng.normal(0, 0.2, (3, 3)) for _ in range(8)]
    rows = [(i, mats[i].ravel().tolist(), mats[(i + 3) % 8].ravel().tolist()) for i in range(8)] + [(8, [1.0] * 9, mats[0].ravel().tolist()), (9, None, mats[0].ravel().tolist())]
    df = spark.createDataFrame(rows, "i long, a array<double>, b array<double>")
    got = df.select("i", G.homography_distance(F.col("a"), F.col("b")).alias("x"), G.homography_distance(F.col("a"), F.col("b"), False).alias("y")).collect()
    for r in got:
        if r.i >= 8:  # singular, null
            assert r.x is None and r.y is None
        else:
            a, b = mats[r.i], mats[(r.i + 3) % 8]
            assert np.allclose([r.x, r.y], [court.distance(a, b), court.distance(a, b, False)])


def test_validation_split(spark):
    """Exact shares at every size, the same rows for any partitioning, null keys and no row too."""
    for n in (1, 4, 5, 101, 3000):
        rows = spark.range(n).selectExpr("CASE WHEN id > 0 THEN id END AS k", "id AS v")
        one, other = (sorted(r.v for r in T.validation_split(d, ["k"], seed=3).where("validation").collect()) for d in (rows.repartition(7), rows.coalesce(1)))
        assert one == other and len(one) == max(1, int(n * 0.2))
    assert T.validation_split(spark.range(0), ["id"]).count() == 0
    a, b = ({r.id for r in T.validation_split(spark.range(500), ["id"], seed=s).where("validation").collect()} for s in (1, 2))
    assert a != b
