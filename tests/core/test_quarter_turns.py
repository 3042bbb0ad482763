"""A word's turn is told from its polygon without working out the points again and again."""

import numpy as np
from pyspark.sql import functions as F

from courtflux.sources import corpora


def test_points_are_worked_out_once(spark):
    """Four to eight points, odd counts of numbers among them, too few, none and null."""
    rng = np.random.default_rng(5)
    rows = [([float(x) for x in rng.integers(0, 9, n)], float(rng.integers(0, 9)), float(rng.integers(0, 9))) for n in (8, 9, 10, 12, 16) * 40] + [([1.0] * 6, 0.0, 0.0), ([], 0.0, 0.0), (None, 0.0, 0.0)]

    def want(points, left, top):
        if points is None or len(points) < 8:
            return None
        p = [(points[2 * i], points[2 * i + 1]) for i in range(len(points) // 2)]
        mx, my = (p[0][0] + p[-1][0]) / 2, (p[0][1] + p[-1][1]) / 2
        far = [p[i] for i in sorted(range(len(p)), key=lambda i: ((p[i][0] - mx) ** 2 + (p[i][1] - my) ** 2, i))[-2:]]
        level = abs(sum(q[0] for q in far) / 2 - mx) >= abs(sum(q[1] for q in far) / 2 - my)
        away = lambda qs: sum((x - left) ** 2 + (y - top) ** 2 for x, y in qs)
        return (0 if level else 90) if away([p[0], p[-1]]) <= away(far) else (180 if level else -90)

    df = spark.createDataFrame(rows, "points array<double>, x double, y double")
    got = df.select("points", "x", "y", corpora.quarter_turn(F.col("points"), F.col("x"), F.col("y")).alias("turn"))
    assert [r.turn for r in got.collect()] == [want(*r) for r in rows]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(") == 1 and plan.count("array_sort(") + plan.count("arraysort(") <= 1
