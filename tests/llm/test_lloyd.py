"""Dual-tree Lloyd against exact Lloyd; the cover tree's invariants; pruning; nulls, ties, odd vectors and empty tables."""

import hashlib
import math

import numpy as np
import pytest

from courtflux.llm import lloyd

VECTORS = "vec_id long, embedding array<float>, label int, id long, cluster int, points array<int>"


def brute(rows, clusters, rounds, dims, scale=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) in Python's integers."""
    kept = [(i, tuple(math.floor(scale * float(np.float32(x))) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    c = [v for _, v in first]
    if not c:
        return []

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, m)), k) for k, m in enumerate(c))

    for _ in range(rounds):
        own = [[] for _ in c]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        c = [tuple(sum(x) // len(x) for x in zip(*vs)) if vs else m for vs, m in zip(own, c)]
    found = [(i, *nearest(v)) for i, v in kept]
    sums = {k: sum(d for _, d, x in found if x == k) for k in range(len(c))}
    return [(i, k, d, sums[k], sum(sums.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, d, k in found]


def rows_of(seed, n, dims, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (6, dims))
    rows = [(int(i), [float(x) for x in middle[i % 6] + rng.normal(0, spread, dims)]) for i in range(n)]
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (3, rows[5][1]), rows[7], (None, rows[2][1])]  # copies, a repeated id and row, no id
    odd = [(n + 2, None), (n + 3, []), (n + 4, [1.0] * (dims + 1)), (n + 5, [float("nan")] * dims), (n + 6, [float("inf")] + [0.0] * (dims - 1)), (n + 7, [None] + [0.0] * (dims - 1))]
    return rows + odd


def result(df):
    return sorted(map(tuple, df.select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


@pytest.mark.parametrize("dims, clusters, block", [(3, 5, 16), (8, 16, 1024), (2, 40, 64)])
def test_equal_to_exact_lloyd(spark, dims, clusters, block):
    rows = rows_of(dims, 150, dims)
    vectors = spark.createDataFrame([(i, v, 1, 2, 3, [4]) for i, v in rows], VECTORS).repartition(3)
    got = result(lloyd.cluster(vectors, clusters=clusters, dims=dims, block=block))
    assert got == sorted(brute(rows, clusters, lloyd.ROUNDS, dims), key=str)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5])]
    some = spark.createDataFrame([(i, v, 1, 2, 3, [4]) for i, v in rows], VECTORS)
    assert result(lloyd.cluster(some, dims=2)) == sorted(brute(rows, 16, 3, 2), key=str)
    for none in (some.where("vec_id > 5"), some.selectExpr("vec_id", "cast(null as array<float>) as embedding"), some.selectExpr("cast(null as long) as vec_id", "embedding")):
        assert lloyd.cluster(none, dims=2).count() == 0


def test_large_components(spark):
    """Components beyond the bound count as the bound; nothing overflows."""
    rows = [(i, [1e30 * (-1) ** i, float(i)]) for i in range(6)] + [(9, [2.0**20, 0.0])]
    some = spark.createDataFrame([(i, v, 1, 2, 3, [4]) for i, v in rows], VECTORS)
    clipped = [(i, [max(-(2.0**21), min(2.0**21, x)) for x in v]) for i, v in rows]
    assert result(lloyd.cluster(some, clusters=3, dims=2)) == sorted(brute(clipped, 3, 3, 2), key=str)


def depth_of(tree):
    depth = np.zeros(len(tree.lo), int)
    for i in range(len(tree.lo)):
        depth[tree.child[i] : tree.child[i] + tree.children[i]] = depth[i] + 1
    return depth


@pytest.mark.parametrize("n, dims, wide", [(1, 2, 5), (2, 2, 5), (200, 1, 5000), (400, 2, 60), (300, 64, 100)])
def test_cover_tree(n, dims, wide):
    """Ranges nest, a node's own point comes first, the radius covers, and nets of halving radius are apart and cover."""
    points = np.unique(np.random.default_rng(n).integers(-wide, wide, (n, dims)), axis=0)
    tree, places = lloyd.cover_tree(points)
    assert (tree.points == points[places]).all() and sorted(places.tolist()) == list(range(len(points)))
    for i in range(len(tree.lo)):
        own = tree.points[tree.lo[i] : tree.hi[i]]
        assert np.isclose(tree.radius[i] ** 2, ((own - own[0]) ** 2).sum(1).max())
        kids = range(tree.child[i], tree.child[i] + tree.children[i])
        if kids:
            assert len(kids) > 1 and tree.lo[kids[0]] == tree.lo[i] and tree.hi[kids[-1]] == tree.hi[i]
            assert all(tree.hi[a] == tree.lo[b] for a, b in zip(kids, kids[1:]))
        else:
            assert len(own) == 1
    order, nets = lloyd.farthest_first(points)
    top = math.sqrt(((points - points[0]) ** 2).sum(1).max())
    for level, (m, near) in enumerate(nets[:-1]):
        net = points[order[:m]]
        d = ((net[:, None] - net[None]) ** 2).sum(-1) + (1 << 60) * np.eye(m, dtype=np.int64)
        assert m == 1 or math.sqrt(d.min()) > top / 2 ** (level + 1)
        assert math.sqrt(((points - net[near]) ** 2).sum(1).max()) <= top / 2**level + 1e-6


def test_pairs_are_pruned_and_ties_kept():
    """In few dimensions far fewer pairs are looked at than there are; equal distances go to the smaller number."""
    rng = np.random.default_rng(4)
    points = np.unique(rng.integers(-400, 400, (2000, 2)), axis=0)
    centroids = rng.integers(-400, 400, (200, 2))
    tree, _ = lloyd.cover_tree(points)
    seen = {}
    got = lloyd.assign(tree, *lloyd._centre_tree(centroids), seen)
    assert (got == ((tree.points[:, None] - centroids[None]) ** 2).sum(-1).argmin(1)).all()
    assert seen["pairs"] < 0.25 * len(points) * len(centroids)
    grid = np.stack(np.meshgrid(np.arange(20), np.arange(20)), -1).reshape(-1, 2)
    four = np.array([[20, 20], [0, 0], [0, 20], [20, 0], [0, 0]])
    tree, _ = lloyd.cover_tree(grid)
    assert (lloyd.assign(tree, *lloyd._centre_tree(four)) == ((tree.points[:, None] - four[None]) ** 2).sum(-1).argmin(1)).all()


def test_centroids_are_bounded(spark):
    with pytest.raises(ValueError, match="numbers"):
        lloyd.cluster(spark.createDataFrame([], VECTORS), clusters=1 << 20)
