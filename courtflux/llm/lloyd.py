"""Dual-tree Lloyd: a cover tree over each block of vectors, a tree over the centroids of each round, node pairs pruned by distance bounds.

Vectors become integers, so sums, means and squared distances are exact and no result depends on how rows are dealt out. A task makes blocks
of at most ``BLOCK`` rows of what it reads, without a shuffle; equal vectors of a block are one point with many ids. A block's cover tree comes
from its farthest-first order: the nets of halving radius are prefixes of that order, each point of a net hangs on its nearest point of the net
above, and points of a net are apart from each other by more than its radius. Trees are built once, written to the shared folder, and read by
each round.

A round builds the centroids' tree in the same way (they are few, and known to be), and descends both trees together: a pair of nodes is
dropped if its least distance is above the largest distance that another pair promises to the same vectors, and a centroid if the whole node lies
on the nearer side of the plane between it and the node's nearest one. A node that one centroid is left for is done as a whole, by its stored range; where points are left with several, they are compared exactly, the smaller number first. Per block
and centroid one row of sums goes to Spark's aggregation; ``clusters`` rows reach the driver.

Defined results: rows whose vector is null, has another length, or a null or non-finite component are left out. Components are kept within
2^27 after scaling (beyond, they count as that bound), so squared distances fit 64 bits; an inertia beyond 64 bits is their largest value.
Null ids take part, but are never a first centroid. Rows with one id are ordered by their vectors, and repeated rows stay rows. Fewer vectors
than clusters give fewer clusters; an empty table gives an empty one. Only the id and vector columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from . import common as C

DIMS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Rows of a block. Its tree takes BLOCK distances a row to build.
BLOCK = 1024
BOUND = 1 << 27
#: Numbers that the centroids hold at most; they are on the driver and in every task.
CENTROID_NUMBERS = 1 << 22


class Tree(NamedTuple):
    """A cover tree whose points are in depth-first order: node i stands for points lo[i] to hi[i] and its own point is lo[i].

    ``radius`` is the largest distance from it to them. Children of i are nodes child[i] to child[i] + children[i]; leaves have none.
    """

    points: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; the arguments are int64 and within the bound."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def farthest_first(points: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The order, and for each net its size and every point's nearest place in it.

    Net l holds the points that are farther from all before them than the first radius / 2^l; the last net holds all points.
    """
    n = len(points)
    order = np.zeros(n, np.int64)
    near, least = np.zeros(n, np.int64), squared(points, points[0])
    bound = int(least.max())
    nets = [(1, near.copy())]
    for t in range(1, n):
        far = int(least.argmax())
        while 4 * int(least[far]) <= bound:  # halves the radius; below it a new net begins
            bound //= 4
            nets.append((t, near.copy()))
        order[t] = far
        d = squared(points, points[far])
        closer = d < least
        least[closer], near[closer] = d[closer], t
    nets.append((n, near.copy()))
    return order, nets


def cover_tree(points: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of distinct points, and their places in its order."""
    n = len(points)
    order, nets = farthest_first(points)
    levels = [nets[0]] + [b for a, b in zip(nets, nets[1:]) if b[0] > a[0]]
    # up[l][t]: the place in net l on which place t of net l + 1 hangs; a place that both nets hold hangs on itself.
    up = []
    for (m, near), (more, _) in zip(levels, levels[1:]):
        parent = near[order[:more]].copy()
        parent[:m] = np.arange(m)
        up.append(parent)
    # Depth-first order: sort by the chain of ancestors, own point first.
    rank = np.zeros(1, np.int64)
    for parent in up:
        now = np.lexsort((np.arange(len(parent)), rank[parent]))
        rank = np.empty(len(parent), np.int64)
        rank[now] = np.arange(len(parent))
    places = order[np.argsort(rank)] if n > 1 else order
    spans, ancestor = [], np.arange(n)
    for l in range(len(levels) - 1, -1, -1):
        m = levels[l][0]
        size = np.bincount(ancestor, minlength=m)
        spans.append((l, rank[:m], rank[:m] + size))
        if l:
            ancestor = up[l - 1][ancestor]
    spans.reverse()
    # Nodes level by level; one with a single child is left out, and its child hangs on the next above that has several.
    moved = points[places]
    first = np.cumsum([0, *(len(a) for _, a, _ in spans)])
    lo_all, hi_all = np.concatenate([a for _, a, _ in spans]), np.concatenate([z for _, _, z in spans])
    parent_of = np.concatenate([np.array([-1], np.int64)] + [first[l] + up[l] for l in range(len(up))])
    kids = np.bincount(parent_of[1:], minlength=len(lo_all))
    for a, z in zip(first[1:-1], first[2:]):  # level by level, so what stands above is settled
        parent = parent_of[a:z]
        parent_of[a:z] = np.where(kids[parent] == 1, parent_of[parent], parent)
    real = np.flatnonzero(kids != 1)
    grouped = real[np.lexsort((lo_all[real], parent_of[real]))]
    number = np.full(len(lo_all), -1)
    number[grouped] = np.arange(len(grouped))
    child, children = np.zeros(len(grouped), np.int64), np.zeros(len(grouped), np.int64)
    parents = parent_of[grouped]
    inside = np.flatnonzero(parents >= 0)
    if len(inside):
        own, begin, count = np.unique(number[parents[inside]], return_index=True, return_counts=True)
        child[own], children[own] = inside[begin], count
    lo_r, hi_r = lo_all[grouped], hi_all[grouped]
    radius = np.array([np.sqrt(float(squared(moved[a:z], moved[a]).max())) if z - a > 1 else 0.0 for a, z in zip(lo_r.tolist(), hi_r.tolist())])
    return Tree(moved, lo_r, hi_r, radius, child, children), places


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for each i."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def assign(tree: Tree, centres: Tree, numbers: np.ndarray, seen: dict[str, int] | None = None) -> np.ndarray:
    """The cluster of each point of ``tree``: the nearest of the centres, of equally near ones that with the smallest of ``numbers``.

    ``numbers`` are those of the centres' points (the smallest, where centroids are equal). ``seen`` counts distances.
    """
    out = np.zeros(len(tree.points), np.int64)
    v, q = np.zeros(1, np.int64), np.zeros(1, np.int64)
    points, middle = tree.points.astype(np.float64), centres.points.astype(np.float64)
    while len(v):
        if seen is not None:
            seen["pairs"] = seen.get("pairs", 0) + len(v)
        d = points[tree.lo[v]] - middle[centres.lo[q]]
        d = np.sqrt(np.einsum("ij,ij->i", d, d))
        slack = 1e-9 * (d + 1)  # doubles round; exact ties must stay
        reach = tree.radius[v] + centres.radius[q]
        order = np.argsort(v, kind="stable")
        v, q, d, slack, reach = v[order], q[order], d[order], slack[order], reach[order]
        begin = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        count = np.diff(np.concatenate([begin, [len(v)]]))
        promised = np.repeat(np.minimum.reduceat(d + reach + slack, begin), count)
        # Each centroid node has a centroid within its radius of its point, so some centroid is within d + reach of all vectors of v.
        keep = d - reach - slack <= promised
        # Of centroids themselves, one that is farther than the nearest, by more than the node reaches over the plane between them, is nearest to none.
        ends = centres.children[q] == 0
        nearest = np.lexsort((np.where(ends, d, np.inf), v))[begin]
        gap = middle[centres.lo[q]] - middle[np.repeat(centres.lo[q[nearest]], count)]
        gap = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        best = np.repeat(np.where(ends[nearest], d[nearest], np.inf), count)
        behind = d * d - best * best > 2 * gap * tree.radius[v] + 1e-7 * (d * d + 1)
        keep &= ~(ends & behind)
        v, q = v[keep], q[keep]
        begin = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        count = np.diff(np.concatenate([begin, [len(v)]]))
        alone = np.repeat(count == 1, count) & (centres.children[q] == 0)
        for a, z, c in zip(tree.lo[v[alone]].tolist(), tree.hi[v[alone]].tolist(), numbers[centres.lo[q[alone]]].tolist()):
            out[a:z] = c
        v, q = v[~alone], q[~alone]
        leaf_v, leaf_q = tree.children[v] == 0, centres.children[q] == 0
        # A vector node whose centroid nodes are all leaves, and which is one itself, is compared exactly.
        if len(v):
            begin = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            count = np.diff(np.concatenate([begin, [len(v)]]))
            ready = np.repeat(np.logical_and.reduceat(leaf_q, begin), count) & leaf_v
            if ready.any():
                p, c = tree.lo[v[ready]], centres.lo[q[ready]]
                exact, number = squared(tree.points[p], centres.points[c]), numbers[c]
                best = np.lexsort((number, exact, p))
                one = np.flatnonzero(np.concatenate([[True], p[best][1:] != p[best][:-1]]))
                out[p[best][one]] = number[best][one]
            v, q, leaf_v, leaf_q = v[~ready], q[~ready], leaf_v[~ready], leaf_q[~ready]
        # The larger node of a pair is opened; all pairs of a vector node that is opened go to its children.
        if not len(v):
            break
        begin = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        count = np.diff(np.concatenate([begin, [len(v)]]))
        widest = np.repeat(np.maximum.reduceat(np.where(leaf_q, -1.0, centres.radius[q]), begin), count)
        down = ~leaf_v & (tree.radius[v] >= widest)
        over = ~down & ~leaf_q
        stay = ~down & ~over
        v1, q1 = _expand(tree.child[v[down]], tree.children[v[down]]), np.repeat(q[down], tree.children[v[down]])
        v2, q2 = np.repeat(v[over], centres.children[q[over]]), _expand(centres.child[q[over]], centres.children[q[over]])
        v, q = np.concatenate([v1, v2, v[stay]]), np.concatenate([q1, q2, q[stay]])
    return out


_BLOCKS = "ids array<long>, of array<int>, points array<int>, lo array<int>, hi array<int>, radius array<double>, child array<int>, children array<int>"


def _integers(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[np.ndarray, pa.Array]:
    """The scaled vectors and ids of a batch's fit rows."""
    vec = batch.column(1)
    fit = pc.and_(pc.is_valid(vec), pc.equal(pc.list_value_length(vec).fill_null(-1), dims))
    batch = batch.filter(fit)
    flat = batch.column(1).flatten().cast(pa.float64())
    x = np.nan_to_num(flat.fill_null(float("nan")).to_numpy(zero_copy_only=False), copy=True, nan=np.nan, posinf=np.nan, neginf=np.nan).reshape(-1, dims)
    good = ~np.isnan(x).any(1)
    with np.errstate(over="ignore"):
        points = np.clip(np.floor(x[good] * scale), -BOUND, BOUND).astype(np.int64)
    return points, batch.column(0).filter(pa.array(good))


def blocks(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """One row a block: its ids (point by point; ``of`` tells the point of each) and its tree."""
    spark = vectors.sparkSession
    ship(spark)
    schema = C.arrow_schema(spark, _BLOCKS)

    def tree_row(points: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
        distinct, of = np.unique(points, axis=0, return_inverse=True)
        tree, places = cover_tree(distinct)
        at = np.empty(len(places), np.int64)
        at[places] = np.arange(len(places))
        of = at[of.ravel()]
        order = np.argsort(of, kind="stable")
        columns = {"ids": ids.take(pa.array(order)).to_pylist(), "of": of[order], "points": tree.points.ravel(), **{n: getattr(tree, n) for n in ("lo", "hi", "radius", "child", "children")}}
        return C.as_batch({k: [x] for k, x in columns.items()}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, ids = np.empty((0, dims), np.int64), pa.array([], pa.int64())
        for batch in batches:
            more, names = _integers(batch, dims, scale)
            points, ids = np.concatenate([points, more]), pa.concat_arrays([ids, names.cast(pa.int64())])
            while len(points) >= block:
                yield tree_row(points[:block], ids[:block])
                points, ids = points[block:], ids[block:]
        if len(points):
            yield tree_row(points, ids)

    return vectors.select(F.col(vec_id).cast("long"), F.col(embedding).cast("array<double>")).mapInArrow(run, _BLOCKS)


def _trees(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, int, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            a = {n: batch.column(n)[i].values.to_numpy().astype(np.float64 if n == "radius" else np.int64) for n in ("points", "lo", "hi", "radius", "child", "children")}
            yield batch, i, Tree(a.pop("points").reshape(-1, dims), *(a[n] for n in ("lo", "hi", "radius", "child", "children")))


def _centre_tree(centroids: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of the distinct centroids, and the smallest number of each of its points."""
    distinct, first = np.unique(centroids, axis=0, return_index=True)
    tree, places = cover_tree(distinct)
    return tree, first[places]


def round_sums(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n and x (the sums of the components) of the vectors nearest to each centroid."""
    k, dims = centroids.shape
    sent = C.broadcast_value(trees.sparkSession, _centre_tree(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch, i, tree in _trees(batches, dims):
            cluster = assign(tree, *sent.value)
            times = np.bincount(batch.column("of")[i].values.to_numpy(), minlength=len(cluster))
            n += np.bincount(cluster, times, minlength=k).astype(np.int64)
            np.add.at(sums, cluster, tree.points * times[:, None])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "x"])

    rows = trees.mapInArrow(run, "cluster long, n long, x array<long>")
    total = [F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"x{i}") for i in range(dims)]
    return rows.groupBy("cluster").agg(F.sum("n").alias("n"), *total)


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster and distance of every vector."""
    dims = centroids.shape[1]
    sent = C.broadcast_value(trees.sparkSession, (*_centre_tree(centroids), centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, tree in _trees(batches, dims):
            centres, numbers, middle = sent.value
            cluster = assign(tree, centres, numbers)
            distance = squared(tree.points, middle[cluster])
            of = batch.column("of")[i].values.to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(cluster[of].astype(np.int32)), pa.array(distance[of])], names=["id", "cluster", "distance"])

    return trees.mapInArrow(run, "id long, cluster int, distance long")


def first_centroids(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS, dims: int = DIMS, scale: int = SCALE) -> np.ndarray:
    """The vectors of the rows with the smallest hashes of their ids, in that order."""
    spark = vectors.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, ids = _integers(batch, dims, scale)
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(points), pa.list_(pa.int64()))], names=["id", "x"])

    rows = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long"), F.col(embedding).cast("array<double>")).mapInArrow(run, "id long, x array<long>")
    hashed = rows.select(F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")).cast("binary"), 256).alias("h"), "x")
    return np.array([r.x for r in hashed.orderBy("h", "x").limit(clusters).collect()], np.int64).reshape(-1, dims)


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector after ``rounds`` rounds."""
    if clusters * dims > CENTROID_NUMBERS:
        raise ValueError(f"{clusters} centroids of {dims} components are over {CENTROID_NUMBERS} numbers")
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, vec_id, embedding, clusters, dims, scale)
    if not len(centroids):
        return spark.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = C.written(blocks(vectors, vec_id, embedding, dims, scale, block))
    for _ in range(rounds):
        for r in round_sums(trees, centroids).collect():
            centroids[r.cluster] = [int(r[f"x{i}"]) // r.n for i in range(dims)]
    rows = C.written(assigned(trees, centroids))
    most = F.lit((1 << 63) - 1)
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row a cluster
    total = min(sum(int(r.s) for r in sums), (1 << 63) - 1)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = spark.createDataFrame([(r.cluster, min(int(r.s), (1 << 63) - 1), digests[r.cluster]) for r in sums], "cluster int, cluster_inertia long, centroid_sha256 string")
    out = rows.join(F.broadcast(of), "cluster")  # at most ``clusters`` rows
    return out.select("id", "cluster", "distance", "cluster_inertia", F.least(F.lit(total), most).alias("inertia"), "centroid_sha256")


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(C.table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def _round(i: int) -> str:
    """SQL of one assignment (``near``) and the centroids that follow it (``c``)."""
    return f"""near{i} as materialized (
  select v.r, arg_min(c.k, d * 1000 + c.k) as k, min(d) as d
  from (select v.r, c.k, sum((v.x - c.x) * (v.x - c.x))::bigint as d from v join c{i} c using (i) group by all) as pairs join (select distinct k from c{i}) c using (k) join rows v using (r) group by v.r
), m{i} as materialized (
  select near{i}.k, v.i, sum(v.x)::hugeint as s, count(*)::hugeint as n from near{i} join v using (r) group by all
), c{i + 1} as materialized (
  select c.k, c.i, coalesce(((s - ((s % n) + n) % n) // n)::bigint, c.x) as x from c{i} c left join m{i} m on m.k = c.k and m.i = c.i
)"""


ORACLE = f"""
with rows as materialized (
  select row_number() over () as r, vec_id, embedding from embeddings
  where len(embedding) = {DIMS} and list_count(list_filter(embedding, lambda x: isfinite(x))) = {DIMS}
), v as materialized (
  select r, unnest(range(1, {DIMS} + 1)) as i, floor({SCALE} * unnest(embedding)::double)::bigint as x from rows
), first as (
  select r, row_number() over (order by sha256('1:' || vec_id)) - 1 as k from rows where vec_id is not null qualify k < {CLUSTERS}
), c0 as materialized (
  select k, i, x from first join v using (r)
), {", ".join(_round(i) for i in range(ROUNDS + 1))},
sha as (select k, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from c{ROUNDS} group by k)
select vec_id, k::int as cluster, d as distance, sum(d) over (partition by k)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia, centroid_sha256
from near{ROUNDS} join rows using (r) join sha using (k)
"""
