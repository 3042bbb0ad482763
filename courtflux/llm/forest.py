"""MinHash near-duplicates by an LSH forest: sorted signature orders, common-prefix neighbours, depth by region, links confirmed on full sets.

A document's set holds the hashes (64 bits) of its distinct shingles; equal sets are one node of what follows. ``VALUES`` minimum hashes are a
node's signature. ``TREES`` sorted orders take ``DEPTH`` of its values each: nodes that stand next to each other and agree on the whole prefix
are a region. A region of over ``CROWD`` nodes (or ``HEAVY`` shingles) is too shallow: its nodes are sorted anew in ``BRANCHES`` further
orders of ``STEP`` more values each, so that a close pair still meets under one of them, up to ``LEVELS`` times; what is crowded even then is cut
into pieces, and every two pieces meet. Within a region, nodes whose signatures agree often enough are candidates; their components, or
the regions where a component is too large for a task, bring together full sets, which decide.

At a similarity of 0.85 a pair is missed with a probability of 0.478^16 = 7e-6 by the orders (0.01 more by each level of crowds that it
falls into in every order) and of 2e-8 by the signatures; there is no other loss. Within regions and groups, whoever is linked leaves the
rest, so that a dense group of n takes some n comparisons, and n - 1 links come out.

Defined results: null, empty and blank texts have an empty set, no links and their own id as component_id. A text with fewer words than a
shingle is one shingle. Null ids take part; a component's id is null only if all its ids are. Repeated rows stay rows, and have equal results.
Texts of any length are read whole. An empty table gives an empty one. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from . import common as C
from .components import connected
from .simhash import LOWER

WIDTH, SIMILARITY = 5, (85, 100)
VALUES, TREES, DEPTH = 128, 16, 4
LEVELS, BRANCHES, STEP = 3, 6, 3
#: Nodes and shingles of a region, and of a group of full sets, that one task compares at once.
CROWD, HEAVY = 2048, 4 << 20
#: Words whose hashes a worker remembers.
WORDS = 1 << 20

_DRAWN = np.random.default_rng(20)
_TIMES = _DRAWN.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _DRAWN.integers(0, 1 << 63, VALUES, dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes, hashes: dict[bytes, int], width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of the shingles of ``width`` words, lower-cased in A-Z; of fewer words, one of them all."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    h = np.zeros(n, np.uint64)
    for at in range(min(width, len(words))):
        h += each[at : at + n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each of ``VALUES`` hashes of the set, 32 bits each; a long set by parts."""
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 512):
        h = (shingles[at : at + 512, None] * _TIMES + _PLUS) >> np.uint64(32)
        np.minimum(out, h.min(0).astype(np.uint32), out=out)
    return out


def signed(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if it is empty), orders (the values, big-endian) and low (their low bytes) of every row."""

    def f(part: pa.RecordBatch, hashes: dict[bytes, int] = _Hashes()) -> dict:  # noqa: B006  one memory for all of a worker's slices
        n, digests, orders, low = [], [], [], []
        for text in C.utf8_list(part.column("text")):
            s = shingle_set(text, hashes, width)
            n.append(len(s))
            if len(s):
                values = signature(s)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                orders.append(values.astype(">u4").tobytes())
                low.append(values.astype(np.uint8).tobytes())
            else:
                for column in (digests, orders, low):
                    column.append(None)
        return {"doc_id": part.column("doc_id"), "n_shingles": n, "digest": digests, "orders": orders, "low": low}

    return C.map_text(docs, ["doc_id", "text"], "doc_id long, n_shingles long, digest binary, orders binary, low binary", f)


def _groups(batches: Iterator[pa.RecordBatch], close: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Calls ``close`` with the parts of each group of consecutive rows that agree on the first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cut = (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()
        for a, z in zip([0, *cut], [*cut, batch.num_rows]):
            if held and key[a] != held[0].column(0)[0].as_py():
                yield from close(held)
                held = []
            held.append(batch.slice(a, z - a))
    if held:
        yield from close(held)


def _scan(rows: DataFrame, crowd: int, heavy: int) -> DataFrame:
    """region, piece, crowded and digest of rows (order, key, digest, n), sorted by order and key, that agree on both with a neighbour.

    A region is streamed: of one that is within the bounds all rows have piece 0; the rows of a crowded one come out in pieces within the bounds.
    """
    ship(rows.sparkSession)
    dealt = rows.repartition("order", "key").sortWithinPartitions("order", "key", "digest").select("order", "key", "digest", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["region", "piece", "crowded", "digest"]
        at, held, size, weight, piece = None, [], 0, 0, 0

        def out(digests: list[pa.Array], piece: int, crowded: bool) -> pa.RecordBatch:
            d = pa.concat_arrays(digests)
            region = xxhash.xxh64_intdigest(at[1] + at[0].to_bytes(8, "big", signed=True)) - (1 << 63)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(d), region)), pa.array(np.full(len(d), piece, np.int32)), pa.array(np.full(len(d), crowded)), d], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            order, key, n = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(3).to_numpy()
            keys = np.array(key, object)
            cut = (np.flatnonzero((order[1:] != order[:-1]) | (keys[1:] != keys[:-1])) + 1).tolist()
            parts: list[pa.RecordBatch] = []
            for a, z in zip([0, *cut], [*cut, len(key)]):
                if (int(order[a]), key[a]) != at:
                    if size > 1 or piece:
                        parts.append(out(held, piece, piece > 0))
                    at, held, size, weight, piece = (int(order[a]), key[a]), [], 0, 0, 0
                digests = batch.column(2)
                while a < z:  # up to the bounds; one row fits always
                    room = min(z - a, crowd - size)
                    fits = int(np.searchsorted(np.cumsum(n[a : a + room]), heavy - weight, side="right")) if room else 0
                    if not fits and size:
                        parts.append(out(held, piece, True))
                        held, size, weight, piece = [], 0, 0, piece + 1
                        continue
                    fits = max(fits, 1)
                    held.append(digests.slice(a, fits))
                    size, weight, a = size + fits, weight + int(n[a : a + fits].sum()), a + fits
            if parts:
                yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        if size > 1 or piece:
            yield out(held, piece, piece > 0)

    return dealt.mapInArrow(run, "region long, piece int, crowded boolean, digest binary")


def _values(first: int, count: int) -> Column:
    return F.substring("orders", 4 * first + 1, 4 * count)


def regions(nodes: DataFrame, crowd: int = CROWD, heavy: int = HEAVY) -> DataFrame:
    """region and digest: nodes (digest, n, orders) that share a prefix of an order, as deep as its crowd asks for."""
    keys = F.posexplode(F.array(*(_values(DEPTH * t, DEPTH) for t in range(TREES)))).alias("order", "key")
    rows = nodes.select("digest", "n", keys).withColumn("order", F.col("order").cast("long"))
    found, at = [], DEPTH * TREES
    for level in range(LEVELS + 1):
        seen = C.written(_scan(rows, crowd, heavy))
        found.append(seen.where("not crowded").select("region", "digest"))
        rest = seen.where("crowded")
        if rest.isEmpty():
            break
        if level == LEVELS:
            last = rest.groupBy("region").agg(F.max("piece").alias("last"))
            met = rest.join(last, "region").withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
            found.append(met.select(F.xxhash64("region", F.least("piece", "other"), F.greatest("piece", "other")).alias("region"), "digest"))
            break
        more = F.posexplode(F.array(*(_values(at + STEP * b, STEP) for b in range(BRANCHES)))).alias("branch", "key")
        rows = rest.select("region", "digest").join(nodes, "digest").select("digest", "n", "region", more)
        rows = rows.select("digest", "n", F.xxhash64("region", "branch").alias("order"), "key")
        at += STEP * BRANCHES
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def _forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that join what chains of close pairs join; ``near`` tells which of the rest are close to one. Whoever is reached leaves the rest."""
    rest, out = np.arange(n), []
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            a = front.pop()
            hit = near(a, rest)
            if hit.any():
                found = rest[hit].tolist()
                out += [(a, b) for b in found]
                front += found
                rest = rest[~hit]
    return out


def _pairs(digests: list[bytes], links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([digests[i] for i, _ in links], pa.binary()), pa.array([digests[i] for _, i in links], pa.binary())], names=["a", "b"])


def least_agreement(similarity: tuple[int, int], values: int = VALUES) -> int:
    """Values on which two signatures agree at least: 5.5 standard deviations below what the similarity lets expect."""
    j = similarity[0] / similarity[1]
    return max(0, math.floor(values * j - 5.5 * math.sqrt(values * j * (1 - j))))


def candidates(found: DataFrame, nodes: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Links (a, b) of digests whose signatures agree often enough; of each region a spanning forest."""
    least = least_agreement(similarity)
    rows = found.join(nodes.select("digest", "low"), "digest").select("region", "digest", "low")

    def close(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = [x for p in parts for x in p.column(1).to_pylist()]
        if len(digests) > 1:
            low = np.frombuffer(b"".join(x for p in parts for x in p.column(2).to_pylist()), np.uint8).reshape(-1, VALUES)
            if links := _forest(len(digests), lambda a, rest: (low[rest] == low[a]).sum(1) >= least):
                yield _pairs(digests, links)

    return rows.repartition("region").sortWithinPartitions("region", "digest").mapInArrow(lambda x: _groups(x, close), "a binary, b binary").distinct()


def exact_links(sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY) -> list[tuple[int, int]]:
    """Links that join what chains of similar sets join; similar: ``similarity[1]`` intersections are ``similarity[0]`` unions or more."""
    part, whole = similarity
    sizes = np.array([len(s) for s in sets], np.int64)
    _, of = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts, mark = ends - sizes, np.zeros(len(of), bool)

    def near(a: int, rest: np.ndarray) -> np.ndarray:
        own = of[starts[a] : ends[a]]
        fit = np.flatnonzero(whole * np.minimum(sizes[rest], len(own)) >= part * np.maximum(sizes[rest], len(own)))
        out = np.zeros(len(rest), bool)
        if len(fit):
            mark[own] = True
            some = rest[fit]
            lengths = sizes[some]
            first = np.cumsum(lengths) - lengths
            both = np.add.reduceat(mark[of[np.repeat(starts[some] - first, lengths) + np.arange(lengths.sum())]].astype(np.int64), first)
            mark[own] = False
            out[fit] = whole * both >= part * (lengths + len(own) - both)
        return out

    return _forest(len(sets), near)


def confirmed(groups: DataFrame, sets: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Links (a, b) of digests that are similar by their full sets, within each group (columns grp and digest)."""
    rows = groups.join(sets, "digest").select("grp", "digest", "shingles")

    def close(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {d: s for p in parts for d, s in zip(p.column(1).to_pylist(), p.column(2).to_pylist())}
        digests = list(own)
        if len(digests) > 1 and (links := exact_links([np.frombuffer(own[d], np.uint64) for d in digests], similarity)):
            yield _pairs(digests, links)

    return rows.repartition("grp").sortWithinPartitions("grp", "digest").mapInArrow(lambda x: _groups(x, close), "a binary, b binary").distinct()


def full_sets(docs: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """digest and shingles (sorted hashes) of the wanted nodes (digest, least: an id of theirs)."""
    ship(docs.sparkSession)
    ids = wanted.select("least").distinct()
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for part in C.slices(batch):
                sets = [shingle_set(t, hashes, width).tobytes() for t in C.utf8_list(part.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["digest", "shingles"])

    # Ids may repeat or be null, so their rows are told apart by their sets.
    return rows.mapInArrow(run, "digest binary, shingles binary").join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY, crowd: int = CROWD, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = C.written(signed(docs, width))
    some = rows.where("digest is not null").groupBy("digest")
    nodes = C.written(some.agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("orders").alias("orders"), F.first("low").alias("low")))
    found = regions(nodes, crowd, heavy)
    members = C.written(connected(candidates(found, nodes, similarity)).withColumnRenamed("node", "digest"))
    sized = members.join(nodes.select("digest", "least", "n"), "digest")
    totals = sized.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    fits = (F.col("size") <= crowd) & (F.col("weight") <= heavy)
    small = members.join(totals.where(fits), "root").select(F.col("root").alias("grp"), "digest")
    large = found.join(members.join(totals.where(~fits), "root"), "digest").select(F.xxhash64("region", "root").cast("string").cast("binary").alias("grp"), "digest")
    sets = C.written(full_sets(docs, sized.select("digest", "least"), width))
    roots = C.written(connected(confirmed(small.unionAll(large).distinct(), sets, similarity)))
    named = nodes.select("digest", "least").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    ids = named.where("root is not null").groupBy("root").agg(F.min("least").alias("id"))
    of_node = named.join(ids, "root", "left").select("digest", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("id")).alias("id"))
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("id"))
    out = rows.select("doc_id", "n_shingles", "digest").join(of_node, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))


#: Pairs of documents by common shingles, then everything reachable.
ORACLE = """
with recursive docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents
), shingles as (
  select distinct r, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: md5(array_to_string(w[i:i + 4], ' ')))) as s from docs where len(w) > 0
), sizes as (
  select r, count(*) as n from shingles group by r
), pairs as (
  select x.r as a, y.r as b, count(*) as common from shingles x join shingles y on x.s = y.s and x.r < y.r group by all
), links as (
  select a, b from pairs join sizes x on x.r = a join sizes y on y.r = b where 100 * common >= 85 * (x.n + y.n - common)
), either as (
  select a, b from links union all select b, a from links
), reach(a, b) as (
  select r, r from sizes union select reach.a, either.b from reach join either on reach.b = either.a
), ids as (
  select a as r, min(doc_id) as component_id from reach join docs on docs.r = reach.b group by a
)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id, d.doc_id = coalesce(component_id, d.doc_id) as kept
from docs d left join sizes using (r) left join ids using (r)
"""
