"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, verified Hamming distances, components.

A fingerprint has 64 bits; two within ``distance`` bits differ in at most that many of ``BLOCKS`` blocks, so they agree on all of some
``BLOCKS - distance`` blocks. Every choice of so many blocks gives a key, and close pairs meet under at least one key. Only distinct
fingerprints are keyed; equal ones are one node. Under a key, links are found by a search that leaves each linked fingerprint once, so
that a bucket of n emits under n links and never all pairs: links inside a component that the bucket already joined add nothing. A key
that over ``HOT`` fingerprints share is keyed once more, by the pigeonhole principle on the bits that it leaves open; such buckets agree on
48 bits, so they hold 65,536 different fingerprints at most, whatever the corpus is.

Defined results: a text without words has fingerprint 0 and links like any other; a text of fewer words than a shingle is one shingle.
Null texts count as empty. Null ids take part and are never a component's id unless all ids are null. Repeated rows stay rows. An empty
table gives an empty one. Texts of any length are read whole. ``near_duplicates`` reads doc_id and text only; ``keep_one`` passes all
columns on and names its own so that they don't clash with any of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..runtime import ship
from . import common as C
from .components import connected

BLOCKS, DISTANCE, WIDTH = 8, 4, 4
#: Fingerprints of one key that are linked at once; more are keyed anew.
HOT = 8192
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``width`` words, lower-cased in A-Z and joined by spaces."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    view = memoryview(joined)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(view[a:b], 42) for a, b in zip(starts[:n].tolist(), (ends[len(words) - n :] - 1).tolist())), np.uint64, n)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    h = shingle_hashes(text, width)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # a long text by parts
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def block_masks(blocks: int, distance: int) -> list[int]:
    """The bits of every choice of ``blocks - distance`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(parts[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]


def links_within(fps: np.ndarray, distance: int, wave: int = 64) -> list[tuple[int, int]]:
    """Links that join all of a bucket's fingerprints which a chain of close pairs joins; at most one for each fingerprint.

    From one fingerprint the search goes on through all it reaches; whoever is reached leaves the rest, so a dense group of n costs
    about n comparisons for each of its few centres instead of n * n.
    """
    rest, out = fps, []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            now, front = front[:wave], front[wave:]
            near = np.bitwise_count(now[:, None] ^ rest[None, :]) <= distance
            hit = near.any(0)
            if hit.any():
                by = near.argmax(0)[hit]
                found = rest[hit]
                out += zip(now[by].tolist(), found.tolist())
                front, rest = np.concatenate([front, found]), rest[~hit]
    return out


def inner_masks(mask: int, distance: int) -> list[int]:
    """``mask`` with the bits of every choice of all but ``distance`` of the 8 nearly equal parts of the bits that it leaves open."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * i // 8 for i in range(9)]
    parts = [sum(1 << i for i in free[a:z]) for a, z in zip(cuts, cuts[1:])]
    return [mask | sum(chosen) for chosen in combinations(parts, 8 - distance)]


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _linked(keyed: DataFrame, distance: int, hot: int | None) -> DataFrame:
    """Links (a, b) of rows (mask, key, fp) within each (mask, key); the fingerprints of a key with over ``hot`` come out as (mask, fp), unlinked."""
    dealt = keyed.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(pairs: np.ndarray, mask: int | None = None) -> pa.RecordBatch:
            masks = pa.nulls(len(pairs), pa.int32()) if mask is None else pa.array(np.full(len(pairs), mask, np.int32))
            return pa.RecordBatch.from_arrays([masks, pa.array(pairs.min(1)), pa.array(pairs.max(1))], names=["mask", "a", "b"])

        def alone(fps: np.ndarray, mask: int) -> pa.RecordBatch:
            return emit(np.stack([fps, fps], 1), mask)

        def joined(fps: np.ndarray) -> list[tuple[int, int]]:
            return links_within(fps.view(np.uint64), distance)

        open_key, held, size, spilt = None, [], 0, False

        def close() -> Iterator[pa.RecordBatch]:
            if held and (found := joined(np.concatenate(held))):
                yield emit(np.array(found, np.uint64).view(np.int64))

        for batch in batches:
            if not batch.num_rows:
                continue
            mask, key, fp = (batch.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            found: list[tuple[int, int]] = []
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(fp)]):
                if (mask[a], key[a]) != open_key:
                    if held and size > 1:
                        found += joined(np.concatenate(held))
                    open_key, held, size, spilt = (mask[a], key[a]), [], 0, False
                size += z - a
                if hot is not None and size > hot:
                    for part in held:
                        yield alone(part, int(mask[a]))
                    held, spilt = [], True
                if spilt:
                    yield alone(fp[a:z], int(mask[a]))
                else:
                    held.append(fp[a:z])
            if found:
                yield emit(np.array(found, np.uint64).view(np.int64))
        if size > 1:
            yield from close()

    return dealt.mapInArrow(link, "mask int, a long, b long")


def close_links(fps: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, long) that have the same components as all close pairs."""
    ship(fps.sparkSession)
    masks = block_masks(blocks, distance)
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for i, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("k.mask", "k.key", "fp")
    first = C.written(_linked(keyed, distance, hot))
    links = first.where("mask is null").select("a", "b")
    if not first.where("mask is not null").isEmpty():
        # Keys of a hot bucket: its own bits and those of each choice of the others, told apart by (outer, inner) number.
        inner = F.array(*(F.array(*(F.lit(_signed(x)).cast("long") for x in inner_masks(m, distance))) for m in masks))
        crowd = first.where("mask is not null").select("mask", F.col("a").alias("fp"), F.posexplode(F.get(inner, F.col("mask"))).alias("k", "bits"))
        again = crowd.select((F.col("mask") * 1000 + F.col("k")).alias("mask"), F.col("fp").bitwiseAND(F.col("bits")).alias("key"), "fp")
        links = links.unionAll(_linked(again, distance, None).select("a", "b"))
    return links.distinct()


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row."""

    def f(part: pa.RecordBatch) -> dict:
        fps = [fingerprint(t, width) for t in C.utf8_list(part.column("text"))]
        return {"doc_id": part.column("doc_id"), "fp": pa.array(np.array(fps, np.uint64).view(np.int64))}

    return C.map_text(docs, ["doc_id", "text"], "doc_id long, fp long", f)


def _groups(rows: DataFrame, blocks: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """Distinct fingerprints with their smallest ids, and the roots of those that have links."""
    groups = C.written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return groups, connected(close_links(groups.select("fp"), blocks, distance))


def near_duplicates(docs: DataFrame, width: int = WIDTH, blocks: int = BLOCKS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = C.written(fingerprints(docs, width))
    groups, roots = _groups(rows, blocks, distance)
    named = groups.join(roots, groups.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = C.written(named.join(ids, "root").select("fp", "component_id"))
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH, blocks: int = BLOCKS, distance: int = DISTANCE) -> DataFrame:
    """One row of each group of near-duplicates: of those with the smallest id, one; a group without ids keeps one row too."""
    groups, roots = _groups(C.written(fingerprints(docs, width)), blocks, distance)
    named = groups.join(roots, groups.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    chosen = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("x"))
    no_id = F.lit(-(1 << 63))
    names = set(docs.columns)
    own_id, own_fp = (next(x for x in (f"__{n}{'_' * i}" for i in range(len(names) + 1)) if x not in names) for n in ("id", "fp"))
    kept = C.written(chosen.select(F.coalesce("x.least", no_id).alias(own_id), F.col("x.fp").alias(own_fp)))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch):
                fps = np.array([fingerprint(t, width) for t in C.utf8_list(part.column("text"))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps)], names=[*part.schema.names, own_fp])

    schema = StructType([*docs.schema.fields, StructField(own_fp, LongType())])
    tagged = docs.mapInArrow(tag, schema).withColumn(own_id, F.coalesce("doc_id", no_id))
    return tagged.join(kept, [own_id, own_fp], "left_semi").dropDuplicates([own_id, own_fp]).select(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))
