"""Language-model scores by deleted interpolation.

P(w | v) mixes the bigram's and the word's maximum-likelihood estimates and the uniform distribution. The weights depend on how often the
context v was seen (buckets of powers of two) and are learned by expectation-maximisation on held-out counts: each training token is
held out in turn, so its estimates are (c - 1) / (C - 1) and (u - 1) / (N - 1).

Counts cover every training token. Texts become blocks of word numbers in a table bucketed by block. Each block sends its distinct words
and bigrams, as sorted 64-bit hashes with the block's training counts, to hash buckets; a bucket sums them over all blocks and sends back
corpus counts in the same order. A key travels once per block, never once per token, and a hot word is one key of each block. Blocks then
join their answers by the table's bucketing, so texts are not shuffled.

A block sends to ``FAN`` buckets of words and of bigrams at most, so rows grow with the blocks, not with blocks times buckets. Where a
corpus needs more buckets than that, a bucket's requests are gathered into groups of bounded size; a group merges its keys and asks
``FAN`` smaller buckets in turn, and its answer is dealt back to the requests in it. Each turn divides a bucket's keys by ``FAN``.

Defined results: null and empty texts are one end token. A null id counts as the empty text for the remainder. Words that training never
had have c = 0; an unknown context gives its weight to the word and uniform estimates. Without training tokens, N = V = 0 and both scores
are 0. Repeated rows are scored alike, and counted as often as they stand there. An empty table gives an empty one. A text of any length
is one block's at most, whole. Only doc_id and text are read, so other columns don't clash.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from . import common as C

BLOCK_BYTES = 8 << 20  # text of a block
BUCKET_BYTES = 24 << 20  # keys of a bucket, and of a group
FAN = 512  # buckets that a block, or a group, sends words or bigrams to
DEEPEST = 6  # levels of buckets, more than the 32 bits of a range can be cut into
LEVELS = 24  # buckets of context counts: 0, 1, 2-3, 4-7, ...
STEPS = 40
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END, START = xxhash.xxh64_intdigest(b"\x00end"), xxhash.xxh64_intdigest(b"\x00start")
_MIX = np.uint64(0x9E3779B97F4A7C15)


# -- packing -------------------------------------------------------------------------------------------------------------------


def pack(x: np.ndarray, level: int = 1) -> bytes:
    """An integer array, its bytes by place, which sorted and small numbers make alike, compressed."""
    size = x.dtype.itemsize
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, size).T) if len(x) else np.empty(0, np.uint8)
    return bytes([size]) + zstandard.compress(planes.tobytes(), level)


def unpack(b: bytes) -> np.ndarray:
    size = b[0]
    planes = np.frombuffer(zstandard.decompress(b[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(f"<u{size}").ravel()


def small(n: np.ndarray) -> np.ndarray:
    """In the fewest bytes that hold the largest number."""
    top = int(n.max()) if len(n) else 0
    return n.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def bigram(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = (first ^ (second * _MIX)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h * _MIX


# -- blocks --------------------------------------------------------------------------------------------------------------------


class Block:
    """Word numbers of a block's documents, each with its end token; number 0 is the end."""

    def __init__(self, words: np.ndarray, ids: np.ndarray, sizes: np.ndarray, train: np.ndarray):
        self.words, self.ids, self.sizes, self.train = words, ids.astype(np.int64), sizes.astype(np.int64), train.astype(bool)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]) if len(sizes) else np.empty(0, np.int64)
        self.of_train = np.repeat(self.train, self.sizes)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.ids[self.of_train], minlength=len(self.words))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct bigram hashes, sorted, and each token's place among them."""
        before = np.empty(len(self.ids), np.uint64)
        before[1:] = self.words[self.ids[:-1]]
        before[self.start] = np.uint64(START)
        return np.unique(bigram(before, self.words[self.ids]), return_inverse=True)


def blocks_of(docs: DataFrame, block_bytes: int) -> DataFrame:
    """block, doc_id and sizes of the documents, whether they train, hashes of the block's words, and word numbers."""
    ship(docs.sparkSession)
    schema = "block long, doc_ids array<long>, sizes binary, train binary, words binary, ids binary"
    out = C.arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        index: defaultdict[bytes, int]

        def fresh() -> None:
            nonlocal index, doc_ids, ids, held
            index = defaultdict(None, {b"": 0})  # no word is empty: number 0 is the end
            index.default_factory = index.__len__
            doc_ids, ids, held = [], [], 0

        def close() -> pa.RecordBatch:
            words = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
            words[0] = END
            sizes = small(np.fromiter(map(len, ids), np.int64, len(ids)))
            train = np.array([C.crc_of(i) % 7 != 2 for i in doc_ids], np.uint8)
            row = {"block": [task << 24 | done], "doc_ids": [doc_ids], "sizes": [pack(sizes)], "train": [pack(train)], "words": [pack(words)], "ids": [pack(small(np.concatenate(ids)), 3)]}
            return C.as_batch(row, out)

        doc_ids, ids, held = [], [], 0
        fresh()
        for batch in batches:
            for part in C.slices(batch):
                for i, text in zip(part.column("doc_id").to_pylist(), C.utf8_list(part.column("text"))):
                    words = text.translate(LOWER).split()
                    own = np.zeros(len(words) + 1, np.int32)
                    own[:-1] = np.fromiter(map(index.__getitem__, words), np.int32, len(words))
                    doc_ids.append(i)
                    ids.append(own)
                    held += len(text) + 8
                    if held >= block_bytes:
                        yield close()
                        done += 1
                        fresh()
        if doc_ids:
            yield close()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def opened(row: dict) -> Block:
    return Block(unpack(row["words"]).view(np.uint64), unpack(row["ids"]), unpack(row["sizes"]), unpack(row["train"]))


def cut(keys: np.ndarray, buckets: int, low: int = 0, high: int = 1 << 32) -> np.ndarray:
    """Where each bucket's keys begin and end among sorted ones; buckets are equal ranges of the upper 32 bits within [low, high)."""
    edges = [low + (high - low) * i // buckets for i in range(buckets + 1)]
    return np.searchsorted(keys >> np.uint64(32), np.array(edges, np.uint64))


# -- counts --------------------------------------------------------------------------------------------------------------------


REQUEST = "bucket long, kind int, low long, high long, block long, keys binary, n binary"


def _parts(first: int, kind: int, low: int, high: int, buckets: int, block: int, keys: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
    """Requests to the buckets that [low, high) is cut into, numbered from ``first`` on; none where there are no keys."""
    ends = cut(keys, buckets, low, high)
    for k, (a, z) in enumerate(zip(ends, ends[1:])):
        if z > a:
            yield first + k, kind, low + (high - low) * k // buckets, low + (high - low) * (k + 1) // buckets, block, pack(keys[a:z]), pack(small(n[a:z]))


def requests(blocks: DataFrame, buckets: dict[str, int]) -> DataFrame:
    """bucket, kind (0 for words, 1 for bigrams), the range of its keys, block, keys and training counts; words have the first buckets."""
    out = C.arrow_schema(blocks.sparkSession, REQUEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = opened(row)
                by = np.argsort(b.words)
                pairs, at = b.pairs()
                for kind, first, keys, n in ((0, 0, b.words[by], b.word_counts()[by]), (1, buckets["w"], pairs, np.bincount(at[b.of_train], minlength=len(pairs)))):
                    for part in _parts(first, kind, 0, 1 << 32, buckets["p" if kind else "w"], row["block"], keys, n):
                        yield C.as_batch(dict(zip(out.names, ([x] for x in part))), out)

    return blocks.select("block", "sizes", "train", "words", "ids").mapInArrow(run, REQUEST)


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of some requests, sorted, with their sums, and each request's keys' places among them."""
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(n).astype(np.float64), len(distinct)).astype(np.uint64), at


def _opened(group: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    keys = [unpack(x) for x in group.column("keys").to_pylist()]
    return keys, [unpack(x).astype(np.uint64) for x in group.column("n").to_pylist()], np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))[:-1]


def answers(asked: DataFrame, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN, depth: int = 0) -> DataFrame:
    """block, bucket and corpus counts of the block's keys; and for each bucket of words, under block -1, its N and V (words 0, bigrams 1: ``kind``).

    ``asked`` is a table in the shared folder. Buckets whose requests have over ``bucket_bytes`` of packed keys go a level down.
    """
    spark = asked.sparkSession
    many = 0
    if depth < DEEPEST:
        sizes = asked.groupBy("bucket").agg(F.sum(F.octet_length("keys")).alias("bytes"), F.first("low").alias("l"), F.first("high").alias("h"))
        large = C.written(sizes.where(F.col("bytes") > bucket_bytes).where("h - l > 1").select("bucket", "bytes"))
        many = large.agg(F.count("*")).first()[0]

    def total(group: pa.Table) -> pa.Table:
        keys, n, cuts = _opened(group)
        _, sums, at = _summed(keys, n)
        blocks, kind = group.column("block").to_pylist(), group.column("kind")[0].as_py()
        packed = [pack(small(x)) for x in np.split(sums[at], cuts)]
        if kind == 0:
            blocks.append(-1)
            packed.append(pack(np.array([sums.sum(), (sums > 0).sum()], np.uint64)))
        return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([group.column("bucket")[0].as_py()] * len(blocks), pa.int64()), "kind": pa.array([kind] * len(blocks), pa.int32()), "n": pa.array(packed, pa.binary())})

    reply = "block long, bucket long, kind int, n binary"
    if not many:
        return asked.groupBy("bucket").applyInArrow(total, reply)
    direct = asked.join(large.select("bucket"), "bucket", "left_anti").groupBy("bucket").applyInArrow(total, reply)
    # Groups of a large bucket's requests, by hash, of about ``bucket_bytes`` each.
    grouped = asked.join(large, "bucket").withColumn("member", F.pmod(F.xxhash64("block", F.lit(depth)), F.ceil(2 * F.col("bytes") / bucket_bytes))).drop("bytes")
    down = C.arrow_schema(spark, REQUEST)

    def merge(group: pa.Table) -> pa.Table:
        keys, n, _ = _opened(group)
        distinct, sums, _ = _summed(keys, n)
        bucket, kind, low, high, member = (group.column(c)[0].as_py() for c in ("bucket", "kind", "low", "high", "member"))
        rows = list(_parts(bucket * fan, kind, low, high, min(fan, high - low), member, distinct, sums))
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows), down)], schema=down)

    sub = C.written(grouped.groupBy("bucket", "member").applyInArrow(merge, REQUEST), "none")
    back = C.written(answers(sub, bucket_bytes, fan, depth + 1), "none")
    # A merged group's counts, in the order of its keys, dealt to its requests.
    whole = back.where("block >= 0").groupBy(F.floor(F.col("bucket") / fan).alias("bucket"), F.col("block").alias("member")).agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("parts"))
    ready = grouped.groupBy("bucket", "member").agg(F.collect_list(F.struct("kind", "block", "keys")).alias("own")).join(whole, ["bucket", "member"])
    out = C.arrow_schema(spark, reply)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = [unpack(x["keys"]) for x in row["own"]]
                counts = np.concatenate([unpack(x["n"]).astype(np.uint64) for x in row["parts"]])
                _, at = np.unique(np.concatenate(keys), return_inverse=True)
                each = np.split(counts[at], np.cumsum([len(k) for k in keys])[:-1])
                yield C.as_batch({"block": [x["block"] for x in row["own"]], "bucket": [row["bucket"]] * len(keys), "kind": [x["kind"] for x in row["own"]], "n": [pack(small(x)) for x in each]}, out)

    dealt = ready.select("bucket", "own", "parts").mapInArrow(deal, reply)
    sums = back.where("block = -1").select("block", F.floor(F.col("bucket") / fan).alias("bucket"), "kind", "n")
    return direct.unionByName(dealt).unionByName(sums)


def answered(b: Block, got: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token the corpus counts u of its word, C of its context (the training texts for a text's start) and c of the bigram."""
    parts = sorted((x["bucket"], x["kind"], x["n"]) for x in got)
    by = np.argsort(b.words)
    u = np.empty(len(b.words), np.int64)
    u[by] = np.concatenate([unpack(n).astype(np.int64) for _, kind, n in parts if kind == 0])
    c = np.concatenate([unpack(n).astype(np.int64) for _, kind, n in parts if kind == 1])
    _, at = b.pairs()
    of = u[b.ids]
    context = np.empty(len(of), np.int64)
    context[1:] = of[:-1]
    context[b.start] = of[b.start + b.sizes - 1]  # a training text has one end token, and one start
    return of, context, c[at]


# -- weights -------------------------------------------------------------------------------------------------------------------


def level(context: np.ndarray) -> np.ndarray:
    """0 for no count, else 1 + floor(log2), at most LEVELS - 1."""
    return np.minimum(np.frexp(np.maximum(context, 0).astype(np.float64))[1], LEVELS - 1)


#: Held-out tokens are gathered by level and by steps of 1/4 in log2 of their two estimates (0: none).
GRID = 256


def _step(p: np.ndarray) -> np.ndarray:
    out = np.zeros(len(p), np.int64)
    ok = p > 0
    out[ok] = np.clip(GRID - 1 + np.round(4 * np.log2(p[ok])), 1, GRID - 1)
    return out


def held_out_cells(of: np.ndarray, context: np.ndarray, c: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and numbers of the tokens, each left out of its own counts."""
    p2 = np.where(context > 1, (c - 1) / np.maximum(context - 1, 1), 0.0)
    p1 = (of - 1) / max(total - 1, 1)
    cell = (level(context - 1) * GRID + _step(p2)) * GRID + _step(p1)
    return np.unique(cell, return_counts=True)


def expectation_maximisation(cells: np.ndarray, n: np.ndarray, uniform: float) -> np.ndarray:
    """Weights of bigram, word and uniform estimate for each level; levels without tokens take those of the level below."""
    value = np.concatenate([[0.0], 2.0 ** ((np.arange(1, GRID) - GRID + 1) / 4)])
    lv, p = cells // GRID**2, np.stack([value[cells // GRID % GRID], value[cells % GRID], np.full(len(cells), uniform)], 1)
    out = np.tile([0.0, 0.9, 0.1], (LEVELS, 1))
    for k in range(LEVELS):
        mine = lv == k
        if not mine.any():
            if k > 1:
                out[k] = out[k - 1]
            continue
        w = np.array([0.0, 0.5, 0.5]) if k == 0 else np.array([0.4, 0.4, 0.2])
        for _ in range(STEPS):
            share = p[mine] * w
            share /= share.sum(1, keepdims=True)
            w = (share * n[mine][:, None]).sum(0) + 1e-3
            if k == 0:
                w[0] = 0
            w /= w.sum()
        out[k] = w
    return out


# -- operator ------------------------------------------------------------------------------------------------------------------

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN) -> DataFrame:
    """Base and model log10 probability of every row's whole text."""
    spark = docs.sparkSession
    name = f"courtflux_blocks_{uuid.uuid4().hex}"
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = blocks_of(docs, block_bytes).write.format("parquet").option("compression", "none").option("path", C.shared_dir(spark))
    try:
        writer.bucketBy(least, "block").saveAsTable(name)
        return _scored(spark.table(name), least, bucket_bytes, fan)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the name alone; the files stay in the shared folder for the result


def _scored(made: DataFrame, least: int, bucket_bytes: int, fan: int) -> DataFrame:
    """The scores of a table of blocks."""
    spark = made.sparkSession
    size = made.agg(F.count("*"), F.sum(F.octet_length("ids")), F.sum(F.octet_length("words"))).first()
    if not size[0]:
        return spark.createDataFrame([], SCHEMA)
    # A token's number takes two bytes packed; as many bigram keys of eight bytes are the most there can be.
    buckets = {k: min(fan, max(least, ceil(n / bucket_bytes))) for k, n in (("w", size[2]), ("p", 4 * size[1]))}
    asked = requests(made, buckets)
    if 4 * size[1] / buckets["p"] > bucket_bytes or size[2] / buckets["w"] > bucket_bytes:
        replies = answers(C.written(asked, "none"), bucket_bytes, fan)
    else:
        replies = answers(asked, bucket_bytes, fan, depth=DEEPEST)
    replies = C.written(replies, "none")
    n = v = 0
    for x in replies.where("block = -1").select("n").collect():  # a row for each bucket of words
        a, b = unpack(x[0])
        n, v = n + int(a), v + int(b)
    got = replies.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "kind", "n")).alias("got"))  # bounded by the block
    joined = made.join(got, "block")
    uniform = 1 / (v + 1)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = opened(row)
                of, context, c = answered(b, row["got"])
                cell, k = held_out_cells(of[b.of_train], context[b.of_train], c[b.of_train], n)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(k)], names=["cell", "k"])

    cells = joined.select("block", "sizes", "train", "words", "ids", "got").mapInArrow(learn, "cell long, k long").groupBy("cell").agg(F.sum("k").alias("k")).toArrow()  # at most LEVELS * GRID**2 rows
    weights = expectation_maximisation(cells.column("cell").to_numpy(), cells.column("k").to_numpy(), uniform)
    out = C.arrow_schema(spark, SCHEMA)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = opened(row)
                of, context, c = answered(b, row["got"])
                if n:
                    base = np.log10((of + 1) / (n + v + 1))
                    w = weights[level(context)]
                    p = w[:, 0] * c / np.maximum(context, 1) + w[:, 1] * (of / n) + w[:, 2] * uniform
                    p = p / np.where(context == 0, w[:, 1] + w[:, 2], 1.0)
                    model = np.log10(p)
                else:
                    base = model = np.zeros(len(of))
                rows = len(b.sizes)
                yield C.as_batch({"doc_id": row["doc_ids"], "held_out": ~b.train, "n_tokens": b.sizes, "n_known": np.add.reduceat((of > 0).astype(np.int64), b.start), "train_tokens": [n] * rows, "base_score": np.add.reduceat(base, b.start), "score": np.add.reduceat(model, b.start)}, out)

    return joined.mapInArrow(score, SCHEMA)


def op7_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(C.table(spark, sf_dir, "documents"))
