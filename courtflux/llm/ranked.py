"""Ranked lexical search by hierarchical max trees: the best documents for each query, in exact integers, ties by id.

Queries are a stated set; they are taken in blocks of bounded terms. For a block, one pass over the documents leaves posting lists of its terms
by document range (at most ``RANGE`` documents that a task reads one after another), the documents' lengths, and each range's counts, from
which Spark adds up the corpus statistics. Ranges are a table in the shared folder; texts aren't shuffled.

A range's tree holds for each term, at each node, the largest share that the term can add to the score of a document below it; leaves are
documents, and nodes have ``FAN`` children. A query's bound of a node is the sum over its terms. The search opens the node with the highest
bound first, and ends when no bound reaches the query's tenth score; a node that equals it is opened, as a tie may have a smaller id.
First all ranges' roots are bounded and each query is searched in its best range: its tenth score there is what bounds have to reach everywhere
else. Then every range is searched; a task passes its tenth scores on from range to range and emits ``k`` rows a query at most.

Defined results: a null or empty text has no terms, and isn't counted among the documents; a query without terms, or whose terms no document
holds, has no rows. Null ids of documents come last among equal scores. Repeated rows of documents are ranked one by one; repeated queries
have their own ranks each. Empty tables give an empty one. Texts of any length are read whole. Only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import ship
from . import common as C

K, RANGE, FAN = 10, 1024, 16
#: Distinct terms and bytes of text of a block of queries; a larger query is a block of its own.
QUERY_TERMS, QUERY_BYTES = 4096, 8 << 20
#: Numbers of a range's leaves; queries of many terms get shorter ranges.
CELLS = 4 << 20

_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and bytes beyond ASCII; A-Z lower-cased."""
    return text.translate(_TERM).split()


class Queries(NamedTuple):
    """A block: query q has the terms term[start[q]:start[q + 1]] of the vocabulary."""

    ids: list
    vocabulary: dict[bytes, int]
    start: np.ndarray
    term: np.ndarray


def query_blocks(items: DataFrame, item_id: str, most_terms: int = QUERY_TERMS, most_bytes: int = QUERY_BYTES) -> Iterator[Queries]:
    """The queries, block by block; only one block is on the driver."""
    ids, known, start, term, size = [], {}, [0], [], 0

    def done() -> Queries:
        return Queries(ids, known, np.array(start), np.array(term, np.int64))

    for row in items.select(F.col(item_id).alias("id"), F.col("text").cast("binary").alias("text")).toLocalIterator():
        own = set(terms(bytes(row.text or b"")))
        if ids and (len(known) + len(own - known.keys()) > most_terms or size + len(row.text or b"") > most_bytes):
            yield done()
            ids, known, start, term, size = [], {}, [0], [], 0
        ids.append(row.id)
        term += [known.setdefault(t, len(known)) for t in sorted(own)]
        start.append(len(term))
        size += len(row.text or b"")
    if ids:
        yield done()


_RANGES = "range long, docs array<long>, n array<long>, term array<int>, held array<int>, doc array<int>, tf array<long>"


def ranges(docs: DataFrame, vocabulary: dict[bytes, int], size: int = RANGE) -> DataFrame:
    """Posting lists by document range: ids and lengths of its documents with terms; of each of its terms how many hold it; those and tf."""
    spark = docs.sparkSession
    ship(spark)
    schema, sent = C.arrow_schema(spark, _RANGES), C.broadcast_value(spark, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, part, number = sent.value.get, TaskContext.get().partitionId(), 0
        ids, n, own, doc, tf = [], [], [], [], []

        def close() -> pa.RecordBatch:
            t, d, f = np.array(own, np.int32), np.array(doc, np.int32), np.array(tf, np.int64)
            order = np.argsort(t, kind="stable")
            term, held = np.unique(t, return_counts=True)
            return C.as_batch({"range": [(part << 32) + number], "docs": [ids], "n": [n], "term": [term], "held": [held.astype(np.int32)], "doc": [d[order]], "tf": [f[order]]}, schema)

        for batch in batches:
            for some in C.slices(batch):
                for i, text in zip(some.column("doc_id").to_pylist(), C.utf8_list(some.column("text"))):
                    words = terms(text)
                    if not words:
                        continue
                    found = Counter(map(get, words))
                    found.pop(None, None)
                    own += found.keys()
                    tf += found.values()
                    doc += [len(ids)] * len(found)
                    ids.append(i)
                    n.append(len(words))
                    if len(ids) == size:
                        yield close()
                        number += 1
                        ids, n, own, doc, tf = [], [], [], [], []
        if ids:
            yield close()

    return docs.select("doc_id", "text").mapInArrow(run, _RANGES)


def weights(table: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """The terms' weights, the number of documents and of all their terms; sums of what each range has counted."""
    whole = table.agg(F.sum(F.size("docs")), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    count, total = int(whole[0] or 0), int(whole[1] or 0)
    df = np.zeros(terms, np.int64)
    held = table.select(F.explode(F.arrays_zip("term", "held")).alias("x")).groupBy("x.term").agg(F.sum("x.held").alias("df"))
    for r in held.toLocalIterator():  # a row a term of the block
        df[r.term] = r.df
    return np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(d) + 1))) for d in df], np.int64), count, total


class Range(NamedTuple):
    """A document range: ``row`` tells the row of each of the block's terms (-1: not held); ``levels`` its max tree, documents first, root last."""

    docs: list
    row: np.ndarray
    levels: list[np.ndarray]


def impacts(tf: np.ndarray, n: np.ndarray, count: int, total: int) -> np.ndarray:
    """What a term adds to a score, but for its weight."""
    if 90 * int(n.max(initial=0)) * count >= 1 << 63 or 10**9 * int(tf.max(initial=0)) >= 1 << 63:
        n, tf = n.astype(object), tf.astype(object)
    m = 10 + 90 * n * count // total
    return (10**9 * tf // (1000 * tf + 8 * m)).astype(np.int64)


def _open(batch: pa.RecordBatch, i: int, terms: int, count: int, total: int, roots_only: bool = False) -> Range:
    a = {name: batch.column(name)[i].values.to_numpy(zero_copy_only=False) for name in ("n", "term", "held", "doc", "tf")}
    row = np.full(terms, -1, np.int64)
    row[a["term"]] = np.arange(len(a["term"]))
    share = impacts(a["tf"], a["n"][a["doc"]], count, total)
    first = np.cumsum(a["held"]) - a["held"]
    if roots_only:
        root = np.maximum.reduceat(share, first) if len(first) else np.zeros(0, np.int64)
        return Range([], row, [root[:, None]])
    width = -(-len(a["n"]) // FAN) * FAN
    leaves = np.zeros((len(a["term"]), width), np.int64)
    leaves[np.repeat(np.arange(len(a["term"])), a["held"]), a["doc"]] = share
    levels = [leaves]
    while levels[-1].shape[1] > 1:
        last = levels[-1]
        if short := -last.shape[1] % FAN:
            last = np.pad(last, ((0, 0), (0, short)))
        levels.append(last.reshape(len(last), -1, FAN).max(2))
    return Range(batch.column("docs")[i].as_py(), row, levels)


def root_bounds(found: Range, queries: Queries, w: np.ndarray) -> np.ndarray:
    """Every query's bound of the whole range."""
    row = found.row[queries.term]
    share = np.where(row >= 0, found.levels[-1][row, 0], 0) * w[queries.term] if len(found.levels[-1]) else np.zeros(len(row), np.int64)
    return np.diff(np.concatenate([[0], np.cumsum(share)])[queries.start])


class Best:
    """The best ``k`` documents of a query so far; ``least`` is what a score has to reach."""

    def __init__(self, k: int, least: int = 1):
        self.k, self.least, self.heap = k, max(1, least), []

    def offer(self, scores: np.ndarray, docs: list) -> None:
        some = np.flatnonzero(scores >= self.least)
        if len(some) > self.k:  # ties included, no more than k of them can stay
            order = sorted(some.tolist(), key=lambda i: (-scores[i], docs[i] is None, docs[i] or 0))
            some = order[: self.k]
        for i in some:
            entry = (int(scores[i]), -math.inf if docs[i] is None else -docs[i], docs[i])
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry[:2] > self.heap[0][:2]:
                heapq.heapreplace(self.heap, entry)
        if len(self.heap) == self.k:
            self.least = max(self.least, self.heap[0][0])


def search(found: Range, own: np.ndarray, w: np.ndarray, bound: int, best: Best, seen: dict[str, int] | None = None) -> None:
    """Best-first branch and bound: offers ``best`` each document of the range that may be among them. ``own``: the query's terms."""
    row = found.row[own]
    own, row = own[row >= 0], row[row >= 0]
    weight = w[own]
    top = len(found.levels) - 1
    nodes = [(-bound, top, 0)]
    while nodes and -nodes[0][0] >= best.least:
        _, level, at = heapq.heappop(nodes)
        if seen is not None:
            seen["opened"] = seen.get("opened", 0) + 1
        a = at * FAN
        below = found.levels[level - 1] if level else found.levels[0]
        z = min(a + FAN, below.shape[1])
        sums = weight @ below[row, a:z]
        if level <= 1:
            best.offer(sums[: max(0, len(found.docs) - a)], found.docs[a:z])
        else:
            for i in np.flatnonzero(sums >= best.least).tolist():
                heapq.heappush(nodes, (-int(sums[i]), level - 1, a + i))


def _best_ranges(table: DataFrame, queries: Queries, w: np.ndarray, count: int, total: int) -> dict[int, list[int]]:
    """The queries whose highest root bound a range has, by range; a row a query reaches the driver."""
    sent = C.broadcast_value(table.sparkSession, (queries, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, w = sent.value
        high, where = np.zeros(len(queries.ids), np.int64), np.zeros(len(queries.ids), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                bound = root_bounds(_open(batch, i, len(w), count, total, roots_only=True), queries, w)
                more = bound > high
                high[more], where[more] = bound[more], batch.column("range")[i].as_py()
        some = np.flatnonzero(high)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(high[some]), pa.array(where[some])], names=["query", "bound", "range"])

    out: dict[int, list[int]] = {}
    for r in table.mapInArrow(run, "query long, bound long, range long").groupBy("query").agg(F.max_by("range", F.struct("bound", "range")).alias("range")).collect():
        out.setdefault(r.range, []).append(r.query)
    return out


def _searched(table: DataFrame, queries: Queries, w: np.ndarray, count: int, total: int, k: int, least: np.ndarray, only: dict[int, list[int]] | None = None) -> DataFrame:
    """query, doc_id and score of each task's best documents; of the ranges in ``only``, for their queries alone, if it is given."""
    sent = C.broadcast_value(table.sparkSession, (queries, w, least, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, w, least, only = sent.value
        best: dict[int, Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("range")[i].as_py()
                if only is not None and number not in only:
                    continue
                bounds = root_bounds(_open(batch, i, len(w), count, total, roots_only=True), queries, w)
                wanted = [q for q in (range(len(bounds)) if only is None else only[number]) if bounds[q] >= (best[q].least if q in best else max(1, least[q]))]
                if not wanted:
                    continue
                found = _open(batch, i, len(w), count, total)
                for q in wanted:
                    if q not in best:
                        best[q] = Best(k, int(least[q]))
                    search(found, queries.term[queries.start[q] : queries.start[q + 1]], w, int(bounds[q]), best[q])
        rows = [(q, d, s) for q, b in best.items() for s, _, d in b.heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["query", "doc_id", "score"])

    return table.mapInArrow(run, "query long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, item_id: str = "item_id", k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"{item_id} {kind}, rank int, doc_id long, score long")
    for queries in query_blocks(items, item_id):
        size = max(FAN, min(RANGE, CELLS // max(1, len(queries.vocabulary))))
        table = C.written(ranges(docs, queries.vocabulary, size))
        w, count, total = weights(table, len(queries.vocabulary))
        if not total:
            continue
        least = np.ones(len(queries.ids), np.int64)
        first = _best_ranges(table, queries, w, count, total)
        seeds = _searched(table.where(F.col("range").isin(list(first))), queries, w, count, total, k, least, first)
        for r in seeds.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).collect():  # a row a query
            least[r.query] = r.least
        rows = _searched(table, queries, w, count, total, k, least)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = spark.createDataFrame(list(enumerate(queries.ids)), f"query long, {item_id} {kind}")  # a block's
        out = out.unionAll(top.join(F.broadcast(named), "query").select(item_id, "rank", "doc_id", "score"))
    return out


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


_TERMS_SQL = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLE = f"""
with words as materialized (
  select row_number() over () as r, doc_id, {_TERMS_SQL} as w from documents
), items as (
  select row_number() over () as q, item_id, list_distinct({_TERMS_SQL}) as w from benchmark
), wanted as materialized (
  select q, item_id, unnest(w) as term from items
), tf as materialized (
  select r, term, count(*) as tf from (select r, unnest(w) as term from words) where term in (select term from wanted) group by all
), whole as materialized (
  select count(*)::bigint as n, sum(len(w))::bigint as l from words where len(w) > 0
), weight as (
  select term, floor(1000 * ln((2 * n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, whole group by term, n
), share as (
  select tf.r, tf.term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(words.w) * n) // l)) as x from tf join words using (r), whole
), scores as (
  select q, item_id, r, sum(weight.w * x)::bigint as score from wanted join share using (term) join weight using (term) group by all
)
select item_id, (row_number() over (partition by q order by score desc, doc_id))::int as rank, doc_id, score
from scores join words using (r) where score > 0 qualify rank <= {K}
"""
