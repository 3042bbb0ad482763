"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct lower-cased words and their five-byte prefixes, hashed into ``2**BITS`` buckets. The machine
adds a weight for each term and the products of latent vectors for each pair of terms, so that pairs such as an insult beside a
group's name count beyond their sum. Terms take part that are linked to the label alone (likelihood ratio of ``MIN_G2`` or more) or in a
pair: among the rows that hold one of the pair, the other is linked to the label (``PAIR_G2``, as millions of pairs are tried). Pairs are
looked for among the linked terms and those most frequent in toxic rows, ``CANDIDATES`` in all, and only if ``MIN_PAIRS`` rows hold
both. Other terms keep weight 0. A row that is repeated weighs in a step as often as it is there, 64 times at most.

Defined results: a null or empty text has no terms and gets the score of the intercept alone. A tie of 0.5 predicts 1. Repeated rows
get equal scores. Without any labelled row of both kinds the score is the smoothed share of toxic labels. Duplicate labels of one id
count as toxic if any is. A null doc_id matches no label. Of rows that share an id one text is learned from (that of the smallest terms).
An empty table gives no scores, an empty label table the score 0.25 for all. Texts of any length are read whole. Only doc_id and text
(and from labels doc_id and toxic) are read, so other columns don't clash; ``drop_toxic`` passes them on.
"""

from __future__ import annotations

import math
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BITS = 20
#: At most so many labelled rows of each kind are learned from; those with the smallest hashes of their ids.
MAX_TOXIC, MAX_CLEAN = 4_000, 8_000
MIN_DF, MIN_G2, PAIR_G2 = 3, 12.0, 60.0
CANDIDATES, MIN_PAIRS = 2048, 20
#: Passes over the rows; so many that there are LEAST_STEPS at least.
FACTORS, EPOCHS, LEAST_STEPS, RATE, L2, SEED = 8, 12, 2000, 0.1, 1e-3, 42

#: Maps bytes that are no part of an ASCII word to spaces; bytes of other letters stay.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_PREFIX = itemgetter(slice(0, 5))


def terms(text: str) -> np.ndarray:
    """Sorted distinct buckets of a text's terms."""
    words = set(text.lower().encode("utf-8", "surrogatepass").translate(WORD_BYTES).split())
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    whole = np.fromiter(map(crc32, words), np.uint32, n)
    stems = set(map(_PREFIX, words))
    start = np.fromiter(map(crc32, stems), np.uint32, len(stems)) ^ np.uint32(0x9E3779B9)
    return np.unique(np.concatenate([whole, start]) >> np.uint32(32 - BITS)).astype(np.int64)


def g2(pos: np.ndarray, neg: np.ndarray, n1: np.ndarray | int, n0: np.ndarray | int) -> np.ndarray:
    """Likelihood ratio of presence against label: ``pos`` of n1 toxic and ``neg`` of n0 other rows hold a term."""
    n = np.maximum(n1 + n0, 1)
    out = np.zeros(np.broadcast(pos, neg, n1, n0).shape)
    for seen, row, column in ((pos, pos + neg, n1), (n1 - pos, n - pos - neg, n1), (neg, pos + neg, n0), (n0 - neg, n - pos - neg, n0)):
        e = row * column / n
        ok = (seen > 0) & (e > 0)
        out += np.where(ok, 2 * seen * np.log(np.where(ok, seen, 1) / np.where(ok, e, 1)), 0)
    return out


def link(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets whose presence depends on the label, alone or among the rows that hold another bucket."""
    size = 1 << BITS
    empty = [np.empty(0, np.int64)]
    pos = np.bincount(np.concatenate([r for r, t in zip(rows, y) if t] or empty), minlength=size)
    neg = np.bincount(np.concatenate([r for r, t in zip(rows, y) if not t] or empty), minlength=size)
    n1 = int(y.sum())
    alone = np.flatnonzero((g2(pos, neg, n1, len(y) - n1) >= MIN_G2) & (pos + neg >= MIN_DF))
    order = np.lexsort((np.arange(size), -pos))[: CANDIDATES + len(alone)]
    frequent = order[(pos[order] >= MIN_PAIRS) & ~np.isin(order, alone)]
    by_link = alone[np.argsort(-pos[alone], kind="stable")][: CANDIDATES // 2]
    terms = np.concatenate([by_link, frequent])[:CANDIDATES]
    at = np.full(size, -1)
    at[terms] = np.arange(len(terms))
    both = []  # by label, in how many rows each pair of the candidates stands
    for label in (1, 0):
        held = [k[k >= 0] for k in (at[r] for r, t in zip(rows, y) if t == label)]
        count = np.zeros((len(terms), len(terms)), np.float32)
        for i in range(0, len(held), 1024):
            x = np.zeros((len(held[i : i + 1024]), len(terms)), np.float32)
            for row, k in zip(x, held[i : i + 1024]):
                row[k] = 1
            count += x.T @ x
        both.append(count)
    found = np.zeros(len(terms), bool)
    for i in range(0, len(terms), 256):
        c1, c0 = both[0][i : i + 256], both[1][i : i + 256]
        own = np.arange(i, i + len(c1))
        hit = (g2(c1, c0, both[0][own, own][:, None], both[1][own, own][:, None]) >= PAIR_G2) & (c1 + c0 >= MIN_PAIRS) & ~np.isin(terms, alone)
        found |= hit.any(0)
        found[own] |= hit.any(1)
    return np.union1d(alone, terms[found])


class Machine:
    """w0 + sum w_i + sum over pairs <v_i, v_j>, of the terms present; through the logistic function."""

    def __init__(self, active: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.at = np.zeros(1 << BITS, np.int32)
        self.at[active] = np.arange(1, len(active) + 1)
        self.active, self.w0, self.w, self.v = active, w0, w, v

    def __reduce__(self):
        return Machine, (self.active, self.w0, self.w, self.v)

    def raw(self, buckets: np.ndarray) -> float:
        k = self.at[buckets]
        k = k[k > 0] - 1
        if not len(k):
            return self.w0
        v = self.v[k]
        return self.w0 + self.w[k].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.raw(terms(text))))))


def fit(rows: list[np.ndarray], y: np.ndarray) -> Machine:
    """Adagrad on the logistic loss; rows in the given order, seeded shuffles."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    prior = math.log((n1 + 0.5) / (n0 + 1.5))
    if not n1 or not n0:
        return Machine(np.empty(0, np.int64), prior, np.empty(0), np.empty((0, FACTORS)))
    active = link(rows, y)
    at = np.full(1 << BITS, -1)
    at[active] = np.arange(len(active))
    own = [k[k >= 0] for k in (at[r] for r in rows)]
    rng = np.random.default_rng(SEED)
    w0, w, v = prior, np.zeros(len(active)), rng.normal(0, 0.01, (len(active), FACTORS))
    g0, gw, gv = 1e-8, np.full(len(active), 1e-8), np.full((len(active), FACTORS), 1e-8)
    # Rows with the same terms and label move together.
    groups: dict[tuple, int] = {}
    for k, t in zip(own, y):
        key = (k.tobytes(), int(t))
        groups[key] = groups.get(key, 0) + 1
    items = [(np.frombuffer(k, at.dtype), t, c) for (k, t), c in groups.items()]
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // len(items)))):
        for i in rng.permutation(len(items)):
            k, t, c = items[i]
            vk = v[k]
            total = vk.sum(0)
            z = w0 + w[k].sum() + 0.5 * (total**2 - (vk**2).sum(0)).sum()
            d = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - t) * min(c, 64)
            g0 += d * d
            w0 -= RATE * d / math.sqrt(g0)
            if len(k):
                d /= math.sqrt(len(k))
                gr = d + L2 * w[k]
                gw[k] += gr * gr
                w[k] -= RATE * gr / np.sqrt(gw[k])
                gr = d * (total - vk) + L2 * vk
                gv[k] += gr * gr
                v[k] -= RATE * gr / np.sqrt(gv[k])
    return Machine(active, w0, w, v)


def learn(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Machine:
    """A machine from at most ``max_toxic + max_clean`` labelled documents outside the held-out fifth.

    Which rows: those whose ids hash lowest, taken from the narrow label table before any text is read.
    """
    spark = docs.sparkSession
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(C.crc_of_id() % 5 != 0)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marked.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(marked.where("toxic = 0").orderBy(*order).limit(max_clean))
    ids = {r[0]: r[1] for r in chosen.collect()}
    if not ids:
        return fit([], np.empty(0, int))
    # At most max_toxic + max_clean pairs of numbers are broadcast, so that only chosen texts leave the scan.
    picked = spark.createDataFrame(list(ids.items()), "doc_id long, toxic int").select("doc_id")
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id", "left_semi")

    def gather(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column("doc_id"), "terms": [terms(t).astype(np.int32).tobytes() for t in C.text_list(part.column("text"))]}

    found = C.map_text(sample, ["doc_id", "text"], "doc_id long, terms binary", gather).groupBy("doc_id").agg(F.min("terms").alias("terms")).toArrow().sort_by("doc_id")  # a row for each chosen id
    rows = [np.frombuffer(x, np.int32).astype(np.int64) for x in found.column("terms").to_pylist()]
    return fit(rows, np.array([ids[i] for i in found.column("doc_id").to_pylist()], int))


def toxicity(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    machine = C.broadcast_value(docs.sparkSession, learn(docs, labels, **bounds))

    def score(part: pa.RecordBatch) -> dict:
        s = [machine.value.score(t) for t in C.text_list(part.column("text"))]
        ids = part.column("doc_id")
        return {"doc_id": ids, "held_out": [C.crc_of(i) % 5 == 0 for i in ids.to_pylist()], "score": s, "predicted": [int(x >= 0.5) for x in s]}

    return C.map_text(docs, ["doc_id", "text"], "doc_id long, held_out boolean, score double, predicted int", score)


def drop_toxic(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    machine = C.broadcast_value(docs.sparkSession, learn(docs, labels, **bounds))
    return C.keep_rows(docs, lambda part: np.array([machine.value.score(t) < 0.5 for t in C.text_list(part.column("text"))], bool))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
