"""Language identification by error-correcting output codes.

Each learned language has a binary codeword. For each bit a logistic classifier over hashed character n-grams (one to three characters,
square roots of relative frequencies) predicts which half of the languages a text is of; decoding sums the losses of each codeword's
bits, weighted by how well each bit was told apart in training, and takes the least. The gap to the next codeword flags ambiguity.

Learned from a bounded sample: of each language rows with low hashes of ids and texts, ``SAMPLE`` over the number of languages of them
expected (all if it has fewer; repeated rows count once), so that ``SAMPLE`` bounds the rows and no language is left out for its rank. Defined results: ``und`` with score 0 for
null texts and texts without a letter, and for all if nothing could be learned. Of equal losses the first language in order of name wins,
and the row is ambiguous. Repeated rows get equal results; an empty table gives an empty one. Texts of any length are read whole. Only
doc_id, text and lang are read, so other columns don't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BITS = 12
#: Documents that are learned from, shared equally among the languages.
SAMPLE = 4000
STEPS, RATE, L2, SEED = 150, 4.0, 1e-4, 42
AMBIGUOUS = 0.6
LETTER = regex.compile(r"\p{L}")


def counted(texts: list[str]) -> np.ndarray:
    """Feature rows of the texts: for each order's hashed n-grams square roots of their shares."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    shift = np.uint32(32 - BITS)
    for i, t in enumerate(texts):
        cp = np.frombuffer(t.lower().encode("utf-32-le"), np.uint32)
        if not len(cp):
            continue
        cp = np.where(cp < 65, np.uint32(32), cp)
        h1 = cp * np.uint32(0x9E3779B1)
        total = np.bincount(h1 >> shift, minlength=1 << BITS)
        if len(cp) > 1:
            h2 = h1[:-1] * np.uint32(31) + h1[1:] * np.uint32(0x85EBCA6B)
            total = total + np.bincount(h2 >> shift, minlength=1 << BITS)
            if len(cp) > 2:
                h3 = h2[:-1] * np.uint32(31) + h1[2:] * np.uint32(0xC2B2AE35)
                total = total + np.bincount(h3 >> shift, minlength=1 << BITS)
        out[i] = np.sqrt(total / total.sum())
    return out


def codewords(n: int) -> np.ndarray:
    """Codewords of n languages: every split into two parts up to 7 languages, else random splits at the largest least distance of 200 draws."""
    if n <= 1:
        return np.ones((n, 1), bool)
    if n <= 7:
        return np.array([[True, *(bool(b >> i & 1) for i in range(n - 1))] for b in range(2 ** (n - 1) - 1)], bool).T
    rng, best, most = np.random.default_rng(SEED), None, -1
    for _ in range(200):
        code = rng.random((n, 15 * math.ceil(math.log2(n)))) < 0.5
        code = code[:, code.any(0) & ~code.all(0)]
        sign = np.where(code, 1.0, -1.0)
        least = (code.shape[1] - np.max(sign @ sign.T - 1e9 * np.eye(n))) / 2  # the least distance of two codewords
        if least > most:
            best, most = code, least
    return best


class Model:
    def __init__(self, langs: list[str], code: np.ndarray, w: np.ndarray, b: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.w, self.b, self.trust = langs, code, w, b, trust

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and ambiguity of each text; the score is the share of the chosen codeword in exp(-loss)."""
        langs, scores, doubt = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        at = [i for i, t in enumerate(texts) if self.langs and LETTER.search(t)]
        for k in range(0, len(at), 64):
            own = at[k : k + 64]
            margin = counted([texts[i] for i in own]) @ self.w + self.b
            sign = np.where(self.code, 1.0, -1.0)
            loss = (np.logaddexp(0, -margin[:, None, :] * sign[None]) * self.trust).sum(2)
            p = np.exp(loss.min(1, keepdims=True) - loss)
            p /= p.sum(1, keepdims=True)
            best = loss.argmin(1)
            for i, j, row in zip(own, best, p):
                langs[i], scores[i], doubt[i] = self.langs[j], float(row[j]), bool(len(row) > 1 and np.sort(row)[-2] > (1 - AMBIGUOUS) * row[j])
        return langs, scores, doubt


def fit(x: np.ndarray, names: list[str]) -> Model:
    """A logistic classifier for each bit, by full-batch gradient steps with momentum, languages weighted equally."""
    langs = sorted(set(names))
    if not langs:
        return Model([], np.empty((0, 1), bool), np.empty((1 << BITS, 1)), np.zeros(1), np.ones(1))
    code = codewords(len(langs))
    y = np.array([langs.index(v) for v in names])
    share = 1 / np.bincount(y)[y] / len(langs)
    target = code[y].astype(np.float32)
    w, b = np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    if len(langs) > 1:
        for _ in range(STEPS):
            d = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - target) * share[:, None].astype(np.float32)
            mw = 0.9 * mw + x.T @ d + L2 * w
            mb = 0.9 * mb + d.sum(0)
            w -= RATE * mw
            b -= RATE * mb
    right = ((x @ w + b > 0) == target.astype(bool)) * share[:, None]
    trust = np.clip(2 * right.sum(0) - 1, 0.05, 1)
    return Model(langs, code, w.astype(np.float32), b, trust)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(C.crc_of_id() % 4 != 2)
    # A row's hash decides whether it is drawn: a language's share of hashes is its bound over its count. Texts don't move until then.
    keyed = known.withColumn("h", F.xxhash64("doc_id", "text", F.lit(5)))
    counts = keyed.groupBy("lang").count()
    share = counts.select("lang", (F.lit(sample) / F.lit(max(1, counts.count())) / F.col("count")).alias("share"))
    drawn = keyed.select("lang", "h").join(share, "lang").where((F.col("h") % 1_000_000 + 1_000_000) % 1_000_000 < F.col("share") * 1_000_000).select("h").distinct()
    some = keyed.join(F.broadcast(C.written(drawn)), "h").dropDuplicates(["lang", "h"])  # about ``sample`` hashes

    def f(part: pa.RecordBatch) -> dict:
        return {"h": part.column("h"), "lang": part.column("lang"), "x": [r.astype(np.float16).tobytes() for r in counted(C.text_list(part.column("text")))]}

    got = C.map_text(some, ["h", "text", "lang"], "h long, lang string, x binary", f).toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).astype(np.float32).reshape(-1, 1 << BITS)
    return fit(x, got.column("lang").to_pylist())


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row."""
    model = C.broadcast_value(docs.sparkSession, learn(docs, sample))

    def f(part: pa.RecordBatch) -> dict:
        lang, score, doubt = model.value.predict(C.text_list(part.column("text")))
        ids = part.column("doc_id")
        return {"doc_id": ids, "held_out": [C.crc_of(i) % 4 == 2 for i in ids.to_pylist()], "lang_pred": lang, "score": score, "ambiguous": doubt}

    return C.map_text(docs, ["doc_id", "text"], "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean", f)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(C.table(spark, sf_dir, "documents"))
