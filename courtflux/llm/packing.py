"""Packing along a space-filling curve.

A document's distinct words are hashed and projected to ``DIMS`` dimensions, each of about unit spread whatever the length; the point's
Hilbert key orders documents so that neighbours on the curve share words. One pass over the texts gives keys and token ids, as a table.
Documents are dealt by ranges of the curve and sorted by (key, doc_id), and their ids laid end to end: a document's place is its range's
base plus the tokens before it there. Sequences are cut every ``LENGTH`` tokens of the one stream, so only the very last is ever padded.

Tokenization is by the vocabulary's pre-tokens. Those of texts of simple characters (ASCII, most European letters, punctuation) are found by
array operations on a slice's bytes, those of other texts by a pattern, where words with other characters go to the tokenizer whole, as it
never joins text across ASCII white space. Each distinct one's ids are found once and kept (tests compare with whole texts).

Defined results: null and empty texts are the end id alone. Equal keys are ordered by id (nulls first), then by the token ids. Repeated
rows are packed as often as they stand there. An empty table gives no pieces. A text of any length is tokenized whole, and cut where
sequences end. Only doc_id and text are read, so other columns don't clash.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import chain
from unicodedata import category, normalize
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from . import common as C

LENGTH, END = 2048, 1
DIMS, BITS = 4, 12
#: One in so many documents is looked at to part the curve into even ranges.
SAMPLED = 16
#: Input of a range of the curve, where the session's number of partitions would give more.
RANGE_BYTES = 256 << 20
NO_ID = -(1 << 63)
#: Pre-tokens whose ids a worker keeps; the store is emptied beyond.
KEPT_WORDS = 1_200_000
#: Slots of the table that finds short pre-tokens, at first.
TABLE_BITS = 21


# -- order ---------------------------------------------------------------------------------------------------------------------


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys on the Hilbert curve of points (a row each) with coordinates below ``2**bits``."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    d = len(x)
    for b in range(bits - 1, 0, -1):  # undo the turns of each level
        q, p = 1 << b, (1 << b) - 1
        for i in range(d):
            hit = (x[i] & q) != 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            x[i] = x[i] ^ t
    for i in range(1, d):  # Gray code
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = np.where((x[d - 1] & (1 << b)) != 0, t ^ ((1 << b) - 1), t)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | ((x[i] ^ t) >> b & 1)
    return key


def projected(document: np.ndarray, hashes: np.ndarray, documents: int) -> np.ndarray:
    """Points of the documents: their distinct pre-tokens' hashes (each with its document's number), byte by byte summed and scaled to [0, 2**BITS)."""
    n = np.bincount(document, minlength=documents)
    each = hashes.view(np.uint8).reshape(-1, DIMS)
    total = np.stack([np.bincount(document, each[:, i], documents) for i in range(DIMS)], 1)
    out = (total - 127.5 * n[:, None]) / (73.9 * np.sqrt(np.maximum(n, 1)))[:, None]
    share = 1 / (1 + np.exp(-1.702 * np.clip(out, -20, 20)))
    return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def bounds(docs: DataFrame, partitions: int, tokenizer: str | None) -> list[tuple[int, int]]:
    """(key, doc_id) pairs that part the documents about evenly, from those that ``SAMPLED`` of all ids' hashes pick; they only balance the load."""

    def key(part: pa.RecordBatch) -> dict:
        keys, _ = words_of(tokenizer).encode(C.text_list(part.column("text")))
        return {"key": keys, "doc_id": part.column("doc_id").fill_null(NO_ID)}

    some = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(SAMPLED)) == 0)
    keys = C.map_text(some, ["doc_id", "text"], "key long, doc_id long", key)
    most = 64 * partitions  # those of lowest hashes; a bound on what reaches the driver
    got = sorted((r[0], r[1]) for r in keys.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(most).collect())
    return [got[len(got) * i // partitions] for i in range(1, partitions)] if got else []


# -- tokens --------------------------------------------------------------------------------------------------------------------




def _simple(c: str) -> bool:
    """Characters beyond ASCII that the normalizer only lowers: letters, and punctuation."""
    if normalize("NFC", c) != c or c == "\u03a3":  # a capital sigma's lower case depends on its place
        return False
    return category(c)[0] == "P" or category(c)[0] == "L" and len(c.lower()) == 1 and category(c.lower())[0] == "L" and normalize("NFC", c.lower()) == c.lower()


#: Latin, Greek, Cyrillic and general punctuation, as a class of characters that need no care.
SIMPLE = "\x00-\x7f" + "".join(filter(_simple, map(chr, [*range(0x80, 0x530), *range(0x2010, 0x2028)])))
_SPACE, _TAIL = " \\t\\n\\r\\f\\v", "'s|'t|'re|'ve|'m|'ll|'d"
_LETTERS = "".join(c for c in SIMPLE[3:] if c.isalpha())
#: The vocabulary's pre-tokens in text that isn't simple, where a word with other characters stays whole.
OTHER_TOKENS = re.compile(f"(?:(?=[{SIMPLE}])[^{_SPACE}])*+[^{SIMPLE}{_SPACE}][^{_SPACE}]*|[A-Za-z{_LETTERS}]+|(?ai:{_TAIL})|[0-9]|[^{_SPACE}A-Za-z0-9{_LETTERS}]+")
OTHER = re.compile(f"[^{SIMPLE}]")


# Kinds of bytes in lower-cased simple text: white space, letters, digits (each a pre-token), punctuation.
SPACE, LETTER, DIGIT, MARK = range(4)
_KIND = np.full(256, MARK, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[97:123] = LETTER
_KIND[128:] = LETTER
_KIND[48:58] = DIGIT
_MARKS = [c.encode() for c in SIMPLE[3:] if not c.isalpha()]
_MARKS_2 = np.array([m[1] for m in _MARKS if len(m) == 2 and m[0] == 0xC2], np.uint8)  # others are E2 80 .., and no letter begins so


def bounds_of_tokens(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokens of lower-cased simple text (UTF-8, white space at both ends) begin and end."""
    kind = _KIND[text]
    if text.max() >= 0xC2:
        at = np.flatnonzero(text == 0xC2)
        at = at[np.isin(text[at + 1], _MARKS_2)]
        kind[at] = kind[at + 1] = MARK
        at = np.flatnonzero(text == 0xE2)
        kind[at] = kind[at + 1] = kind[at + 2] = MARK
    change = kind[1:] != kind[:-1]
    change |= kind[1:] == DIGIT
    quote = np.flatnonzero(text[1:-3] == 39) + 1
    if len(quote):
        quote = quote[kind[quote - 1] != MARK]
        one, two = text[quote + 1], text[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        for some, size in ((quote[short], 2), (quote[long], 3)):
            change[some] = False  # the letters stay with their quote
            change[some + size - 1] = True
    edge = np.flatnonzero(change) + 1
    first = kind[edge[:-1]] != SPACE
    return edge[:-1][first], edge[1:][first]


class Words:
    """Ids of texts, pre-token by pre-token; each distinct one gets a number and is encoded once, many at a time.

    Pre-tokens of up to 16 bytes are told apart by those bytes and their length, in arrays that a whole slice is looked up in at once;
    others by a dictionary. Runs of letters are encoded joined by spaces; each run's last piece carries the end-of-word mark, which tells
    them apart again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # Runs of a-z need no normalizer and no pre-tokenizer but white space, if the vocabulary agrees on a probe.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        probe = " ".join(["a", "the", "zq", "abcdefghijklmnopqrstuvwxyz", "internationalisation", "sst", "dll"])
        if self.plain.encode(probe, add_special_tokens=False).ids != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            self.plain = self.tokenizer
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.count, self.other = 1, {}  # number 0 is the end of a text
        self.low, self.high, self.length = np.zeros(1 << 18, np.uint64), np.zeros(1 << 18, np.uint64), np.zeros(1 << 18, np.uint8)
        self.bits, self.table = TABLE_BITS, np.zeros(1 << TABLE_BITS, np.int32)
        self.first, self.size = np.zeros(1, np.int32), np.ones(1, np.int32)  # by number: where its ids begin, and how many they are
        self.ids = np.array([END], self.kind)
        self.hash = np.zeros(1, np.uint32)

    def _slots(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15) + length.astype(np.uint64)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _grow(self) -> None:
        self.bits += 1
        self.table = np.zeros(1 << self.bits, np.int32)
        own = np.flatnonzero(self.length).astype(np.int32)
        self._add(own, self._slots(self.low[own], self.high[own], self.length[own]))

    def _find(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Numbers of short pre-tokens, 0 where they are new."""
        out = self.table[slot]
        wrong = np.flatnonzero((out > 0) & ((self.low[out] != low) | (self.high[out] != high) | (self.length[out] != length)))
        at = slot[wrong]
        while len(wrong):
            at = (at + 1) & (len(self.table) - 1)
            now = self.table[at]
            out[wrong] = now
            bad = (now > 0) & ((self.low[now] != low[wrong]) | (self.high[now] != high[wrong]) | (self.length[now] != length[wrong]))
            wrong, at = wrong[bad], at[bad]
        return out

    def _add(self, number: np.ndarray, slot: np.ndarray) -> None:
        while len(number):
            free = self.table[slot] == 0
            self.table[slot[free]] = number[free]  # of several for one slot the last stays
            left = self.table[slot] != number
            number, slot = number[left], (slot[left] + 1) & (len(self.table) - 1)

    def _numbers(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pre-tokens of simple text, and where each begins."""
        buffer = np.frombuffer(text, np.uint8)
        start, stop = bounds_of_tokens(buffer[:-16])
        length = stop - start
        eight = np.ndarray((len(buffer) - 7,), "<u8", buffer.data, strides=(1,))
        low, high = eight[start] & _MASKS[np.minimum(length, 8)], eight[start + 8] & _MASKS[np.clip(length - 8, 0, 8)]
        slot = self._slots(low, high, length)
        out = np.zeros(len(start), np.int32)
        short = np.flatnonzero(length <= 16)
        fresh = []
        while len(short):
            out[short] = self._find(low[short], high[short], length[short], slot[short])
            short = short[out[short] == 0]
            if not len(short):
                break
            _, one = np.unique(slot[short], return_index=True)  # of new ones that share a slot, one at a time
            one = short[one]
            number = np.arange(self.count, self.count + len(one), dtype=np.int32)
            self.count += len(one)
            self._room()
            while self.count > 0.7 * len(self.table):
                self._grow()
                slot = self._slots(low, high, length)
            self.low[number], self.high[number], self.length[number] = low[one], high[one], length[one]
            fresh += [text[a:z].decode() for a, z in zip(start[one].tolist(), stop[one].tolist())]
            self._add(number, slot[one])
        if fresh:
            self._learn(fresh)
        at = np.flatnonzero(length > 16)
        out[at] = self._others([text[a:z].decode() for a, z in zip(start[at].tolist(), stop[at].tolist())])
        return out, start

    def _others(self, words: list[str]) -> np.ndarray:
        """Numbers of pre-tokens by the dictionary."""
        new = [w for w in dict.fromkeys(words) if w not in self.other]
        if new:
            self.other.update(zip(new, range(self.count, self.count + len(new))))
            self.count += len(new)
            self._room()
            self._learn(new)
        return np.fromiter(map(self.other.__getitem__, words), np.int32, len(words))

    def _room(self) -> None:
        while self.count > len(self.low):
            self.low, self.high, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.low, self.high, self.length))

    def _each(self, words: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(words), 10_000):
            out += [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(words[at : at + 10_000], add_special_tokens=False)]
        return out

    def _runs(self, runs: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the runs one behind the other, and their numbers of ids."""
        ids, sizes = [np.empty(0, self.kind)], [np.empty(0, np.int64)]
        for at in range(0, len(runs), 1024):
            some = runs[at : at + 1024]
            own = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            size = np.diff(np.flatnonzero(self.ends[own]), prepend=-1)
            if len(size) != len(some):
                each = self._each(some)
                own, size = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
            ids.append(own)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, words: list[str]) -> None:
        """The ids of words that have the next numbers."""
        ascii_runs, runs, rest = [], [], []
        for i, w in enumerate(words):
            (rest if not w.isalpha() else ascii_runs if w.isascii() else rest if OTHER.search(w) else runs).append(i)
        parts = [self._runs([words[i].lower() for i in ascii_runs], self.plain), self._runs([words[i] for i in runs], self.tokenizer)]
        each = self._each([words[i] for i in rest])
        sizes = np.concatenate([parts[0][1], parts[1][1], np.fromiter(map(len, each), np.int64, len(each))])
        own = np.empty((2, len(words)), np.int32)
        own[:, ascii_runs + runs + rest] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
        self.first, self.size = np.concatenate([self.first, own[0]]), np.concatenate([self.size, own[1]])
        self.ids = np.concatenate([self.ids, parts[0][0], parts[1][0], *each])
        self.hash = np.concatenate([self.hash, np.fromiter(map(crc32, map(str.encode, map(str.lower, words))), np.uint32, len(words)) * np.uint32(0x9E3779B1)])

    def _numbers_each(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the pre-tokens of texts that aren't simple."""
        split = [OTHER_TOKENS.findall(t) for t in texts]
        return np.split(self._others(list(chain.from_iterable(split))), np.cumsum([len(x) for x in split])[:-1])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[bytes]]:
        """Each text's key on the curve, and its ids with the end id as little-endian 16-bit (or 32-bit) numbers."""
        if not texts:
            return np.empty(0, np.int64), []
        if self.count > KEPT_WORDS:
            self._forget()
        each: list[np.ndarray] = [_END] * len(texts)
        easy = [i for i, t in enumerate(texts) if t.isascii() or not OTHER.search(t)]
        raw = [texts[i].lower().encode() for i in easy]
        number, start = self._numbers(b" " + b" ".join(raw) + b" " * 20)
        cut = np.searchsorted(start, np.cumsum([1, *(len(x) + 1 for x in raw)]))
        for i, a, z in zip(easy, cut.tolist(), cut[1:].tolist()):
            each[i] = number[a:z]
        rest = sorted(set(range(len(texts))).difference(easy))
        for i, own in zip(rest, self._numbers_each([texts[i] for i in rest]) if rest else ()):
            each[i] = own
        count = np.array([len(x) + 1 for x in each])
        words = np.concatenate([x for own in each for x in (own, _END)])
        distinct = np.sort(np.repeat(np.arange(len(texts)) << 32, count) | words)
        distinct = distinct[1:][(distinct[1:] != distinct[:-1]) & (distinct[1:] & 0xFFFFFFFF > 0)]  # the end is number 0, so the first is one
        keys = hilbert(projected(distinct >> 32, self.hash[distinct & 0xFFFFFFFF], len(texts)), BITS)
        size = self.size[words]
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(self.first[words] - (ends - size), size) + np.arange(int(ends[-1]))]
        view, cut = memoryview(flat.view(np.uint8)), (ends[np.cumsum(count) - 1] * self.kind.itemsize).tolist()
        return keys, [bytes(view[a:z]) for a, z in zip([0, *cut], cut)]


_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_END = np.zeros(1, np.int32)


@lru_cache(2)
def words_of(path: str | None) -> Words:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Words(path)


@cache
def kind_of(path: str | None) -> np.dtype:
    return words_of(path).kind


def tokenized(docs: DataFrame, partitions: int, tokenizer: str | None) -> DataFrame:
    """doc_id, the number and bytes of its ids, its key and the range pid of the curve that the key lies in."""
    edges = bounds(docs, partitions, tokenizer)

    def encode(part: pa.RecordBatch) -> dict:
        words = words_of(tokenizer)
        keys, ids = words.encode(C.text_list(part.column("text")))
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // words.kind.itemsize
        pid = [bisect_right(edges, x) for x in zip(keys.tolist(), part.column("doc_id").fill_null(NO_ID).to_pylist())]
        return {"doc_id": part.column("doc_id"), "key": keys, "pid": pid, "n": n, "ids": ids}

    return C.map_text(docs, ["doc_id", "text"], "doc_id long, key long, pid int, n long, ids binary", encode)


# -- packing -------------------------------------------------------------------------------------------------------------------


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: where each lies in its document and in its sequence; with ``with_ids`` its ids (32-bit)."""
    spark = docs.sparkSession
    ship(spark)
    # As the plan tells the input's size where it is read from files; else it is unknown, and counts as endless.
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES) if size < 1 << 60 else 0)
    found = C.written(tokenized(docs, partitions, tokenizer))
    totals = sorted((r[0], r[1]) for r in found.groupBy("pid").agg(F.sum("n")).collect())  # a row for each range
    base, at = {}, 0
    for pid, n in totals:
        base[pid], at = at, at + n
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    out = C.arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = kind_of(tokenizer)
        own, place = -1, 0
        for batch in batches:
            for part in C.slices(batch, "ids"):
                rows: list[tuple] = []
                for pid, n, doc_id, ids in zip(*(part.column(c).to_pylist() for c in ("pid", "n", "doc_id", "ids"))):
                    if pid != own:
                        own, place = pid, base[pid]
                    done, wide = 0, np.frombuffer(ids, kind).astype("<u4").tobytes()
                    while done < n:
                        k = min(n - done, length - place % length)
                        piece = wide[4 * done : 4 * (done + k)]
                        row = (doc_id, done, k, crc32(piece), n, place // length, place % length)
                        rows.append((*row, piece) if with_ids else row)
                        place, done = place + k, done + k
                if rows:
                    yield C.as_batch(dict(zip(out.names, map(list, zip(*rows)))), out)

    dealt = found.repartitionById(partitions, "pid").sortWithinPartitions("pid", "key", "doc_id", "ids")
    return dealt.select("pid", "n", "doc_id", "ids").mapInArrow(run, schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
