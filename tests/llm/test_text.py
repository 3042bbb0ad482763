"""License scans, archives, media, language-model scores, packing, segmentations, the pipeline."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from courtflux.llm import interpolate, licenses, media, packing, segment, warc


# -- licenses ------------------------------------------------------------------------------------------------------------------


def literal_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    places = [(label, i) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


@given(st.lists(st.sampled_from(["MIT", "mit", "License", "license,", "cc", "BY", "by", "gnu general public license", "apache", "é", "x-", "\x00"]), max_size=25).map(" ".join))
@settings(max_examples=150, deadline=None)
def test_license_base(text):
    n, places, _ = licenses.scan(text.encode())
    assert (n, sorted(places)) == literal_base(text)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def kept(notice, chars):
    """The places of the exact words, which bear no edit, and of the spaces beside them."""
    text = "".join(chars)
    return {i for w in notice.exact for m in re.finditer(rf"(?<![^ ]){re.escape(w)}(?![^ ])", text) for i in range(m.start() - 1, m.end() + 1)}


def test_license_fuzzy():
    """Every planted notice with few edits is found at its place; what no substring comes near to is not."""
    rng = np.random.default_rng(3)
    for notice in licenses.NOTICES:
        for k in range(notice.edits + 1):
            t = list(notice.text)
            for _ in range(k):
                free = [i for i in range(1, len(t) - 1) if i not in kept(notice, t)]
                at, how = int(rng.choice(free)), int(rng.integers(3))
                t[at : at + 1] = [] if how == 0 else ["q"] if how == 1 else [t[at], "q"]
            text = "aaa bbb " + "".join(t) + " ccc"
            _, _, spans = licenses.scan(text.encode())
            assert any(s.edits <= k for s in spans), (notice, text)
    assert licenses.scan(b"some words that are no notice at all, by any license of theirs")[2] == []
    n, _, spans = licenses.scan(b"Xx yy. Licenced under teh Apache License, Version 2.0!")
    assert [(s.label, s.first_word, s.last_word) for s in spans] == [("apache-2.0", 2, 9)] and n == 10
    assert 1 <= spans[0].edits <= 4


def test_licenses_table(docs, no_docs, corpus):
    got = licenses.licenses(docs).collect()
    assert len(got) == len(corpus[0])
    for r in got:
        if r.doc_id is not None and r.doc_id < 160 and r.doc_id % 11 == 0:
            assert r.labels == "apache,apache-2.0" and r.base_labels == "apache" and r.score == 1.0 and r.n_base == 1
        if r.doc_id in (300, 301, 303):
            assert (r.n_words, r.n_base, r.first_word, r.labels, r.score) == (0, 0, None, "", 0.0)
    assert licenses.licenses(no_docs).count() == 0


# -- archives ------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "<p>é" + "x" * 150
    rows = [(5, "http://a/1", big), (3, "http://a/2 b", big), (9, None, big), (1, "http://a/3", "tiny"), (2, "http://a/4", "tiny"), (4, "u", None), (6, "u", ""), (7, "http://s", "WARC/1.1\r\n\r\nfiledesc://x 1\n" * 9), (None, "n", big), (8, "v", "y" * 100), (10, "v", "y" * 100), (10, "v", "y" * 100), (11, "v", "z" * 99), (12, "v", "z" * 99)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    for bound in (warc.MAX_BROADCAST, -1):
        got = warc.archive(pages, max_broadcast=bound).collect()
        con = duckdb.connect()
        table = pages.toPandas()
        con.register("pages", table.astype({"page_id": "Int64"}))
        want = con.sql(warc.ORACLE).fetchall()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
        assert len({r.record_id for r in got}) >= 11 and {r.warc_date for r in got} == {"2024-01-01T00:00:00Z"}
        assert {r.target_uri for r in got} >= {"http://a/2%20b", "about:blank"}
    assert warc.archive(pages.limit(0)).count() == 0


def test_arc_versions():
    block = warc.http_response(4, b"\nfiledesc://in the payload 1 2 3\n")
    for v in (1, 2):
        data = warc.version_block(v, "n.arc.gz") + b"\n".join([warc.arc_record(v, "http://h/", block, "n", 7)] * 2)
        recs = [r for _, r in warc.parse_arc(data) if r]
        assert [r.block for r in recs] == [block] * 2 and recs[0].url == "http://h/" and recs[0].date == warc.CAPTURED
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-5]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.arc_record(1, "u", block, "n", 0)))


# -- media ---------------------------------------------------------------------------------------------------------------------


def test_media_table(docs, corpus, no_docs):
    got = {(r.doc_id, r.n_bytes): r for r in media.features(media.store(docs)).collect()}
    for row in corpus[0]:
        t = (row[1] or "").encode()
        x = t + b"\xff" * (-len(t) % 576 if t else 576)
        r = got[row[0], len(t)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-32:]))
    assert media.features(media.store(no_docs)).count() == 0


@given(st.binary(max_size=300), st.binary(max_size=40), st.integers(0, 2))
@settings(max_examples=100, deadline=None)
def test_carving(payload, before, k):
    kind, write = media.WRITERS[k]
    x = media.padded(payload)
    blob = write(x)
    assert media.corrected(blob, "image/png")[0] == kind
    found = [f for f in media.sniff(before + blob + b"tail") if f.start == len(before) and f.kind == kind]
    assert found and (before + blob)[found[0].payload_start : found[0].payload_end] == x
    assert not [f for f in media.sniff(before + blob[:-1]) if f.start == len(before)]


def test_other_formats():
    def chunk(n, d):
        return len(d).to_bytes(4, "big") + n + d + zlib.crc32(n + d).to_bytes(4, "big")

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x2c" + bytes(9) + b"\x02" + b"\x02\x44\x01\x00" + b"\x3b"
    assert [f.kind for f in media.sniff(b"BM RIFF" + png + gif + b".snd")] == ["image/png", "image/gif"]
    assert media.corrected(png.replace(b"IDAT", b"IDAX"), "text/plain")[0] == "text/plain"


# -- language model ------------------------------------------------------------------------------------------------------------


def test_interpolation(docs, corpus, no_docs):
    rows = [(r[0], (r[1] or "").translate({c: c + 32 for c in range(65, 91)})) for r in corpus[0]]
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", t), None] for _, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    uni, bi, starts = Counter(), Counter(), 0
    for t, h in zip(toks, held):
        if not h:
            uni.update(t)
            bi.update(zip(["<s>", *t], t))
            starts += 1
    n, v = sum(uni.values()), len(uni)
    want = sorted((str(i), len(t), sum(uni[w] > 0 for w in t), round(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), 6)) for (i, _), t in zip(rows, toks))
    for block in (interpolate.BLOCK_BYTES, 2000):
        got = interpolate.scores(docs, block_bytes=block).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        assert {r.train_tokens for r in got} == {n}
        assert sorted((str(r.doc_id), r.held_out) for r in got) == sorted((str(i), h) for (i, _), h in zip(rows, held))
        assert all(r.score < 0 for r in got)
        scores = sorted((str(r.doc_id), round(r.score, 6)) for r in got)
        first = scores if block == interpolate.BLOCK_BYTES else first
        assert scores == first  # blocks don't matter
        seen = [r for r in got if not r.held_out]
        assert sum(r.score for r in seen) > sum(r.base_score for r in seen)
    assert interpolate.scores(no_docs).count() == 0


def test_interpolation_weights():
    """Expectation-maximisation raises the held-out likelihood and keeps distributions."""
    rng = np.random.default_rng(0)
    context = rng.integers(1, 500, 5000)
    c = np.minimum(context, rng.integers(1, 40, 5000))
    cells, n = interpolate.held_out_cells(rng.integers(1, 900, 5000), context, c, 100_000)
    w = interpolate.expectation_maximisation(cells, n, 1e-5)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all() and (w[0, 0] == 0)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
@settings(deadline=None)
def test_packed_arrays(x):
    a = np.array(sorted(x), np.uint64)
    assert (interpolate.unpack(interpolate.pack(a)) == a).all()


# -- packing -------------------------------------------------------------------------------------------------------------------


def test_hilbert_is_a_curve():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        pts = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        key = packing.hilbert(pts, bits)
        assert sorted(key) == list(range(len(pts)))
        steps = np.abs(np.diff(pts[np.argsort(key)], axis=0)).sum(1)
        assert (steps == 1).all()


def test_packing(docs, corpus, no_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    got = packing.pack(docs, length=64, with_ids=True).collect()
    by = {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by.setdefault(r.sequence_id, []).append(r)
    sizes = []
    for k in sorted(by):
        at = 0
        for r in sorted(by[k], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert set(sizes[:-1]) == {64} and sizes[-1] <= 64 and sorted(by) == list(range(len(by)))
    whole = Counter()
    stream = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    ids = b""
    for r in stream:
        ids += bytes(r.ids)
        if r.start + r.length == r.doc_tokens:
            whole[str(r.doc_id), ids[-4 * r.doc_tokens :]] += 1
    want = Counter((str(r[0]), np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in corpus[0])
    assert whole == want
    assert packing.pack(no_docs).count() == 0


@given(st.text(st.sampled_from("abAéÉ'sStTmM.,!3½ \n\t \x1c…”́ßΣİ한"), max_size=40))
@settings(max_examples=1500, deadline=None)
def test_words_as_whole_texts(text):
    w = packing.words_of(None)
    assert np.frombuffer(w.encode([text])[1][0], w.kind).tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids + [1]


# -- segmentations -------------------------------------------------------------------------------------------------------------


def all_paths(v, text):
    s, out = segment.SPACE + text.replace(" ", segment.SPACE), []

    def go(i, lw, ids):
        if i == len(s):
            out.append((lw, tuple(ids)))
            return
        one = False
        for n in range(1, min(v.longest, len(s) - i) + 1):
            if g := v.log_weight.get(s[i : i + n]):
                one |= n == 1
                go(i + n, lw + g[0], ids + [g[1]])
        if not one:
            b = [v.byte_id[x] for x in s[i].encode()]
            go(i + 1, lw + v.log_byte * len(b), ids + b)

    go(0, 0.0, [])
    z = sum(math.exp(w) for w, _ in out)
    return {p: math.exp(w) / z for w, p in out}


def test_samples_without_replacement():
    v = segment.vocabulary(None, 1.0)
    text = "on é\n"
    want = all_paths(v, text)
    n, k = 4000, 3
    x = segment.Texts(v, [text] * n, list(range(n)))
    first, estimate = Counter(), 0.0
    for found, least in segment.top_k(x, k):
        ids = [tuple(v.expand(x.id[p.edges]).tolist()) for _, p in found]
        assert len(set(ids)) == k and [g for g, _ in found] == sorted((g for g, _ in found), reverse=True)
        first[ids[0]] += 1
        for i, (_, p) in zip(ids, found):
            assert math.isclose(want[i], math.exp(p.before[-1]), rel_tol=1e-9)
            estimate += want[i] / -math.expm1(-math.exp(p.before[-1] - least)) / n
    for p, q in want.items():
        assert abs(first[p] / n - q) < 4 * math.sqrt(q / n) + 0.002
    assert abs(estimate - 1) < 0.05


def test_few_segmentations():
    v = segment.vocabulary(None, 1.0)
    want = all_paths(v, "a")
    (found, least), (none, _) = segment.top_k(segment.Texts(v, ["a", ""], [1, 2]), 50)
    assert len(found) == len(want) and least == -math.inf and len(none) == 1 and len(none[0][1].edges) == 0


def test_segmentations_table(docs, corpus, no_docs):
    a = segment.segmentations(docs, with_ids=True).orderBy("doc_id", "ids_crc32").collect()
    b = segment.segmentations(docs.repartition(5), with_ids=True).orderBy("doc_id", "ids_crc32").collect()
    assert a == b  # seeded by the row's key alone
    assert all(r.decoded_ok and 0 <= r.inclusion <= 1 and r.log_prob <= 1e-9 and r.n_pieces == len(r.ids) for r in a)
    assert Counter(r.rank for r in a) == {1: len(corpus[0]), 2: sum(bool(r[1]) for r in corpus[0])}
    assert segment.segmentations(no_docs).count() == 0


# -- pipeline ------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, docs, labels, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, str(tmp_path))
        after.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == kept.columns and 0 < now.count() < kept.count()
        kept = now
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    want = packing.pack(kept)
    keys = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pieces.columns == keys
    # Cuts follow the curve's order, which is the same; so are all pieces.
    assert pieces.exceptAll(want).count() == 0 and want.exceptAll(pieces).count() == 0
    ended = pieces.where(F.col("start") + F.col("length") == F.col("doc_tokens"))
    assert ended.count() == kept.count() and ended.agg(F.sum("doc_tokens")).first() == pieces.agg(F.sum("length")).first()
