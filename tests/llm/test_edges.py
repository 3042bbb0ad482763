"""Empty tables, rows of nulls, ties, the curve's order, and a library without the subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtflux.llm import common, interpolate, langid, licenses, media, packing, quality, segment, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_curve_order(spark, docs, corpus):
    """Documents follow each other by key, then id (nulls first), then ids of tokens."""
    words = packing.words_of(None)
    rows = [(r[0], r[1] or "") for r in corpus[0]] + [(77, "b a"), (78, "a b"), (77, "a b")]
    keys, ids = words.encode([t for _, t in rows])
    want = sorted((int(k), -(1 << 63) if i is None else i, x) for k, (i, _), x in zip(keys, rows, ids))
    some = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(some, length=64, with_ids=True).orderBy("sequence_id", "offset").collect()
    stream, at = [], b""
    for r in got:
        at += bytes(r.ids)
        if r.start + r.length == r.doc_tokens:
            stream.append((-(1 << 63) if r.doc_id is None else r.doc_id, np.frombuffer(at, "<u4").astype(words.kind).tobytes()))
            at = b""
    assert stream == [(i, x) for _, i, x in want]


def test_points_literally():
    words = packing.words_of(None)
    texts = ["the cat sat on the mat", "", "x", "The CAT the"]
    from zlib import crc32

    for text, key in zip(texts, words.encode(texts)[0]):
        h = np.array([crc32(w.encode()) * 0x9E3779B1 % 2**32 for w in set(text.lower().split())], np.uint32)
        raw = (h.view(np.uint8).reshape(-1, 4).sum(0, dtype=np.int64) - 127.5 * len(h)) / (73.9 * max(len(h), 1) ** 0.5) if len(h) else np.zeros(4)
        point = np.minimum((1 / (1 + np.exp(-1.702 * raw)) * 4096).astype(np.int64), 4095)
        assert packing.hilbert(point[None], packing.BITS)[0] == key


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(None, None, None, None, None)] * 3 + [(5, None, None, None, None), (None, "", None, None, None)], DOCS)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_rows_of_nulls(nulls, no_labels):
    assert {r.score for r in toxicity.toxicity(nulls, no_labels).collect()} == {0.25}
    assert {(r.n_words, r.base_failed, r.kept, r.perplexity) for r in quality.quality(nulls, no_labels).collect()} == {(0, True, False, None)}
    assert {(r.n_words, r.labels, r.score) for r in licenses.licenses(nulls).collect()} == {(0, "", 0.0)}
    assert {(r.lang_pred, r.score) for r in langid.languages(nulls).collect()} == {("und", 0.0)}
    assert {(r.n_bytes, r.payload_bytes) for r in media.features(media.store(nulls)).collect()} == {(0, 576)}
    assert {r.n_tokens for r in interpolate.scores(nulls).collect()} == {1}
    assert {r.doc_tokens for r in packing.pack(nulls).collect()} == {1}
    assert {(r["rank"], r.n_pieces, r.inclusion) for r in segment.segmentations(nulls).collect()} == {(1, 0, 1.0)}
    assert {(r.fingerprint, r.component_id) for r in simhash.near_duplicates(nulls).collect()} == {("0" * 16, 5)}
    assert simhash.keep_one(nulls).collect()[0].doc_id == 5


def test_empty_pipeline(spark, tmp_path, no_labels):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    no_labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_without_labels(spark, docs, tmp_path, no_labels):
    """Nothing is toxic then, and the bands are those of all rows."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kept = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept.write.parquet(f"{tmp_path}/documents.parquet")
    no_labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, kept, str(tmp_path)).count() == kept.count()
    assert 0 < corpus_pipeline.run(spark, str(tmp_path)).where(F.col("start") == 0).count() < kept.count()


@pytest.mark.parametrize("shift, kept", [(0.0, True), (1e-9, False)])
def test_band_edges(spark, docs, monkeypatch, shift, kept):
    """A document on a band's upper edge is kept, one beyond is not."""
    some = docs.where("doc_id = 7").limit(1)
    at = quality.scored(some, quality.learn(some)).first()
    assert not at.base_failed
    monkeypatch.setattr(quality, "bands", lambda *_: {at.language: (at.log10_ppl - shift, 1.0, 0.0)})
    assert quality.quality(some).first().kept == kept and quality.keep_good(some).count() == kept


def test_very_long_texts(spark):
    long = " ".join(f"word{i % 977} and" for i in range(60_000)) + "\n" + "x" * 300_000
    docs = spark.createDataFrame([(1, long, "en", "s", 1), (2, "short text of a few words that are here for the count", "en", "s", 1)], DOCS)
    assert segment.segmentations(docs, k=1).where("doc_id = 1 and decoded_ok").count() == 1
    assert packing.pack(docs).where("doc_id = 1").agg(F.sum("length") == F.max("doc_tokens")).first()[0]
    assert simhash.near_duplicates(docs).count() == 2 and interpolate.scores(docs).where("doc_id = 1").first().n_tokens == 120_002
    assert licenses.licenses(docs).where("doc_id = 1").first().n_words == 120_001
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://h/").alias("url"), F.col("text").alias("html"))
    assert warc.archive(pages).where("page_id = 1").first().payload_bytes == len(long)


def test_shared_folder_is_needed_off_local(spark, monkeypatch):
    """Only a local session may do without a shared folder."""
    conf = type("C", (), {"get": lambda self, key: None})()
    context = type("S", (), {"getConf": lambda self: conf, "master": "spark://far:7077", "applicationId": "a"})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(type("P", (), {"sparkContext": context})())


def test_library_without_the_folders(tmp_path):
    """Without this subpackage, its tests and the pipeline the rest imports and answers."""
    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not [x for x in q if x.startswith('op') or x == 'pipeline'] and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)
