"""Codewords, decoding by brute force, ties, and rows without ids."""

import math
import time

import numpy as np

from courtflux.llm import langid


def test_decoding_literally():
    rng = np.random.default_rng(2)
    langs = ["a", "b", "c", "d"]
    code = langid.codewords(4)
    model = langid.Model(langs, code, rng.normal(0, 3, (1 << langid.BITS, code.shape[1])).astype(np.float32), rng.normal(0, 1, code.shape[1]), rng.random(code.shape[1]))
    texts = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(n))) for n in rng.integers(1, 60, 150)] + ["123", "", " ?"]
    got = list(zip(*model.predict(texts)))
    for text, (lang, score, doubt) in zip(texts, got):
        if not any(c.isalpha() for c in text):
            assert (lang, score, doubt) == ("und", 0.0, False)
            continue
        margin = langid.counted([text])[0].astype(float) @ model.w + model.b
        loss = [sum(t * math.log1p(math.exp(-m if bit else m)) for t, m, bit in zip(model.trust, margin, word)) for word in code]
        p = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        assert lang == langs[int(np.argmin(loss))] and abs(score - p.max()) < 1e-4
        if abs(np.sort(p)[-2] - (1 - langid.AMBIGUOUS) * p.max()) > 1e-3:
            assert doubt == (np.sort(p)[-2] > (1 - langid.AMBIGUOUS) * p.max())


def test_equal_losses():
    """The first by name wins, and the row is ambiguous."""
    code = langid.codewords(3)
    model = langid.Model(["x", "y", "z"], code, np.zeros((1 << langid.BITS, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    assert model.predict(["abc"]) == (["x"], [1 / 3], [True])


def test_many_languages():
    for n in (8, 30, 120):
        code = langid.codewords(n)
        assert min((code[i] ^ code[j]).sum() for i in range(n) for j in range(i)) >= code.shape[1] // 8
    assert langid.codewords(1).shape == (1, 1) and langid.codewords(0).shape == (0, 1)


def test_rows_without_ids(spark):
    """They share a remainder, but are drawn one by one."""
    rows = [(None, f"{w} {w}{i}", lang) for i in range(400) for w, lang in (("haus", "de"), ("maison", "fr"))]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=100)
    assert model.langs == ["de", "fr"] and model.predict(["haus 7", "maison 9"])[0] == ["de", "fr"]


def test_rare_languages_are_learned(spark):
    """No rank leaves a language out, and rows that are repeated count once."""
    rows = [(4 * i, f"{lang * 3} {i}", lang) for lang, n in (("a", 5), ("b", 90), ("c", 90), ("d", 1)) for i in range(100, 100 + n)]
    rows += [(400, "ddd", "d")] * 300
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=3000)
    assert model.langs == ["a", "b", "c", "d"] and model.predict(["aaa", "ddd", "ccc 1"])[0] == ["a", "d", "c"]


def test_thousands_of_languages():
    """As a dirty column may hold; the sample bounds them."""
    began = time.perf_counter()
    assert len(langid.codewords(1000)) == 1000 and time.perf_counter() - began < 20
