"""Toxicity, quality rules, language identification, near-duplicates."""

import math
import pickle
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from courtflux.llm import components, langid, quality, simhash, toxicity


def test_toxicity_learns_and_holds_out(spark, docs, labels, corpus):
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(corpus[0])
    toxic = {i: t for i, _, t in corpus[1]}
    held = [r for r in got if r.held_out and r.doc_id in toxic]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_toxicity_pairs():
    """Two terms that are toxic only together are told apart by the pair."""
    a, b = "aaaa", "bbbb"
    rows = [toxicity.terms(t) for t in (f"{a} {b}", a, b, "cccc")] * 40
    m = toxicity.fit(rows, np.array([1, 0, 0, 0] * 40))
    assert m.score(f"{a} {b}") > 0.5 > max(m.score(a), m.score(b), m.score("cccc"))


def test_toxicity_empty(spark, no_docs, docs, labels):
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def base_of(text):
    """The base rules, literally."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = defaultdict(list)
    for i in range(len(words) - 4):
        wins[tuple(words[i : i + 5])].append(i)
    rep = {j for at in wins.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep)


@given(st.text(st.sampled_from("ab é#|\n\t  \x1c"), max_size=80))
@settings(max_examples=200, deadline=None)
def test_base_counts(text):
    assert quality.base_counts(text.encode()) == base_of(text)


def test_quality(spark, docs, corpus, no_docs):
    got = quality.quality(docs).collect()
    by = {(r.doc_id, r.word_chars): r for r in got}
    for row in corpus[0]:
        b = base_of(row[1] or "")
        r = by[row[0], b[1]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        assert not (r.base_failed and r.kept)
    assert sum(r.kept for r in got) > 100
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(str(r.doc_id) for r in kept.collect()) == Counter(str(r.doc_id) for r in got if r.kept)
    assert quality.quality(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0


def literal_kneser_ney(texts):
    """log10 probability of a symbol after a context, by the recursion of modified Kneser-Ney on dictionaries."""
    pad = "\0" * (quality.ORDER - 1)

    def symbol(c):
        if c == "\0":
            return 0
        if ord(c) >= 128:
            return ord(c) % 128 + 128
        return 48 if c.isdigit() else 32 if (ord(c) < 32 and c != "\n") or ord(c) == 127 else ord(c)

    def grams(text):
        s = [symbol(c) for c in pad + text.replace("\0", " ")]
        return [tuple(s[i : i + quality.ORDER]) for i in range(len(text))]

    counts = [Counter(g for t in texts for g in grams(t))]
    while len(counts) < quality.ORDER:
        counts.append(Counter(g[1:] for g in counts[-1]))
    discount = []
    for c in counts:
        n = [0, *(sum(v == k for v in c.values()) for k in (1, 2, 3, 4))]
        if all(n[1:]):
            y = n[1] / (n[1] + 2 * n[2])
            discount.append([0.0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k) for k in (1, 2, 3))])
        else:
            discount.append([0.0, 0.5, 1.0, 1.5])

    def p(gram, level=0):
        if not gram:
            return 1 / 256
        same = {g: v for g, v in counts[level].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:], level + 1)
        d = {g: discount[level][min(v, 3)] for g, v in same.items()}
        total = sum(same.values())
        return (same.get(gram, 0) - d.get(gram, 0)) / total + sum(d.values()) / total * p(gram[1:], level + 1)

    return lambda text: -sum(math.log10(p(g) + 1e-12) for g in grams(text)) / len(text)


@given(st.lists(st.text(st.sampled_from("ab é\n1жя漢\x00\x1f"), min_size=1, max_size=30), min_size=1, max_size=6), st.lists(st.text(st.sampled_from("abc é\n12жя字z"), min_size=1, max_size=20), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_kneser_ney(learned, asked):
    codes, n = np.unique(quality.packed(learned)[0], return_counts=True)
    models = pickle.loads(pickle.dumps(quality.Models({"x": quality.Model(codes, n)})))
    want = literal_kneser_ney(learned)
    assert np.allclose(models.log10_perplexity("x", asked), [want(t) for t in asked], atol=1e-4)
    assert np.isnan(models.log10_perplexity("y", asked)).all()


def test_symbols_of_an_alphabet_stay_apart():
    for letters in ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"):
        assert len(set(quality.packed([letters])[0] & 255)) == len(letters)


def test_bands_literally(spark, docs, corpus):
    """Verdicts from medians and deviations of the documents' own perplexities, without labels."""
    got = quality.quality(docs).collect()
    rows = [(r, len(t or "")) for r, t in ((r, {x[0]: x[1] for x in corpus[0]}.get(r.doc_id)) for r in got)]
    lang = {x[0]: x[2] for x in corpus[0]}
    for name in ("en", "fr"):
        own = [(math.log10(r.perplexity), n, r) for r, n in rows if lang.get(r.doc_id) == name and not r.base_failed and r.perplexity is not None]
        m = sorted(round(1000 * x) for x, _, _ in own)[math.ceil(len(own) / 2) - 1] / 1000
        wide = [math.sqrt(1 + quality.SHORT / max(2 ** ((math.floor(2 * math.log2(n)) + 0.5) / 2), 1)) for _, n, _ in own]
        off = sorted(abs(round(1000 * x) / 1000 - m) / w for (x, _, _), w in zip(own, wide))
        s = max(quality.LEAST_SPREAD, 1.4826 * off[math.ceil(len(off) / 2) - 1])
        for x, n, r in own:
            z = (x - m) / (s * math.sqrt(1 + quality.SHORT / n))
            if abs(z + quality.BELOW) > 0.05 and abs(z - quality.ABOVE) > 0.05:
                assert r.kept == (-quality.BELOW <= z <= quality.ABOVE), (r.doc_id, z)


def test_langid(spark, docs, corpus, no_docs):
    got = langid.languages(docs).collect()
    lang = {r[0]: (r[1], r[2]) for r in corpus[0]}
    for r in got:
        text, true = lang[r.doc_id]
        if not text or not re.search(r"[^\W\d_]", text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.held_out and r.doc_id < 200:
            assert r.lang_pred == true
    assert {r.lang_pred for r in langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.languages(no_docs).count() == 0


def test_codewords():
    for n in (2, 4, 7, 12):
        c = langid.codewords(n)
        assert len({tuple(r) for r in c}) == n


def literal_fingerprint(text):
    words = text.translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [literal_fingerprint(t or "") for _, t in rows]
    par = list(range(len(fps)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                par[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), 1 << 60))
    return [(d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))]


def test_simhash(spark, docs, corpus, no_docs):
    rows = [(r[0], r[1]) for r in corpus[0]]
    want = brute_components(rows)
    got = [tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, _, c in want if c is not None})
    assert ids.count(None) == sum(c is None for _, _, c in want)
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=30, unique=True), st.lists(st.integers(0, 63), max_size=60))
@settings(max_examples=100, deadline=None)
def test_links_within(base, flips):
    """The links join what the chain of close pairs joins, with fewer links than members."""
    fps = list(dict.fromkeys(base + [base[i % len(base)] ^ (1 << b) for i, b in enumerate(flips)]))
    links = simhash.links_within(np.array(fps, np.uint64), 4)
    assert len(links) < len(fps)

    def parts(pairs):
        par = {f: f for f in fps}

        def find(x):
            while par[x] != x:
                x = par[x]
            return x

        for a, b in pairs:
            par[find(a)] = find(b)
        return {frozenset(f for f in fps if find(f) == r) for r in {find(f) for f in fps}}

    assert parts(links) == parts([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])


def test_hot_keys(spark):
    """Keys that too many fingerprints share are keyed anew, and lose no link."""
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**63))
    fps = {base ^ sum(1 << int(b) for b in rng.choice(64, int(k), replace=False)) for k in rng.integers(0, 12, 700)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")

    def parts(links):
        par = {f: f for f in signed}

        def find(v):
            while par[v] != v:
                v = par[v]
            return v

        for a, b in links:
            par[find(a)] = find(b)
        return {frozenset(f for f in signed if find(f) == r) for r in {find(f) for f in signed}}

    close = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    for hot in (3, 100, 8192):
        assert parts([tuple(r) for r in simhash.close_links(df, hot=hot).collect()]) == parts(close)


def test_inner_masks():
    rng = np.random.default_rng(0)
    for m in simhash.block_masks(8, 4)[::9]:
        inner = simhash.inner_masks(m, 4)
        free = [i for i in range(64) if not m >> i & 1]
        assert all(x & m == m and x.bit_count() >= 48 for x in inner)
        for _ in range(20):
            flips = sum(1 << int(b) for b in rng.choice(free, 4, replace=False))
            assert any(flips & x == 0 for x in inner)


def test_keep_one_clashing_columns(docs):
    clash = docs.withColumnsRenamed({"key": "__id", "fp": "__fp"})
    kept = simhash.keep_one(clash)
    assert kept.columns == clash.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect())


def test_block_masks():
    masks = simhash.block_masks(8, 4)
    assert len(masks) == 70
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(x & m == 0 for m in masks)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, 7)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    par = {n: n for e in edges for n in e}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        par[max(x, y)] = min(x, y)
    want = {n: find(n) for n in par if any(n in e and e[0] != e[1] for e in edges)}
    assert got == want
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0
