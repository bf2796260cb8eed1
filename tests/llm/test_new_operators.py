"""Toxicity, spelling variants and whitening against brute force, held-out accuracy and edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import spelling, toxicity, whitening
from tessera.llm.common import read_table, utf8_blocks
from tessera.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
CLASHES = ["id", "t", "i", "r", "h", "n", "word", "form", "root", "near", "x", "d", "s", "y", "score", "size", "shard", "offending", "part", "w"]


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def with_clashes(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in df.columns])


# --- 11 toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op11_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r for r in read_table(spark, sf, "labels").collect()}
    assert len(rows) == read_table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    out = [(rows[i].predicted, y.toxic) for i, y in labels.items() if rows[i].held_out and y.quality == 1]
    assert np.mean([p for p, y in out if y == 1]) > 0.85 and np.mean([p for p, y in out if y == 0]) < 0.02


@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(5)
    clean = ["the cat sat", "a dog ran home", "we walked by the sea", "it rained all day", "bread and cheese"]
    docs, labels = [], []
    for i in range(300):
        said = [rng.choice(clean) + "." for _ in range(rng.randint(1, 12))]
        if i % 3 == 0:
            said.insert(rng.randrange(len(said) + 1), f"You {rng.choice(['zorkish', 'zorkling', 'zorkest'])} fool!")
        docs.append((i, " ".join(said)))
        labels.append((i, int(i % 3 == 0)))
    docs, labels = frame(spark, docs), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    return docs, labels, toxicity.fit_toxicity(docs, labels)


def test_toxicity_finds_the_sentence(spark, insults):
    docs, _, model = insults
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = toxicity.offending_sentences(docs, model).collect()
    assert {r.doc_id for r in found} == {i for i in texts if i % 3 == 0}
    assert all("zork" in r.sentence and "." not in r.sentence.strip() and texts[r.doc_id][r.start : r.start + r.length] == r.sentence for r in found)
    accented = frame(spark, [(1, "Été à la mer. Ça va bien! You zorkful fool! Ärger."), (2, "Été.")])
    (one,) = toxicity.offending_sentences(accented, model).collect()
    assert one.doc_id == 1 and one.sentence.strip() == "You zorkful fool!"


def test_toxicity_is_the_noisy_or(spark, insults):
    docs, _, model = insults
    for row in toxicity.score_toxicity(docs, model).limit(20).collect():
        text = docs.where(F.col("doc_id") == row.doc_id).first().text.encode()
        clean = 1.0
        data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        for a, b, _ in zip(*toxicity.sentences(data, offsets), strict=True):
            _, bucket = toxicity.features(data[a:b], np.array([0, b - a]))
            clean *= 1 - 1 / (1 + np.exp(-(model["weights"][bucket].sum() + model["bias"])))
        assert row.score == pytest.approx(1 - clean, abs=1e-6)


def test_toxicity_edges(spark, insults):
    docs, labels, model = insults
    long = "we walked by the sea " * 60_000
    rows = [(1, None), (2, ""), (3, " \n.!?"), (4, "zorkish fool"), (4, "zorkish fool"), (None, "bread"), (5, long + "you zorkish fool!"), (6, "é" * 5_000)]
    got = toxicity.score_toxicity(with_clashes(frame(spark, rows)), model).collect()
    assert len(got) == len(rows) and [r.score for r in got[:3]] == [0, 0, 0]
    assert got[3].score == got[4].score > 0.5 and got[3].offending[0].length == 12 and got[6].score > 0.5 and got[7].score < 0.5
    assert toxicity.score_toxicity(frame(spark, []), model).collect() == []
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.score_toxicity(frame(spark, rows), none).count() == len(rows)
    odd = labels.unionAll(spark.createDataFrame([(None, 1), (3, None), (4, 7), (9_999, 1), (3, 1)], "doc_id bigint, toxic int"))
    again = toxicity.fit_toxicity(with_clashes(docs.unionAll(frame(spark, [(None, "x"), (7, None)]))), with_clashes(odd))
    assert toxicity.offending_sentences(with_clashes(docs), again).where("doc_id = 0").count() == 1


def test_sentences_cover_the_text():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é.!?\n ,") for _ in range(rng.choice((0, 1, 7, 90, 4_000)))) for _ in range(60)] + ["x" * 3_500, "é" * 2_100 + " a"]
    for _, data, offsets in utf8_blocks(pa.array(texts), 1 << 20):
        starts, ends, rows = toxicity.sentences(data, offsets)
        assert (starts[1:] == ends[:-1]).all() and starts[0] == 0 and ends[-1] == len(data)
        assert ((offsets[rows] <= starts) & (ends <= offsets[rows + 1])).all()
        assert ((data[starts] & 0xC0) != 0x80).all() and (ends - starts).max() <= 2 * toxicity.LONGEST


# --- 12 spelling variants


def brute_words(docs, noise=199):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if noise and h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts):
    by_size, out = defaultdict(list), {}
    for w in counts:
        by_size[len(w)].append(w)
    for w, n in counts.items():
        others = [o for k in (-1, 0, 1) for o in by_size[len(w) + k] if o != w and near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        out[w] = (best if best and counts[best] >= 5 * n else None, n, len(others))
    rows = {}
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, n, k, counts[form] if form else None)
    return rows


def got_variants(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_spelling_is_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").collect()]
    got = got_variants(QUERIES["op12_spelling"](spark, SF))
    assert got == brute_variants(brute_words(docs)) and any(form for form, *_ in got.values())


@pytest.mark.parametrize("block", [2_000, 7])
def test_near_words_of_dense_vocabularies(spark, monkeypatch, block):
    """Words over few letters, which share most grams; with small blocks, which cut every shard."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(block)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))): rng.randint(5, 400) for _ in range(900)}
    counts |= {"aaaaaa": 5, "aaaaaaa": 30, "aaaaaaaa": 200, "aaaaaaaaa": 1_001, "zzzzzz": 9}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert got_variants(spelling.spelling_variants(with_clashes(vocab))) == brute_variants(counts)


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(27)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w27"}


def test_one_edit():
    rng = random.Random(1)
    for _ in range(3_000):
        a = "".join(rng.choice("ab") for _ in range(6))
        b = "".join(rng.choice("ab") for _ in range(rng.choice((6, 7))))
        assert spelling.one_edit(a, b) == near(a, b)


def test_spelling_edges(spark):
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "STRASSE Straße straße×÷ strasse"), (None, "strasse strasse strasse"), (5, "strasse " * 40_000), (5, "strasse " * 3), (6, "Éléphant éléphant " * 5)]
    got = {r.word: r.n for r in spelling.count_words(with_clashes(frame(spark, rows))).collect()}
    assert got == {"strasse": 40_008, "Éléphant": 5, "éléphant": 5}
    noisy = {r.word: r.n for r in spelling.count_words(frame(spark, rows), noise=1).collect()}
    assert noisy == brute_words([("" if i is None else i, t) for i, t in rows], 1)
    empty = spelling.count_words(frame(spark, []))
    assert empty.collect() == [] and spelling.spelling_variants(empty).collect() == []


# --- 13 whitening


def checked(rows, vectors, most=32):
    """Result rows against a plain eigendecomposition; vectors by id, each once."""
    x = np.floor(64 * np.array([vectors[i] for i in sorted(vectors)], float)).astype(np.int64) + 1_000_000
    n = len(x)
    off = x - x.mean(axis=0)
    values, own = np.linalg.eigh(off.T @ off / n)
    values, own = values[::-1], own[:, ::-1]
    got = {(r.vec_id, r.component): r for r in rows}
    k = max(c for _, c in got)
    assert k == min(most, int((values > 1e-11 * values[0]).sum())) and len(got) == len(rows) == n * k
    deviation = ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)
    w = np.array([[got[i, c].whitened for c in range(1, k + 1)] for i in sorted(vectors)])
    assert all(got[i, 1].deviation == e and got[i, k].n == n for i, e in zip(sorted(vectors), deviation, strict=True))
    assert np.allclose([got[min(vectors), c].explained for c in range(1, k + 1)], values[:k] / values.sum(), rtol=1e-9)
    assert np.abs(w.T @ w / n - np.eye(k)).max() <= 1e-8 and {r.identity_error <= 1e-8 for r in rows} == {True}
    apart = np.concatenate([[True], np.diff(values) < -1e-6 * values[0], [True]])
    for c in range(k):
        if apart[c] and apart[c + 1]:
            want = off @ own[:, c] / np.sqrt(values[c])
            assert np.allclose(w[:, c], want * np.sign(want @ w[:, c]), atol=1e-7)


def test_whitening_is_the_eigendecomposition(spark):
    rows = read_table(spark, SF, "embeddings").collect()
    vectors = {r.vec_id: r.embedding for r in rows if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)}
    checked(QUERIES["op13_whitening"](spark, SF).collect(), vectors)


def vectors_of(spark, vectors):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in vectors.items()], "vec_id bigint, embedding array<float>")


@pytest.mark.parametrize("d,rank,n", [(5, 5, 40), (40, 3, 200), (90, 90, 400), (1, 1, 9), (70, 70, 30)])
def test_whitening_shapes(spark, d, rank, n):
    """More dimensions than a block, fewer than the components, less rank than dimensions (breakdowns), fewer rows."""
    rng = np.random.default_rng(d)
    v = (rng.integers(-40, 40, (n, rank)) @ rng.integers(-3, 4, (rank, d)) if rank < d else rng.normal(size=(n, d)) * 20 * 0.93 ** np.arange(d)).astype(np.float32)
    vectors = dict(enumerate(v))
    checked(whitening.whiten(vectors_of(spark, vectors)).collect(), vectors)


def test_block_lanczos_finds_repeated_values():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(120, 120)))[0]
    values = np.concatenate([np.full(30, 7.0), np.full(50, 2.0), np.zeros(40)])
    a = (q * values) @ q.T
    got, vectors = whitening.block_lanczos(lambda v: a @ v, 120, 32, 8)
    assert np.allclose(got, np.sort(values)[::-1][:32]) and np.allclose(vectors.T @ vectors, np.eye(32)) and np.allclose(a @ vectors, vectors * got)
    steep = (q * 0.5 ** np.arange(120)) @ q.T
    calls = []
    got, _ = whitening.block_lanczos(lambda v: calls.append(v.shape[1]) or steep @ v, 120, 10, 8)
    assert np.allclose(got, 0.5 ** np.arange(10), atol=1e-12) and sum(calls) < 80


def test_whitening_edges(spark):
    rng = np.random.default_rng(9)
    good = {i: rng.normal(size=6) for i in range(50)}
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [nan] * 6), (103, [inf] + [0.0] * 5), (104, [-inf] + [0.0] * 5), (105, [1.0]), (106, [])]
    df = vectors_of(spark, good).unionAll(spark.createDataFrame(odd, "vec_id bigint, embedding array<float>"))
    checked(whitening.whiten(with_clashes(df)).collect(), {i: np.float32(v) for i, v in good.items()})
    twice = whitening.whiten(vectors_of(spark, good).unionAll(vectors_of(spark, good)).unionAll(spark.createDataFrame([(None, [1.0] * 6)], "vec_id bigint, embedding array<float>")))
    assert twice.count() == 101 * 6 and twice.where("vec_id is null").count() == 6 and twice.first().n == 101
    assert whitening.whiten(vectors_of(spark, {})).collect() == []
    assert whitening.whiten(vectors_of(spark, {1: [2, 2], 2: [2, 2]})).collect() == []
    assert whitening.whiten(spark.createDataFrame(odd[:5], "vec_id bigint, embedding array<float>")).collect() == []


def test_deviation_past_64_bits():
    assert whitening.Centre(10, [0, 0]).deviation(np.array([[10**8, 3]])).tolist() == [10**18 + 900]
    with pytest.raises(OverflowError):
        whitening.Centre(10, [0, 0]).deviation(np.array([[10**9, 0]]))
