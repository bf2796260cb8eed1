"""The corpus operators against brute force, exact round trips, held-out accuracy and edge cases."""

import datetime
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, exact_dedup, langid, mixing, near_dedup, pii, quality, suffix_dedup, token_output
from tessera.llm.common import read_table, utf8_blocks, word_blocks
from tessera.llm.components import components
from tessera.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def with_clashes(df):
    """Extra columns whose names the operators use inside."""
    names = ["id", "t", "row", "rep", "class", "v", "a", "b", "keep_id", "anchor", "doc", "first", "spans", "part", "gid", "node", "hits", "gaps", "new", "n", "kept"]
    return df.select("*", *[F.lit("x").alias(c) for c in names if c not in df.columns])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, want))


# --- 1 language ID


def test_language_held_out(spark):
    rows = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.98


def test_language_backs_off(spark):
    docs = frame(spark, [(k, *x) for k, x in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30)], "doc_id bigint, text string, lang string")
    model = langid.fit_language_model(docs)
    scorer = langid.Scorer(model)
    got = [x[0] for x in scorer.predict(["the the", "theand", "katzehund", "zqzq", None, "", "123 !?", "²"])]
    assert got[:3] == ["en", "en", "de"] and got[3] in ("en", "de") and got[4:] == ["und"] * 4
    assert len(scorer.evidence("katzehund")) > 1 and "katzehund" not in model["words"]
    assert langid.fit_language_model(docs.limit(0))["langs"] == []
    odd = with_clashes(frame(spark, [(1, None), (None, "the"), (2, "x" * 100_000), (2, "x" * 100_000)]))
    assert langid.predict_language(odd, model).count() == 4
    assert langid.keep_languages(odd, model).count() == 3 and langid.keep_languages(odd, model).columns == odd.columns


# --- 2 near-dedup, components


def test_unlearned_languages_are_dropped(spark):
    import corpus_pipeline

    docs = read_table(spark, SF, "documents").select("doc_id", "text", "lang")
    odd = ["Привет мир это текст на русском языке", "これは日本語の文章です 今日は天気がいい", "xq zvk wqj kxz qqv", "12 34", None]
    odd = frame(spark, [(-1 - k, t, None) for k, t in enumerate(odd)], "doc_id bigint, text string, lang string")
    kept = corpus_pipeline.language_stage(spark, docs.unionByName(odd), SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    out = langid.held_out(F.col("doc_id"))
    kept = langid.keep_languages(docs.where(out), langid.fit_language_model(docs.where(~out)), min_known=langid.MIN_KNOWN)
    assert kept.count() == docs.where(out).where("text is not null").count() > 300


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def near_texts(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    bases = [[rng.choice(vocab) for _ in range(rng.choice([3, 40, 120]))] for _ in range(8)]
    out = []
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, len(words) // 20, len(words) // 12, len(words)])):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], ["new"], [words[k], words[k]], [rng.choice(vocab)]])
            words = words or ["z"]
        out.append(" ".join(words))
    return [None, "", "!!", *out, "rep " * 300, "rep " * 301, "rep " * 100]


def classes(texts, threshold=0.8):
    """Components by the plain longest common subsequence of words, as a share of the longer text; shorter ones than a shingle must be equal."""
    seqs, root = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [Counter(s) for s in seqs]
    for i in range(len(texts)):
        for j in range(i):
            most = max(len(seqs[i]), len(seqs[j]))
            if seqs[i] and seqs[j] and (seqs[i] == seqs[j] or min(len(seqs[i]), len(seqs[j])) >= near_dedup.SHINGLE and (bags[i] & bags[j]).total() >= threshold * most and lcs(seqs[i], seqs[j]) >= threshold * most):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("part_words", [2_000_000, 400])
def test_near_duplicates_against_brute_force(spark, part_words):
    texts = near_texts(5)
    df = with_clashes(frame(spark, list(enumerate(texts))).repartition(5))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df, part_words=part_words).collect()}
    assert got == classes(texts)
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, c in got.items() if i == c}


def test_near_duplicates_edges(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    a, b = "a b c d e f", "q r s t u v w"
    turn = [bin(k).count("1") % 2 for k in range(2048)]
    morse = [" ".join(("cat", "dog")[x ^ y] for x in turn) for y in (0, 1)]  # sums over powers of one base agree for these
    rows = [(None, a), (None, a), (4, a), (4, a), (9, "A, b c d e F!"), (5, a), (5, b), (7, b), (7, b), (11, morse[0]), (12, morse[1]), (13, " ".join(long)), (14, " ".join(x for k, x in enumerate(long) if k % 25))]
    df = with_clashes(frame(spark, rows))
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=repr)
    want = [(None, None, True)] * 2 + [(4, 4, True), (4, 4, False), (9, 4, False), (5, 4, False), (5, 5, True), (7, 5, False), (7, 5, False), (11, 11, True), (12, 12, True), (13, 13, True), (14, 13, False)]
    assert got == sorted(want, key=repr)
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, len(r.text)) for r in kept.collect()), key=repr) == sorted([(None, len(a))] * 2 + [(4, len(a)), (5, len(b)), (11, len(morse[0])), (12, len(morse[1])), (13, len(rows[11][1]))], key=repr)
    assert near_dedup.near_duplicates(df.limit(0)).count() == near_dedup.drop_near_duplicates(df.limit(0)).count() == 0


def test_similarity_against_plain_alignment():
    rng = random.Random(1)
    for _ in range(300):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 90))]
        other, swaps = list(words), rng.random() < 0.5
        for _ in range(rng.randrange(0, max(2, len(words) // 8))):
            k = rng.randrange(len(other))
            other[k : k + 1] = ["new"] if swaps else rng.choice([[], ["new"], [other[k], "more"], [other[k], other[k]]])
            other = other or ["z"]
        a, b = near_dedup.texts_of(pa.array([" ".join(words), " ".join(other)]))
        most = max(len(words), len(other))
        want, got, back = lcs(words, other) / most, near_dedup.similarity(a, b), near_dedup.similarity(b, a)
        assert got <= want + 1e-9 and back <= want + 1e-9
        if swaps and len(set(words)) > 5 and want >= 0.8 and len(words) >= 30:
            assert got == pytest.approx(want, abs=0.03)
        elif want > 0.93 and len(words) >= 30:
            assert got > 0.8


def test_recall_by_edit_rate(spark):
    """Copies with words replaced at random, in pairs with their originals among unrelated texts."""
    rng = random.Random(12)
    vocab, rows, n = [f"v{k}" for k in range(3000)], [], 60
    rates = (0.02, 0.05, 0.08, 0.1, 0.12, 0.15, 0.18, 0.3)
    for rate in rates:
        for _ in range(n):
            words = [rng.choice(vocab) for _ in range(300)]
            rows += [words, [f"new{rng.randrange(10**6)}" if rng.random() < rate else w for w in words]]
    df = frame(spark, [(k, " ".join(w)) for k, w in enumerate(rows)])
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    found = [sum(got[k + 1] == got[k] for k in range(2 * n * r, 2 * n * (r + 1), 2)) / n for r in range(len(rates))]
    print("recall by edit rate", dict(zip(rates, found, strict=True)))
    # at 18 % some copies have more than a fifth of their words replaced, and are none
    assert min(found[:3]) == 1 and min(found[3:5]) >= 0.95 and found[5] >= 0.85 and found[6] >= 0.5 and found[7] == 0, found


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (101, 102), (7, 7), (None, 3), (200, 100)]
    got = {r.node: r.comp for r in components(frame(spark, edges, "a bigint, b bigint")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {100: 100, 101: 100, 102: 100, 200: 100}
    assert components(frame(spark, [], "a bigint, b bigint")).count() == 0


# --- 3 token output


def test_tokens_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_output.tokenizer_file())
    rng = random.Random(2)
    texts = [None, "", " ", "It's É x² İ <|endoftext|> foo", "Σς", *("".join(rng.choice("aZ's'trevmd. 19éÖ×÷ß\n\t-¡") for _ in range(60)) for _ in range(150)), "word " * 20_000]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    df = with_clashes(frame(spark, list(zip(ids, texts, strict=True))).repartition(6))
    manifest, folder = token_output.write_tokens(df, token_output.tokenizer_file(), folder=f"file://{tmp_path}/t", shard_tokens=500)
    got = token_output.read_tokens(manifest, folder, with_ids=True).orderBy("doc_id").collect()
    start = 0
    for r, text in zip(got, [t for _, t in sorted(zip(ids, texts, strict=True))], strict=True):
        want = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        assert r.ids == want and (r.start, r.n_tokens) == (start, len(want))
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    assert token_output.write_tokens(df.limit(0), token_output.tokenizer_file())[0].count() == 0
    twice = frame(spark, [(None, "b"), (3, "a"), (3, "a"), (None, "a")])
    assert [r.doc_id for r in token_output.read_tokens(*token_output.write_tokens(twice, token_output.tokenizer_file())).orderBy("start").collect()] == [None, None, 3, 3]


def test_codes_give_random_access():
    rng = np.random.default_rng(3)
    ids = (rng.integers(0, 1 << 32, 3000, dtype=np.uint64) >> rng.integers(0, 32, 3000).astype(np.uint64)).astype(np.uint32)
    reads = []
    data = token_output.dac_bytes(ids, np.array([5, 0]), np.array([False, True]), np.array([0, 10, 3000]))

    def read_at(at, n):
        reads.append(n)
        return data[at : at + n]

    shard = token_output.DacFile(read_at)
    reads.clear()
    assert [shard.token(i) for i in range(3000)] == ids.tolist()
    assert max(reads) <= 64  # one token never takes more than a directory entry's block of bits
    for a, b in [(0, 3000), (511, 513), (7, 7), (2999, 3000)]:
        assert (shard.tokens(a, b) == ids[a:b]).all()
    assert shard.doc_ids() == [5, None] and shard.offsets().tolist() == [0, 10, 3000]
    with pytest.raises(IndexError):
        shard.token(3000)
    empty = token_output.dac_bytes(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool), np.array([0]))
    assert token_output.DacFile(lambda at, n: empty[at : at + n]).tokens(0, 0).tolist() == []


# --- 4 quality


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op4_quality"](spark, d).collect()}
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows.values())
    labels = read_table(spark, d, "labels").collect()
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in labels if rows[r.doc_id].held_out]) > 0.93


def test_quality_edges(spark):
    docs = frame(spark, [(k, ("good clean words here " if k % 2 else "bad### junk$$$ ") * 3) for k in range(60)])
    labels = frame(spark, [(k, k % 2) for k in range(60)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    model = quality.fit_quality(docs, labels)
    odd = with_clashes(frame(spark, [(1, None), (2, ""), (None, "good clean words"), (4, "junk$$$ bad###"), (5, "x" * 3_000_000)]))
    got = {r.doc_id: r.score for r in quality.score_quality(odd, model).collect()}
    assert got[None] > 0.5 > got[4] and got[1] == got[2] and len(got) == 5
    assert quality.fit_quality(docs, labels.limit(0))["bias"] == 0
    twice = quality.score_quality(odd.unionAll(odd), quality.fit_quality(docs, labels.limit(0))).collect()
    assert len(twice) == 10 and {r.score for r in twice} == {0.5}  # a tie, which op4_quality calls class 1
    assert quality.score_quality(odd.limit(0), model).count() == 0


def test_features_are_those_of_characters():
    texts = ["aé b", "", "日本語 テキスト 日本語", "x" * 50 + " é" * 9, None, "ab\tcd"]
    table = {}
    for first, data, offsets in utf8_blocks(pa.array(texts), 12):
        row, bucket = quality.features(data, offsets)
        for r in range(len(offsets) - 1):
            table[first + r] = sorted(bucket[row == r].tolist())
    for k, text in enumerate(texts):
        t = text or ""
        grams = [t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1) if not any(c in " \t" for c in t[i + 1 : i + n - 1])]
        words = t.split()
        again = sum(words[i] == words[i - lag] for lag in range(1, quality.LAGS + 1) for i in range(lag, len(words)))
        assert len(table[k]) == len(grams) + len(words) + again, text
        assert len(set(table[k])) == len(set(grams)) + len(set(words)) + len({lag for lag in range(1, quality.LAGS + 1) for i in range(lag, len(words)) if words[i] == words[i - lag]})


# --- 5 mixing


def test_mixing(spark):
    docs = frame(spark, [(k, f"t{k}", "big" if k % 3 else "small") for k in range(6000)], "doc_id bigint, text string, source string")
    out = mixing.mix_sources(docs, {"big": 1.0, "small": 3.0}, size=2.0)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert n["small"] == pytest.approx(9000, rel=0.05) and n["big"] == pytest.approx(3000, rel=0.08)
    keys = [r.mix_key for r in out.select("mix_key").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    counts = [r["count"] for r in out.where("source = 'small'").groupBy("doc_id").count().collect()]
    counts += [0] * (2000 - len(counts))
    assert np.var(counts) == pytest.approx(4.5, rel=0.12)  # Poisson: the variance is the mean
    odd = frame(spark, [(None, "a", None), (1, None, None), (1, None, None), (2, "", "x")], "doc_id bigint, text string, source string").withColumn("copy_no", F.lit("z"))
    assert set(mixing.mix_sources(odd).columns) == {"doc_id", "text", "source", "copy_no", "mix_key"}
    assert mixing.mix_sources(odd.limit(0)).count() == 0
    assert mixing.mix_sources(docs, {"nowhere": 1.0}).count() == 0
    plain = mixing.mix_sources(docs, max_broadcast_sources=1)
    assert plain.count() == mixing.mix_sources(docs).count()


# --- 6 decontamination


def test_leaks(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(500)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(30)) for k in range(5)] + [(5, None), (6, ""), (7, "two words")]
    edited = items[1][1].split()
    edited[7], edited[20] = "changed", "other"
    del edited[12]
    docs = [
        (0, text(100)), (1, f"{text(50)} {items[0][1]} {text(50)}"), (2, f"{text(20)} {' '.join(edited)}"), (3, None), (4, ""),
        (5, f"x {items[2][1].upper()} y".replace(" ", ", ")), (6, " ".join(items[3][1].split()[:8]) + " " + text(80)), (7, items[4][1] + " " + text(50_000)), (8, "has two words in it"),
    ]
    df = with_clashes(frame(spark, docs))
    bench = frame(spark, items, "item_id bigint, text string")
    for block_words in (10**6, 35):
        hits = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(df, bench, block_words=block_words).collect()}
        assert set(hits) == {(1, 0), (2, 1), (5, 2), (7, 4), (8, 7)}
        assert hits[1, 0].score == 1 and (hits[1, 0].first_word, hits[1, 0].end_word) == (50, 80)
        assert 0.7 < hits[2, 1].score < 1
        clean = decontaminate.decontaminate(df, bench, block_words=block_words)
        assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {0, 3, 4, 6}
    assert decontaminate.find_leaks(df.limit(0), bench).count() == decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_edited_leaks_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(800)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [text(rng.randint(13, 60)) for _ in range(12)]
    docs = [*items, *[text(n) for n in (0, 1, 200, 3000)]]  # exact leaks elsewhere don't make a word rare
    for n in (3, 4, 5, 6):
        for x in items:
            docs.append(f"{text(rng.randint(0, 300))} {' '.join(f'new{i}' if i % n == n - 1 else w for i, w in enumerate(x.split()))} {text(rng.randint(0, 300))}")
    for x in items:
        docs.append(f"{text(50)} {' '.join(f'{w} more' if i % 2 else w for i, w in enumerate(x.split()))} {text(50)}")
        docs.append(f"{text(50)} {' '.join(w for i, w in enumerate(x.split()) if i % 4)} {text(50)}")
    cut = lambda t: next((w for _, w, _ in word_blocks(pa.array([t]))), np.zeros(0, np.uint64))
    want = {(d, i): s for d, t in enumerate(docs) for i, x in enumerate(items) if (s := decontaminate.align(cut(x), cut(t))[0]) >= decontaminate.THRESHOLD}
    found = decontaminate.find_leaks(frame(spark, list(enumerate(docs))), frame(spark, list(enumerate(items)), "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id): r.score for r in found} == want and len(found) == len({(r.doc_id, r.item_id) for r in found})
    assert len(want) > 6 * len(items)


def test_smith_waterman_against_plain():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.smith_waterman(a, b)[0] == h.max()


# --- 7 PII


def feistel(digits, kind, radix, key=pii.KEY):
    """The permutation again, in Python."""
    a, b = digits[: len(digits) // 2], digits[len(digits) // 2 :]
    for r in range(1, pii.ROUNDS + 1):
        stream = "".join(hashlib.sha256(f"{key}|{kind}|{r}|{len(b)}|{a}|{n}".encode()).hexdigest() for n in range(3))
        moved = "".join(pii.ALNUM[(pii.ALNUM.index(c) + int(stream[2 * i : 2 * i + 2], 16)) % radix] for i, c in enumerate(b))
        a, b = moved, a
    return a + b


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10


def test_pseudonyms(spark):
    card = "4845168114407329"
    rows = [
        (1, f"pay {card} or {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}; not 9807915762804490"), (2, "ip 97.51.17.173, 999.1.1.1, v1.2.3.4.5"), (3, "+1 (017) 555-7713 and 017-555-7713"),
        (4, "1990-02-28 1990-02-30 28.02.1990"), (5, None), (6, ""), (7, "no 12 345 here"), (8, "a.b@x.org A.B@x.org"), (9, "DE89 3704 0044 0532 0130 00"), (10, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'),
    ]
    got = {r.doc_id: r for r in pii.pseudonymise(with_clashes(frame(spark, rows))).collect()}
    p = feistel(card[:-1], "card", 10)
    assert got[1].text.startswith(f"pay {p}") and got[1].text.endswith("; not 9807915762804490") and got[1].kinds == ["card", "card"]
    cards = re.findall(r"\d{4} ?\d{4} ?\d{4} ?\d{4}", got[1].text)
    assert cards[0] == cards[1].replace(" ", "") and luhn(cards[0]) == 0
    assert re.fullmatch(r"ip \d+(\.\d+){3}, 999\.1\.1\.1, v1\.2\.3\.4\.5", got[2].text) and got[2].n_private == 1
    national = feistel("0175557713", "phone", 10)
    assert got[3].text == f"+1 ({national[:3]}) {national[3:6]}-{national[6:]} and {national[:3]}-{national[3:6]}-{national[6:]}"
    iso, kept, dotted = got[4].text.split()
    assert kept == "1990-02-30" and iso != "1990-02-28" and dotted == ".".join(reversed(iso.split("-")))
    assert (got[5].text, got[6].text, got[7].text) == (None, "", rows[6][1]) and got[7].n_private == 0
    a, b = got[8].text.split()
    assert a == b and a.endswith("@x.org") and a != "a.b@x.org"
    iban = got[9].text.replace(" ", "")
    assert iban != "DE89370400440532013000" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[10].text) and "04dbebab" not in got[10].text
    assert pii.pseudonymise(frame(spark, [])).count() == 0


def test_private_numbers_beside_others(spark):
    card, iban = "4111111111111111", "AT611904300234573201"
    spaced, grouped = "4111 1111 1111 1111", "AT61 1904 3002 3457 3201"
    amex = "3782 822463 10005"
    new = {c: p + str((10 - luhn(p + "0")) % 10) for c in (card, amex.replace(" ", "")) for p in [feistel(c[:-1], "card", 10)]}
    four = lambda d: " ".join(d[i : i + 4] for i in range(0, len(d), 4))
    account = feistel(iban[4:], "iban", 10)
    safe = f"AT{98 - int(account + '102900') % 97:02d}{account}"
    a, b, x, e = new[card], four(new[card]), new[amex.replace(" ", "")], four(safe)
    cases = {
        f"{spaced} 12/25": f"{b} 12/25", f"{card} 123": f"{a} 123", f"{card} 05/27": f"{a} 05/27", f"42 {card}": f"42 {a}", f"12 34 {spaced}": f"12 34 {b}",
        f"1234 {spaced} 99.": f"1234 {b} 99.", f"{spaced} 123 {spaced}": f"{b} 123 {b}", f"{amex} 1234": f"{x[:4]} {x[4:10]} {x[10:]} 1234", f"{spaced.replace(' ', '-')}-7": f"{b.replace(' ', '-')}-7",
        f"{grouped} BANK AG": f"{e} BANK AG", f"{iban} BANK AG": f"{safe} BANK AG", f"{grouped} {spaced} 12/25": f"{e} {b} 12/25", f"{grouped} BIC": f"{e} BIC",
        "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 17": None, "9" * 5000: None, "AT61 1904 3002 3457 3202 BANK AG": None,
    }
    got = {r.doc_id: r for r in pii.pseudonymise(with_clashes(frame(spark, list(enumerate(cases))))).collect()}
    for k, (text, want) in enumerate(cases.items()):
        assert got[k].text == (text if want is None else want), text[:80]
    assert got[6].kinds == ["card", "card"] and got[11].kinds == ["iban", "card"]
    # a country without a known length; a phone number after another number; more groups than a match once held
    bare = "ZZ00123456789012"
    check = f"{98 - int('123456789012' + '3535' + '00') % 97:02d}"
    zz = four(bare.replace("ZZ00", f"ZZ{check}"))
    rows = pii.pseudonymise(frame(spark, [(0, f"{zz} HAUS"), (1, "100 017-555-7713"), (2, "7 " * 30_000 + card)])).collect()
    rows = {r.doc_id: r for r in rows}
    assert rows[0].kinds == ["iban"] and rows[0].text.endswith(" HAUS") and rows[0].text != f"{zz} HAUS"
    assert rows[1].kinds == ["phone"] and rows[1].text.startswith("100 ") and "7713" not in rows[1].text
    assert rows[2].text.endswith(a) and "card" in rows[2].kinds


def test_feistel_is_a_permutation(spark):
    rows = spark.range(1000).select(F.format_string("%03d", "id").alias("v"))
    got = [r[0] for r in rows.select(F.expr(pii.feistel("v", "k", 10, "key"))).collect()]
    assert len(set(got)) == 1000 and got[:50] == [feistel(f"{k:03d}", "k", 10, "key") for k in range(50)]
    first, last = -pii.DAY_ONE, pii.LAST_DAY - pii.DAY_ONE
    days = spark.range(first, last + 1, 97).unionAll(spark.range(last - 3000, last + 1)).distinct().select(F.expr(pii._day("cast(id as int)", "key")).alias("d"), "id").collect()
    assert len({r.d for r in days}) == len(days) and all((r.d - first) // pii.CYCLE == (r.id - first) // pii.CYCLE and first <= r.d <= last and r.d != r.id for r in days)
    one = spark.range(36).select(F.expr(f"substr('{pii.ALNUM}', cast(id as int) + 1, 1)").alias("v"))
    both = one.unionAll(one.crossJoin(one.toDF("w")).select(F.concat("v", "w")))  # names of one and of two characters
    got = both.select("v", F.expr(pii.moved_always("v", "email", 36, "key")).alias("p")).collect()
    assert len({r.p for r in got}) == len(got) and all(r.p != r.v and len(r.p) == len(r.v) for r in got)
    back = spark.range(200).select(F.format_string("%07d", F.col("id") * 49_999).alias("v")).select("v", F.expr(pii.feistel("v", "k", 10, "key")).alias("p"))
    assert back.where(F.expr(pii.feistel("p", "k", 10, "key", inverse=True)) != F.col("v")).count() == 0


def test_nothing_found_stays_or_leaves_its_form(spark):
    """Random mixtures of private values and look-alikes: finding and validating again, in Python."""
    rng = random.Random(21)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def good(kind, v):
        d = re.sub(r"\D", "", v)
        if kind == "card":
            return 13 <= len(d) <= 19 and luhn(d) == 0
        if kind == "ssn":
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        if kind == "ipv4":
            return all(int(x) <= 255 for x in v.split("."))
        if kind == "date":
            y, m, day = (int(x) for x in (v.split("-") if "-" in v else reversed(re.split("[./]", v))))
            try:
                return bool(datetime.date(y, m, day))
            except ValueError:
                return False
        if kind == "iban":
            return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
        return True

    def value(kind):
        if kind == "email":
            return "".join(rng.choice("aZ9.ёжöé京") for _ in range(rng.randint(1, 8))).strip(".").replace("..", ".") or "q"
        return {
            "card": lambda: digits(16), "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", "ipv4": lambda: ".".join(str(rng.randrange(300)) for _ in range(4)),
            "date": lambda: rng.choice([f"{rng.randint(0, 9999):04d}-{rng.randint(0, 13):02d}-{rng.randint(0, 32):02d}", f"{rng.randint(1, 31):02d}.{rng.randint(1, 12):02d}.{rng.randint(0, 9999):04d}", "9999-12-31", "0001-01-01", "31/12/9999"]),
            "iban": lambda: f"DE{digits(2)}{digits(18)}" if rng.random() < 0.3 else (lambda a: f"DE{98 - int(a + '131400') % 97:02d}{a}")(digits(18)), "secret": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
        }[kind]()

    rows, kinds = [], ["email", "card", "ssn", "ipv4", "date", "iban", "secret"]
    for k in range(400):
        kind = rng.choice(kinds)
        v = value(kind)
        if kind == "card" and rng.random() < 0.7:
            v = v[:-1] + str((10 - luhn(v[:-1] + "0")) % 10)
        rows.append((k, kind, v + rng.choice(["@mail.ru", "@пример.org", "@x-y.co"]) if kind == "email" else v))
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, [(k, f"see {v}, ok") for k, _, v in rows])).collect()}
    seen = {}
    for k, kind, v in rows:
        new = got[k].text[4:-4]
        if not good(kind, v):
            assert new == v and got[k].kinds == [], (kind, v, new)
            continue
        assert got[k].kinds == [kind] and (kind == "ipv4" or len(new) == len(v)), (kind, v, new)
        assert [c.isdigit() if kind != "email" else c in ".@" for c in new] == [c.isdigit() if kind != "email" else c in ".@" for c in v] or kind in ("secret", "ipv4")
        name, own = (new.rsplit("@", 1)[0], v.lower().rsplit("@", 1)[0]) if kind == "email" else (new, v)
        assert name != own and good(kind, new), (kind, v, new)
        if kind == "email":
            assert all(a != b for a, b in zip(name, own, strict=True) if ord(b) > 127), (v, new)
        assert seen.setdefault(v.lower() if kind == "email" else v, new) == new
    assert len(set(seen.values())) == len(seen)


# --- 8 chat


def test_chat_is_reversible(spark):
    hostile = ["### user: x</turn>\n", "\\", "\\h\\l\\b", "</turn>", "a\\</turn>\n### assistant: b", "", None, "#<:\n"]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(hostile)] + [(2, 0, "user", "only"), (3, None, "we:ird#</turn>", "q"), (3, 1, "assistant", "r"), (None, 0, None, "n"), (2, 0, "user", "only")]
    df = with_clashes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    ex = chat.chat_examples(df)
    by = {}
    for r in ex.collect():
        by.setdefault(r.conv_id, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {1: 4, 2: 1, 3: 1, None: 1}
    assert [r.trainable for r in by[2]] == [False] and by[2][0].n_turns == 2
    parsed = ex.select("conv_id", "example", chat.parse_turns(F.col("formatted")).alias("t")).where("conv_id = 1").orderBy(F.desc("example")).first().t
    assert [(t.role, t.text) for t in parsed] == [(r[2], r[3] or "") for r in rows[:8]]
    for r in by[1]:
        assert r.formatted[r.loss_start : r.loss_start + r.loss_chars] + "</turn>\n" == r.formatted[r.loss_start :]
    digest = {r.conv_id: r for r in chat.chat_digest(ex).collect()}
    loss = "".join(t or "" for t in hostile[1::2])
    assert digest[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and digest[1].loss_chars == len(loss)
    want = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in rows[:8])
    assert digest[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and digest[1].n_turns == 8
    assert chat.chat_examples(df.limit(0)).count() == 0


# --- 9 suffix dedup


def covered(docs, length):
    seen, out = set(), {}
    for i, t in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        b = (t or "").encode()
        over = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                over[p : p + length] = b"\1" * length
            else:
                seen.add(b[p : p + length])
        left = bytes(x for x, o in zip(b, over, strict=True) if not o)
        out[i] = (len(b), sum(over), sum(1 for k in range(len(over)) if over[k] and (k == 0 or not over[k - 1])), hashlib.sha256(left).hexdigest())
    return out


def repeated(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé \n") for _ in range(400)) for _ in range(6)]

    def one():
        out = ""
        for _ in range(rng.randrange(4)):
            k = rng.randrange(400)
            out += rng.choice(base)[k : k + rng.randrange(60, 300)] + "ab" * rng.choice([0, 0, 120])
        return out

    docs = [(i, None if rng.random() < 0.03 else one()) for i in range(120)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("settings", [{}, {"heavy_runs": 2, "most_runs": 6, "chunk_runs": 3}, {"heavy_runs": 1, "length": 20, "anchor": 8}])
def test_suffix_dedup_against_brute_force(spark, settings):
    docs = repeated(9)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(with_clashes(frame(spark, docs).repartition(7)), **settings).collect()}
    assert got == covered(docs, settings.get("length", 100))


def test_suffix_dedup_edges(spark):
    rng = random.Random(1)
    long = "".join(rng.choices("abcdef ", k=5_000_000))
    docs = [(None, long[:500]), (1, long), (1, long), (7, long[1000:2000] + "x" * 99), (8, None), (9, "")]
    got = {(r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(frame(spark, docs)).collect()}
    assert got == {(None, 0), (1, 0), (7, 1000), (8, 0), (9, 0)}
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0
    rng = random.Random(8)
    x, y = ("".join(rng.choice("abcdefghij ") for _ in range(300)) for _ in range(2))
    twice = [(1, x), (2, y), (2, x), (2, x), (None, x), (3, y)]  # ids that repeat with other texts lose none that occurs once
    out = suffix_dedup.remove_repeats(frame(spark, twice)).collect()
    sha = {hashlib.sha256(t.encode()).hexdigest(): n for n, t in (("x", x), ("y", y))}
    removed = sorted(((r.doc_id or 0, sha.get(r.kept_sha256, "-"), r.n_removed) for r in out), key=repr)
    assert (0, "x", 0) in removed and (1, "x", 0) in removed and len(out) == 6
    two = [r for r in removed if r[0] == 2]
    assert two in ([(2, "-", 300), (2, "-", 300), (2, "y", 0)], [(2, "x", 0), (2, "x", 0), (2, "y", 0)])
    assert (3, "-", 300) in removed or two[0][1] == "-"  # y is covered where the document 2 is y
    kept = suffix_dedup.remove_repeats(frame(spark, [(1, long[:200]), (2, "é" + long[:150])]), with_text=True).orderBy("doc_id").collect()
    assert bytes(kept[1].kept) == "é".encode()


def test_suffix_sort_survives_collisions(monkeypatch):
    rng = np.random.default_rng(2)
    runs = [bytes(rng.integers(97, 99, 120).astype(np.uint8)) for _ in range(12)] * 2
    n = len(runs)
    args = (np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64), np.full(n, 20), np.full(n, 20), runs)
    want = sorted(zip(*(x.tolist() for x in suffix_dedup.covered_strings(*args)), strict=True))
    monkeypatch.setattr(suffix_dedup, "_CODE", np.ones(256, np.uint64))  # every string hashes alike
    assert sorted(zip(*(x.tolist() for x in suffix_dedup.covered_strings(*args)), strict=True)) == want


def test_classes_survive_collisions(monkeypatch):
    """All anchors under one hash: runs that count as one class still agree byte by byte."""
    rng = random.Random(6)
    base = ["".join(rng.choice("ab") for _ in range(260)) for _ in range(5)]
    texts = [t for t in base * 3] + [t[:130] + "c" + t[130:] for t in base]
    monkeypatch.setattr(suffix_dedup, "_CODE", np.ones(256, np.uint64))
    mapped = list(suffix_dedup._mapper(100, 32)(pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t])], names=["doc", "text"]) for k, t in enumerate(texts)))
    rows = sorted((r["anchor"], r["c1"], r["c2"], r["doc"], r["pos"]) for b in mapped for r in b.to_pylist() if not r["covered"])
    cut = lambda doc, pos: texts[doc][pos >> 16 : (pos >> 16) + (pos & 255) + 100]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)] + [pa.array([False] * len(rows))], names=["anchor", "c1", "c2", "doc", "pos", "covered"])
    covered = [r for b in suffix_dedup._classer(iter([batch.slice(0, 7), batch.slice(7)])) for r in b.to_pylist() if r["anchor"] is None]
    assert len(covered) > 10
    for r in covered:  # its bytes start earlier, too
        string = texts[r["doc"]][r["first"] : r["first"] + r["more"] + 100]
        assert any(string in texts[d] for d in range(r["doc"])) or texts[r["doc"]].find(string) < r["first"]
    groups = {}
    for a, c1, c2, doc, pos in rows:
        assert groups.setdefault((a, c1, c2), cut(doc, pos)) == cut(doc, pos)


# --- 10 exact dedup


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups(spark, bits):
    rng = random.Random(8)
    long = ["".join(rng.choice("abcd \n") for _ in range(30_000)) for _ in range(3)]
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a b", " a b", *long, long[0][:-1], long[0].replace("\n", " "), long[1] + "x"]
    docs = [(k, t) for k, t in enumerate(texts * 2)] + [(None, "a b"), (None, "only"), (5, "a  b")]
    got = exact_dedup.exact_groups(with_clashes(frame(spark, docs).repartition(4)), digest_bits=bits).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in docs:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in docs:
        own = groups[norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_chunks_follow_content():
    rng = random.Random(3)
    data = bytes(rng.choice(b"abcdef ") for _ in range(200_000))
    pieces = lambda d: {d[a:b] for a, b in zip([0, *exact_dedup.cut_points(d)], exact_dedup.cut_points(d), strict=False)}
    assert b"".join(data[a:b] for a, b in zip([0, *exact_dedup.cut_points(data)], exact_dedup.cut_points(data), strict=False)) == data
    assert len(pieces(data) & pieces(b"inserted" + data)) > 0.8 * len(pieces(data))


# --- pipeline


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    d = SF
    docs = read_table(spark, d, "documents")
    texts = {r.doc_id: r for r in docs.collect()}
    kept = {i for i, r in texts.items() if any(c.isalpha() for c in r.text or "")}
    order = sorted(kept)
    by = classes([texts[i].text for i in order])
    kept = {order[i] for i, c in by.items() if i == c}
    words = lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower()))
    items = [words(r.text) for r in read_table(spark, d, "benchmark").collect()]
    leaks = {i for i in kept if any(f" {x} " in f" {words(texts[i].text)} " for x in items)}
    kept -= leaks
    out = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in out} <= kept and len(out) == pytest.approx(len(kept), rel=0.25)
    got = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, got, d)
        assert got.columns == docs.columns, name
    assert {r.doc_id for r in got.collect()} == kept
    ordered = sorted(out, key=lambda r: r.start)
    mixed = mixing.mix_sources(got).orderBy("mix_key").collect()
    assert [r.doc_id for r in ordered] == [r.doc_id for r in mixed] != sorted(r.doc_id for r in out)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:], strict=False))


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null cells, repeated ids, repeated rows, columns that clash, and no rows at all."""
    import corpus_pipeline

    docs = read_table(spark, SF, "documents")
    words = docs.where("length(text) > 400").orderBy("doc_id").limit(2).collect()
    a, b = words[0].text, words[1].text
    odd = frame(spark, [(None, a, None, None, None), (-1, None, None, None, 0), (-2, "", "en", "x", 0), (-3, a, None, None, 1), (-3, b, "en", None, 1), (-4, b, "en", "x", 1), (-4, b, "en", "x", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = ["keep", "id", "h", "row", "node", "_of", "origin", "at"]
    for name, rows in (("odd", docs.select(*odd.columns).unionAll(odd)), ("empty", odd.limit(0))):
        rows = rows.select("*", *[F.lit("x").alias(c) for c in clash])
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        read_table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").orderBy("start").collect()
    assert got and {-1, -2}.isdisjoint(r.doc_id for r in got)  # no language
    assert all(x.start + x.n_tokens == y.start for x, y in zip(got, got[1:], strict=False))
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    stage = corpus_pipeline.near_dedup_stage(spark, spark.read.parquet(f"{tmp_path}/odd/documents.parquet"), SF)
    assert stage.where("doc_id in (-3, -4)").count() == 2 and stage.where("doc_id is null").count() == 1  # -4: b; -3: a; the null id stays
