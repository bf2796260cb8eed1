"""Ties, repeated rows, very long texts, repeated labels and items, empty tables."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_new_operators import frame, with_clashes

from tessera.llm import chat, decontaminate, exact_dedup, langid, pii, quality, token_output


def test_language_edges(spark):
    rows = [(k, *x) for k, x in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30)]
    learned = frame(spark, rows, "doc_id bigint, text string, lang string")
    model = langid.fit_language_model(with_clashes(learned.unionAll(frame(spark, [(None, None, "en"), (3, "x", None), (0, "the cat and the dog", "en")], "doc_id bigint, text string, lang string"))))
    long = "der hund und die katze " * 5_000
    tied = "the hund"  # a known word of either language
    docs = with_clashes(frame(spark, [(1, long), (2, tied), (2, tied), (3, None), (4, ""), (None, "the dog"), (5, "12 34")]))
    got = langid.predict_language(docs, model).collect()
    assert len(got) == 7
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert by[1][0][0] == "de" and by[None][0][0] == "en" and by[2][0] == by[2][1] and 0 <= by[2][0][1] <= 1
    assert {by[k][0][0] for k in (3, 4, 5)} == {"und"}
    assert langid.predict_language(frame(spark, []), model).collect() == []
    none = langid.fit_language_model(learned.limit(0))
    assert {r.lang_pred for r in langid.predict_language(docs, none).collect()} == {"und"}


def test_long_texts_keep_their_tokens(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    long = " ".join(rng.choice(["Straße", "cat's", "日本", "x" * 40, "don't!"]) for _ in range(30_000))
    tok = Tokenizer.from_file(token_output.tokenizer_file())
    manifest, folder = token_output.write_tokens(with_clashes(frame(spark, [(2, long), (1, "a b"), (3, None)])), token_output.tokenizer_file())
    got = {r.doc_id: r for r in token_output.read_tokens(manifest, folder, with_ids=True).collect()}
    assert list(got[2].ids) == [*tok.encode(long, add_special_tokens=False).ids, token_output.END_ID]
    assert (got[1].start, got[2].start, got[3].start) == (0, got[1].n_tokens, got[1].n_tokens + got[2].n_tokens) and got[3].n_tokens == 1


def test_quality_repeats(spark):
    docs = frame(spark, [(k, ("good clean words here " if k % 2 else "bad### junk$$$ ") * 3) for k in range(60)] + [(1, "good clean words"), (1, "good clean words")])
    labels = frame(spark, [(k, k % 2) for k in range(60)] + [(1, 1), (2, 1)], "doc_id bigint, quality int")
    model = quality.fit_quality(with_clashes(docs), with_clashes(labels))
    got = quality.score_quality(with_clashes(docs.unionAll(frame(spark, [(77, "good clean words here " * 60_000)]))), model).collect()
    assert len(got) == 63 and all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got)


def test_repeated_benchmark_items(spark):
    rng = random.Random(9)
    item = " ".join(f"q{rng.randrange(10**6)}" for _ in range(30))
    docs = frame(spark, [(1, f"before {item} after"), (1, f"before {item} after"), (2, "nothing of it"), (3, item + " filler" * 20_000)])
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "")], "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.score) for r in decontaminate.find_leaks(with_clashes(docs), with_clashes(items)).collect())
    assert got == [(1, 7, 1.0)] * 4 + [(3, 7, 1.0)] * 2
    assert [r.doc_id for r in decontaminate.decontaminate(docs, items).collect()] == [2]
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(1_200))  # an item longer than a block
    got = decontaminate.find_leaks(frame(spark, [(1, long), (2, "w1 w2")]), spark.createDataFrame([(1, long)], "item_id bigint, text string"), block_words=500).collect()
    assert [(r.doc_id, r.first_word, r.end_word) for r in got] == [(1, 0, 1_200)]


def test_chunks_of_texts_without_cut_points(spark):
    """One character many times has no content-defined cut, so chunks end at the forced length."""
    same, other = "a" * 300_000, "a" * 299_999 + "b"
    rows = [(5, same), (3, same), (4, other), (9, "\t a"), (8, " \n a"), (8, " a"), (None, same)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(with_clashes(frame(spark, rows))).collect()}
    assert {(5, 3, 3, False), (4, 4, 1, True)} <= got or {(5, 3, 2, False), (4, 4, 1, True)} <= got
    assert len([g for g in got if g[0] == 8]) >= 1 and {g[1] for g in got if g[0] in (8, 9)} == {8}
    cuts = exact_dedup.cut_points(b"a" * 300_000)
    sizes = np.diff([0, *cuts])
    assert max(sizes) <= 65_536 and sum(sizes) == 300_000


def test_private_data_in_long_and_repeated_rows(spark):
    text = "call 555-123-4567 or write ann@example.com " * 200
    got = pii.pseudonymise(with_clashes(frame(spark, [(1, text), (1, text), (2, None), (3, "")]))).collect()
    kept = [r for r in got if r.doc_id == 1]
    assert len(got) == 4 and kept[0] == kept[1]
    assert not any("555-123-4567" in str(v) or "ann@example.com" in str(v) for v in kept[0])


def test_long_turns(spark):
    text = "### Assistant: \\ </turn> " * 2_000
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", text), (2, 0, "user", text), (2, 1, "assistant", None)], "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.chat_digest(chat.chat_examples(with_clashes(rows))).collect()}
    assert got[1].loss_chars == len(text) and got[2].loss_chars == 0 and got[1].n_turns == got[2].n_turns == 2
    assert chat.chat_examples(rows.limit(0)).count() == 0 and chat.chat_examples(rows).where(F.col("conv_id") == 1).count() == 1
