"""Language ID by word-first backoff.

A known word adds its log frequency in each language. A word that the training texts don't have is
scored by its longest character n-grams that they do have, down to single letters.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import arrow_map
from .common import read_table, release_others

#: Bounds of the model: training documents (in expectation), words and n-grams kept, each for a language.
TRAIN_DOCS, MAX_WORDS, MAX_GRAMS = 3_000, 10_000, 15_000
LONGEST, LEAST, EVIDENCE, CACHED = 5, 3, 12.0, 100_000
#: The least share of words that are known, or have a known n-gram of KNOWN characters or more, in a text to be kept.
#: The least of 17,188 held-out rows of the check tool's 0.10 GB has 0.714; texts in an unlearned script have 0.
MIN_KNOWN, KNOWN = 0.5, 3
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column, fold: int = 1, folds: int = 3) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


def grams_of(word: str, n: int) -> list[str]:
    w = f"^{word}$" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def fit_language_model(docs: DataFrame, train_docs: int = TRAIN_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict:
    """Learns from rows with a text and a language.

    The sample is bounded: about train_docs rows a language, chosen by a hash of the id; the model holds
    of each language its max_words most frequent words and max_grams n-grams, so that large languages don't
    take the places of small ones. Ties of frequency go to the word that sorts first; repeated rows count as
    often as they come. An empty table gives a model without languages, which predicts `und` always.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": [], "words": {}, "grams": {}, "vectors": np.zeros((0, 0), np.float32)}
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, train_docs / counts[lang]))).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) < share * (1 << 20))
    words = picked.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{Nl}\p{No}]+)"), 1)).alias("w"))
    words = words.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    grams = None
    for n in range(1, LONGEST + 1):
        w = "w" if n == 1 else "concat('^', w, '$')"
        cut = f"transform(sequence(1, greatest(length({w}) - {n - 1}, 1)), i -> substr({w}, i, {n}))"
        one = words.select("lang", "n", F.explode(F.expr(cut)).alias("w")).where(F.length("w") == n)
        grams = one if grams is None else grams.unionAll(one)
    grams = grams.groupBy("lang", "w").agg(F.sum("n").alias("n"))

    def most(table: DataFrame, bound: int) -> dict[str, dict[str, int]]:
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
        top = table.where(F.col("n") >= LEAST).withColumn("r", rank).where(F.col("r") <= bound).select("w").distinct()
        found = table.join(top, "w").groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
        return {r["w"]: r["by"] for r in found.orderBy("w").collect()}  # bounded: languages x bound

    index, vectors = {lang: i for i, lang in enumerate(langs)}, []

    def table(found: dict[str, dict[str, int]], start: int, by_length: bool) -> dict[str, int]:
        groups: dict[int, list[str]] = {}
        for w in found:
            groups.setdefault(len(w) if by_length else 0, []).append(w)
        ids = {}
        for own in groups.values():
            n = np.zeros((len(own), len(langs)))
            for i, w in enumerate(own):
                ids[w] = start + i
                for lang, c in found[w].items():
                    n[i, index[lang]] = c
            start += len(own)
            vectors.append(np.log((n + 0.1) / (n.sum(axis=0) + 0.1 * len(own))).astype(np.float32))
        return ids

    word_ids = table(most(words, max_words), 0, by_length=False)
    gram_ids = table(most(grams, max_grams), len(word_ids), by_length=True)
    return {"langs": langs, "words": word_ids, "grams": gram_ids, "vectors": np.concatenate(vectors) if vectors else np.zeros((0, len(langs)), np.float32)}


class Scorer:
    def __init__(self, model: dict):
        self.langs, self.words, self.grams = model["langs"], model["words"], model["grams"]
        # a last column says whether a row counts as known
        known = np.ones((len(model["vectors"]), 1), np.float32)
        known[[i for g, i in self.grams.items() if len(g) < KNOWN]] = 0
        self.vectors = np.concatenate([model["vectors"], known], axis=1)
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((0, self.vectors.shape[1]), np.float32)
        self.older, self.older_rows = self.cache, self.rows

    def evidence(self, word: str) -> list[int]:
        """Rows of the model that speak for a word: its own, or those of its longest known n-grams."""
        i = self.words.get(word)
        if i is not None:
            return [i]
        get = self.grams.get
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            found = [i for g in grams_of(word, n) if (i := get(g)) is not None]
            if found:
                return found
        return []

    def vectors_of(self, words: list[str]) -> np.ndarray:
        """Mean log frequencies of each word's evidence, by language, and whether the word is known; 0 without any."""
        own = [self.evidence(w) for w in words]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        out = np.zeros((len(own), self.vectors.shape[1]), np.float32)
        some = np.flatnonzero(sizes)
        if len(some):
            flat = self.vectors[np.fromiter(chain.from_iterable(own), np.int64, int(sizes.sum()))]
            starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            out[some] = np.add.reduceat(flat, starts, axis=0) / sizes[some, None]
        return out

    def _learn(self, words: set[str]) -> None:
        """Puts the vectors of all words into the cache; older is the generation before it."""
        unseen = words.difference(self.cache)
        if len(self.cache) + len(unseen) > CACHED:
            self.older, self.older_rows = self.cache, self.rows
            self.cache, self.rows, unseen = {}, self.rows[:0], words
        if unseen:
            known = [w for w in unseen if w in self.older]
            fresh = [w for w in unseen if w not in self.older]
            again = self.older_rows[np.fromiter(map(self.older.__getitem__, known), np.int64, len(known))]
            first = len(self.cache)
            self.rows = np.concatenate([self.rows, again, self.vectors_of(fresh)])
            self.cache.update(zip([*known, *fresh], range(first, first + len(unseen)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        return [(lang, score) for lang, score, _ in self.judge(texts)]

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, share of known words) of each text."""
        cut = [[w for w in WORD.findall((t or "").lower())] for t in texts]
        if not self.langs:
            return [("und", 0.0, 0.0)] * len(texts)
        self._learn(set().union(*cut) if cut else set())
        get, out = self.cache.__getitem__, []
        for own in cut:
            if not own or not any(c.isalpha() for w in own for c in w):
                out.append(("und", 0.0, 0.0))
                continue
            mean = self.rows[np.fromiter(map(get, own), np.int64, len(own))].mean(axis=0, dtype=np.float64)
            mean, known = mean[:-1], float(mean[-1])
            odds = np.exp((mean - mean.max()) * min(len(own), EVIDENCE))
            best = int(np.argmax(odds))
            out.append((self.langs[best], float(odds[best] / odds.sum()), known))
        return out


def _predictor(model):
    def run(batches):
        release_others("language_id")
        scorer = Scorer(model.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            langs, scores = [], []
            at, n = 0, len(ids)
            while at < n:
                upto, size, own = at, 0, []
                while upto < n and (size < 1 << 20 or upto == at):
                    own.append(texts[upto].as_py())
                    size += len(own[-1] or "")
                    upto += 1
                for lang, score in scorer.predict(own):
                    langs.append(lang)
                    scores.append(score)
                at = upto
            yield pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *batch.columns[2:]], names=["id", "lang_pred", "score", *batch.schema.names[2:]])

    return run


def predict_language(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score (0 to 1) of every row; only the text is an input of the prediction.

    A null text, or one without a letter, is `und` with score 0. Ties go to the language that sorts
    first. Repeated rows are predicted each; an empty table gives an empty result; other columns are
    not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see fit_language_model
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    return arrow_map(rows, _predictor(shared), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def _keeper(model, at: int, min_score: float, min_known: float):
    def run(batches):
        release_others("language_id")
        scorer = Scorer(model.value)
        for batch in batches:
            texts, n, keep, row = batch.column(at), len(batch), [], 0
            while row < n:
                upto, size, own = row, 0, []
                while upto < n and (size < 1 << 20 or upto == row):
                    own.append(texts[upto].as_py())
                    size += len(own[-1] or "")
                    upto += 1
                keep += [lang != "und" and score >= min_score and known >= min_known for lang, score, known in scorer.judge(own)]
                row = upto
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_languages(docs: DataFrame, model: dict, min_score: float = 0.0, text_col: str = "text", min_known: float = 0.0) -> DataFrame:
    """docs without the rows that are `und`, score below min_score or have a smaller share of known words than min_known; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_map(docs, _keeper(shared, docs.columns.index(text_col), min_score, min_known), docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(~held_out(F.col("doc_id"))))
    found = predict_language(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
