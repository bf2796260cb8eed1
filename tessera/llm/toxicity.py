"""Toxicity by multiple-instance learning.

Labels are of documents, but a few sentences make a document toxic. A sentence's log odds are a bias and the weights
of its words and character n-grams; a document is toxic unless all its sentences are clean (noisy-or):
P = 1 - product of (1 - p). The weights are learned from labelled documents by gradient descent through that
product, which credits the sentences that explain a label; the same weights then locate the offending sentences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import arrow_map
from .common import byte_table, mix64, prefix_hashes, read_table, span_hashes, utf8_blocks
from .langid import held_out

#: Bounds of the training sample (in expectation): rows of class 1 and of class 0, bytes of text.
TOXIC_ROWS, CLEAN_ROWS, TRAIN_BYTES = 1_500, 3_000, 8 << 20
#: The model's sizes: weights, n-grams of characters, passes, step, log odds of a sentence without features, documents that a learned
#: feature is in at least, standard deviations by which these are more often of class 1 than chance explains.
BUCKETS, GRAMS, EPOCHS, RATE, BIAS, SPREAD, TELLING = 1 << 20, (3, 4, 5, 6), 8, 0.5, -4.0, 3, 3.0
#: A sentence of more bytes is cut at spaces; features are made for so many bytes at once.
LONGEST, SLICE = 1_000, 1 << 19
_CODE = byte_table(31)
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals of Latin-1 in lower case, in the places where they were."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    after = np.concatenate([[False], data[:-1] == 0xC3])
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the sentences of a block's texts.

    A sentence ends before white space that follows . ! or ?, at the end of a line, at the end of its text, and, where it has more
    than LONGEST bytes, at the next space (or character, if none comes within LONGEST bytes).
    """
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    space = (data == 32) | ((data >= 9) & (data <= 13))
    stop = (data == 46) | (data == 33) | (data == 63)
    cut = np.concatenate([stop[:-1] & space[1:], [True]]) | (data == 10)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    ends = np.flatnonzero(cut | edge[1:]) + 1
    starts = np.concatenate([[0], ends[:-1]])
    long = np.flatnonzero(ends - starts > LONGEST)
    if len(long):
        more = []
        first = (data & 0xC0) != 0x80
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            while b - a > LONGEST:
                a += LONGEST
                near = space[a : min(a + LONGEST, b)]
                k = int(near.argmax()) if near.any() else int(first[a : a + 4].argmax())
                a += k
                if a < b:
                    more.append(a)
        ends = np.unique(np.concatenate([ends, np.array(more, np.int64)]))
        starts = np.concatenate([[0], ends[:-1]])
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the sentences that bounds cut data into: (sentence, bucket), in no order.

    Words are runs of letters, digits and characters beyond ASCII; n-grams lie in a word and the gaps at its ends.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _INSIDE[data]
    plain = np.where(inside, lowered(data), 32).astype(np.uint8)
    prefix = prefix_hashes(_CODE[plain])
    row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    chars = np.concatenate([np.flatnonzero((data & 0xC0) != 0x80), [n]])
    gaps = np.concatenate([[0], np.cumsum(~inside[chars[:-1]])])
    rows, found = [], []
    for k in GRAMS:
        i = np.arange(max(len(chars) - k, 0))
        i = i[(gaps[i + k - 1] == gaps[i + 1]) & (row_of[chars[i]] == row_of[chars[i + k - 1]])]
        rows.append(row_of[chars[i]])
        found.append(mix64(span_hashes(prefix, chars[i], chars[i + k]) + np.uint64(k)))
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begins = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    rows.append(row_of[begins])
    found.append(mix64(span_hashes(prefix, begins, ends) + np.uint64(99)))
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(16)).astype(np.int64) % BUCKETS


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's features, sentence by sentence, and where a sentence's begin; sentences without any are left out."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for _, data, offsets in utf8_blocks(texts, SLICE):
        starts, ends, rows = sentences(data, offsets)
        sent, bucket = features(data, np.concatenate([starts, ends[-1:]]))
        order = np.argsort(sent, kind="stable")
        sent, bucket = sent[order], bucket[order].astype(np.int32)
        cuts = np.searchsorted(rows[sent] if len(sent) else np.zeros(0, np.int64), np.arange(len(offsets)))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = sent[a:b]
            out.append((bucket[a:b], np.flatnonzero(np.diff(own, prepend=-1)) if len(own) else np.zeros(0, np.int64)))
    return out


def telling(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Which buckets are in more documents of class 1 than chance explains: by TELLING standard deviations, in SPREAD or more."""
    inside = np.zeros((2, BUCKETS))
    for (bucket, _), y in zip(docs, labels, strict=True):
        inside[y, np.unique(bucket)] += 1
    both, share = inside.sum(axis=0), labels.mean()
    return (both >= SPREAD) & (inside[1] - both * share > TELLING * np.sqrt(both * share * (1 - share)))


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> dict:
    """weights (a number a bucket) and bias, from bags() and labels 0 and 1, by the log loss of the noisy-or.

    Only telling() buckets get a weight; a sentence without any has the bias alone.
    """
    labels = np.asarray(labels, np.int64)
    weights, bias = np.zeros(BUCKETS), BIAS
    if not len(labels) or labels.min() == labels.max():
        return {"weights": weights.astype(np.float32), "bias": BIAS if not len(labels) or not labels[0] else -BIAS}
    known, cases = telling(docs, labels), []
    for bucket, begins in docs:
        sent = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(bucket))))
        keep = known[bucket]
        own = sent[keep]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        cases.append((bucket[keep], first, np.append(first[1:], len(own)) - first, len(begins) - len(first)))
    rng, seen, turns = np.random.Generator(np.random.PCG64(seed)), np.full(BUCKETS, 1e-2), 1e-2
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            bucket, first, size, bare = cases[i]
            done += 1
            z = np.clip(np.add.reduceat(weights[bucket], first) + bias, -30, 30) if len(first) else np.zeros(0)
            p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-bias))
            clean = float(np.exp(-np.log1p(np.exp(z)).sum() - bare * np.log1p(np.exp(bias))))  # the product of 1 - p
            back = -clean / max(1 - clean, 1e-9) if labels[i] else 1.0
            step, slope, base = rate * (1 - done / (steps + 1)), p * back, back * (float(p.sum()) + bare * p0)
            turns += base * base
            bias -= step * base / turns**0.5
            by = np.repeat(slope, size)
            np.add.at(seen, bucket, by * by)
            np.subtract.at(weights, bucket, step * by / np.sqrt(seen[bucket]))
    return {"weights": weights.astype(np.float32), "bias": float(bias)}


def fit_toxicity(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, train_bytes: int = TRAIN_BYTES, label_col: str = "toxic") -> dict:
    """Trains on a bounded sample of the labelled rows, chosen by a hash of doc_id: about toxic_rows of class 1 and
    clean_rows of class 0, and fewer of both where their whole texts have more than train_bytes bytes.

    Rows without a label, an id or a text are passed over; repeated rows count as often as they come. Without
    labelled rows of both classes the model scores all texts that have sentences alike.
    """
    marked = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = [min(1.0, most / max(counts.get(y, 0), 1)) for y, most in ((0, clean_rows), (1, toxic_rows))]

    def sample(share: float) -> DataFrame:
        part = F.when(F.col("y") == 1, F.lit(shares[1] * share)).otherwise(F.lit(shares[0] * share))
        picked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20))
        # about toxic_rows + clean_rows narrow rows: bounded by the parameters
        return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")

    size, share = sample(1.0).agg(F.sum(F.octet_length("text"))).first()[0] or 0, 1.0
    if size > train_bytes:
        share = train_bytes / size
    rows = sample(share).orderBy("doc_id", "text", "y").select("text", "y").toArrow()
    return train(bags(rows.column("text")), rows.column("y").to_pylist())


def _scorer(model, threshold: float):
    def run(batches):
        weights, bias = model.value["weights"], model.value["bias"]
        for batch in batches:
            ids, scores, found = batch.column(0), np.zeros(len(batch)), [[] for _ in range(len(batch))]
            for first, data, offsets in utf8_blocks(batch.column(1), SLICE):
                starts, ends, rows = sentences(data, offsets)
                if not len(starts):
                    continue
                place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
                z = np.empty(len(starts))
                # whole sentences, so many that their features stay small, however long the text is
                group = np.concatenate([[0], np.flatnonzero(np.diff(starts // SLICE)) + 1, [len(starts)]])
                for a, b in zip(group[:-1], group[1:], strict=True):
                    bounds = np.concatenate([starts[a:b], ends[b - 1 : b]]) - starts[a]
                    sent, bucket = features(data[starts[a] : ends[b - 1]], bounds)
                    worded = np.bincount(sent, minlength=b - a) > 0
                    z[a:b] = np.where(worded, np.clip(np.bincount(sent, weights[bucket], minlength=b - a) + bias, -30, 30), -np.inf)
                kept = np.bincount(rows, np.log1p(np.exp(z)), minlength=len(offsets) - 1)
                scores[first : first + len(offsets) - 1] = -np.expm1(-kept)
                p = 1 / (1 + np.exp(-z))
                for i in np.flatnonzero(p >= threshold).tolist():
                    base = place[offsets[rows[i]]]
                    found[first + rows[i]].append({"start": int(place[starts[i]] - base), "length": int(place[ends[i]] - place[starts[i]]), "score": float(p[i])})
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.clip(scores, 0, 1)), pa.array(found, _FOUND)], names=["id", "score", "offending"])

    return run


_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id_col, score (0 to 1) and offending of every row: where sentences of at least threshold start (in characters, from 0), how
    long they are and what they score. The text is the only input.

    A null or empty text, or one without any word, scores 0. A document's score is at least that of its worst sentence. Repeated rows are
    scored each, alike. An empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, score double, offending array<struct<start: int, length: int, score: double>>"
    return arrow_map(rows, _scorer(shared, threshold), schema).withColumnRenamed("id", id_col)


def offending_sentences(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """A row for each sentence of at least threshold: id_col, start, length, score and the sentence itself."""
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    found = score_toxicity(texts.select(F.struct("_id", "_text", "_row").alias("_own"), "_text"), model, "_own", "_text", threshold)
    rows = found.select("_own", F.explode("offending").alias("o"))
    return rows.select(F.col("_own._id").alias(id_col), "o.start", "o.length", "o.score", F.substr("_own._text", F.col("o.start") + 1, F.col("o.length")).alias("sentence"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(~held_out(F.col("doc_id"), 0, 5)))
    scored = score_toxicity(docs, model)
    worst = F.array_max(F.transform("offending", lambda o: F.struct(o.score, -o.start, o.length)))
    rows = scored.select("doc_id", held_out(F.col("doc_id"), 0, 5).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("offending").alias("n_offending"), worst.alias("w"))
    return rows.select("doc_id", "held_out", "score", "predicted", "n_offending", (-F.col("w.col2")).alias("worst_start"), F.col("w.length").alias("worst_length"))
