"""Benchmark decontamination: shared words as an exact filter, then Smith-Waterman alignment.

Every stretch of a document is compared with every test item by the words that they share; where these leave
a score of the threshold possible, the stretch is aligned with the item, word by word. The score is the
alignment's share of the item's best possible score. The filter is a bound, so no passage is lost, whichever
words were edited; items of up to WHOLE words must occur unedited.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import arrow_map
from .common import read_table, release_others, word_blocks

WHOLE, THRESHOLD = 3, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items are held in blocks of at most so many words; each block is one pass over the documents.
BLOCK_WORDS = 2_000_000
#: Counts of stretches by items that are held at once.
CELLS = 1_000_000
_BITS = 20


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two sequences: (score, end in item, end in text), ends exclusive."""
    steps = np.arange(len(text) + 1) * GAP
    row = np.zeros(len(text) + 1, np.int64)
    best = (0, 0, 0)
    for i, w in enumerate(item):
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(text == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(new - steps) + steps
        j = int(np.argmax(row))
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
    return best


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """(share of the item's best score, start in text, end in text)."""
    score, i, j = smith_waterman(item, text)
    if not score:
        return 0.0, 0, 0
    _, _, back = smith_waterman(item[:i][::-1], text[:j][::-1])
    return score / (MATCH * len(item)), j - back, j


class _Bits:
    """Membership in a set of hashes: a bit table first, then the sorted values."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.values >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in hashes that hold a member, its index among the values)."""
        at = np.flatnonzero(self.table[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at) or not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        index = np.minimum(np.searchsorted(self.values, hashes[at]), len(self.values) - 1)
        same = self.values[index] == hashes[at]
        return at[same], index[same]


class _Class:
    """Items of similar length, with a bound on how much of each a stretch of text can hold.

    A passage that scores share t of an item of n words has at least t * n of them and is at most
    (3 - 2 * t) * n words long: each word beyond a match costs a point. Texts are cut into stretches of that
    length, so a passage lies within two that follow each other, and both must have t * n of the item's words.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], least: dict[int, float], threshold: float):
        self.ids = np.array([i for i, _ in items])
        longest = max(len(w) for _, w in items)
        self.step = max(longest, math.ceil(longest * (3 - 2 * threshold)))
        self.words = np.array([math.ceil(least[i] * len(w) - 1e-9) for i, w in items])
        self.score = np.array([math.ceil(least[i] * MATCH * len(w) - 1e-9) for i, w in items])
        own = [np.unique(w, return_counts=True) for _, w in items]
        self.bits = _Bits(np.concatenate([w for w, _ in own]))
        at = np.concatenate([np.searchsorted(self.bits.values, w) for w, _ in own])
        order = np.argsort(at, kind="stable")
        self.item = np.repeat(np.arange(len(own)), [len(w) for w, _ in own])[order]
        self.times = np.concatenate([n for _, n in own])[order]
        self.first = np.searchsorted(at[order], np.arange(len(self.bits.values) + 1))

    def stretches(self, words: np.ndarray, bounds: np.ndarray):
        """(row, item's index, start, end) of each two stretches that may hold a passage; ordered by row, item and start."""
        at, word = self.bits.find(words)
        if not len(at):
            return
        codes = np.full(len(words) + 1, len(self.bits.values), np.int64)
        codes[at] = word
        # what a word adds to an item's score at most; the last row is for words that no item has
        points = np.full((len(self.bits.values) + 1, len(self.ids)), MISMATCH, np.int8)
        points[np.repeat(np.arange(len(self.bits.values)), np.diff(self.first)), self.item] = MATCH
        # a row's stretches are numbered from base on, and an empty one follows them
        base = np.concatenate([[0], np.cumsum(-(-np.diff(bounds) // self.step) + 1)])
        rows = np.searchsorted(bounds, at, side="right") - 1
        keys, n = np.unique((base[rows] + (at - bounds[rows]) // self.step) * len(self.bits.values) + word, return_counts=True)
        stretch, word = keys // len(self.bits.values), keys % len(self.bits.values)
        size = max(1, CELLS // len(self.ids))
        found = []
        for low in range(0, int(base[-1]), size):
            high = min(low + size, int(base[-1])) + 1  # one more, to be added to the one before it
            lo, hi = np.searchsorted(stretch, (low, high))
            begin, many = self.first[word[lo:hi]], np.diff(self.first)[word[lo:hi]]
            flat = np.arange(many.sum()) + np.repeat(begin - np.cumsum(many) + many, many)
            cell = np.repeat((stretch[lo:hi] - low) * len(self.ids), many) + self.item[flat]
            held = np.bincount(cell, np.minimum(self.times[flat], np.repeat(n[lo:hi], many)), (high - low) * len(self.ids)).reshape(high - low, -1)
            k, item = np.nonzero(held[:-1] + held[1:] >= self.words)
            rows = np.searchsorted(base, k + low, side="right") - 1
            start = bounds[rows] + (k + low - base[rows]) * self.step
            end = np.minimum(start + 2 * self.step, bounds[rows + 1])
            at = np.flatnonzero(start < end)
            for part in np.array_split(at, len(at) * 2 * self.step // CELLS + 1):
                part = part[self._best(codes, points, start[part], end[part], item[part]) >= self.score[item[part]]]
                found += zip(rows[part].tolist(), self.ids[item[part]].tolist(), start[part].tolist(), end[part].tolist(), strict=True)
        yield from sorted(found)

    def _best(self, codes: np.ndarray, points: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray) -> np.ndarray:
        """No alignment can score more: an item's words count as matches in any order, others as edits."""
        at = start + np.arange(2 * self.step)[:, None]
        at = np.where(at < end, at, len(codes) - 1)
        sums = np.zeros((len(at) + 1, len(start)), np.int32)
        np.cumsum(points[codes[at], item], axis=0, out=sums[1:])
        return (sums - np.minimum.accumulate(sums, axis=0)).max(axis=0, initial=0)


class _Aligner:
    def __init__(self, items: list[tuple[object, np.ndarray]], threshold: float):
        self.items = items
        #: An item of up to WHOLE words must be there as it is: half of so few words is no copy.
        self.least = {i: max(threshold, 1.0) if len(w) <= WHOLE else threshold for i, (_, w) in enumerate(items)}
        # by length, and so few at once that words x items stay below 4 * CELLS
        sizes: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        seen: dict[int, int] = {}
        for i, (_, w) in enumerate(items):
            k = (len(w) - 1).bit_length()
            seen[k] = seen.get(k, -1) + 1
            sizes.setdefault((k, seen[k] // max(1, math.isqrt(4 * CELLS >> k))), []).append((i, w))
        self.classes = [_Class(own, self.least, threshold) for _, own in sorted(sizes.items())]

    def hits(self, texts: pa.Array):
        """(row, item's index, score, first word, end word) of all passages that reach the threshold."""
        for first, words, bounds in word_blocks(texts):
            regions: dict[tuple[int, int], list[list[int]]] = {}
            for own in self.classes:
                for r, item, start, end in own.stretches(words, bounds):
                    spans = regions.setdefault((r, item), [])
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = end
                    else:
                        spans.append([start, end])
            for (r, item), spans in sorted(regions.items()):
                best = (0.0, 0, 0)
                for s, e in spans:
                    score, a, b = align(self.items[item][1], words[s:e])
                    if score > best[0]:
                        best = (score, s + a - int(bounds[r]), s + b - int(bounds[r]))
                if best[0] >= self.least[item]:
                    yield first + r, item, *best


_HITS = "item_id {kind}, score double, first_word bigint, end_word bigint"


def _finder(shared, kind):
    def run(batches):
        release_others("decontaminate")
        items, threshold = shared.value
        aligner = _Aligner(items, threshold)
        for batch in batches:
            rows, cols = [], [[], [], [], []]
            for row, item, score, start, end in aligner.hits(batch.column(1)):
                rows.append(row)
                for col, x in zip(cols, (items[item][0], score, start, end), strict=True):
                    col.append(x)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], kind), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["id", "item_id", "score", "first_word", "end_word"])

    return run


def _cleaner(shared, at: int):
    def run(batches):
        release_others("decontaminate")
        items, threshold = shared.value
        aligner = _Aligner(items, threshold)
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for row, *_ in aligner.hits(batch.column(at)):
                keep[row] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int):
    """The items with words, as (id, word hashes), in blocks; streamed, so one block is held at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").toLocalIterator():
        for _, words, _ in word_blocks(pa.array([r["t"]])):
            if len(words):
                block.append((r["i"], words))
                size += len(words)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The passages that copy test items: id_col, item_id, score, first_word, end_word.

    A row a document and item whose best passage scores threshold or more; the passage is words
    [first_word, end_word) of the document. An item of up to WHOLE words needs a score of 1. Documents without such passage have no row. Null texts and
    texts or items without words match nothing; repeated documents and items are reported each; empty
    tables on either side give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    item_type = benchmark.schema[item_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"id {dict(rows.dtypes)['id']}, " + _HITS.format(kind=item_type.simpleString())
    out = spark.createDataFrame([], schema)
    for k, items in enumerate(_blocks(benchmark, item_col, item_text_col, block_words)):
        shared = spark.sparkContext.broadcast((items, threshold))
        found = arrow_map(rows, _finder(shared, to_arrow_type(item_type)), schema)
        out = out.unionByName(found) if k else found
    return out.withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows that find_leaks() reports; all columns as they are."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for items in _blocks(benchmark, item_col, item_text_col, block_words):
        shared = spark.sparkContext.broadcast((items, threshold))
        docs = arrow_map(docs, _cleaner(shared, at), docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
