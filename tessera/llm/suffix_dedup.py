"""Suffix-array dedup: bytes covered by a LENGTH-byte string that starts earlier are removed.

A suffix array brings equal strings together. Over a corpus, strings are first dealt into groups that
equal ones must share, and then each group's suffixes are sorted:

1. Every string of LENGTH bytes is named by its anchor, the ANCHOR-byte substring with the smallest
   hash (the leftmost of equals). Equal strings have equal anchors at equal offsets. Neighbouring
   strings share anchors, so a document has an anchor about every (LENGTH - ANCHOR) / 2 bytes, and
   strings with the same anchor form a run.
2. Runs are brought together by anchor. Runs that agree in all their bytes form a class; the polynomial
   hash of the anchor only brings them together, what makes them equal is 128 bits of BLAKE2b over their
   bytes. All of a class but its first run are covered; that needs no text, and classes are combined before
   the shuffle.
3. Only where several classes share an anchor, their first runs' bytes are fetched, and the suffixes
   that start at their strings are sorted: a mergesort whose comparisons find the common extension of
   two suffixes by binary search over prefix polynomial hashes. Neighbours that agree for LENGTH
   bytes are verified byte by byte. The first of equals stays.

Removed bytes are the union of what is covered. Nothing is capped: an anchor with many classes has its
strings dealt out by their offset from it and by the bytes that strings near that offset have in common, and one
with more than a task should hold has them grouped by their bytes in a distributed aggregation instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import arrow_map
from .common import byte_table, mix64, prefix_hashes, read_table, shuffle_parts, span_hashes, utf8_blocks, written

LENGTH, ANCHOR = 100, 32
#: Bytes that are hashed at a time; runs whose suffixes are sorted together; runs of an anchor from which its
#: strings are dealt out by their offsets, SLICE at a time, and from which they are grouped by their bytes.
SEGMENT, CHUNK_RUNS, HEAVY_RUNS, SLICE, MOST_RUNS = 1 << 20, 6_000, 1_000, 8, 40_000
_CODE = byte_table(41)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """Runs of strings with the same anchor: row, first start in the row, anchor's offset, last - first, the anchor's
    hash and a digest of the run's bytes, as two numbers."""
    n = len(data)
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)]
    if n < length:
        return none
    prefix = prefix_hashes(_CODE[data])
    at = np.arange(n - anchor + 1)
    grams = mix64(span_hashes(prefix, at, at + anchor))
    least, width, span = (grams & _HIGH) | at.astype(np.uint64), 1, length - anchor + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    total = n - length + 1
    least = np.minimum(least[:total], least[span - width :][:total])
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.arange(total)
    start = start[start + length <= offsets[1:][row_of[:total]]]
    spot = (least[start] & ~_HIGH).astype(np.int64)
    if not len(start):
        return none
    fresh = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
    first, last = start[fresh], start[np.concatenate([fresh[1:] - 1, [len(start) - 1]])]
    spot, row = spot[fresh], row_of[first]
    offset, more = spot - first, last - first
    raw, digest = memoryview(data.tobytes()), hashlib.blake2b
    content = b"".join([digest(raw[s:e], digest_size=16).digest() for s, e in zip(first.tolist(), (last + length).tolist(), strict=True)])
    return row, first - offsets[row], offset, more, grams[spot], np.frombuffer(content, "<i8").reshape(-1, 2)


def _segments(arr: pa.Array, length: int):
    """(rows' first index, bytes, offsets, start within the row): long rows come in overlapping pieces."""
    for first, data, offsets in utf8_blocks(arr, SEGMENT):
        if len(data) <= 2 * SEGMENT:
            yield first, data, offsets, 0
        else:
            for s in range(0, max(len(data) - length + 1, 1), SEGMENT):
                piece = data[s : s + SEGMENT + length - 1]
                yield first, piece, np.array([0, len(piece)]), s


def _pack(first, offset, more):
    return (first << 16) | (offset << 8) | more


def _mapper(length: int, anchor: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for begin, data, offsets, shift in _segments(batch.column(1), length):
                row, first, offset, more, name, content = anchor_runs(data, offsets, length, anchor)
                doc, pos = ids[begin + row].astype(np.int64), _pack(first + shift, offset, more)
                order = np.lexsort((pos, doc, content[:, 1], content[:, 0], name))
                doc, pos, name, content = doc[order], pos[order], name[order], content[order]
                same = np.concatenate([[False], (name[1:] == name[:-1]) & (content[1:] == content[:-1]).all(axis=1)]) if len(doc) else np.zeros(0, bool)
                lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc)))) if len(doc) else np.zeros(0, np.int64)
                again = same & ((doc != doc[lead]) | (pos != pos[lead]))
                # Covered within this block: nothing left to compare, so it is dealt anywhere.
                name = np.where(again, mix64(doc.view(np.uint64) ^ pos.view(np.uint64)), name)
                keep = ~same | again
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[keep].view(np.int64)), pa.array(content[keep, 0]), pa.array(content[keep, 1]), pa.array(doc[keep]), pa.array(pos[keep]), pa.array(again[keep])],
                    names=["anchor", "c1", "c2", "doc", "pos", "covered"],
                )

    return run


_RUNS = "doc bigint, first bigint, more int, offset int, anchor bigint"


def _runs_batch(doc, pos, anchor=None):
    none = pa.nulls(len(doc), pa.int64()) if anchor is None else pa.array(anchor)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(pos >> 16), pa.array((pos & 255).astype(np.int32)), pa.array(((pos >> 8) & 255).astype(np.int32)), none],
        names=["doc", "first", "more", "offset", "anchor"],
    )


def _classer(batches):
    """Rows sorted by anchor, c1, c2, doc, pos: covered runs (anchor null), and the first runs of classes
    that aren't alone with their anchor. What it remembers of earlier batches is one row."""
    last = pending = None  # (anchor, c1, c2, doc, pos of the class's first run); (anchor, doc, pos) of a first run that may be alone
    for batch in batches:
        anchor, c1, c2, doc, pos, covered = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        covered = covered.astype(bool)
        if covered.any():
            yield _runs_batch(doc[covered], pos[covered])
            anchor, c1, c2, doc, pos = anchor[~covered], c1[~covered], c2[~covered], doc[~covered], pos[~covered]
        n = len(anchor)
        if not n:
            continue
        group = np.ones(n, bool)
        group[1:] = anchor[1:] != anchor[:-1]
        klass = np.ones(n, bool)
        klass[1:] = group[1:] | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
        if last is not None:
            group[0] = anchor[0] != last[0]
            klass[0] = group[0] or (c1[0], c2[0]) != last[1:3]
        lead = np.maximum.accumulate(np.where(klass, np.arange(n), -1))
        lead_doc = np.where(lead >= 0, doc[lead], last[3] if last else 0)
        lead_pos = np.where(lead >= 0, pos[lead], last[4] if last else 0)
        over = ~klass & ((doc != lead_doc) | (pos != lead_pos))
        if over.any():
            yield _runs_batch(doc[over], pos[over])
        heads = np.flatnonzero(klass)
        if len(heads):
            joins = ~group[heads]  # its anchor has an earlier class
            followed = np.concatenate([joins[1:], [False]])
            if pending is not None and joins[0]:
                yield _runs_batch(np.array([pending[1]]), np.array([pending[2]]), np.array([pending[0]]))
            several = joins | followed
            if several.any():
                yield _runs_batch(doc[heads[several]], pos[heads[several]], anchor[heads[several]])
            h = heads[-1]
            pending = None if several[-1] else (anchor[h], doc[h], pos[h])
        last = (anchor[-1], c1[-1], c2[-1], int(lead_doc[-1]), int(lead_pos[-1]))


# --- the suffix sort -----------------------------------------------------------------------------


class Suffixes:
    """Suffixes of a text, cut off after `length` bytes, compared by prefix polynomial hashes."""

    def __init__(self, text: np.ndarray, length: int):
        self.text, self.length = text, length
        self.prefix = prefix_hashes(_CODE[text])

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of the common extensions, by binary search."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.length)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = span_hashes(self.prefix, x, x + mid) == span_hashes(self.prefix, y, y + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        lcp = self.common(x, y)
        ended = lcp >= self.length
        lcp = np.where(ended, 0, lcp)
        return ~ended & (self.text[x + lcp] < self.text[y + lcp])

    def equal_bytes(self, x: np.ndarray, y: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        span = np.arange(self.length)
        parts = [(self.text[x[s : s + step, None] + span] == self.text[y[s : s + step, None] + span]).all(axis=1) for s in range(0, len(x), step)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    def sort(self, starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Stable mergesort of starts within each segment [bounds[i], bounds[i + 1]); all segments at once."""
        order, sizes = np.arange(len(starts)), np.diff(bounds)
        begin, size = np.repeat(bounds[:-1], sizes), np.repeat(sizes, sizes)
        width, most = 1, int(sizes.max()) if len(sizes) else 0
        while width < most:
            live = np.flatnonzero(size > width)
            own, seg = order[live], begin[live]
            inside = live - seg
            run = inside // width
            left = run % 2 == 0
            other = seg + (run ^ 1) * width
            low, high = np.zeros(len(live), np.int64), np.clip(size[live] - (run ^ 1) * width, 0, width)
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                probe, mine = starts[order[other[open_] + mid]], starts[own[open_]]
                is_left = left[open_]
                # of equals, those from the left run go first
                small = self.less(np.where(is_left, probe, mine), np.where(is_left, mine, probe))
                right = np.where(is_left, small, ~small)
                low[open_] = np.where(right, mid + 1, low[open_])
                high[open_] = np.where(right, high[open_], mid)
            merged = order.copy()
            merged[seg + (run // 2) * 2 * width + inside % width + low] = own
            order, width = merged, width * 2
        return order


def covered_strings(anchor, doc, first, offset, more, contexts: list[bytes], length: int = LENGTH):
    """Strings of runs that an earlier run has too, as (doc, first start, last - first).

    Runs come sorted by anchor, doc, first; contexts are the bytes from a run's first string's start to its
    last string's end.
    """
    text = np.frombuffer(b"".join(contexts), np.uint8)
    base = np.concatenate([[0], np.cumsum(more + length)])[:-1]
    run = np.repeat(np.arange(len(doc)), more + 1)
    t = np.arange(len(run)) - np.repeat(np.concatenate([[0], np.cumsum(more + 1)])[:-1], more + 1)
    group = np.cumsum(np.concatenate([[False], anchor[1:] != anchor[:-1]]))[run]
    key = group * 512 + offset[run] - t
    order = np.argsort(key, kind="stable")  # within a key, runs stay in the order of (doc, first)
    run, t, key = run[order], t[order], key[order]
    marks = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    sizes = np.diff(marks)
    keep = np.repeat(sizes > 1, sizes)
    run, t = run[keep], t[keep]
    bounds = np.concatenate([[0], np.cumsum(sizes[sizes > 1])])
    none = np.zeros(0, np.int64)
    if not len(run):
        return none, none, none
    suffixes, starts = Suffixes(text, length), base[run] + t
    order = suffixes.sort(starts, bounds)
    edge = np.zeros(len(order), bool)
    edge[bounds[:-1]] = True
    x = starts[order]
    pair = np.flatnonzero(~edge)
    same = suffixes.common(x[pair - 1], x[pair]) >= length
    agree = suffixes.equal_bytes(x[pair - 1][same], x[pair][same])
    if not agree.all():  # two different strings have one hash: sort by the bytes themselves
        segment = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        keys = [text[s : s + length].tobytes() for s in starts]
        order = np.array(sorted(range(len(keys)), key=lambda i: (segment[i], keys[i])), np.int64)
        same = np.array([keys[order[i - 1]] == keys[order[i]] for i in pair], bool)
    equal = np.zeros(len(order), bool)
    equal[pair[same]] = True
    lead = order[np.maximum.accumulate(np.where(equal, 0, np.arange(len(order))))]
    at, begin = doc[run], first[run] + t
    over = equal & ((at[order] != at[lead]) | (begin[order] != begin[lead]))
    hit = order[over]
    hit = hit[np.lexsort((t[hit], run[hit]))]
    if not len(hit):
        return none, none, none
    r, s = run[hit], t[hit]
    fresh = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)]))
    last = np.concatenate([fresh[1:] - 1, [len(r) - 1]])
    return doc[r[fresh]], first[r[fresh]] + s[fresh], s[last] - s[fresh]


_COVERED = "doc bigint, first bigint, more int"


def _sorter(length: int, chunk_runs: int):
    def solve(parts):
        cols = [np.concatenate([p[k] for p in parts]) for k in range(5)]
        contexts = [c for p in parts for c in p[5]]
        doc, first, more = covered_strings(*cols, contexts, length)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(first, pa.int64()), pa.array(more, pa.int32())], names=["doc", "first", "more"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
            contexts = batch.column(5).to_pylist()
            n, at = len(contexts), 0
            # whole anchors are sorted together: a chunk ends where an anchor does
            ends = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
            if held and n and held[-1][0][-1] != cols[0][0] and size >= chunk_runs:
                yield solve(held)
                held, size = [], 0
            for e in ends:
                if size + e - at >= chunk_runs:
                    held.append([c[at:e] for c in cols] + [contexts[at:e]])
                    yield solve(held)
                    held, size, at = [], 0, e
            if at < n:
                held.append([c[at:] for c in cols] + [contexts[at:]])
                size += n - at
        if held:
            yield solve(held)

    return run


# --- the operator --------------------------------------------------------------------------------


def covered_ranges(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, heavy_runs: int = HEAVY_RUNS, most_runs: int = MOST_RUNS, chunk_runs: int = CHUNK_RUNS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, first, more: strings of length bytes that start at first to first + more and also start earlier."""
    if not 8 <= anchor <= length or length - anchor > 200:
        raise ValueError("the anchor must be 8 bytes at least, and at most 200 shorter than the string")
    parts = shuffle_parts(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc is not null")
    runs = arrow_map(rows, _mapper(length, anchor), "anchor bigint, c1 bigint, c2 bigint, doc bigint, pos bigint, covered boolean")
    runs = runs.repartition(parts, "anchor").sortWithinPartitions("anchor", "c1", "c2", "doc", "pos")
    classed = written(arrow_map(runs, _classer, _RUNS), "runs")
    firsts = classed.where("anchor is not null")
    crowded = written(firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy_runs), "crowded")
    # 0: sorted as one group; 1: its strings are dealt out by their offset; 2: grouped by their bytes
    level = F.when(F.col("n") > most_runs, 2).when(F.col("n").isNotNull(), 1).otherwise(0)
    none = crowded.isEmpty()
    firsts = firsts.withColumn("level", F.lit(0)) if none else firsts.join(crowded, "anchor", "left").withColumn("level", level).drop("n")
    wanted = firsts.groupBy("doc").agg(F.collect_list(F.struct("anchor", "first", "offset", "more", "level")).alias("runs"))
    cut = f"transform(runs, r -> named_struct('anchor', r.anchor, 'first', r.first, 'offset', r.offset, 'more', r.more, 'level', r.level, 'bytes', substring(bytes, cast(r.first as int) + 1, r.more + {length})))"
    fetched = rows.join(wanted, "doc").select("doc", "runs", F.col("text").cast("binary").alias("bytes")).select("doc", F.explode(F.expr(cut)).alias("r"))
    fetched = fetched.select("doc", "r.anchor", "r.first", "r.offset", "r.more", "r.level", "r.bytes")
    few, extra = fetched, None
    if not none:
        # Strings at different offsets from the anchor are never equal, so SLICE offsets make a group.
        part = f"""transform(sequence(cast((offset - more) div {SLICE} as int), cast(offset div {SLICE} as int)), s -> named_struct(
            's', s, 'high', least(offset, s * {SLICE} + {SLICE - 1}), 'low', greatest(offset - more, s * {SLICE})))"""
        parts_of = F.when(F.col("level") == 0, F.expr("array(named_struct('s', -1, 'high', offset, 'low', offset - more))")).otherwise(F.expr(part))
        few = fetched.where("level < 2").withColumn("p", F.explode(parts_of))
        # All strings of a slice hold the same length - SLICE + 1 bytes around the anchor, so only runs that agree there meet.
        middle = F.when(F.col("level") == 1, F.expr(f"substring(bytes, offset - p.s * {SLICE} + 1, {length - SLICE + 1})"))
        few = few.select(
            F.xxhash64("anchor", "p.s", middle).alias("anchor"), "doc", F.expr("first + offset - p.high").alias("first"), F.expr("p.high").alias("offset"),
            F.expr("p.high - p.low").alias("more"), F.expr(f"substring(bytes, offset - p.high + 1, p.high - p.low + {length})").alias("bytes"),
        )
        many = fetched.where("level = 2").withColumn("t", F.explode(F.expr("sequence(0, more)")))
        many = many.select("doc", (F.col("first") + F.col("t")).alias("first"), F.expr(f"substring(bytes, t + 1, {length})").alias("string"))
        least = many.groupBy("string").agg(F.min(F.struct("doc", "first")).alias("lead"))
        extra = many.join(least, "string").where("doc <> lead.doc or first <> lead.first").select("doc", "first", F.lit(0).alias("more"))
    few = few.select("anchor", "doc", "first", "offset", "more", "bytes").repartition(parts, "anchor").sortWithinPartitions("anchor", "doc", "first")
    found = arrow_map(few, _sorter(length, chunk_runs), _COVERED)
    if extra is not None:
        found = found.unionByName(extra)
    return classed.where("anchor is null").select("doc", "first", "more").unionByName(written(found, "covered"))


def _remover(length: int, with_text: bool):
    def run(batches):
        for batch in batches:
            ids, texts, spans = batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2)
            cols: list[list] = [[], [], [], [], []]
            for text, own in zip(texts, spans, strict=True):
                data = text.as_py() or b""
                kept, runs, at = [], 0, 0
                own = own.values
                if own is not None and len(own):
                    start = own.field(0).to_numpy()
                    order = np.argsort(start)
                    start, end = start[order], (own.field(0).to_numpy() + own.field(1).to_numpy() + length)[order]
                    end = np.maximum.accumulate(end)
                    fresh = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
                    for s, e in zip(start[fresh].tolist(), end[np.concatenate([fresh[1:] - 1, [len(end) - 1]])].tolist(), strict=True):
                        kept.append(data[at:s])
                        at, runs = e, runs + 1
                kept.append(data[at:])
                left = b"".join(kept)
                for col, x in zip(cols, (len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest(), left if with_text else None), strict=True):
                    col.append(x)
            arrays = [ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())]
            names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(cols[4], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, **settings) -> DataFrame:
    """A row a row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256, and with_text the bytes kept.

    Texts are UTF-8 bytes, null is empty. A byte is removed if a string of length bytes that covers it also starts
    earlier: in a row with a smaller id, or before it in the same. Strings are judged on the input and
    never cross rows. Rows that repeat an id and its text are one document. Where rows repeat an id with other texts, those
    with the smallest hash of their text are the document; the others, like rows with a null id, are left whole and cover
    nothing. An empty table gives an empty result; other columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = _one_text_an_id(rows)
    ranges = covered_ranges(rows.select("doc", "text"), length, id_col="doc", text_col="text", **settings)
    ranges = ranges.groupBy("doc").agg(F.collect_list(F.struct("first", "more")).alias("spans"))
    joined = rows.join(ranges, "doc", "left").select(F.col("id").alias("doc"), "text", "spans")
    schema = "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    return arrow_map(joined, _remover(length, with_text), schema).withColumnRenamed("doc", id_col)


def _one_text_an_id(rows: DataFrame) -> DataFrame:
    """rows(doc, text) with id, as doc was; doc is null where another text is the id's document."""
    hashed = rows.select("doc", F.xxhash64("text").alias("h")).where("doc is not null")
    split = hashed.groupBy("doc").agg(F.min("h").alias("_least"), F.max("h").alias("_most")).where("_least <> _most").select(F.col("doc").alias("_doc"), "_least")
    split = written(split, "split")
    named = rows.withColumn("id", F.col("doc"))
    if split.isEmpty():
        return named
    other = F.col("_least") != F.xxhash64("text")
    found = named.join(split, F.col("doc") == F.col("_doc"), "left")
    return found.select(F.when(other, F.lit(None)).otherwise(F.col("doc")).cast("bigint").alias("doc"), "text", "id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))
