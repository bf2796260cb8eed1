"""Near-dedup by Order MinHash.

A text is the sequence of its shingles of SHINGLE words, each labelled with how often it has occurred
before. A sketch takes the PICKS labelled shingles with the smallest hashes, in text order, so that two
texts share a sketch when they agree in content and in order. Texts that share a sketch are aligned:
the longest chain of common labelled shingles within the band that the threshold allows anchors the
alignment, and the words between neighbouring anchors are aligned exactly. The similarity is the share of aligned
equal words in the longer text. Classes are the connected components of pairs that reach the threshold.

A pair whose labelled shingles have Jaccard similarity J shares no sketch with probability about
(1 - J**PICKS)**SKETCHES. One word in ten replaced leaves J = 0.42 and a miss of 6e-5, one in eight J = 0.34 and 0.005, one in
six J = 0.25 and 0.13, one in five J = 0.20 and 0.38. Texts of fewer than SHORT shingles are candidates by every single shingle as
well.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import arrow_map
from .common import mix64, read_table, release_others, shingle_hashes, shuffle_parts, word_blocks, written
from .components import components

SHINGLE, THRESHOLD, PICKS, SKETCHES, SHORT = 5, 0.8, 3, 128, 16
#: Words of a group that one task holds; a larger group is dealt out as pairs of parts.
PART_WORDS = 2_000_000
#: Odd factors: hashes times one of them, modulo 2**64, are in another order. One a sketch, so at most so many sketches.
_ODDS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LAST = np.uint64((1 << 64) - 1)


def labelled_shingles(words: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(labelled shingle hashes in text order, bounds a row). A text of fewer than k words has one shingle."""
    n_rows, sizes = len(bounds) - 1, np.diff(bounds)
    rows = np.repeat(np.arange(n_rows), sizes)
    full = shingle_hashes(words, k)
    whole = np.flatnonzero(rows[: len(full)] == rows[k - 1 :][: len(full)])
    row, value = rows[whole], full[whole]
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        own = np.array([shingle_hashes(words[bounds[i] : bounds[i + 1]], int(sizes[i]))[0] for i in short], np.uint64)
        order = np.argsort(np.concatenate([row, short]), kind="stable")
        row, value = np.concatenate([row, short])[order], np.concatenate([value, own])[order]
    order = np.lexsort((value, row))
    v, r = value[order], row[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    starts = np.flatnonzero(fresh)
    seen = np.arange(len(v)) - starts[np.cumsum(fresh) - 1] if len(v) else np.zeros(0, np.int64)
    label = np.empty(len(v), np.uint64)
    label[order] = seen.astype(np.uint64)
    return mix64(value + label * np.uint64(0xA24BAED4963EE407)), np.searchsorted(row, np.arange(n_rows + 1))


def order_sketches(labelled: np.ndarray, bounds: np.ndarray, sketches: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """A row of sketches for each text that has shingles, in order."""
    sizes = np.diff(bounds)
    some = np.flatnonzero(sizes)
    out = np.zeros((len(some), sketches), np.uint64)
    if not len(some):
        return out
    starts = bounds[:-1][some]
    bits = max(1, int(len(labelled)).bit_length())
    mask = np.uint64((1 << bits) - 1)
    index = np.arange(len(labelled), dtype=np.uint64)
    for j in range(sketches):
        packed = (labelled * _ODDS[j] & ~mask) | index
        spots = []
        for p in range(picks):
            low = np.minimum.reduceat(packed, starts)
            spot = np.where(sizes[some] > p, (low & mask).astype(np.int64), -1)
            spots.append(spot)
            packed[spot[spot >= 0]] = _LAST
        spots = np.sort(np.stack(spots), axis=0)
        value = np.full(len(some), _ODDS[j])
        for spot in spots:
            value = np.where(spot >= 0, mix64(value * np.uint64(0x9E3779B97F4A7C15) + labelled[spot]), value)
        out[:, j] = value
    return out


def candidate_keys(labelled: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Each text's keys, of which candidates share one: its sketches, and for short texts their shingles."""
    sketches, out, k = order_sketches(labelled, bounds), [], 0
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if s == e:
            out.append(np.zeros(0, np.uint64))
            continue
        out.append(np.unique(sketches[k]) if e - s >= SHORT else np.unique(np.concatenate([sketches[k], labelled[s:e]])))
        k += 1
    return out


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _sketcher(batches):
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33  # names a row of the table that this is written to
    for batch in batches:
        n = len(batch)
        sizes, digests, lists = np.zeros(n, np.int64), np.zeros((n, 2), np.int64), []
        for first, words, bounds, own in word_blocks(batch.column(2), digests=True):
            m = len(bounds) - 1
            sizes[first : first + m] = np.diff(bounds)
            digests[first : first + m] = _halves(own)
            lists += candidate_keys(*labelled_shingles(words, bounds))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *lists]).view(np.int64)))
        named = [pa.array(np.arange(row, row + n)), batch.column(0), batch.column(1), pa.array(sizes), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), keys]
        yield pa.RecordBatch.from_arrays(named, names=["row", "id", "h", "n", "c1", "c2", "keys"])
        row += n


class Text:
    """A text for alignment: its words, its labelled shingles and, made when asked for, their order."""

    def __init__(self, words: np.ndarray, shingles: np.ndarray):
        self.words, self.shingles = words, shingles
        self._order = self._bag = None

    @property
    def order(self) -> np.ndarray:
        if self._order is None:
            self._order = np.argsort(self.shingles).astype(np.int32)
        return self._order

    @property
    def bag(self) -> np.ndarray:
        """The words, each with how often it has occurred before, as sorted 32-bit hashes."""
        if self._bag is None:
            labelled, _ = labelled_shingles(self.words, np.array([0, len(self.words)]), 1)
            self._bag = np.sort((labelled >> np.uint64(32)).astype(np.uint32))
        return self._bag


def texts_of(arr) -> list[Text]:
    out = []
    for _, words, bounds in word_blocks(arr):
        labelled, marks = labelled_shingles(words, bounds)
        out += [Text(words[bounds[i] : bounds[i + 1]].copy(), labelled[marks[i] : marks[i + 1]].copy()) for i in range(len(bounds) - 1)]
    return out


def _chain(i: np.ndarray) -> np.ndarray:
    """Places of a longest strictly increasing subsequence of i."""
    if len(i) < 2 or (i[1:] > i[:-1]).all():
        return np.arange(len(i))
    tails: list[int] = []
    ends, before = [], []
    for k, x in enumerate(i.tolist()):
        at = bisect_left(tails, x)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(x)
            ends.append(k)
        else:
            tails[at], ends[at] = x, k
    out, k = [], ends[-1]
    while k >= 0:
        out.append(k)
        k = before[k]
    return np.array(out[::-1])


def similarity(a: Text, b: Text, threshold: float = THRESHOLD) -> float:
    """Aligned equal words as a share of the longer text's words, if that reaches threshold; otherwise 0.

    Aligned words are a common subsequence, so this never exceeds 1 - (edit distance) / (longer text).
    """
    n1, n2 = len(a.words), len(b.words)
    most = max(n1, n2)
    if not min(n1, n2) or min(n1, n2) < threshold * most:
        return 0.0
    if n1 == n2 and (a.words == b.words).all():
        return 1.0
    if min(n1, n2) < SHINGLE:
        return 0.0
    at = np.minimum(np.searchsorted(a.shingles, b.shingles, sorter=a.order), len(a.shingles) - 1)
    i = a.order[at]
    j = np.flatnonzero(a.shingles[i] == b.shingles)
    i = i[j].astype(np.int64)
    # An alignment that reaches the threshold leaves at most this many words of the longer text out.
    near = np.abs(i - j) <= (1 - threshold) * most
    i, j = i[near], j[near]
    if not len(i):
        return 0.0
    kept = _chain(i)
    i, j = i[kept], j[kept]
    # Anchors with one distance j - i are one stretch, compared word by word.
    cut = np.flatnonzero(np.diff(j - i)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(i) - 1]])
    stretches, e1, e2 = [], 0, 0
    for s1, s2, t1 in zip(i[first].tolist(), j[first].tolist(), (i[last] + SHINGLE).tolist(), strict=True):
        over = max(0, e1 - s1, e2 - s2)
        if s1 + over < t1:
            stretches.append((s1 + over, s2 + over, t1))
            e1, e2 = t1, s2 + t1 - s1
    ends = [(0, 0), *[(t1, s2 + t1 - s1) for s1, s2, t1 in stretches]]
    starts = [*[(s1, s2) for s1, s2, _ in stretches], (n1, n2)]
    gaps = [(e1, e2, s1, s2) for (e1, e2), (s1, s2) in zip(ends, starts, strict=True) if e1 < s1 and e2 < s2]
    total = sum(int(np.count_nonzero(a.words[s1:t1] == b.words[s2 : s2 + t1 - s1])) for s1, s2, t1 in stretches)
    # What the gaps could add at most settles most pairs that aren't similar.
    if total + sum(min(s1 - e1, s2 - e2) for e1, e2, s1, s2 in gaps) < threshold * most:
        return 0.0
    total += sum(common_words(a.words[e1:s1], b.words[e2:s2]) for e1, e2, s1, s2 in gaps)
    return total / most if total >= threshold * most else 0.0


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of the table held as the bits of one number."""
    if len(a) == len(b) and (a == b).all():
        return len(a)
    own, masks = a.tolist(), {}
    for k, w in enumerate(own):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(own)) - 1
    row = full
    for w in b.tolist():
        if mask := masks.get(w):
            both = row & mask
            row = (row + both | row - both) & full
    return len(own) - row.bit_count()


class Group:
    """Texts of which some are candidates; links() gives a spanning forest of the pairs that are similar."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.ids: list[int] = []
        self.parts: list[int] = []
        self.texts: list[Text] = []
        self.keys: list[np.ndarray] = []
        self.seen: set[int] = set()

    def add(self, ids, parts, wanted: np.ndarray, texts: pa.Array) -> None:
        """Adds the texts whose digests are the wanted ones (a row that repeats an id may hold another)."""
        for first, words, bounds, digests in word_blocks(texts, digests=True):
            labelled, marks = labelled_shingles(words, bounds)
            keys, right = candidate_keys(labelled, marks), (_halves(digests) == wanted[first : first + len(digests)]).all(axis=1)
            for r in range(len(bounds) - 1):
                if not len(keys[r]) or not right[r] or ids[first + r] in self.seen:
                    continue
                self.seen.add(ids[first + r])
                self.ids.append(ids[first + r])
                self.parts.append(parts[first + r])
                self.texts.append(Text(words[bounds[r] : bounds[r + 1]].copy(), labelled[marks[r] : marks[r + 1]].copy()))
                self.keys.append(keys[r])

    def links(self, across: bool, stars: bool = False) -> list[tuple[int, int]]:
        """Links that connect what is similar. across: pairs of one part are compared elsewhere, and only others
        count here. stars: instead of links, (id, smallest id of its component) for all but the smallest.

        Texts come one by one, by id. Each is held against earlier texts that share a sketch with it and
        aren't in its component yet: first against those with most links, since copies link to what they were
        copied from; then all others, of which a bound on the common words rules out most at once.
        """
        n, found = len(self.ids), []
        order = np.argsort(np.array(self.ids, np.int64), kind="stable")
        ids = np.array(self.ids, np.int64)[order]
        texts, part = [self.texts[k] for k in order], np.array(self.parts, np.int64)[order]
        sizes = np.array([len(t.words) for t in texts], np.int64)
        comp, members, degree = np.arange(n), {}, np.zeros(n, np.int64)
        buckets: dict[int, list] = {}  # key -> [texts so far, how many, the one with most links, whether all are of its component]
        keys, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.keys]), return_counts=True)
        keys = keys[times > 1]  # what one text alone has makes no candidates
        shared = [k[np.isin(k, keys, assume_unique=True)] for k in self.keys]

        def test(x: int, y: int) -> bool:
            if not similarity(texts[y], texts[x], self.threshold):
                return False
            degree[[x, y]] += 1
            found.append((int(ids[x]), int(ids[y])))
            one, two = comp[x], comp[y]
            a, b = members.pop(one, [x]), members.pop(two, [y])
            if len(a) < len(b):
                a, b, one, two = b, a, two, one
            comp[b] = one
            a.extend(b)
            members[one] = a
            return True

        def open_(x: int, y: np.ndarray) -> np.ndarray:
            y = y[comp[y] != comp[x]]
            y = y[(sizes[y] * self.threshold <= sizes[x]) & (sizes[x] * self.threshold <= sizes[y])]
            return y[part[y] != part[x]] if across else y

        for x in range(n):
            own = [buckets.setdefault(v, [np.empty(2, np.int64), 0, -1, True]) for v in shared[order[x]].tolist()]
            hubs = sorted({b[2] for b in own if b[1]}, key=lambda y: -degree[y])
            tested = []
            for y in hubs:
                if len(open_(x, np.array([y]))):
                    tested.append(y)
                    test(x, y)
            # a bucket of one component, x's own, has nothing left to compare
            rest = [r for b in own if b[1] and not (b[3] and comp[b[2]] == comp[x]) and len(r := open_(x, b[0][: b[1]]))]
            if rest:
                rest = np.setdiff1d(np.concatenate(rest), tested)
                rest = self._plausible(texts, sizes, x, rest)
                while len(rest):
                    y = int(rest[np.argmax(degree[rest])])
                    rest = rest[rest != y]
                    if test(x, y):
                        rest = open_(x, rest)
            for b in own:
                if b[1] == len(b[0]):
                    b[0] = np.concatenate([b[0], np.empty(len(b[0]), np.int64)])
                b[0][b[1]] = x
                b[1] += 1
                b[3] = b[3] and (b[2] < 0 or comp[b[2]] == comp[x])
                if b[2] < 0 or degree[x] > degree[b[2]]:
                    b[2] = x
        if stars:
            return [(int(ids[k]), int(ids[least])) for own in members.values() for least in (min(own),) for k in own if k != least]
        return found

    def _plausible(self, texts, sizes, x: int, rest: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """Those of rest that have enough of x's words to be similar, in whatever order."""
        mine, keep, at = texts[x].bag, [], 0
        while at < len(rest):
            end = at + max(1, int(np.searchsorted(np.cumsum(sizes[rest[at:]]), most)))
            some = rest[at:end]
            flat = np.concatenate([texts[y].bag for y in some])
            spot = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            m = np.add.reduceat((mine[spot] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
            keep.append(some[m >= self.threshold * np.maximum(sizes[some], sizes[x])])
            at = end
        return np.concatenate(keep) if keep else rest


def _linker(threshold: float):
    def run(batches):
        release_others("near_dedup")
        key, group = None, None

        def done():
            whole = key[3] == 1
            found = group.links(across=key[1] != key[2], stars=whole)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64()), pa.array([whole] * len(found), pa.bool_())], names=["a", "b", "whole"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
            ids, parts = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            wanted = np.stack([batch.column(k).to_numpy() for k in (6, 7)], axis=1)
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            cuts = [0, *change.tolist(), len(ids)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                own = tuple(keys[:, s].tolist())
                if own != key:
                    if group is not None:
                        yield done()
                    key, group = own, Group(threshold)
                group.add(ids[s:e], parts[s:e], wanted[s:e], batch.column(8).slice(s, e - s))
        if group is not None:
            yield done()

    return run


def _classes(docs: DataFrame, threshold: float, id_col: str, text_col: str, part_words: int) -> DataFrame:
    """A row a row of docs: id, h (a hash of the text), n (words), class_id, kept."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("h"), "text")
    staged = written(arrow_map(rows, _sketcher, "row bigint, id bigint, h bigint, n bigint, c1 bigint, c2 bigint, keys array<bigint>"), "sketches")
    named = staged.where("id is not null and n > 0")
    # Equal word sequences, told by 128 bits of their digest, are one text; its row with the smallest id names it.
    texts = named.groupBy("c1", "c2").agg(F.min(F.struct("id", "row")).alias("lead"), F.first("keys").alias("keys"), F.first("n").alias("n"))
    texts = written(texts.select("c1", "c2", "lead.id", F.col("lead.row").alias("node"), "keys", "n"), "texts")
    picked = texts.select("node", F.explode("keys").alias("v"))
    shared = picked.groupBy("v").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").select("v", "first")
    coarse = components(picked.join(shared, "v").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")))
    members = coarse.join(texts.drop("keys"), "node")
    sizes = members.groupBy("comp").agg(F.sum("n").alias("words")).select("comp", F.ceil(F.col("words") / F.lit(part_words)).cast("int").alias("parts"))
    members = members.join(sizes, "comp")
    members = members.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = dealt.select(F.col("id").alias("of"), "node", "c1", "c2", "part", F.col("comp").alias("gid"), F.least("part", "other").cast("int").alias("p1"), F.greatest("part", "other").cast("int").alias("p2"), "parts")
    fetched = rows.join(dealt, F.col("id") == F.col("of")).select("gid", "p1", "p2", "parts", "node", "part", "c1", "c2", "text")
    grouped = fetched.repartition(shuffle_parts(docs.sparkSession), "gid", "p1", "p2").sortWithinPartitions("gid", "p1", "p2", "node")
    # A group that one task has seen whole is done; links of groups in parts go on to their components.
    links = written(arrow_map(grouped, _linker(threshold), "a bigint, b bigint, whole boolean"), "links")
    classes, open_ = links.where("whole").select(F.col("a").alias("node"), F.col("b").alias("comp")), links.where("not whole").select("a", "b")
    if not open_.isEmpty():
        classes = classes.unionAll(components(open_))
    by_text = texts.select("c1", "c2", "id", "node").join(classes, "node", "left").withColumn("class", F.coalesce("comp", "node"))
    leads = by_text.groupBy("class").agg(F.min(F.struct("id", "node")).alias("lead"))
    by_text = by_text.join(leads, "class").select("c1", "c2", "lead")
    alone = staged.where("id is null or n = 0").select("id", "h", "n", F.col("id").alias("class_id"), F.lit(True).alias("kept"))
    out = named.join(by_text, ["c1", "c2"]).select("id", "h", "n", F.col("lead.id").alias("class_id"), (F.col("row") == F.col("lead.node")).alias("kept"))
    return out.unionAll(alone)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """A row a row of docs: id_col, class_id (the smallest id of its class), kept (one row of each class).

    Classes are whole: every pair that shares a key and is in different classes so far is aligned.
    Equal word sequences are one text throughout, and exact repeats of a row are of one class, of which
    one row is kept. Rows that repeat an id with other texts are classed by their own texts. Texts without words, and null
    texts, are alone; a row with a null id is alone, with a null class_id, and kept. Texts of fewer than SHINGLE words
    are near-duplicates only of equal ones. An empty table gives an empty result; other columns aren't read.

    Ids must be integers. A task holds at most two parts of about part_words words of one group.
    """
    out = _classes(docs, threshold, id_col, text_col, part_words)
    return out.select(F.col("id").alias(id_col), "class_id", "kept")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """docs with one row of each class of near_duplicates(), the one with the smallest id; all columns as they are.

    Rows are told apart by id and text, so a row stays or goes by its own text where ids repeat; of rows that repeat
    both, one stays. Rows with a null id, null texts and texts without words stay.
    """
    found = _classes(docs, threshold, id_col, text_col, part_words).where("id is not null and n > 0")
    found = found.groupBy(F.col("id").alias("_near_id"), F.col("h").alias("_near_h")).agg(F.max("kept").alias("any"), F.count(F.lit(1)).alias("times"))
    found = written(found.where("not any or times > 1"), "dropped")
    on = (F.col(id_col).cast("bigint") == F.col("_near_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_near_h"))
    kept = docs.join(found.select("_near_id", "_near_h"), on, "left_anti")
    twice = found.where("any").select("_near_id", "_near_h")
    if twice.isEmpty():
        return kept
    names = [f"c{k}" for k in range(len(docs.columns))]
    again = docs.join(twice, on).toDF(*names, "_near_id", "_near_h").groupBy("_near_id", "_near_h").agg(F.first(F.struct(*names)).alias("r"))
    return kept.unionAll(again.select(*[F.col(f"r.{c}").alias(name) for c, name in zip(names, docs.columns, strict=True)]))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
