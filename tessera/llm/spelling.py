"""Spelling variant grouping with a positional q-gram index.

Two words are near if they differ by one inserted, deleted or replaced character. One edit leaves the first or the
last half of the shorter word as it is, so each word is dealt to a shard by either half; the index of a shard
lists the words by their other q-grams and positions. A word's postings are merged with a heap, under the limits
of length and position that a shard implies; words that share as many q-grams as one edit must leave are verified.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import arrow_map
from .common import read_table, shuffle_parts, written

RUN, UPPER, LOWER = "[A-Za-zÀ-ÿ]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of fewer characters or occurrences are left out; a form comes at least RATIO times as often as its variant.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Characters of a gram, and how many words of a shard are indexed at once; more are dealt over blocks.
Q, BLOCK = 2, 2_000


def count_words(docs: DataFrame, noise: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: the runs of letters of all texts in lower case (A-Z only), with LEAST_LENGTH characters and
    LEAST_COUNT occurrences or more.

    With noise, a run loses the character at h modulo its length where noise divides h, the CRC-32 of
    `<id>:<run>` (a null id is empty), which plants misspellings. Null and empty texts have no words; repeated rows count
    each; an empty table gives an empty result; other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t"))
    # A shorter run gives no word with or without noise; a match begins where its run does.
    runs = texts.select("i", F.explode(F.regexp_extract_all("t", F.lit(f"{RUN}{{{LEAST_LENGTH},}}"), F.lit(0))).alias("r"))
    words = runs.select("i", F.translate("r", UPPER, LOWER).alias("word"))
    if noise:
        h = F.crc32(F.concat("i", F.lit(":"), "word").cast("binary"))
        words = words.select("word", h.alias("h"), F.length("word").alias("size"))
        at = (F.col("h") % F.col("size")).cast("int")
        cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        words = words.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _shards(vocab: DataFrame) -> DataFrame:
    """Rows (shard, half, base, word, n, role, own): a word in its shards, by its own length and as the longer of a pair.

    base is the length of a pair's shorter word; half is 0 where a shard shares first halves. role 1 marks the longer
    words. Where a shard has more than BLOCK rows, words are indexed (own) in one of its blocks and looked up in all.
    """
    size = F.length("word")
    w = vocab.select("word", "n", size.alias("size"))

    def place(half: int, role: int):
        base = F.col("size") - role
        middle = F.floor(base / 2).cast("int")
        part = F.substr("word", F.lit(1), middle) if half == 0 else F.substr("word", middle + role + 1)
        return F.struct(F.lit(half).alias("half"), base.cast("int").alias("base"), part.alias("part"), F.lit(role).alias("role"))

    rows = w.select("word", "n", F.explode(F.array(*[place(h, r) for h in (0, 1) for r in (0, 1)])).alias("p")).where(F.col("p.base") >= LEAST_LENGTH)
    rows = rows.select("word", "n", "p.*")
    key = ["half", "base", "part"]
    large = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK).select(*key, F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    home = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    rows = rows.withColumn("home", home)
    seen = F.when((F.col("role") == 0) & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("home"))
    rows = rows.withColumn("block", F.explode(seen))
    return rows.select(F.concat_ws(":", "half", "base", "part", "block").alias("shard"), "half", "base", "word", "n", "role", (F.col("block") == F.col("home")).alias("own"))


def one_edit(a: str, b: str) -> bool:
    """Whether b, as long as a or longer by one, is a with just one character replaced or inserted."""
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] and a != b if len(b) == n else a[i:] == b[i + 1 :]


def near_in_shard(half: int, base: int, words: list[str], roles: list[int], own: list[bool]):
    """Positions (i, j) of the near pairs in a shard, with words[i] of length base and words[j] indexed here.

    A pair of one length comes once, the smaller word first. Pairs that share first halves are left to the
    shard of these.
    """
    middle = base // 2
    # grams that the shard's common half doesn't imply, by the positions of the shorter word
    places = range(middle - 1, base - 1) if half == 0 else range(middle)
    implied = middle - 1 if half == 0 else base - middle - 1
    index: dict[tuple[int, str], list[int]] = {}
    for j, (word, longer) in enumerate(zip(words, roles, strict=True)):
        if own[j]:
            for p in places:
                index.setdefault((p, word[p : p + Q]), []).append(j)
                if longer and word[p : p + Q] != word[p + 1 : p + 1 + Q]:  # a gram after the inserted character stands one place on
                    index.setdefault((p, word[p + 1 : p + 1 + Q]), []).append(j)
    # An edit spoils Q grams of the longer word: so many must be shared, of those that aren't implied
    need = [base + longer - Q + 1 - Q - implied for longer in (0, 1)]
    for i, a in enumerate(words):
        if roles[i]:
            continue
        lists = sorted((index.get((p, a[p : p + Q]), ()) for p in places), key=len)
        # A pair that misses as many of the shortest lists as an edit can spoil is in the next one: these are merged, the
        # longer ones are only searched
        short, rest = lists[: Q + 1], lists[Q + 1 :]
        last, shared = -1, 0
        for j in (*heapq.merge(*short), -1):
            if j == last:
                shared += 1
                continue
            if last >= 0 and (roles[last] or a < words[last]):
                least = need[roles[last]]
                for k, found in enumerate(rest):
                    if shared + len(rest) - k < least:
                        break
                    at = bisect_left(found, last)
                    shared += at < len(found) and found[at] == last
                b = words[last]
                if shared >= least and one_edit(a, b) and not (half and a[:middle] == b[:middle]):
                    yield i, last
            last, shared = j, 1


_PAIRS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _search(batches):
    """Near pairs, in both directions, of shards that come sorted."""
    now, words, counts, roles, own, head = None, [], [], [], [], (0, 0)
    out: tuple[list, list, list] = ([], [], [])

    def close():
        if len(words) > 1:
            for i, j in near_in_shard(*head, words, roles, own):
                for x, y in ((i, j), (j, i)):
                    out[0].append(words[x])
                    out[1].append(words[y])
                    out[2].append(counts[y])

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _PAIRS.types, strict=True)], schema=_PAIRS)
        for c in out:
            c.clear()
        return batch

    for batch in batches:
        for shard, half, base, word, n, role, mine in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
            if shard != now:
                close()
                now, words, counts, roles, own, head = shard, [], [], [], [], (half, base)
            words.append(word)
            counts.append(n)
            roles.append(role)
            own.append(mine)
        if len(out[0]) > 10_000:
            yield flush()
    close()
    yield flush()


def near_words(vocab: DataFrame) -> DataFrame:
    """Rows (word, near, near_n): each near pair of vocab(word, n) in both directions, once each."""
    spark = vocab.sparkSession
    rows = _shards(vocab).repartition(shuffle_parts(spark), F.xxhash64("shard")).sortWithinPartitions("shard", "word", "role")
    return arrow_map(rows, _search, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of forms(word, form): the last word on the way from form to form.

    Each form is RATIO times as frequent as its variant, so ways are short (27 steps at most for 64-bit counts); each
    round doubles the steps.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(6):
        up = now.select(F.col("word").alias("root"), F.col("root").alias("on"))
        now = written(now.select("word", "root").join(up, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "forms")
        if now.where("moved").isEmpty():
            break
    return now.select("word", "root")


def spelling_variants(vocab: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of vocab(word, n); words are not null and come once.

    form is the most frequent near word (ties: the smallest by code points) if it has RATIO times the word's
    occurrences, else null; root follows forms to the last, and is the word itself where there is none. Words of fewer than
    LEAST_LENGTH characters have no near words. An empty vocabulary gives an empty result.
    """
    vocab = written(vocab.select("word", "n"), "vocabulary")
    best = near_words(vocab).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("b"))
    rows = vocab.join(best, "word", "left")
    strong = -F.col("b.m") >= RATIO * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("b.w")).alias("form"), F.when(strong, -F.col("b.m")).alias("form_n")), "near")
    last = roots(rows.where("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(count_words(read_table(spark, sf_dir, "documents"), noise=199))
