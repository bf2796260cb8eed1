"""Exact dedup by content-defined chunk recipes.

Every text is cut into chunks where its own content says so, chunks are deduplicated to verified
identifiers, and texts are compared as ordered lists of those identifiers. A text's bytes cross the
network once, as chunks; all later steps move short lists of integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import arrow_map
from .common import byte_table, read_table, written

MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 4096, 8192, 65536
_GEAR = byte_table(11)


def normalise(raw: bytes) -> bytes:
    r"""Every run of [\x20\x09-\x0D] becomes one space."""
    parts = raw.split()
    if not parts:
        return b" " if raw else b""
    out = b" ".join(parts)
    if raw[:1].isspace():
        out = b" " + out
    return out + b" " if raw[-1:].isspace() else out


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of data: after bytes whose last 16 bytes hash to a chosen residue."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):
        shifted = h.copy()
        shifted[step:] += h[:-step] << np.uint64(step)
        h = shifted
    marks = np.flatnonzero((h >> np.uint64(40)) % np.uint64(MEAN_CHUNK - MIN_CHUNK) == 0) + 1
    ends, at = [], 0
    while n - at > MIN_CHUNK:
        k = int(np.searchsorted(marks, at + MIN_CHUNK))
        end = min(int(marks[k]) if k < len(marks) else n, at + MAX_CHUNK, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def _chunker(bits: int):
    keep = (1 << bits) - 1

    def digest(piece: bytes) -> int:
        x = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little") & keep
        return x - (1 << 64) if x >= 1 << 63 else x

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            shas, recipes, pieces = [], [], []
            for text in texts:
                data = normalise(text.as_py() or b"")
                shas.append(hashlib.sha256(data).hexdigest())
                at, own = 0, []
                for end in cut_points(data):
                    own.append(data[at:end])
                    at = end
                pieces.append(own)
                recipes.append([digest(p) for p in own])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(shas, pa.string()), pa.array(recipes, pa.list_(pa.int64())), pa.array(pieces, pa.list_(pa.binary()))],
                ["id", "sha", "recipe", "pieces"],
            )

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 64) -> DataFrame:
    r"""One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of [\x20\x09-\x0D] has become one space;
    null counts as empty. The row with the smallest id stays. Defined edge cases: an empty table gives
    an empty result; rows that repeat an id and its text count each and are kept or dropped alike; a
    null id ranks after all others, and is kept only in a group of null ids; other columns of docs
    are not read, so their names can't clash.

    digest_bits shortens the chunk digests, so that tests can make them collide; results don't change.
    """
    id_type = dict(docs.dtypes)[id_col]
    if id_type in ("tinyint", "smallint", "int"):
        id_type = "bigint"
    rows = docs.select(F.col(id_col).cast(id_type).alias("id"), F.col(text_col).cast("string").alias("text"))
    staged = written(
        arrow_map(rows, _chunker(digest_bits), f"id {id_type}, sha string, recipe array<bigint>, pieces array<binary>"),
        "chunks",
    )
    # Identifiers are verified by comparing the bytes of all chunks that share a digest. The count is
    # combined before the shuffle, so a chunk that occurs everywhere moves once per task.
    chunks = staged.select(F.explode(F.arrays_zip("recipe", "pieces")).alias("c")).select("c.recipe", "c.pieces")
    distinct = chunks.groupBy("recipe", "pieces").agg(F.count(F.lit(1)).alias("n"))
    clashing = distinct.groupBy("recipe").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("recipe")
    clashing = written(clashing, "clashing")
    if clashing.isEmpty():
        recipes = staged.select("id", "sha", F.col("recipe").alias("key"))
    else:
        recipes = _told_apart(staged, distinct, clashing)
    groups = recipes.groupBy("key").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # A hot key has many rows on the left and one on the right: AQE's skew join splits it.
    joined = recipes.join(groups, "key")
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _told_apart(staged: DataFrame, distinct: DataFrame, clashing: DataFrame) -> DataFrame:
    """Recipes whose digests carry a rank among the contents that share them, where there are several."""
    ranks = distinct.join(clashing, "recipe", "left_semi").select(
        F.col("recipe").alias("digest"),
        F.col("pieces").alias("piece"),
        F.expr("dense_rank() over (partition by recipe order by pieces)").alias("rank"),
    )
    # Rows are told apart by content, so that repeated ids can't mix: sha and recipe name a text's list.
    texts = staged.select("sha", "recipe", "pieces").dropDuplicates(["sha", "recipe", "pieces"])
    spots = texts.select("sha", "recipe", "pieces", F.posexplode(F.arrays_zip(F.col("recipe").alias("d"), F.col("pieces").alias("p"))).alias("pos", "c"))
    named = (
        spots.select("sha", "recipe", "pieces", "pos", F.col("c.d").alias("digest"), F.col("c.p").alias("piece"))
        .join(ranks, ["digest", "piece"], "left")
        .groupBy("sha", "recipe", "pieces")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "digest", F.coalesce("rank", F.lit(0)).alias("rank")))).alias("key"))
        .select(F.col("sha").alias("s"), F.col("recipe").alias("r"), F.col("pieces").alias("p"), F.transform("key", lambda x: F.struct(x.digest, x.rank)).alias("key"))
    )
    on = (F.col("sha") == F.col("s")) & (F.col("recipe") == F.col("r")) & (F.col("pieces") == F.col("p"))
    none = F.expr("cast(array() as array<struct<digest: bigint, rank: int>>)")
    return staged.join(named, on, "left").select("id", "sha", F.coalesce("key", none).alias("key"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""
