"""Catalog against disk: missing and moved files, verification, recheck against the source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import kept
from .numbering import matched

VERIFY = ("ok", "missing", "io_error", "size_mismatch", "hash_mismatch", "hash_not_available")
RECHECK = ("ok", "source_modified", "vault_corrupted", "both_diverged", "source_deleted", "vault_deleted", "error")


def missing_files(files: DataFrame, disk: DataFrame) -> DataFrame:
    """Imported files whose path isn't on disk."""
    return files.where("status = 'imported'").join(disk.select("path"), "path", "left_anti")


def reconcile_moves(missing: DataFrame, disk: DataFrame) -> DataFrame:
    """id, old_path, new_path, confidence: a missing file's content found at another path.

    Contents agree by fast hash and size, and by SHA-256 where both sides have it (definitive, and matched first; otherwise
    fast). Of each content, the k-th missing path (ties: id) is found at the k-th path on disk, so that each file and each row
    is matched once at most.
    """
    key = ["xxh3_128", "size"]
    lost = missing.select(*key, F.col("sha256").alias("m_sha"), F.col("path").alias("old_path"), "id")
    there = disk.select(*key, F.col("sha256").alias("d_sha"), F.col("path").alias("new_path"))
    out, before = None, ["old_path", "id"]
    for kind in ("definitive", "bare", "unread"):
        if out is not None:
            lost, there = lost.join(out.select("id"), "id", "left_anti"), there.join(out.select("new_path"), "new_path", "left_anti")
        if kind == "definitive":
            pairs = matched(lost.withColumn("sha", F.col("m_sha")).drop("m_sha"), there.withColumn("sha", F.col("d_sha")).drop("d_sha"), [*key, "sha"], before, ["new_path"])
        elif kind == "bare":  # the catalog has no SHA-256
            pairs = matched(lost.where("m_sha is null").drop("m_sha"), there.drop("d_sha"), key, before, ["new_path"])
        else:  # the disk's could not be read
            pairs = matched(lost.where("m_sha is not null").drop("m_sha"), there.where("d_sha is null").drop("d_sha"), key, before, ["new_path"])
        found = pairs.select("id", "old_path", "new_path", F.lit("definitive" if kind == "definitive" else "fast").alias("confidence"))
        out = kept(found if out is None else out.unionByName(found), "moves")
    return out


def update_summary(missing: DataFrame, moves: DataFrame) -> DataFrame:
    """missing, matched and marked, as one row."""
    both = missing.select("id").join(moves.select("id", F.lit(1).alias("moved")), "id", "left")
    return both.agg(F.count(F.lit(1)).alias("missing"), F.count("moved").alias("matched"), (F.count(F.lit(1)) - F.count("moved")).alias("marked"))


def moved_rows(files: DataFrame, moves: DataFrame, lost: DataFrame) -> DataFrame:
    """The rows of files that an update changes, as they are then: moved ones with their new path, lost ones as `missing`."""
    moved = files.join(moves.select("id", "new_path"), "id").withColumn("path", F.col("new_path")).select(*files.columns)
    return moved.unionByName(files.join(lost.select("id"), "id", "left_semi").withColumn("status", F.lit("missing")).select(*files.columns))


def untracked_candidates(disk: DataFrame, files: DataFrame, missing: DataFrame) -> DataFrame:
    """The rows of disk(path, size) whose contents may be a missing file's: no row tracks the path, and some missing row has the size."""
    tracked = files.where("status <> 'missing'").select("path").distinct()
    return disk.join(tracked, "path", "left_anti").join(missing.select("size").distinct(), "size", "left_semi")


def unmatched(missing: DataFrame, moves: DataFrame) -> DataFrame:
    return missing.join(moves.select("id"), "id", "left_anti")


def apply_moves(files: DataFrame, moves: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """The catalog after an update: moved rows have their new path, lost ones the status `missing`."""
    out = files.join(moves.select("id", "new_path"), "id", "left").withColumn("path", F.coalesce("new_path", "path")).drop("new_path")
    if lost is not None:
        gone = lost.select("id", F.lit(True).alias("_gone"))
        out = out.join(gone, "id", "left").withColumn("status", F.when(F.col("_gone"), "missing").otherwise(F.col("status"))).drop("_gone")
    return out.select(*files.columns)


def verify(files: DataFrame, disk: DataFrame) -> DataFrame:
    """id, path, result, expected, actual: each catalog row against disk(path, size, xxh3_128, sha256, error).

    Size is compared before hashes, SHA-256 before the fast hash; rows marked missing are verified too.
    """
    there = disk.select(F.col("path").alias("_p"), F.col("size").alias("d_size"), F.col("xxh3_128").alias("d_x"), F.col("sha256").alias("d_s"), F.col("error").alias("d_e"))
    j = files.join(there, F.col("path") == F.col("_p"), "left")
    use_sha, use_x = F.col("sha256").isNotNull(), F.col("xxh3_128").isNotNull()
    bad = F.when(use_sha, ~F.col("sha256").eqNullSafe(F.col("d_s"))).when(use_x, ~F.col("xxh3_128").eqNullSafe(F.col("d_x")))
    result = (
        F.when(F.col("_p").isNull(), "missing")
        .when(F.col("d_e").isNotNull(), "io_error")
        .when(F.col("d_size") != F.col("size"), "size_mismatch")
        .when(~use_sha & ~use_x, "hash_not_available")
        .when(bad, "hash_mismatch")
        .otherwise("ok")
    )
    j = j.withColumn("result", result)
    expected = F.when(F.col("result") == "size_mismatch", F.col("size").cast("string")).when(F.col("result") == "hash_mismatch", F.when(use_sha, F.lower(F.hex("sha256"))).otherwise(F.lower(F.hex("xxh3_128"))))
    actual = F.when(F.col("result") == "size_mismatch", F.col("d_size").cast("string")).when(F.col("result") == "hash_mismatch", F.when(use_sha, F.lower(F.hex("d_s"))).otherwise(F.lower(F.hex("d_x"))))
    return j.select("id", "path", "result", expected.alias("expected"), actual.alias("actual"))


def verify_summary(verified: DataFrame) -> DataFrame:
    counts = [F.coalesce(F.count_if(F.col("result") == k), F.lit(0)).alias(k) for k in VERIFY]
    failed = F.coalesce(F.count_if(~F.col("result").isin("ok", "hash_not_available")), F.lit(0))
    return verified.agg(F.count(F.lit(1)).alias("total"), *counts, failed.alias("failed"))


def recheck(items: DataFrame, source: DataFrame, vault: DataFrame, with_dest_only: bool = True) -> DataFrame:
    """Manifest items against the hashes of their source and vault files, one of seven results each.

    items(src_path, dest_path, xxh3_128, sha256); source and vault(path, xxh3_128, sha256, error). The
    manifest's SHA-256 decides if it has one. Items without a destination are left out; with
    with_dest_only = False they count as deleted from the vault.
    """
    s = source.select(F.col("path").alias("src_path"), F.struct(F.lit(True).alias("there"), "xxh3_128", "sha256", "error").alias("s"))
    v = vault.select(F.col("path").alias("dest_path"), F.struct(F.lit(True).alias("there"), "xxh3_128", "sha256", "error").alias("v"))
    rows = items.where("dest_path is not null") if with_dest_only else items
    j = rows.join(s, "src_path", "left").join(v, "dest_path", "left")
    sha = F.col("sha256").isNotNull()

    def same(side):
        return F.when(sha, F.col(f"{side}.sha256").eqNullSafe(F.col("sha256"))).otherwise(F.col(f"{side}.xxh3_128").eqNullSafe(F.col("xxh3_128")))

    result = (
        F.when(F.col("s.error").isNotNull(), "error")
        .when(F.col("v.error").isNotNull(), "error")
        .when(F.col("s.there").isNull(), "source_deleted")
        .when(F.col("v.there").isNull(), "vault_deleted")
        .when(same("s") & same("v"), "ok")
        .when(same("s"), "vault_corrupted")
        .when(same("v"), "source_modified")
        .otherwise("both_diverged")
    )
    return j.select("src_path", "dest_path", result.alias("result"), sha.alias("used_sha256"))


def recheck_summary(rows: DataFrame) -> DataFrame:
    counts = [F.coalesce(F.count_if(F.col("result") == k), F.lit(0)).alias(k) for k in RECHECK]
    return rows.agg(F.count(F.lit(1)).alias("total"), *counts, F.coalesce(F.count_if("used_sha256"), F.lit(0)).alias("sha256_verified"))


def verify_source(items: DataFrame, source: DataFrame) -> DataFrame:
    """Manifest items against their source files: unchanged, size_changed, modified, deleted or error."""
    s = source.select(F.col("path").alias("src_path"), F.struct(F.lit(True).alias("there"), "size", "xxh3_128", "sha256", "error").alias("s"))
    j = items.join(s, "src_path", "left")
    same = F.when(F.col("sha256").isNotNull(), F.col("s.sha256").eqNullSafe(F.col("sha256"))).otherwise(F.col("s.xxh3_128").eqNullSafe(F.col("xxh3_128")))
    result = F.when(F.col("s.there").isNull(), "deleted").when(F.col("s.error").isNotNull(), "error").when(F.col("s.size") != F.col("size"), "size_changed").when(same, "unchanged").otherwise("modified")
    return j.select("src_path", result.alias("result"))
