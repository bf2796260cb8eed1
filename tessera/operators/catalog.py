"""Filters, lookups and statistics over the catalog of archived files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

DAY_MS = 86_400_000


def all_files(files: DataFrame) -> DataFrame:
    return files.orderBy("path")


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    """The row with this path; of several, the one with the smallest id."""
    return files.where(F.col("path") == path).orderBy("id").limit(1)


def files_by_paths(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bulk form: wanted(path) against the catalog, first row by id."""
    first = files.groupBy("path").agg(F.min("id").alias("id"))
    return wanted.join(first, "path", "left")


def imported_since(files: DataFrame, since_ms: int) -> DataFrame:
    """From since_ms on, itself included."""
    return files.where(F.col("imported_at") >= since_ms).orderBy("imported_at", "id")


def recent_files(files: DataFrame, seconds: int, now_ms: int) -> DataFrame:
    return imported_since(files, now_ms - seconds * 1000)


def pending_sha256(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Files that have the fast hash only, oldest import first."""
    out = files.where(F.col("sha256").isNull() & F.col("xxh3_128").isNotNull()).orderBy("imported_at", "id")
    return out if limit is None else out.limit(limit)


def imported_only(files: DataFrame) -> DataFrame:
    return files.where(F.col("status") == "imported")


def vault_stats(files: DataFrame) -> DataFrame:
    """One row of counts and sums, in one pass."""

    def count_if(cond):
        return F.coalesce(F.count_if(cond), F.lit(0))

    return files.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"),
        count_if(F.col("status") == "imported").alias("imported"),
        count_if(F.col("status") == "duplicate").alias("duplicate"),
        count_if(F.col("status") == "missing").alias("missing"),
        count_if(F.col("sha256").isNotNull()).alias("with_sha256"),
        count_if(F.col("sha256").isNull() & F.col("xxh3_128").isNotNull()).alias("pending_sha256"),
    )


def extension_stats(files: DataFrame, limit: int | None = 10, first_dot: bool = True) -> DataFrame:
    """Count and size by extension, largest first. first_dot groups by all after a path's first dot."""
    ext = paths.extension_after_first_dot("path") if first_dot else paths.extension("path")
    out = files.select(ext.alias("extension"), "size").where("extension is not null").groupBy("extension").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("total_size"))
    out = out.orderBy(F.desc("total_size"), "extension")
    return out if limit is None else out.limit(limit)


def recent_imports(files: DataFrame, now_ms: int, days=(1, 7, 30)) -> DataFrame:
    """Imports after (not at) so many days before now, all in one pass."""
    return files.agg(*[F.coalesce(F.count_if(F.col("imported_at") > now_ms - d * DAY_MS), F.lit(0)).alias(f"last_{d}_days") for d in days])


TOTALS = "extension string, status string, strong boolean, fast boolean, day bigint, n bigint, size bigint"


def totals(files: DataFrame, sign: int = 1) -> DataFrame:
    """Rows of TOTALS: counts and sizes of files by all that the statistics ask for; sign -1 takes them back."""
    keys = [paths.extension_after_first_dot("path").alias("extension"), F.col("status"), F.col("sha256").isNotNull().alias("strong"), F.col("xxh3_128").isNotNull().alias("fast"), F.floor(F.col("imported_at") / DAY_MS).alias("day")]
    return files.select(*keys, "size").groupBy("extension", "status", "strong", "fast", "day").agg((F.lit(sign) * F.count(F.lit(1))).alias("n"), (F.lit(sign) * F.coalesce(F.sum("size"), F.lit(0))).cast("long").alias("size"))


def stats_of_totals(view: DataFrame) -> DataFrame:
    """vault_stats(), from totals."""

    def count_if(cond, what="n"):
        return F.coalesce(F.sum(F.when(cond, F.col(what))), F.lit(0)).cast("long")

    return view.agg(
        count_if(F.lit(True)).alias("total_files"),
        count_if(F.lit(True), "size").alias("total_size"),
        *[count_if(F.col("status") == k).alias(k) for k in ("imported", "duplicate", "missing")],
        count_if(F.col("strong")).alias("with_sha256"),
        count_if(~F.col("strong") & F.col("fast")).alias("pending_sha256"),
    )


def extensions_of_totals(view: DataFrame, limit: int | None = 10) -> DataFrame:
    """extension_stats(), from totals."""
    out = view.where("extension is not null").groupBy("extension").agg(F.sum("n").alias("n"), F.sum("size").cast("long").alias("total_size")).where("n > 0")
    out = out.orderBy(F.desc("total_size"), "extension")
    return out if limit is None else out.limit(limit)


def recent_of_totals(view: DataFrame, files: DataFrame, now_ms: int, days=(1, 7, 30)) -> DataFrame:
    """recent_imports(): whole days from totals, of files only those imported on a day that a bound cuts."""
    parts = []
    for d in days:
        after = now_ms - d * DAY_MS
        edge = (after // DAY_MS + 1) * DAY_MS
        cut = files.where((F.col("imported_at") > after) & (F.col("imported_at") < edge)).select(F.lit(d).alias("d"), F.lit(1).cast("long").alias("n"))
        parts += [view.where(F.col("day") * DAY_MS >= edge).select(F.lit(d).alias("d"), "n"), cut]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    return rows.agg(*[F.coalesce(F.sum(F.when(F.col("d") == d, F.col("n"))), F.lit(0)).alias(f"last_{d}_days") for d in days])


def status_report(files: DataFrame, now_ms: int, top: int = 10) -> DataFrame:
    """Statistics, recent imports and the largest extensions as one row."""
    exts = extension_stats(files, top)
    ext = exts.agg(F.array_sort(F.collect_list(F.struct((-F.col("total_size")).alias("k"), "extension", "n", "total_size"))).alias("e"))
    ext = ext.select(F.transform("e", lambda x: F.struct(x.extension.alias("extension"), x.n.alias("n"), x.total_size.alias("total_size"))).alias("extensions"))
    one = vault_stats(files).withColumn("k", F.lit(1)).join(recent_imports(files, now_ms).withColumn("k", F.lit(1)), "k")
    return one.join(ext.withColumn("k", F.lit(1)), "k").drop("k")


def clone_select(files: DataFrame, first_day: str | None = None, last_day: str | None = None, camera: str | None = None) -> DataFrame:
    """Imported files of a range of days (both ends included) and of a camera (a part of the path)."""
    out = imported_only(files)
    if first_day or last_day:
        day = paths.date_in_path("path")
        out = out.where(day.isNotNull())
        if first_day:
            out = out.where(day >= F.lit(first_day).cast("date"))
        if last_day:
            out = out.where(day <= F.lit(last_day).cast("date"))
    if camera:
        out = out.where(F.contains(F.lower("path"), F.lit(camera.lower())))
    return out


def clone_plan(selected: DataFrame, target: DataFrame) -> DataFrame:
    """What copying to a target(path, size) does: skipped if there with equal size, failed if with another, else copied."""
    there = target.select("path", F.col("size").alias("there"))
    action = F.when(F.col("there").isNull(), "copied").when(F.col("there") == F.col("size"), "skipped").otherwise("failed")
    return selected.join(there, "path", "left").select("id", "path", "size", action.alias("action"))


def clone_verify(files: DataFrame, target: DataFrame) -> DataFrame:
    """Counts of selected files at the target that agree in size and hash; absent ones aren't counted."""
    there = target.select("path", F.col("size").alias("there"), F.col("xxh3_128").alias("hash"))
    joined = files.join(there, "path").where("hash is not null")
    good = (F.col("there") == F.col("size")) & F.col("hash").eqNullSafe(F.col("xxh3_128"))
    return joined.agg(F.coalesce(F.count_if(good), F.lit(0)).alias("verified"), F.coalesce(F.count_if(~good), F.lit(0)).alias("mismatched"))
