"""Results as JSON lines: one object a row, its kind under `event`; null fields are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reconcile import RECHECK


def event_lines(rows: DataFrame, event: str, *columns: str | Column) -> DataFrame:
    """line: {"event": event, ...} for each row, with the given columns (all by default)."""
    return rows.select(F.to_json(F.struct(F.lit(event).alias("event"), *(columns or rows.columns))).alias("line"))


def scan_lines(classified: DataFrame) -> DataFrame:
    return event_lines(classified, "scan_item", "path", "size", "mtime_ms", "status", "error")


def preflight_line(classified: DataFrame, source: str) -> DataFrame:
    """The counts before a copy; another event if there is nothing to do."""

    def n(*kinds):
        return F.count_if(F.col("status").isin(*kinds))

    counts = classified.agg(F.count(F.lit(1)).alias("total"), n("new", "recover").alias("new"), n("duplicate").alias("duplicate"), n("moved").alias("moved"), n("failed").alias("failed"))
    some = F.to_json(F.struct(F.lit("preflight").alias("event"), F.col("total").alias("total_scanned"), "new", "duplicate", "moved", "failed", F.lit(source).alias("source")))
    nothing = F.to_json(F.struct(F.lit("nothing_to_import").alias("event"), "total", "duplicate", "moved"))
    return counts.select(F.when(F.col("new") == 0, nothing).otherwise(some).alias("line"))


def session_lines(sessions: DataFrame) -> DataFrame:
    return event_lines(sessions, "history_sessions_item", "session_id", "session_type", "source", F.col("occurred_at").alias("started_at_ms"), "total_files", "added", "duplicate", "failed", "skipped")


def item_lines(items: DataFrame) -> DataFrame:
    return event_lines(items, "history_items_item", "session_id", "src_path", "dest_path", "status", "size", "mtime_ms")


def page_line(info: DataFrame, event: str) -> DataFrame:
    """The end of a listing: total and returned."""
    return event_lines(info, event, F.struct("total", "returned").alias("summary"))


def verify_lines(verified: DataFrame) -> DataFrame:
    """Results with what differed: sizes, the kind of hash, or the error."""
    sizes = F.when(F.col("result") == "size_mismatch", F.struct(F.col("expected").cast("bigint").alias("expected"), F.col("actual").cast("bigint").alias("actual"), F.lit(None).cast("string").alias("algorithm")))
    kind = F.when(F.length("expected") == 64, "Secure").otherwise("Fast")
    hashes = F.when(F.col("result") == "hash_mismatch", F.struct(F.lit(None).cast("bigint").alias("expected"), F.lit(None).cast("bigint").alias("actual"), kind.alias("algorithm")))
    return event_lines(verified, "verify_item_finished", "path", F.col("result").alias("status"), F.coalesce(sizes, hashes).alias("details"))


def summary_line(summary: DataFrame, event: str) -> DataFrame:
    """import_summary, add_summary, recheck_summary, update_summary or verify_summary: a line of counts."""
    return event_lines(summary, event)


def _one(spark: SparkSession, event: str, **fields) -> DataFrame:
    """line: a single event with constant fields; those that are None are left out."""
    given = {k: v for k, v in fields.items() if v is not None}
    return spark.range(1).select(F.to_json(F.struct(F.lit(event).alias("event"), *[F.lit(v).alias(k) for k, v in given.items()])).alias("line"))


def _framed(lines: DataFrame, name: str, **fields) -> DataFrame:
    """lines with the events <name>_started and <name>_finished; fields are the start's. Lines have no order of their own."""
    spark = lines.sparkSession
    return _one(spark, f"{name}_started", **fields).unionAll(lines).unionAll(_one(spark, f"{name}_finished"))


def _each(rows: DataFrame, *events: Column) -> DataFrame:
    """line: several events for each row, in one pass."""
    return rows.select(F.explode(F.array(*events)).alias("line"))


def _json(event: str, *columns: Column | str, nulls: bool = False) -> Column:
    return F.to_json(F.struct(F.lit(event).alias("event"), *columns), {"ignoreNullFields": "false"} if nulls else {})


def started_and_finished(lines: DataFrame, name: str) -> DataFrame:
    """A phase's item lines (scan, verify) between its start and its end."""
    return _framed(lines, name)


def copy_lines(copied: DataFrame) -> DataFrame:
    """Of rows(src, dest, size, copy_error): each file's start, its progress once it is there, and its end, between those of the phase."""
    done, total = F.when(F.col("copy_error").isNull(), F.col("size")).otherwise(F.lit(0)), F.col("size")
    percent = F.when(total > 0, F.floor(done * 100 / total)).otherwise(F.lit(0)).cast("int")
    status = F.when(F.col("copy_error").isNull(), "ok").otherwise("failed")
    lines = _each(
        copied,
        _json("copy_item_started", "src", "dest", "size"),
        _json("copy_item_progress", "src", done.alias("bytes_copied"), total.alias("bytes_total"), percent.alias("percent")),
        _json("copy_item_finished", "src", "dest", status.alias("status"), F.col("copy_error").alias("error")),
    )
    return _framed(lines, "copy")


def hash_lines(hashed: DataFrame) -> DataFrame:
    """Of rows(path, size, error): each file's start and end (its error or null), between those of the phase."""
    return _framed(_each(hashed, _json("hash_item_started", "path", "size"), _json("hash_item_finished", "path", "error", nulls=True)), "hash")


def insert_lines(summary: DataFrame, manifest_path: str | None) -> DataFrame:
    """Of a summary(total, added, duplicate, failed): the phase with its progress at the end, and import_summary."""
    progress = summary.select(_json("insert_progress", F.col("total").alias("completed"), "total").alias("line"))
    counts = summary.select(_json("import_summary", "total", F.col("added").alias("imported"), "duplicate", "failed", F.lit(manifest_path).cast("string").alias("manifest_path"), nulls=True).alias("line"))
    return _framed(progress, "insert").unionAll(counts)


def add_lines(classified: DataFrame, summary: DataFrame, vault_root: str) -> DataFrame:
    """Of classified(path, status, c_path) files of an archive and what adding them gave: counts before, moved files, counts after.

    A moved file is a line of its own, so that no line grows with the archive: add_only_moved where nothing is new, else
    add_moved_hint.
    """
    spark, status = classified.sparkSession, F.col("status")
    counts = classified.agg(F.count_if(status.isin("new", "recover")).alias("new"), F.count_if(status == "duplicate").alias("duplicate"), F.count_if(status == "moved").alias("moved"))
    files = F.array(F.struct(F.col("path").alias("current"), F.col("c_path").alias("previous"))).alias("moved_files")
    root = F.lit(vault_root).alias("vault_root")
    some = classified.where("status = 'moved'").crossJoin(counts.select("new"))  # a row of counts
    moved = some.select(F.when(F.col("new") == 0, _json("add_only_moved", root, files)).otherwise(_json("add_moved_hint", root, files)).alias("line"))
    end = summary.select(_json("add_summary", "total", "added", "duplicate", "failed").alias("line"))
    return counts.select(_json("add_preflight", "new", "duplicate", "moved").alias("line")).unionAll(moved).unionAll(end).unionAll(_one(spark, "add_finished"))


def recheck_lines(rows: DataFrame, summary: DataFrame, session_id: str, source: str, report_path: str) -> DataFrame:
    """Of a recheck's rows and summary: the phase's start with its total, each item's start and result, the end and the counts."""
    start = summary.select(_json("recheck_started", "total", F.lit(session_id).alias("session_id"), F.lit(source).alias("source")).alias("line"))
    vault = F.col("dest_path").alias("vault_path")
    items = _each(rows, _json("recheck_item_started", "src_path", vault), _json("recheck_item_finished", "src_path", vault, F.col("result").alias("status")))
    kinds = [k for k in RECHECK if k != "error"]
    end = summary.select(_json("recheck_summary", *kinds, F.col("error").alias("errors"), "sha256_verified", F.lit(report_path).alias("report_path")).alias("line"))
    return start.unionAll(items).unionAll(_one(rows.sparkSession, "recheck_finished")).unionAll(end)


def update_lines(summary: DataFrame, dry_run: bool = False) -> DataFrame:
    """Of a summary(scanned, missing, matched, unmatched, updated): the phase, its progress at the end and the counts; in a dry run, how many
    would be marked missing."""
    left = F.when(F.lit(dry_run), F.lit(0)).otherwise(F.col("unmatched"))
    total = (F.col("matched") + left).alias("total")
    parts = [_json("update_apply_started", total), _json("update_apply_finished"), _json("update_apply_summary", "scanned", "missing", "matched", "unmatched", "updated")]
    dry = F.when(F.col("unmatched") > 0, _json("update_dry_run_missing", F.col("unmatched").alias("count")))
    parts.append(dry if dry_run else F.when(total > 0, _json("update_apply_progress", (F.col("updated") + left).alias("completed"), total)))
    return _each(summary, *parts).where("line is not null")


def update_error_lines(rows: DataFrame) -> DataFrame:
    """Of rows(path, message): updates that failed."""
    return event_lines(rows, "update_apply_error", "message", "path")
