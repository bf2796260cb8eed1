"""Commands over archives: each puts operators together and leaves effects to sinks."""

from __future__ import annotations

import os
import shutil
import time
from contextlib import contextmanager, nullcontext
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, values
from ..operators import catalog, dedup, events, reconcile
from ..sinks import dump as dumps
from ..sinks.store import Archive, session_id, single_event
from ..sinks.transfer import clone_copy, make_independent, transfer
from ..sources.documents import Settings, clean_root, file_list, listed, manifest_items, manifests, settings
from ..sources.file_tree import file_tree, with_digests, with_fingerprint

NOTHING = {"total": 0, "imported": 0, "duplicate": 0, "failed": 0, "all_cache_hit": False}


def _now() -> int:
    return int(time.time() * 1000)


class _Work:
    """A command's own folder below the archive, for what effects follow from: it must not be computed twice."""

    def __init__(self, archive: Archive):
        self.spark, self.folder = archive.spark, archive.meta.resolve() / "work" / session_id()

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """df written and read again."""
        path = f"file://{self.folder}/{name}-{session_id()}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


@contextmanager
def _work(archive: Archive, lock: bool = True):
    """A work folder for one command, removed at its end; with the archive's lock for those that change it.

    A command returns numbers or what it has written for good, never a frame over this folder.
    """
    work = _Work(archive)
    with archive.lock() if lock else nullcontext():
        try:
            yield work
        finally:
            shutil.rmtree(work.folder, ignore_errors=True)


def _config(archive: Archive) -> Settings:
    return settings(str(archive.meta / "settings.toml"))


def _manifests(archive: Archive) -> DataFrame:
    """The manifests that commits name, newest first."""
    return manifests(archive.spark, archive.manifests())


def inventory(archive: Archive) -> DataFrame:
    """What is on disk in the archive: path and size; contents aren't read."""
    return file_tree(archive.spark, str(archive.root))


def _source(spark: SparkSession, source: str, extensions: list[str], archive: Archive | None, files_from: str | None) -> DataFrame:
    skip = []
    if archive is not None and archive.root.resolve().is_relative_to(Path(source).resolve()) and archive.root.resolve() != Path(source).resolve():
        skip = [str(archive.root.resolve().relative_to(Path(source).resolve()))]
    tree = file_tree(spark, source, extensions, skip)
    if files_from is None:
        return tree
    wanted = file_list(spark, files_from).select(paths.relative_to("path", F.lit(source)).alias("path"))
    return listed(wanted, tree)


def _looked_up(archive: Archive | None, rows: DataFrame, here: DataFrame | None = None) -> DataFrame:
    """rows with status; here is the archive's inventory, if there is one already."""
    if archive is None:
        return rows.withColumn("status", F.when(F.col("error").isNotNull() | F.col("hash_error").isNotNull(), "failed").otherwise("new"))
    found = dedup.classify(dedup.fingerprint_lookup(rows, archive.files()), inventory(archive) if here is None else here)
    return found.withColumn("status", F.when(F.col("error").isNotNull() | F.col("hash_error").isNotNull(), "failed").otherwise(F.col("status")))


def scan(spark: SparkSession, source: str, archive: Archive | None = None, show_dup: bool = False, extensions: list[str] | None = None) -> DataFrame:
    """Lines of the pipe protocol for a folder; without an archive every file is new."""
    source = clean_root(source)
    exts = extensions if extensions is not None else (_config(archive) if archive else Settings()).allowed_extensions
    rows = with_fingerprint(_source(spark, source, exts, archive, None), source)
    return dedup.pipe_lines(_looked_up(archive, rows), show_dup)


def import_files(archive: Archive, source: str, force: bool = False, dry_run: bool = False, full_id: bool = False, files_from: str | None = None) -> dict:
    """Takes a folder's new files into the archive; the summary.

    Everything is classified and planned before anything is copied, so a duplicate never leaves a file.
    """
    spark, config, source = archive.spark, _config(archive), clean_root(source)
    with _work(archive) as work:
        change, here = archive.begin(), work.kept(inventory(archive), "here")
        rows = with_fingerprint(_source(spark, source, config.allowed_extensions, archive, files_from), source)
        seen = work.kept(_looked_up(archive, rows, here), "scan")
        counts = {r["status"]: r["n"] for r in seen.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        total, known = sum(n for k, n in counts.items() if k != "failed"), counts.get("duplicate", 0) + counts.get("moved", 0)
        if not total:
            return dict(NOTHING)
        fresh = dedup.filter_new(seen, force)
        if not force and total == known:
            return NOTHING | {"total": total, "duplicate": known, "all_cache_hit": True}
        if dry_run:
            return NOTHING | {"total": total, "duplicate": known}
        # Whole contents are read only of what the fingerprints leave.
        fresh = work.kept(with_digests(fresh, source, sha256=full_id or force), "hashed")
        session, now = session_id(), _now()
        video = values.quicktime_millis(F.col("video_s"))
        taken = F.timestamp_millis(F.coalesce(values.exif_millis(F.col("original")), values.exif_millis(F.col("modified")), video, F.col("mtime_ms")))
        batch = dedup.with_identity(fresh).withColumn("src_path", F.col("path")).withColumn("error", F.col("hash_error"))
        decided = batch.withColumn("reason", F.col("hash_error")) if force else dedup.strong_hash_decision(batch, dedup.known_hashes(archive.files()), here)
        dest = paths.destination("path", taken, paths.device_name(paths.exif_text("make"), paths.exif_text("model")), config.path_template)
        decided = work.kept(decided.withColumn("dest", F.when(F.col("reason").isNull(), dest)), "decided")
        planned = dedup.conflict_rename(decided.where("reason is null").select("path", "dest"), here.select("path"), config.rename_template)
        decided = decided.join(planned.select("path", F.col("final").alias("dest_path")), "path", "left")
        decided = decided.withColumn("mtime", F.col("mtime_ms")).withColumn("imported_at", F.lit(now).cast("long"))
        plan = work.kept(decided, "plan")
        moved = plan.where("dest_path is not null").select(F.concat(F.lit(f"{source}/"), F.col("path")).alias("src"), F.concat(F.lit(f"{archive.root}/"), F.col("dest_path")).alias("dest"), "path")
        copied = work.kept(transfer(moved, config.sync_strategy), "copied").select("path", "copy_error")
        plan = plan.join(copied, "path", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("copy_error").isNotNull(), F.concat(F.lit("hash error: copy: "), F.col("copy_error")))))
        out = work.kept(dedup.insert_outcome(plan, dedup.known_hashes(archive.files()), force), "outcome")
        n = dedup.outcome_summary(out).first().asDict()
        archive.take_outcomes(change, out)
        shown = out.select("src_path", F.col("manifest_dest").alias("dest_path"), "size", "mtime_ms", F.col("crc32").alias("crc32c"), values.hex_lower(F.col("xxh3_128")).alias("xxh3_128"), values.hex_lower(F.col("sha256")).alias("sha256"), "imported_at", F.col("outcome").alias("status"), F.col("reason").alias("error"))
        summary = {k: n[k] for k in ("total", "added", "duplicate", "failed", "skipped")}
        manifest = change.manifest({"session_id": session, "session_type": "import", "source_root": source, "imported_at": now, "summary": summary}, shown)
        payload = {"session_id": session, "session_type": "import", "source": source, "total_files": n["total"], "added": n["added"], "duplicate": n["duplicate"], "failed": n["failed"], "skipped": n["skipped"], "manifest": manifest}
        change.append(single_event(spark, "batch.imported", "batch", 0, payload, now))
        change.publish()
        return {"total": total, "imported": n["added"], "duplicate": n["duplicate"] + known * (not force), "failed": n["failed"], "all_cache_hit": False, "session_id": session}


def add(archive: Archive, folder: str = "") -> dict:
    """Registers files that are in the archive already; nothing is copied, moved files are only reported."""
    spark, config = archive.spark, _config(archive)
    with _work(archive) as work:
        change = archive.begin()
        tree = file_tree(spark, str(archive.root), config.allowed_extensions)
        if folder:
            tree = tree.where(paths.is_inside("path", F.lit(folder.strip("/"))))
        tracked = archive.files().where("status <> 'missing'").select("path").distinct()
        here = work.kept(inventory(archive), "here")
        seen = work.kept(_looked_up(archive, with_fingerprint(tree.join(tracked, "path", "left_anti"), str(archive.root)), here), "add")
        counts = {r["status"]: r["n"] for r in seen.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        hashed = work.kept(with_digests(seen.where("status in ('new', 'recover')"), str(archive.root)), "hashed")
        batch = dedup.with_identity(hashed).withColumn("error", F.col("hash_error")).withColumn("src_path", F.col("path"))
        decided = dedup.strong_hash_decision(batch, dedup.known_hashes(archive.files()), here, add=True)
        decided = decided.withColumn("dest_path", F.col("path")).withColumn("mtime", F.col("mtime_ms")).withColumn("imported_at", F.lit(_now()).cast("long"))
        out = work.kept(dedup.insert_outcome(decided, dedup.known_hashes(archive.files())), "added")
        n = dedup.outcome_summary(out).first().asDict()
        archive.take_outcomes(change, out)
        session = session_id()
        payload = {k: n[k] for k in ("added", "duplicate", "failed", "skipped")} | {"session_id": session, "session_type": "add", "source": str(archive.root), "total_files": n["total"], "manifest": ""}
        change.append(single_event(spark, "batch.imported", "batch", 0, payload))
        change.publish()
        return {"total": sum(counts.values()), "added": n["added"], "duplicate": n["duplicate"] + counts.get("duplicate", 0), "moved": counts.get("moved", 0), "failed": n["failed"] + counts.get("failed", 0)}


def update(archive: Archive, dry_run: bool = False) -> dict:
    """Follows moved files and marks lost ones. With nothing on disk at all, nothing is marked.

    Of the disk, only files are read that no row tracks and whose size a missing file has.
    """
    with _work(archive) as work:
        change, files, here = archive.begin(), archive.files(), inventory(archive)
        missing = work.kept(reconcile.missing_files(files, here), "missing")
        if missing.isEmpty() or here.isEmpty():
            return {"missing": missing.count(), "moved": 0, "marked": 0}
        disk = work.kept(with_digests(reconcile.untracked_candidates(here, files, missing), str(archive.root), sha256=True), "hashed")
        moves = work.kept(reconcile.reconcile_moves(missing, disk), "moves")
        lost = reconcile.unmatched(missing, moves)
        n = reconcile.update_summary(missing, moves).first()
        if not dry_run:
            change.update(reconcile.moved_rows(files, moves, lost))
            change.publish()
        return {"missing": n["missing"], "moved": n["matched"], "marked": 0 if dry_run else n["marked"]}


def verify(archive: Archive, recent_seconds: int | None = None, path: str | None = None) -> DataFrame:
    """Catalog rows against the disk. Contents are read only where sizes agree."""
    files = archive.files()
    if recent_seconds is not None:
        files = catalog.recent_files(files, recent_seconds, _now())
    if path is not None:
        files = catalog.file_by_path(files, path)
    same = files.select("path", "size", F.lit(True).alias("same")).distinct()
    here = with_digests(inventory(archive).join(same, ["path", "size"], "left"), str(archive.root), sha256=True, due="same")
    return reconcile.verify(files, here.select("path", "size", "xxh3_128", "sha256", F.coalesce("error", "hash_error").alias("error")))


def recheck(archive: Archive, session: str | None = None, with_dest_only: bool = True) -> DataFrame:
    """A session's manifest (the latest by default) against its source and the archive; what is written as a report, which stays."""
    found = _manifests(archive)
    found = found.where(F.col("session_id") == session) if session else found.limit(1)
    head = found.select("session_id", "source_root").first()
    if head is None:
        raise LookupError("no such session")
    items = manifest_items(found).select("src_path", "dest_path", F.unhex("xxh3_128").alias("xxh3_128"), F.unhex("sha256").alias("sha256"))

    def side(root: str, name: str) -> DataFrame:
        tree = file_tree(archive.spark, root).join(items.select(F.col(name).alias("path")).distinct(), "path", "left_semi")
        return with_digests(tree, root, sha256=True).select("path", "xxh3_128", "sha256", F.coalesce("error", "hash_error").alias("error"))

    out = reconcile.recheck(items, side(head["source_root"], "src_path"), side(str(archive.root), "dest_path"), with_dest_only)
    report = archive.write_report(head["session_id"], out)
    return archive.spark.read.schema(out.schema).json(report)


def clone(archive: Archive, target: str, first_day: str | None = None, last_day: str | None = None, camera: str | None = None) -> dict:
    """Copies a selection to another folder, never over a file there, and verifies what then is at the target."""
    if Path(os.path.abspath(target)).is_relative_to(os.path.abspath(archive.root)):  # lexical: links are not followed
        raise ValueError("the target lies in the archive")
    Path(target).mkdir(parents=True, exist_ok=True)
    with _work(archive, lock=False) as work:
        chosen = catalog.clone_select(archive.files(), first_day, last_day, camera)
        plan = work.kept(catalog.clone_plan(chosen, file_tree(archive.spark, target)), "clone")
        done = work.kept(clone_copy(plan, str(archive.root), target), "cloned")
        action = F.when(F.col("copy_error").isNotNull(), "failed").otherwise(F.col("action"))
        counts = {r["a"]: r["n"] for r in done.groupBy(action.alias("a")).agg(F.count(F.lit(1)).alias("n")).collect()}
        there = with_digests(file_tree(archive.spark, target).join(chosen.select("path"), "path", "left_semi"), target)
        return {k: counts.get(k, 0) for k in ("copied", "skipped", "failed")} | catalog.clone_verify(chosen, there).first().asDict()


def background_hash(archive: Archive, limit: int | None = None) -> int:
    """SHA-256 for files that have the fast hash only, with an event for each; how many got one."""
    with _work(archive) as work:
        change, files = archive.begin(), archive.files()
        due = catalog.pending_sha256(files.where("status = 'imported'"), limit)
        hashed = with_digests(due.select("id", "path", F.lit(None).cast("string").alias("error")), str(archive.root), sha256=True)
        new = work.kept(hashed.where("sha256 is not null").select("id", "path", "sha256"), "sha")
        change.update(files.drop("sha256").join(new.select("id", "sha256"), "id"))
        change.append(new.select(F.lit(_now()).cast("long").alias("occurred_at"), F.lit("file.sha256_resolved").alias("event_type"), F.lit("file").alias("entity_type"), F.col("id").alias("entity_id"), events.sha256_payload().alias("payload")))
        change.publish()
        return new.count()


def merge_segments(archive: Archive) -> int:
    """Maintenance: buckets of many small segments are written as one each, and what no commit names is deleted; how many buckets."""
    with archive.lock():
        change = archive.begin()
        n = change.merge()
        change.publish()
        archive.store.log.sweep()
        return n


def upgrade_links(archive: Archive) -> int:
    """Files of the archive that share their data through hard links get copies of their own."""
    linked = file_tree(archive.spark, str(archive.root)).where("nlink > 1").select("path", "nlink")
    with _work(archive, lock=False) as work:
        return work.kept(make_independent(linked, str(archive.root)), "links").where("how = 'copied'").count()


def status(archive: Archive, as_json: bool = False):
    report = catalog.status_report(archive.files(), _now())
    return report.select(F.to_json(F.struct(*report.columns)).alias("value")) if as_json else report


def history_sessions(archive: Archive, limit: int = 50, offset: int = 0, source: str | None = None, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    return events.page(events.sessions(archive.events(), source, from_ms, to_ms), [F.desc("seq")], limit, offset)


def history_items(archive: Archive, session: str | None = None, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = manifest_items(_manifests(archive))
    if session:
        rows = rows.where(F.col("session_id") == session)
    return events.page(events.items(rows, status), ["session_id", "src_path"], limit, offset)


def brought_by(archive: Archive, dests: list[str]) -> DataFrame:
    """dest_path, session_id, src_path, status: the newest import that wrote each of some destinations. Only their part of the index is read."""
    return events.newest_by_dest(archive.store.items(dests=dests))


def verify_chain(archive: Archive) -> DataFrame:
    return events.verify_chain(archive.events())


def tables(archive: Archive) -> list[str]:
    """The tables that an archive dumps."""
    return ["events", "files"]


def dump_tables(archive: Archive, path: str, form: str = "csv", tables: list[str] | None = None, limit: int | None = None) -> list[str]:
    have = {"files": archive.files(), "events": archive.events()}
    unknown = [t for t in tables or [] if t not in have]
    chosen = {k: v for k, v in have.items() if tables is None or k in tables}
    return [f"{t}: no such table" for t in unknown] + dumps.dump(archive.spark, chosen, path, form, limit)


def sync(source: Archive, target: Archive) -> DataFrame:
    """Imported files of source whose content target doesn't have."""
    return dedup.missing_contents(source.files(), target.files())
