"""The event log: filters, the hash chain, history."""

from __future__ import annotations

import hashlib
from itertools import pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import GENESIS, event_hash
from ..scratch import scratch_path
from ..session import arrow_map, shuffle_parts, with_fields

COLUMNS = ["seq", "occurred_at", "event_type", "entity_type", "entity_id", "payload", "prev_hash", "self_hash"]
PAYLOAD = "session_id string, session_type string, source string, total_files long, added long, duplicate long, failed long, skipped long, manifest string"
#: What an item filter may be called, and the status it stands for.
STATUS_NAMES = {
    "added": "added", "duplicate": "duplicate", "dup": "duplicate", "failed": "failed", "fail": "failed", "skipped": "skipped",
    "skip": "skipped", "missing": "missing", "moved": "moved", "move": "moved", "relinked": "relinked", "unchanged": "unchanged",
}


def filter_events(events: DataFrame, event_type: str | None = None, from_ms: int | None = None, to_ms: int | None = None, path: str | None = None, limit: int | None = None, payload_like: str | None = None) -> DataFrame:
    """Newest first; bounds are included; an argument that is None filters nothing."""
    out = events
    if event_type is not None:
        out = out.where(F.col("event_type") == event_type)
    if from_ms is not None:
        out = out.where(F.col("occurred_at") >= from_ms)
    if to_ms is not None:
        out = out.where(F.col("occurred_at") <= to_ms)
    if path is not None:
        keys = [F.get_json_object("payload", f"$.{k}") == path for k in ("path", "old_path", "new_path")]
        out = out.where(F.coalesce(keys[0], F.lit(False)) | F.coalesce(keys[1], F.lit(False)) | F.coalesce(keys[2], F.lit(False)))
    if payload_like is not None:
        out = out.where(F.col("payload").ilike(payload_like))
    out = out.orderBy(F.desc("seq"))
    return out if limit is None else out.limit(limit)


def count_events(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("n"))


#: Rows of a block: what one task sorts and links, however long a log is.
BLOCK = 500_000


def build_chain(events: DataFrame, by: list[str] | None = None, head: str = GENESIS, order: tuple[str, ...] = ("seq",), after: int | None = None) -> DataFrame:
    """events with prev_hash and self_hash, chained in the given order from head; one chain for each value of by. With after, they
    are one chain and get their seq here: after + 1, after + 2, ...

    Rows are written in blocks of sorted ranges. A link needs the one before it, so the hashes that chains have at the ends of blocks
    are found by one small task after another, each over the bodies of one block; with them, all blocks are linked at once.
    Rows that agree in the order follow their bodies, so that both passes have one order.
    """
    by = by or []
    columns = ["occurred_at", "event_type", "entity_type", "entity_id", "payload"]
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    key = F.to_json(F.struct(*[F.col(c) for c in by])) if by else F.lit("")
    rows = events.withColumn("_by", key).withColumn("_body", F.concat_ws("|", *parts).cast("binary"))
    sort = ["_block", "_by", *order, "_body"]
    n = -(-events.count() // BLOCK)
    if n <= 1:
        ranged, starts = rows.coalesce(1).withColumn("_block", F.lit(0)), {}
    else:
        blocks = _blocks(rows, n, sort)
        starts = _starts(blocks, head, sort)
        ranged = blocks.repartitionByRange(n, "_block")
    names = events.columns
    numbered = [] if after is None else ["seq"]
    schema = with_fields(with_fields(events.schema, **dict.fromkeys(numbered, "long")), prev_hash="string", self_hash="string")
    start = after or 0

    def link(batches):
        import pyarrow as pa

        block = key = last = None
        at = start
        for batch in batches:
            prev, own, seq = [], [], []
            for b, k, bodies in _runs(batch):
                if b != block:
                    block, (key, last, before) = b, starts.get(b, (None, None, 0))
                    at = start + before
                if k != key:
                    key, last = k, head
                for body in bodies:
                    prev.append(last)
                    last = _link(body, last)
                    own.append(last)
                seq += range(at + 1, at + 1 + len(bodies))
                at += len(bodies)
            more = [pa.array(seq, pa.int64())] if numbered else []
            more += [pa.array(prev, pa.string()), pa.array(own, pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *more], names=[*names, *numbered, "prev_hash", "self_hash"])

    return arrow_map(ranged.sortWithinPartitions(*sort), link, schema)


def _link(body: bytes, last: str) -> str:
    return hashlib.sha256(body + b"|" + last.encode()).hexdigest()


def _runs(batch):
    """Block, key and bodies of sorted rows: all of a batch at once where its ends agree."""
    block, key, bodies = batch.column("_block"), batch.column("_by"), batch.column("_body").to_pylist()
    if bodies and block[0] == block[-1] and key[0] == key[-1]:
        yield block[0].as_py(), key[0].as_py(), bodies
    else:
        for b, k, body in zip(block.to_pylist(), key.to_pylist(), bodies, strict=True):
            yield b, k, [body]


def _blocks(rows: DataFrame, n: int, sort: list[str]) -> DataFrame:
    """rows, written as n ranges of sort[1:] with their number, a folder each."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "blocks")
    ranged = rows.repartitionByRange(n, *sort[1:]).withColumn("_block", F.spark_partition_id())
    ranged.sortWithinPartitions(*sort).write.partitionBy("_block").parquet(path)
    return spark.read.schema(ranged.schema).parquet(path)


def _starts(blocks: DataFrame, head: str, sort: list[str]) -> dict[int, tuple[str | None, str | None, int]]:
    """For each block, the last key before it, the hash of that key's chain there, and the number of rows before it.

    Blocks whose last chain starts in them are read side by side; only where one chain fills a block, the hash before it is waited for.
    """
    ends = blocks.groupBy("_block").agg(F.min("_by").alias("a"), F.max("_by").alias("z"), F.count(F.lit(1)).alias("n")).orderBy("_block").collect()  # a row a block

    def hashes(numbers: list[int], start: dict) -> dict[int, str]:
        def fold(batches):
            import pyarrow as pa

            block = key = last = None
            for batch in batches:
                done = []
                for b, k, bodies in _runs(batch):
                    if b != block:
                        done += [] if block is None else [(block, last)]
                        block, (key, last) = b, start.get(b, (None, None))
                    if k != key:
                        key, last = k, head
                    for body in bodies:
                        last = _link(body, last)
                yield _pairs(pa, done)
            yield _pairs(pa, [] if block is None else [(block, last)])

        own = blocks.select(*sort).where(F.col("_block").isin(numbers))
        own = own.repartitionByRange(len(numbers), "_block") if len(numbers) > 1 else own.coalesce(1)
        return dict(map(tuple, arrow_map(own.sortWithinPartitions(*sort), fold, "block int, last string").collect()))  # a row a block

    waits = {e["_block"] for before, e in pairwise(ends) if before["z"] == e["a"] == e["z"]}
    at = hashes([e["_block"] for e in ends[:-1] if e["_block"] not in waits] or [ends[0]["_block"]], {})
    out, total = {}, 0
    for before, e in pairwise([None, *ends]):
        if before is not None:
            if before["_block"] in waits:
                at |= hashes([before["_block"]], {before["_block"]: out[before["_block"]][:2]})
            out[e["_block"]] = (before["z"], at[before["_block"]], total)
        total += e["n"]
    return out


def _pairs(pa, rows: list[tuple[int, str]]):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["block", "last"])


def chain_heads(events: DataFrame, by: str | None = None) -> DataFrame:
    """The last hash of a chained log (64 zeros for an empty one), for each value of by."""
    head = F.coalesce(F.max_by("self_hash", "seq"), F.lit(GENESIS)).alias("head")
    return events.groupBy(by).agg(head, F.count(F.lit(1)).alias("n")) if by else events.agg(head, F.count(F.lit(1)).alias("n"))


def fold_heads(events: DataFrame, by: str) -> DataFrame:
    """Chain heads of unchained events by a fold over each group in the order of seq, without Python."""
    body = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("occurred_at", "event_type", "entity_type", "entity_id", "payload")])
    grouped = events.select(by, F.struct("seq", body.alias("body")).alias("e")).groupBy(by).agg(F.array_sort(F.collect_list("e")).alias("es"))
    head = F.aggregate("es", F.lit(GENESIS), lambda a, e: F.sha2(F.concat(e.body, F.lit("|"), a).cast("binary"), 256))
    return grouped.select(by, head.alias("head"), F.size("es").cast("long").alias("n"))


def verify_chain(events: DataFrame, parts: int | None = None) -> DataFrame:
    """first_bad: the smallest seq whose link or own hash is wrong (a null hash is), null if the log is intact.

    Hashes are told where the rows lie; what is left of a row is range-partitioned by seq, in parts ranges or as many more as blocks
    need, and streams through in sorted order. A range's first row is held against the last row of the range before it, of which there is one each.
    """
    n = max(parts or shuffle_parts(events.sparkSession), -(-events.count() // BLOCK))
    own = event_hash(*[F.col(c) for c in ("occurred_at", "event_type", "entity_type", "entity_id", "payload", "prev_hash")])
    rows = events.select("seq", "prev_hash", "self_hash", (~own.eqNullSafe(F.col("self_hash"))).alias("_bad"))
    ends = arrow_map(rows.repartitionByRange(n, "seq").sortWithinPartitions("seq"), _range_ends, "inner bigint, seq bigint, prev string, last string")
    # as many rows as ranges; a hash is held in a struct: it is null only where there is no row before, not where the hash is
    border = ends.withColumn("_z", F.coalesce(F.lag(F.struct(F.col("last").alias("h"))).over(Window.orderBy("seq")), F.struct(F.lit(GENESIS).alias("h"))))
    return border.agg(F.min(F.least("inner", F.when(~F.col("_z.h").eqNullSafe(F.col("prev")), F.col("seq")))).alias("first_bad"))


def _range_ends(batches):
    """Of a range in the order of seq: its first wrong seq, its first row and its last hash."""
    import pyarrow as pa
    import pyarrow.compute as pc

    inner = first = last = None
    for batch in batches:
        if not len(batch):
            continue
        seq, prev, own, bad = (batch.column(c) for c in ("seq", "prev_hash", "self_hash", "_bad"))
        before = pa.concat_arrays([pa.array([prev[0].as_py() if first is None else last], pa.string()), own.slice(0, len(own) - 1).cast(pa.string())])
        differs = pc.coalesce(pc.not_equal(before, prev), pc.xor(pc.is_null(before), pc.is_null(prev)))
        if first is None:
            first = (seq[0].as_py(), prev[0].as_py())
        wrong = pc.min(seq.filter(pc.or_(bad, differs))).as_py()
        inner = wrong if inner is None else inner
        last = own[-1].as_py()
    if first is not None:
        rows = [pa.array([inner], pa.int64()), pa.array([first[0]], pa.int64()), pa.array([first[1]], pa.string()), pa.array([last], pa.string())]
        yield pa.RecordBatch.from_arrays(rows, names=["inner", "seq", "prev", "last"])


def sessions(events: DataFrame, source: str | None = None, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """Import sessions of the log, with defaults for what a payload lacks; source is a part of the path."""
    p = F.from_json("payload", PAYLOAD)
    out = filter_events(events, "batch.imported", from_ms, to_ms).withColumn("p", p)

    def long(k):
        return F.coalesce(F.col(f"p.{k}"), F.lit(0)).alias(k)

    out = out.select(
        "seq",
        "occurred_at",
        F.coalesce("p.session_id", F.lit("unknown")).alias("session_id"),
        F.coalesce("p.session_type", F.lit("import")).alias("session_type"),
        F.coalesce("p.source", F.lit("unknown")).alias("source"),
        *[long(k) for k in ("total_files", "added", "duplicate", "failed", "skipped")],
    )
    return out.where(F.contains("source", F.lit(source))) if source else out


def page(rows: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_info(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """total, returned, has_more of a page; total is the true total."""
    total = F.count(F.lit(1))
    returned = F.greatest(F.least(total - offset, F.lit(limit)), F.lit(0)).cast("long")
    return rows.agg(total.alias("total"), returned.alias("returned"), (total > F.lit(offset) + returned).alias("has_more"))


def items(manifest_items: DataFrame, status: str | None = None) -> DataFrame:
    """Items of sessions: src_path, dest_path ('' if none), status, size, mtime_ms. An unknown status selects nothing."""
    out = manifest_items.withColumn("status", F.coalesce("status", F.lit("added")))
    if status is not None:
        wanted = STATUS_NAMES.get(status.lower())
        out = out.where(F.col("status") == wanted) if wanted else out.where(F.lit(False))
    return out.select("session_id", "src_path", F.coalesce("dest_path", F.lit("")).alias("dest_path"), "status", "size", "mtime_ms")


def manifest_summary(manifest_items: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Counts by session; a stored summary(session_id, total, ...) wins over counting."""
    names = ("added", "duplicate", "failed", "skipped")
    s = F.coalesce("status", F.lit("added"))
    out = manifest_items.groupBy("session_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(s == k).alias(k) for k in names])
    if stored is None:
        return out
    kept = stored.select("session_id", *[F.col(k).alias(f"_{k}") for k in ("total", *names)])
    return out.join(kept, "session_id", "left").select("session_id", *[F.coalesce(f"_{k}", k).alias(k) for k in ("total", *names)])


def latest_session(manifests: DataFrame) -> DataFrame:
    return manifests.orderBy(F.desc("imported_at"), F.desc("session_id")).limit(1)


def newest_by_dest(manifest_items: DataFrame) -> DataFrame:
    """For each destination, the item of the newest session."""
    pick = F.max_by(F.struct("session_id", "src_path", "status"), F.struct("imported_at", "session_id", "src_path", "status"))
    return manifest_items.where("dest_path is not null").groupBy("dest_path").agg(pick.alias("x")).select("dest_path", "x.session_id", "x.src_path", "x.status")


def find_by_src(manifest_items: DataFrame, src_path: str) -> DataFrame:
    """The items, of any session, that came from a path; an item without a status counts as added."""
    return manifest_items.where(F.col("src_path") == src_path).withColumn("status", F.coalesce("status", F.lit("added")))


def source_paths(manifest_items: DataFrame, status: str | None = None) -> DataFrame:
    """src_path: each once, of the items of one status (all by default)."""
    return items(manifest_items, status).select("src_path").distinct()


def import_payload(row: dict[str, str]) -> "F.Column":
    """The payload of `batch.imported`, keys in alphabetical order."""
    return F.to_json(F.struct(*[F.col(v).alias(k) for k, v in sorted(row.items())]))


def sha256_payload(path: str = "path", sha256: str = "sha256"):
    return F.to_json(F.struct(F.col(path).alias("path"), F.lower(F.hex(F.col(sha256))).alias("sha256")))
