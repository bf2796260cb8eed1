"""The archive on disk: layout, lock, and its catalog, event log, totals and manifests over one commit log.

The catalog lies in buckets by content. New rows are appended to the segments of their buckets; a changed row has its bucket
rewritten, and no other. Events are appended. All that a command writes is one commit (see commits): catalog, events,
totals and manifest hold together or not at all.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import time
import uuid
import zlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import GENESIS, event_hash
from ..operators import catalog, dedup
from ..operators import events as ev
from ..operators.numbering import numbered
from ..scratch import kept, mark, release
from ..sources.documents import item_records
from .commits import CommitLog, Conflict
from .document import Fragments, join_document

FILES = (
    "id bigint, path string, size bigint, mtime bigint, crc32 bigint, raw_id string, xxh3_128 binary, sha256 binary, status string, imported_at bigint, "
    "group_id bigint, role string, exif_fp string, duplicate_of bigint"
)
FILE_COLUMNS = [c.split()[0] for c in FILES.split(", ")]
EVENTS = "seq bigint, occurred_at bigint, event_type string, entity_type string, entity_id bigint, payload string, prev_hash string, self_hash string"
EVENT_COLUMNS = [c.split()[0] for c in EVENTS.split(", ")]
ITEMS = "dest_path string, session_id string, imported_at bigint, src_path string, status string"
META, DEFAULT_SETTINGS = ".tessera", '[global]\nsync_strategy = "reflink,hardlink"\n\n[import]\npath_template = "$year/$mon-$day/$device/$filename"\nrename_template = "$filename.$n.$ext"\n'
#: Buckets of a new catalog (for large archives about one a million rows), and the segments of a bucket at which it is merged.
BUCKETS, MERGE_AT = 8, 12


class Store:
    """Tables files, events, totals and manifests over the commit log below root."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.log, self._buckets = spark, CommitLog(spark, root), buckets

    def state(self) -> dict:
        return self.log.state()

    def buckets(self, state: dict) -> int:
        """How many buckets the catalog has: what its first commit said."""
        return state["values"].get("buckets", self._buckets)

    def bucket(self, state: dict):
        """A row's bucket: by its content, and by its id where it has no hash; neither changes."""
        return F.pmod(F.xxhash64(F.coalesce("xxh3_128", F.col("id").cast("string").cast("binary"))), F.lit(self.buckets(state))).cast("int")

    def files(self, state: dict | None = None, buckets: set[int] | None = None) -> DataFrame:
        return self.log.read(state or self.state(), "files", FILES, lambda s: buckets is None or s["bucket"] in buckets)

    def events(self, state: dict | None = None, after: int = 0) -> DataFrame:
        """The log, or its events with a seq over after: segments that end before it are not read."""
        out = self.log.read(state or self.state(), "events", EVENTS, lambda s: s["last"] > after)
        return out.where(F.col("seq") > after) if after else out

    def totals(self, state: dict | None = None) -> DataFrame:
        """Counts and sizes as the commits have added and taken them back (see catalog.totals)."""
        keys = ["extension", "status", "strong", "fast", "day"]
        return self.log.read(state or self.state(), "totals", catalog.TOTALS).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("size").alias("size"))

    def items(self, state: dict | None = None, dests: list[str] | None = None) -> DataFrame:
        """The index of manifest items with a destination: of all, or of some destinations, whose buckets alone are read."""
        state = state or self.state()
        wanted = None if dests is None else {zlib.crc32(p.encode()) % self.buckets(state) for p in dests}
        out = self.log.read(state, "items", ITEMS, lambda s: wanted is None or s["bucket"] in wanted)
        return out if dests is None else out.where(F.col("dest_path").isin(dests))

    def begin(self) -> "Transaction":
        return Transaction(self)


class Transaction:
    """Changes on top of one state of a store. insert(), update(), append() and manifest() write segments, each
    once at most (index() goes with manifest()); publish() makes them hold, or raises Conflict if another commit came first."""

    def __init__(self, store: Store):
        self.store, self.log, self.base = store, store.log, store.state()
        self.add: list[dict] = []
        self.remove: list[str] = []
        self.values: dict = {} if "buckets" in self.base["values"] else {"buckets": store.buckets(self.base)}

    def _write_files(self, rows: DataFrame) -> list[dict]:
        parts = rows.select(*FILE_COLUMNS).withColumn("bucket", self.store.bucket(self.base)).hint("rebalance", "bucket")
        return self.log.write_segments(parts, "files", "bucket")

    def _count(self, changes: DataFrame) -> None:
        self.add += self.log.write_segments(changes.coalesce(1), "totals")  # a few rows: as many as kinds of files

    def insert(self, rows: DataFrame) -> None:
        """New rows of the catalog; ids are given on from the last, in the order of path. No old row is written."""
        top = self.base["values"].get("next_id", 0)
        whole = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in FILES.split(", ")) if c != "id"])
        new = self._write_files(numbered(whole, [], ["path"], "id").withColumn("id", F.col("id") + F.lit(top)))
        if not new:
            return
        there = self.log.read({"segments": new}, "files", FILES)
        self.values["next_id"] = there.agg(F.max("id")).first()[0]
        self._count(catalog.totals(there))
        self.add += new

    def update(self, rows: DataFrame) -> None:
        """Rows of the catalog as they are from now on, found by id; their content hash is as before. Their buckets are rewritten."""
        rows = kept(rows.select(*FILE_COLUMNS), "changed")
        touched = {r["b"] for r in rows.select(self.store.bucket(self.base).alias("b")).distinct().collect()}  # bucket numbers
        if not touched:
            return
        before = self.store.files(self.base, touched)
        self._count(catalog.totals(rows).unionAll(catalog.totals(before.join(rows.select("id"), "id", "left_semi"), -1)))
        self.add += self._write_files(before.join(rows.select("id"), "id", "left_anti").select(*FILE_COLUMNS).unionByName(rows))
        self.remove += [s["path"] for s in self.base["segments"] if s["table"] == "files" and s["bucket"] in touched]

    def append(self, rows: DataFrame) -> None:
        """Events(occurred_at, event_type, entity_type, entity_id, payload), in that order, chained to the head. The log isn't read."""
        last, head = self.base["values"].get("next_seq", 0), self.base["values"].get("head", GENESIS)
        lines = rows.select("occurred_at", "event_type", "entity_type", "entity_id", "payload")
        since = mark()
        new = self.log.write_segments(ev.build_chain(lines, head=head, order=("occurred_at", "event_type", "entity_id", "payload"), after=last).select(*EVENT_COLUMNS), "events")
        release(since)
        end = self.log.read({"segments": new}, "events", EVENTS).agg(F.max("seq").alias("seq"), F.max_by("self_hash", "seq").alias("head")).first()
        if end["seq"] is not None:
            self.add += [s | {"first": last + 1, "last": end["seq"]} for s in new]
            self.values |= {"next_seq": end["seq"], "head": end["head"]}

    def manifest(self, session: dict, items: DataFrame) -> str:
        """A session's manifest: one JSON document of its fields and items, in the order of src_path; null fields are left out."""
        name = f"manifests/import-{session['session_id']}.json"
        head = {k: v for k, v in session.items() if k != "summary"} | {"hash_algorithm": "xxh3_128"}
        tail = {"summary": session["summary"]} if "summary" in session else {}
        path = f"{self.log.root}/{name}"
        rows = Fragments(items.repartitionByRange("src_path").sortWithinPartitions("src_path").select(item_records(items).alias("value")), path)
        join_document(self.store.spark, path, [json.dumps(head)[:-1] + ', "files": [', rows, "]" + (", " + json.dumps(tail)[1:] if tail else "}")])
        self.add.append({"table": "manifests", "path": name, "session": session["session_id"], "at": session.get("imported_at")})
        have = {*items.columns}
        self.index(items.select("src_path", "dest_path", (F.col("status") if "status" in have else F.lit("added")).alias("status"), F.lit(session["session_id"]).alias("session_id"), F.lit(session.get("imported_at")).cast("long").alias("imported_at")))
        return name

    def index(self, items: DataFrame) -> None:
        """Adds manifest items(session_id, imported_at, src_path, dest_path, status) to the index, in the buckets of their destinations."""
        rows = items.where("dest_path is not null").select(*[c.split()[0] for c in ITEMS.split(", ")])
        bucket = F.crc32(F.col("dest_path").cast("binary")) % self.store.buckets(self.base)
        self.add += self.log.write_segments(rows.withColumn("bucket", bucket.cast("int")).hint("rebalance", "bucket"), "items", "bucket")

    def merge(self, most: int = MERGE_AT) -> int:
        """Rewrites buckets of more than most segments as one each; how many. In a transaction of its own."""
        held: dict[int, list[str]] = {}
        for s in self.base["segments"]:
            if s["table"] == "files":
                held.setdefault(s["bucket"], []).append(s["path"])
        crowded = {b for b, own in held.items() if len(own) > most}
        small = [s["path"] for s in self.base["segments"] if s["table"] == "totals"]
        if crowded:
            self.add += self._write_files(self.store.files(self.base, crowded))
            self.remove += [p for b in crowded for p in held[b]]
        if len(small) > most:
            self._count(self.store.totals(self.base).where("n <> 0 or size <> 0"))
            self.remove += small
        return len(crowded)

    def publish(self) -> dict:
        """The state that holds then. Without changes, nothing is published."""
        return self.log.publish(self.base, self.add, self.remove, self.values) if self.add or self.remove else self.base


class Archive:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.meta = spark, Path(root), Path(root) / META
        if not self.meta.is_dir():
            raise FileNotFoundError(f"no archive at {root}")
        self.store = Store(spark, f"file://{self.meta.resolve()}")

    @classmethod
    def init(cls, spark: SparkSession, root: str, buckets: int = BUCKETS) -> "Archive":
        meta = Path(root) / META
        if meta.exists():
            raise FileExistsError(f"{root} is an archive already")
        (meta / "manifests").mkdir(parents=True)
        (meta / "settings.toml").write_text(DEFAULT_SETTINGS)
        out = cls(spark, root)
        out.store.log.publish(out.store.state(), [], [], {"buckets": buckets})
        return out

    @classmethod
    def find(cls, spark: SparkSession, start: str) -> "Archive":
        """The archive that start lies in: the nearest parent with a META folder."""
        at = Path(start).resolve()
        for p in (at, *at.parents):
            if (p / META).is_dir():
                return cls(spark, str(p))
        raise FileNotFoundError(f"no archive above {start}")

    @contextlib.contextmanager
    def lock(self):
        """Exclusive, without waiting: a second writer fails at once."""
        with open(self.meta / "lock", "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            yield

    def files(self) -> DataFrame:
        return self.store.files()

    def events(self) -> DataFrame:
        return self.store.events()

    def begin(self) -> Transaction:
        return self.store.begin()

    def append_events(self, rows: DataFrame) -> None:
        """Appends events as a commit of their own."""
        change = self.begin()
        change.append(rows)
        change.publish()

    def take_outcomes(self, change: Transaction, rows: DataFrame) -> None:
        """Outcomes of operators.dedup.insert_outcome() into the catalog: updates of recovered rows, then inserts."""
        files = self.store.files(change.base)
        change.update(dedup.recovered_rows(files, rows))
        change.insert(dedup.new_rows(files, rows))

    def manifests(self) -> list[str]:
        """The paths of the manifests that commits name."""
        return [f"{self.store.log.root}/{s['path']}" for s in self.store.state()["segments"] if s["table"] == "manifests"]

    def write_report(self, session_id: str, rows: DataFrame) -> str:
        """A recheck's rows as JSON lines, one file a task."""
        path = f"file://{self.meta / f'recheck-{session_id}-{int(time.time() * 1000)}-{uuid.uuid4().hex[:6]}'}"
        rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
        return path


def session_id() -> str:
    """Milliseconds and a random part, so that two sessions never share a manifest."""
    return f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:6]}"


def single_event(spark: SparkSession, event_type: str, entity_type: str, entity_id: int, payload: dict, at_ms: int | None = None) -> DataFrame:
    row = (at_ms or int(time.time() * 1000), event_type, entity_type, entity_id, json.dumps(payload, sort_keys=True, separators=(",", ":")))
    return spark.createDataFrame([row], "occurred_at bigint, event_type string, entity_type string, entity_id bigint, payload string")


__all__ = ["Archive", "Conflict", "Store", "event_hash", "session_id", "single_event"]
