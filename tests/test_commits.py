"""The commit log under crashes and conflicts, the store's segments, totals and feed, and commands that rest on them."""

import json
import os
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_archive import jpeg, put

from tessera import scratch
from tessera.operators import catalog, reconcile
from tessera.plans import commands as c
from tessera.sinks.commits import CommitLog, Conflict
from tessera.sinks.store import EVENTS, Archive, Store, single_event
from tessera.sources.documents import manifests, parse_time
from tessera.sources.file_tree import FileTree, _Reader, file_tree
from tessera.streaming import ingest

DAY = 86_400_000


def rows(spark, names, status="imported", at=1_700_000_000_000):
    return spark.createDataFrame([(f"{n}.jpg", 10 + len(n), n.encode(), status, at) for n in names], "path string, size bigint, xxh3_128 binary, status string, imported_at bigint")


def seen(store):
    """What a reader sees of all tables, from one state."""
    state = store.state()
    files = sorted((r.id, r.path, r.status) for r in store.files(state).collect())
    log = sorted((r.seq, r.payload) for r in store.events(state).collect())
    told = sorted(s["session"] for s in state["segments"] if s["table"] == "manifests")
    n = store.totals(state).agg(F.sum("n")).first()[0] or 0
    return files, log, told, n


def one_import(spark, store, session):
    change = store.begin()
    old = store.files(change.base).where("path = 'a.jpg'")
    change.update(old.withColumn("status", F.lit("missing")))
    change.insert(rows(spark, ["x", "y"]))
    change.append(single_event(spark, "batch.imported", "batch", 0, {"session": session}, 5))
    change.manifest({"session_id": session, "imported_at": 5}, spark.createDataFrame([("x", "d/x"), ("y", "d/y")], "src_path string, dest_path string"))
    change.publish()


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, f"file://{tmp_path}/store", 4)
    change = out.begin()
    change.insert(rows(spark, ["a", "b", "c"]))
    change.publish()
    return out


def test_a_writer_that_dies_between_any_steps(spark, store, tmp_path, monkeypatch):
    """Every file operation of a commit is the last in turn: readers see all tables as before, or all as after."""
    before, steps = seen(store), 0
    kill_at = [None]

    def dying(f):
        def run(*a, **b):
            nonlocal steps
            if steps == kill_at[0]:
                raise KeyboardInterrupt
            steps += 1
            return f(*a, **b)

        return run

    for name in ("write_segments", "write_text", "_claim"):
        monkeypatch.setattr(CommitLog, name, dying(getattr(CommitLog, name)))
    for k in range(20):
        kill_at[0], steps = k, 0
        try:
            one_import(spark, store, f"S{k}")
        except KeyboardInterrupt:
            assert seen(store) == before
            continue
        break
    assert 6 <= k < 20  # update, totals, insert, totals, events, text, claim
    files, log, told, n = seen(store)
    assert [f[1:] for f in files] == [("a.jpg", "missing"), ("b.jpg", "imported"), ("c.jpg", "imported"), ("x.jpg", "imported"), ("y.jpg", "imported")]
    assert len(log) == 1 and told == [f"S{k}"] and n == 5
    held = {s["path"].split("/")[1] for s in store.state()["segments"] if s["path"].startswith("data/")}
    assert len(os.listdir(tmp_path / "store" / "data")) > len(held)
    store.log.sweep()
    assert set(os.listdir(tmp_path / "store" / "data")) == held and seen(store) == (files, log, told, n)


def test_the_second_of_two_writers_conflicts(spark, store):
    first, second = store.begin(), store.begin()
    first.insert(rows(spark, ["p"]))
    second.insert(rows(spark, ["q"]))
    first.publish()
    with pytest.raises(Conflict):
        second.publish()
    assert [r.path for r in store.files().orderBy("id").collect()] == ["a.jpg", "b.jpg", "c.jpg", "p.jpg"]


def test_a_log_in_a_store_that_only_hadoop_opens(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.commits.link./in", f"file://{tmp_path}")
    store = Store(spark, "viewfs://commits/in/log", 2)
    first, second = store.begin(), store.begin()
    for change in (first, second):
        change.insert(rows(spark, ["p"]))
    first.publish()
    with pytest.raises(Conflict):
        second.publish()
    assert store.files().count() == 1 and store.log.names("commits") == ["000000000001.json"]
    assert store.log.sweep() and store.files().count() == 1


def test_bytes_written_follow_the_batch(spark, tmp_path):
    small, large = (Store(spark, f"file://{tmp_path}/{n}", 16) for n in ("small", "large"))
    for store, n in ((small, 200), (large, 20_000)):
        change = store.begin()
        change.insert(spark.range(n).select(F.concat(F.lit("o/"), F.col("id"), F.lit(".jpg")).alias("path"), F.lit(1).cast("long").alias("size"), F.unhex(F.md5(F.col("id").cast("string").cast("binary"))).alias("xxh3_128"), F.lit("imported").alias("status"), F.lit(0).cast("long").alias("imported_at")))
        change.publish()
    wrote = {}
    for name, store in (("small", small), ("large", large)):
        base = store.state()
        change = store.begin()
        change.insert(rows(spark, [f"n{k}" for k in range(10)]))
        change.append(single_event(spark, "t", "e", 0, {}, 1))
        assert not change.remove
        wrote[name] = store.log.written_bytes(change.add)
        change.publish()
        change = store.begin()
        change.update(store.files().where("path = 'o/7.jpg'").withColumn("path", F.lit("moved.jpg")))
        touched = {s["bucket"] for s in change.add if s["table"] == "files"}
        assert len(touched) == 1
        removed = [s for s in store.state()["segments"] if s["path"] in change.remove]
        assert {s["bucket"] for s in removed} == touched and store.log.written_bytes(removed) < store.log.written_bytes([s for s in base["segments"] if s["table"] == "files"]) / 4
        change.publish()
        assert store.files().where("path in ('moved.jpg', 'o/7.jpg')").count() == 1
    assert wrote["large"] < 1.2 * wrote["small"] + 500


def test_many_commits_snapshots_and_merging(spark, store):
    for k in range(20):
        change = store.begin()
        change.insert(rows(spark, [f"n{k:02}"], at=k * DAY))
        change.append(single_event(spark, "t", "e", k, {"k": k}, k))
        change.publish()
    state = store.state()
    assert state["version"] == 21 and "state" in json.loads(store.log.read_text("commits/000000000016.json"))
    assert store.files(store.log.state(5)).count() == 7 and [r.id for r in store.files().orderBy("id").collect()] == list(range(1, 24))
    before = seen(store)
    change = store.begin()
    assert change.merge(2) > 0
    change.publish()
    assert seen(store) == before and len([s for s in store.state()["segments"] if s["table"] == "files"]) < 23
    assert store.events(after=18).count() == 2


def test_totals_agree_with_a_recount(spark, store):
    change = store.begin()
    change.insert(rows(spark, ["d", "e", "f"], at=3 * DAY + 5).unionByName(rows(spark, ["noext"]).withColumn("path", F.lit("noext"))))
    change.publish()
    change = store.begin()
    change.update(store.files().where("path in ('a.jpg', 'd.jpg')").withColumn("status", F.lit("missing")).withColumn("path", F.concat(F.lit("z/"), F.col("path"), F.lit(".png"))))
    change.publish()
    change = store.begin()
    change.update(store.files().where("id = 2").withColumn("sha256", F.lit(b"s")))
    change.publish()
    files, view = store.files(), store.totals()
    assert catalog.stats_of_totals(view).collect() == catalog.vault_stats(files).collect()
    assert catalog.extensions_of_totals(view).collect() == catalog.extension_stats(files).collect()
    for now in (4 * DAY, 4 * DAY + 5, 4 * DAY + 6, 1_700_000_000_000 + DAY):
        assert catalog.recent_of_totals(view, files, now).collect() == catalog.recent_imports(files, now).collect()
    empty = Store(spark, store.log.root + "-none")
    assert catalog.stats_of_totals(empty.totals()).collect() == catalog.vault_stats(empty.files()).collect()


def test_feed_delivers_each_event_once(spark, store, tmp_path):
    target, checkpoint = f"{tmp_path}/fed", f"{tmp_path}/ck"
    store = Store(spark, f"file://{tmp_path}/log")

    def run():
        ingest.event_feed(spark, store.log.root).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()

    for k in range(3):
        change = store.begin()
        change.append(spark.range(50).select(F.lit(k).cast("long").alias("occurred_at"), F.lit("t" if k else "u").alias("event_type"), F.lit("e").alias("entity_type"), "id", F.lit("{}").alias("payload")).withColumnRenamed("id", "entity_id"))
        change.publish()
        run()
        if k == 1:  # the batch that was just made is lost from the sink's side: it runs again
            last = max(int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit())
            os.unlink(f"{checkpoint}/commits/{last}")
            os.unlink(f"{checkpoint}/commits/.{last}.crc")
            run()
    assert sorted(r.seq for r in spark.read.schema(EVENTS).parquet(target).collect()) == list(range(1, 151))
    spark.dataSource.register(ingest.EventFeed)
    late = spark.read.format("event_feed").option("after", 120).load(store.log.root)
    assert late.count() == 30 and late.agg(F.min("seq")).first()[0] == 121


def test_first_sights_survive_restarts(spark, tmp_path):
    folder, target, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "ck"))

    def add(*names):
        spark.createDataFrame([(p, 1, 1, None, None if h is None else h.encode(), None, 5) for p, h in names], ingest.INVENTORY).coalesce(1).write.mode("append").parquet(folder)
        query = ingest.import_first_sights(ingest.inventory_stream(spark, folder), target, checkpoint)
        query.awaitTermination()
        return query

    add(("b", "1"), ("a", "1"), ("c", "2"), ("n", None))
    add(("A", "1"), ("d", "3"), ("e", "3"))
    add(("f", "2"), ("g", "4"))
    got = Counter(r.path for r in spark.read.schema(ingest.INVENTORY).parquet(target).collect())
    assert got == Counter(["a", "c", "d", "g"])


def test_a_large_append_is_no_single_task(spark, tmp_path, monkeypatch):
    """Events are numbered and chained in blocks, and written by as many tasks."""
    from tessera.operators import events

    monkeypatch.setattr(events, "BLOCK", 50)
    log = Store(spark, f"file://{tmp_path}/log", 2)
    for part in range(2):
        change = log.begin()
        change.append(spark.range(300).select((F.col("id") * 37 % 101).alias("occurred_at"), F.lit("t").alias("event_type"), F.lit("e").alias("entity_type"), (F.col("id") + 1000 * part).alias("entity_id"), F.lit("{}").alias("payload")))
        change.publish()
    got = log.events().orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(1, 601)) and events.verify_chain(log.events()).first()[0] is None
    for own in (got[:300], got[300:]):
        assert [(r.occurred_at, r.entity_id) for r in own] == sorted((r.occurred_at, r.entity_id) for r in own)
    held = log.events().groupBy(F.input_file_name()).count().collect()
    assert len(held) >= 10 and max(r["count"] for r in held) < 200


def test_first_sights_of_an_inventory_in_many_files(spark, tmp_path, monkeypatch):
    """The query's inventories are written by all tasks, and each is one batch: of copies in over 100 files, the first by path is seen."""
    from tessera.plans.queries import QUERIES

    data = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    data.repartition(130).write.parquet(f"{tmp_path}/documents.parquet")
    made, real = [], ingest.inventory_stream
    monkeypatch.setattr(ingest, "inventory_stream", lambda s, folder, **more: made.append(folder) or real(s, folder, **more))
    opened = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a file a task
    try:
        got = sorted(r.path for r in QUERIES["first_sights"](spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", opened)
    # contents of the catalog: "same", and what stands for it under old/
    assert got == ["old/s/en/doc_0.jpg", "s/en/doc_1.mov"]
    assert len([n for n in os.listdir(made[0].removeprefix("file://")) if n.endswith(".parquet")]) > 300


# --- commands


@pytest.fixture
def place(spark, tmp_path):
    src, dst = str(tmp_path / "card"), str(tmp_path / "archive")
    os.makedirs(src), os.makedirs(dst)
    return src, Archive.init(spark, dst, 2)


def test_copies_of_a_lost_content(spark, place, tmp_path):
    """Two copies of a missing content, in one import: as many catalog rows as files, and the manifest agrees."""
    src, archive = place
    date = "2024:05:01 10:00:00"
    put(src, "a.jpg", jpeg(b"1", date))
    put(src, "keep.jpg", jpeg(b"2", date))
    c.import_files(archive, src)
    (lost,) = [r.path for r in archive.files().collect() if r.path.endswith("a.jpg")]
    os.unlink(archive.root / lost)
    assert c.update(archive)["marked"] == 1
    card = str(tmp_path / "card2")
    put(card, "C1.jpg", jpeg(b"1", date)), put(card, "C2.jpg", jpeg(b"1", date))
    got = c.import_files(archive, card)
    assert (got["imported"], got["failed"]) == (2, 0)
    files = {r.path: (r.id, r.status) for r in archive.files().collect()}
    assert set(files) == {r.path for r in c.inventory(archive).collect()} and {s for _, s in files.values()} == {"imported"}
    assert sorted(i for i, _ in files.values()) == [1, 2, 3]
    assert {r.dest_path for r in c.history_items(archive, got["session_id"]).collect()} <= set(files)
    assert {r.result for r in c.verify(archive).collect()} == {"ok"}


def test_destinations_are_looked_up_in_their_buckets(spark, place):
    src, archive = place
    for k, name in enumerate(("a", "q7", "zzz9", "m_1")):
        put(src, f"{name}.jpg", jpeg(b"%d" % k))
    session = c.import_files(archive, src)["session_id"]
    paths = sorted(r.path for r in archive.files().collect())
    got = c.brought_by(archive, [paths[2], "nowhere.jpg"]).collect()
    assert [(r.dest_path, r.session_id, r.src_path, r.status) for r in got] == [(paths[2], session, paths[2].rsplit("/", 1)[1], "added")]
    whole, part = archive.store.items(), archive.store.items(dests=[paths[2]])
    used = {zlib.crc32(p.encode()) % 2 for p in paths}
    assert len(used) == 2 and whole.count() == 4 and len(whole.inputFiles()) == 2 and len(part.inputFiles()) == 1


def test_reports_outlive_later_commands(spark, place):
    src, archive = place
    put(src, "a.jpg", jpeg(b"1"))
    c.import_files(archive, src)
    report = c.recheck(archive)
    put(src, "b.jpg", jpeg(b"2"))
    c.import_files(archive, src)
    c.add(archive), c.update(archive), c.upgrade_links(archive)
    assert [r.result for r in report.collect()] == ["ok"]
    assert not (archive.meta / "work").exists() or not os.listdir(archive.meta / "work")


def test_update_reads_candidates_only(spark, place):
    src, archive = place
    for k in range(6):
        put(src, f"{k}.jpg", jpeg(b"x" * (k + 1)))
    c.import_files(archive, src)
    root = archive.root
    paths = sorted(r.path for r in archive.files().collect())
    os.rename(root / paths[0], root / "new name.jpg")
    os.unlink(root / paths[1])
    put(str(root), "stranger.jpg", bytes(5_000))
    here, files = c.inventory(archive), archive.files()
    missing = reconcile.missing_files(files, here)
    assert [r.path for r in reconcile.untracked_candidates(here, files, missing).collect()] == ["new name.jpg"]
    assert c.update(archive) == {"missing": 2, "moved": 1, "marked": 1}
    assert archive.files().where("path = 'new name.jpg' and status = 'imported'").count() == 1


def test_manifest_and_dump_are_documents(spark, place, tmp_path):
    src, archive = place
    for k in range(9):
        put(src, f"{k}.jpg", jpeg(b"%d" % (k // 2)))
    got = c.import_files(archive, src)
    (path,) = archive.manifests()
    doc = json.loads(open(path.removeprefix("file://")).read())
    assert doc["session_id"] == got["session_id"] and doc["summary"]["total"] == 9 and [f["src_path"] for f in doc["files"]] == [f"{k}.jpg" for k in range(9)]
    assert manifests(spark, archive.manifests()).first().summary.added == 5
    assert c.tables(archive) == ["events", "files"] and c.dump_tables(archive, f"file://{tmp_path}/dump", "json") == []
    tables = json.loads((tmp_path / "dump" / "dump.json").read_text())
    assert [(t["name"], t["row_count"], len(t["rows"])) for t in tables] == [("files", 5, 5), ("events", 1, 1)]
    assert tables[0]["columns"] == archive.files().columns == list(tables[0]["rows"][0]) and tables[0]["rows"][0]["xxh3_128"] == "<BLOB:16>"
    assert os.listdir(tmp_path / "dump") == ["dump.json", ".dump.json.crc"] or set(os.listdir(tmp_path / "dump")) <= {"dump.json", ".dump.json.crc"}
    empty = c.dump_tables(Archive.init(spark, str(tmp_path / "none")), f"file://{tmp_path}/dump2", "json")
    assert empty == [] and [t["rows"] for t in json.loads((tmp_path / "dump2" / "dump.json").read_text())] == [[], []]


def test_merge_segments_keeps_the_archive(spark, place):
    src, archive = place
    for k in range(3):
        put(src, f"{k}.jpg", jpeg(b"%d" % k))
        c.import_files(archive, src)
    before = sorted(map(tuple, archive.files().collect()))
    c.merge_segments(archive)
    assert sorted(map(tuple, archive.files().collect())) == before and archive.events().count() == 3 and c.verify_chain(archive).first()[0] is None


def test_one_folder_of_many_is_split(spark, tmp_path):
    for k in range(100):
        put(str(tmp_path), f"DCIM/{k:03}/sub/{k}.jpg", b"x")
    put(str(tmp_path), "DCIM/.tessera/no.jpg", b"x")
    parts = _Reader({"path": str(tmp_path), "tasks": "16"}).partitions()
    assert len([p for p in parts if p.recurse]) >= 100 and FileTree.name() == "file_tree"
    tree = file_tree(spark, str(tmp_path), skip=["007"])
    assert tree.count() == 99 and tree.select(F.spark_partition_id().alias("p")).distinct().count() > 16
    deep = _Reader({"path": str(tmp_path / "DCIM" / "001"), "tasks": "16"}).partitions()
    assert [(p.sub, p.recurse) for p in deep] == [("", False), ("sub", False)]


def test_days_without_a_zone_are_local(monkeypatch):
    import time

    monkeypatch.setenv("TZ", "Asia/Tokyo")
    time.tzset()
    try:
        assert parse_time("2024-05-01") == 1_714_489_200_000 and parse_time("2024-05-01T00:00:00+00:00") == 1_714_521_600_000
        assert parse_time("no day") is None and parse_time(None) is None
    finally:
        monkeypatch.undo()
        time.tzset()


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802  names of the interface
            return {}

    class Session:
        conf, sparkContext = {}, Context()  # noqa: N815

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session())
    assert scratch.shared_dir(spark).startswith("file:///")
