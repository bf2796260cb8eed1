"""Commands on real files, in small archives."""

import os
import struct

import pytest
from pyspark.sql import functions as F
from test_functions import tiff

from tessera.plans import commands as c
from tessera.sinks.store import Archive
from tessera.sources.documents import settings, strategies
from tessera.sources.file_tree import file_tree


def jpeg(tail: bytes = b"", date: str | None = None, make: str = "Apple", model: str = "iPhone") -> bytes:
    out = b"\xff\xd8"
    if date:
        app1 = b"Exif\0\0" + tiff({0x010F: make, 0x0110: model, 0x9003: date}, ">")
        out += b"\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1
    return out + b"\xff\xda\0\x02" + tail


def put(root, name, data, mtime=1_700_000_000):
    p = os.path.join(root, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data)
    os.utime(p, (mtime, mtime))


@pytest.fixture
def place(spark, tmp_path):
    src, dst = str(tmp_path / "card"), str(tmp_path / "archive")
    os.makedirs(src), os.makedirs(dst)
    return src, Archive.init(spark, dst)


def test_tree_keeps_dot_and_empty_files(spark, tmp_path):
    for name in [".hidden.jpg", "_x.jpg", "a/b/empty.jpg", "a/.tessera/x.jpg", "noext", "a/c.TXT"]:
        put(str(tmp_path), name, b"" if "empty" in name else b"x")
    got = {r.path for r in file_tree(spark, str(tmp_path)).collect()}
    assert got == {".hidden.jpg", "_x.jpg", "a/b/empty.jpg", "noext", "a/c.TXT"}
    assert {r.path for r in file_tree(spark, str(tmp_path), ["txt"]).collect()} == {"a/c.TXT"}


def test_import_loses_no_file(spark, place):
    src, archive = place
    date = "2024:05:01 10:00:00"
    for k, name in enumerate(["x/IMG.jpg", "y/IMG.jpg", "z/IMG.1.jpg", "w/IMG.4.jpg"]):
        put(src, name, jpeg(b"%d" % k, date))
    got = c.import_files(archive, src)
    assert (got["imported"], got["failed"]) == (4, 0)
    rows = [r.path for r in archive.files().collect()]
    assert len(set(rows)) == 4 and {open(f"{archive.root}/{p}", "rb").read() for p in rows} == {jpeg(b"%d" % k, date) for k in range(4)}
    # another content that takes the planned name in between is an error, and stays
    from tessera.sinks.transfer import transfer

    put(src, "n.jpg", b"NEW1"), put(str(archive.root), "n.jpg", b"OLD1")
    row = transfer(spark.createDataFrame([(f"{src}/n.jpg", f"{archive.root}/n.jpg")], "src string, dest string")).first()
    assert row.copy_error and open(f"{archive.root}/n.jpg", "rb").read() == b"OLD1"


def test_known_files_are_not_read_whole(spark, place, tmp_path):
    """A big file that is known by its fingerprint: a hole of 1 TB would take hours to hash."""
    src, archive = place
    put(src, "a/big.jpg", jpeg(bytes(200_000)))
    assert c.import_files(archive, src)["imported"] == 1
    size = 1 << 40
    os.truncate(f"{src}/a/big.jpg", size)
    archive.spark.sql("select 1")
    from tessera.sources.file_tree import with_fingerprint

    tree = file_tree(spark, src)
    rows = with_fingerprint(tree, src)
    assert rows.first().hash_error is None and rows.first().size == size
    for k in range(40):
        put(src, f"a/{k}.jpg", jpeg(b"%d" % k))
    where = with_fingerprint(file_tree(spark, src), src).withColumn("p", F.spark_partition_id())
    assert where.select("p").distinct().count() > 1  # one folder, several tasks


def test_import_verify_update_history(spark, place, tmp_path):
    src, archive = place
    shared = bytes(70_000)
    put(src, "x/IMG.jpg", jpeg(b"1", "2024:05:01 10:00:00"))
    put(src, "y/IMG.jpg", jpeg(b"2", "2024:05:01 11:00:00"))
    put(src, "z/COPY.jpg", jpeg(b"1", "2024:05:01 10:00:00"))
    put(src, "a.jpg", jpeg(shared + b"A" * 1000))
    put(src, "b.jpg", jpeg(shared + b"B" * 1000))
    put(src, "skip.txt", b"text")
    got = c.import_files(archive, src)
    assert {k: got[k] for k in ("total", "imported", "duplicate", "failed")} == {"total": 5, "imported": 4, "duplicate": 1, "failed": 0}
    names = {r.path for r in archive.files().collect()}
    assert {"2024/05-01/Apple iPhone/IMG.jpg", "2024/05-01/Apple iPhone/IMG.1.jpg"} <= names
    assert len([n for n in names if n.startswith("2023/11-14/Unknown/")]) == 2  # equal first 64 KB, one session: both stay
    assert {r.path for r in c.inventory(archive).collect()} == names
    again = c.import_files(archive, src)
    assert again["imported"] == 0 and again["all_cache_hit"]
    assert {r.result for r in c.verify(archive).collect()} == {"ok"}
    assert {r.result for r in c.recheck(archive).collect()} == {"ok"}
    assert c.history_sessions(archive).count() == 1
    assert c.history_items(archive, status="dup").count() == 1
    assert c.verify_chain(archive).first()[0] is None
    assert c.background_hash(archive, 3) == 3 and archive.events().count() == 4
    assert c.verify_chain(archive).first()[0] is None
    assert c.status(archive).first()["with_sha256"] == 3
    root = str(archive.root)
    os.rename(f"{root}/2024/05-01/Apple iPhone/IMG.jpg", f"{root}/renamed.jpg")
    os.unlink(f"{root}/2024/05-01/Apple iPhone/IMG.1.jpg")
    assert c.update(archive, dry_run=True)["marked"] == 0
    assert c.update(archive) == {"missing": 2, "moved": 1, "marked": 1}
    got = {r.path: r.status for r in archive.files().collect()}
    assert got["renamed.jpg"] == "imported" and got["2024/05-01/Apple iPhone/IMG.1.jpg"] == "missing"
    back = c.import_files(archive, src)
    assert back["imported"] == 1 and {r.status for r in archive.files().collect()} == {"imported"} and archive.files().count() == 4
    target = str(tmp_path / "clone")
    done = c.clone(archive, target, "2024-05-01", "2024-05-01")
    assert (done["copied"], done["verified"], done["mismatched"]) == (1, 1, 0)
    assert c.clone(archive, target, "2024-05-01", "2024-05-01")["skipped"] == 1
    other = Archive.init(spark, str(tmp_path / "other"))
    assert c.sync(archive, other).count() == 4
    assert c.dump_tables(archive, f"file://{tmp_path}/dump", "csv", ["files", "nope"]) == ["nope: no such table"]
    assert spark.read.text(f"file://{tmp_path}/dump/files").count() == 4


def test_damage_is_told_apart(spark, place):
    src, archive = place
    for k in range(4):
        put(src, f"{k}.jpg", jpeg(b"%d" % k * 10))
    c.import_files(archive, src, full_id=True)
    paths = sorted(r.path for r in archive.files().collect())
    full = [os.path.join(archive.root, p) for p in paths]
    for p in full[:3]:
        os.chmod(p, 0o644)
    size = os.path.getsize(full[0])
    os.unlink(full[0])
    put("/", full[0][1:], b"x" * size)
    os.unlink(full[1])
    put("/", full[1][1:], b"short")
    os.unlink(full[2])
    assert [r.result for r in c.verify(archive).orderBy("path").collect()] == ["hash_mismatch", "size_mismatch", "missing", "ok"]
    assert sorted(r.result for r in c.recheck(archive).collect()) == ["ok", "vault_corrupted", "vault_corrupted", "vault_deleted"]


def test_scan_then_list(spark, place, tmp_path):
    src, archive = place
    put(src, "with space:colon.jpg", jpeg(b"1"))
    put(src, "b.jpg", jpeg(b"2"))
    lines = [r.line for r in c.scan(spark, src, archive).collect()]
    assert sorted(lines) == ["new:b.jpg", "new:with\\ space\\:colon.jpg"]
    (tmp_path / "list").write_text("".join(f"{x}\n" for x in [*lines, "new:gone.jpg"]))
    got = c.import_files(archive, src, files_from=f"file://{tmp_path}/list")
    assert got["total"] == 2 and got["imported"] == 2
    assert c.scan(spark, src, archive).count() == 0
    assert sorted(r.line.split(":")[0] for r in c.scan(spark, src, archive, show_dup=True).collect()) == ["dup", "dup"]


def test_add_force_and_dry_run(spark, place):
    src, archive = place
    put(str(archive.root), "own/a.jpg", jpeg(b"1"))
    put(str(archive.root), "own/b.jpg", jpeg(b"1"))
    got = c.add(archive)
    assert (got["added"], got["duplicate"]) == (1, 1)
    put(src, "c.jpg", jpeg(b"1"))
    assert c.import_files(archive, src)["all_cache_hit"]
    assert c.import_files(archive, src, force=True, dry_run=True)["imported"] == 0
    assert c.import_files(archive, src, force=True)["imported"] == 1
    assert archive.files().count() == 2


def test_raw_ids_refine_the_lookup(spark, place):
    src, archive = place
    pad = bytes(200_000)
    put(src, "a.dng", tiff({0xA431: "CAM1", 0xA420: "SHOT1"}) + pad)
    c.import_files(archive, src)
    assert archive.files().first()["raw_id"] == "CAM1:SHOT1"
    assert c.import_files(archive, src)["all_cache_hit"]


def test_lock_and_layout(spark, place, tmp_path):
    _, archive = place
    with archive.lock(), pytest.raises(BlockingIOError), archive.lock():
        pass
    with pytest.raises(FileExistsError):
        Archive.init(spark, str(archive.root))
    os.makedirs(archive.root / "deep" / "er")
    assert Archive.find(spark, str(archive.root / "deep" / "er")).root == archive.root
    with pytest.raises(FileNotFoundError):
        Archive.find(spark, str(tmp_path))
    assert settings(str(archive.meta / "settings.toml")).sync_strategy == ("reflink", "hardlink", "copy")
    assert strategies("COPY,hardlink") == ("copy",) and strategies(["Hardlink"]) == ("hardlink", "copy")
    with pytest.raises(ValueError):
        strategies("teleport")


def test_links_become_independent(spark, place):
    src, archive = place
    put(src, "a.jpg", jpeg(b"1"))
    (archive.meta / "settings.toml").write_text('[global]\nsync_strategy = "hardlink"\n[import]\n')
    c.import_files(archive, src)
    assert file_tree(spark, str(archive.root)).where(F.col("nlink") > 1).count() == 1
    assert c.upgrade_links(archive) == 1
    assert file_tree(spark, str(archive.root)).where(F.col("nlink") > 1).count() == 0
    assert {r.result for r in c.verify(archive).collect()} == {"ok"}


def test_reflinks_are_not_tried_again_where_there_are_none(tmp_path, monkeypatch):
    import errno
    import fcntl

    from tessera.sinks.transfer import place as put_at

    tried = []

    def refused(*a):
        tried.append(a)
        raise OSError(errno.EOPNOTSUPP, "no reflinks here")

    monkeypatch.setattr(fcntl, "ioctl", refused)
    unable: set = set()
    for k in range(3):
        put(str(tmp_path), f"s/{k}", b"%d" % k)
        assert put_at(f"{tmp_path}/s/{k}", f"{tmp_path}/d/{k}/x", ("reflink", "hardlink"), unable) == "hardlink"
        assert open(f"{tmp_path}/d/{k}/x", "rb").read() == b"%d" % k
    assert len(tried) == 1
    assert put_at(f"{tmp_path}/s/0", f"{tmp_path}/e", ("reflink", "copy"), unable) == "copy" and os.stat(f"{tmp_path}/e").st_nlink == 1
    with pytest.raises(FileExistsError):
        put_at(f"{tmp_path}/s/1", f"{tmp_path}/e", ("reflink", "hardlink"), unable)


def test_file_work_is_dealt_over_all_tasks(spark, tmp_path):
    from tessera.sinks import transfer as t

    rows = spark.createDataFrame([(f"{k}/f.jpg", b"%d" % k, 1000) for k in range(40)], "path string, content binary, mtime_ms long").coalesce(1)
    written = t.write_contents(rows, f"{tmp_path}/a")
    assert written.columns == ["path", "mtime_ms", "how", "copy_error"] and written.rdd.getNumPartitions() == 4
    assert {r.copy_error for r in written.collect()} == {None} and open(f"{tmp_path}/a/7/f.jpg", "rb").read() == b"7"
    moved = t.transfer(rows.select(F.concat(F.lit(f"{tmp_path}/a/"), "path").alias("src"), F.concat(F.lit(f"{tmp_path}/b/"), "path").alias("dest")))
    assert moved.rdd.getNumPartitions() == 4 and {r.copy_error for r in moved.collect()} == {None}
    gone = t.move_or_remove(rows.select("path", F.lit(None).cast("string").alias("new_path")), f"{tmp_path}/b")
    assert gone.rdd.getNumPartitions() == 4 and {r.how for r in gone.collect()} == {"removed"}


def test_small_files_are_read_once(spark, tmp_path):
    import xxhash

    from tessera.sources.file_tree import HEAD, with_digests, with_fingerprint

    sizes = {"empty.jpg": 0, "small.jpg": 10, "small.mov": 70_000, "full.xyz": 10, "edge.jpg": HEAD, "large.jpg": HEAD + 1}
    for name, n in sizes.items():
        put(str(tmp_path), name, os.urandom(n))
    want = {n: xxhash.xxh3_128((tmp_path / n).read_bytes()).digest()[::-1] for n in sizes}
    seen = with_fingerprint(file_tree(spark, str(tmp_path)), str(tmp_path)).localCheckpoint()
    assert {r.path for r in seen.where("xxh3_whole is null").collect()} == {"large.jpg"}
    for n in sizes:
        if n != "large.jpg":
            os.unlink(tmp_path / n)
    out = with_digests(seen, str(tmp_path))
    assert "xxh3_whole" not in out.columns and {r.path: bytes(r.xxh3_128) for r in out.collect()} == want
    # SHA-256 needs the contents
    assert {r.path for r in with_digests(seen, str(tmp_path), sha256=True).where("hash_error is null").collect()} == {"large.jpg"}


def test_a_tree_is_listed_once(spark, place, monkeypatch):
    src, archive = place
    for k in range(3):
        put(src, f"{k}.jpg", jpeg(b"%d" % k))
    listed = []
    monkeypatch.setattr(c, "file_tree", lambda s, root, *a: listed.append(root) or file_tree(s, root, *a))
    assert c.import_files(archive, src)["imported"] == 3
    assert sorted(listed) == sorted([src, str(archive.root)])
    plan = c.verify(archive)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("file_tree") == 1
