"""Operators on small made cases: orders, ties, properties, streams."""

import hashlib
import random
from itertools import pairwise

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.values import GENESIS
from tessera.operators import binding, dedup, events, numbering, reconcile
from tessera.streaming import ingest

LOG = "seq bigint, occurred_at bigint, event_type string, entity_type string, entity_id bigint, payload string"


def log(spark, n):
    return spark.createDataFrame([(k, 1000 + k, "t", "e", k % 3, f'{{"path":"{k}.jpg"}}') for k in range(1, n + 1)], LOG)


def test_chain(spark):
    chained = events.build_chain(log(spark, 50))
    rows = chained.orderBy("seq").collect()
    assert rows[0].prev_hash == GENESIS and all(a.self_hash == b.prev_hash for a, b in pairwise(rows))
    body = "|".join(["1001", "t", "e", "1", '{"path":"1.jpg"}', GENESIS])
    assert rows[0].self_hash == hashlib.sha256(body.encode()).hexdigest()
    assert events.verify_chain(chained).first()[0] is None
    assert events.verify_chain(chained.where("seq <> 20")).first()[0] == 21
    assert events.verify_chain(chained.withColumn("payload", F.when(F.col("seq") == 7, "{}").otherwise(F.col("payload")))).first()[0] == 7
    assert events.verify_chain(chained.where("seq > 1"), 3).first()[0] == 2
    assert events.chain_heads(chained.limit(0)).first()["head"] == GENESIS
    assert events.verify_chain(chained.limit(0)).first()[0] is None
    for c in events.COLUMNS[1:]:  # nulled, and with its hash nulled to hide what was altered
        for parts in (1, 4, 50):
            odd = chained.withColumn(c, F.when(F.col("seq") == 4, F.lit(None).cast(dict(chained.dtypes)[c])).otherwise(F.col(c)))
            assert events.verify_chain(odd, parts).first()[0] == 4, (c, parts)
            odd = odd.withColumn("self_hash", F.when(F.col("seq") == 4, F.lit(None)).otherwise(F.col("self_hash")))
            assert events.verify_chain(odd, parts).first()[0] == 4, (c, parts)


def test_chain_of_many_blocks(spark, monkeypatch):
    """No task sorts more than about a block, whole logs and hot keys alike, and all is as in one block."""
    rows = log(spark, 700).withColumn("entity_id", F.when(F.col("seq") % 10 < 8, 5).otherwise(F.col("seq") % 4).cast("long")).union(log(spark, 3))  # the first three twice
    want = {by: sorted(map(tuple, events.build_chain(rows, by and [by]).collect())) for by in (None, "entity_id")}
    monkeypatch.setattr(events, "BLOCK", 60)
    for by in want:
        chained = events.build_chain(rows, by and [by])
        assert sorted(map(tuple, chained.collect())) == want[by]
        sizes = [r["count"] for r in chained.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 6 and max(sizes) < 300, sizes
    whole = events.build_chain(log(spark, 700))
    assert events.verify_chain(whole, 1).first()[0] is None
    assert events.verify_chain(whole.where("seq <> 400"), 1).first()[0] == 401
    plans = events.verify_chain(whole, 1)._jdf.queryExecution().toString()
    assert "rangepartitioning(seq" in plans and ", 12)" in plans  # 700 rows in ranges of 60, though one was asked for
    lines = log(spark, 300).drop("seq").withColumn("occurred_at", F.col("occurred_at") % 7)
    order = ("occurred_at", "event_type", "entity_id", "payload")
    given = lines.withColumn("seq", F.row_number().over(Window.orderBy(*order)).cast("long") + 40)
    names = [*events.COLUMNS]
    assert sorted(map(tuple, events.build_chain(lines, head="x", order=order, after=40).select(*names).collect())) == sorted(map(tuple, events.build_chain(given, head="x").select(*names).collect()))


def test_items_are_grouped_in_bounded_parts(spark, monkeypatch):
    """Tasks that group lineitem grow in number with it, and nothing is sorted before it is dealt."""
    from conftest import SF

    from tessera.sources import adapters

    monkeypatch.setattr(adapters, "ITEM_ROWS", 500)
    rows = adapters.manifest_items(spark, SF)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= n // 500 and max(sizes) < 1000, sizes


def test_lookup_takes_first_admissible(spark):
    files = spark.createDataFrame(
        [(1, "a.dng", 5, 9, "C:1", "imported"), (2, "b.dng", 5, 9, None, "imported"), (3, "c.dng", 5, 9, "C:2", "missing"), (4, "d.jpg", 5, 9, None, "imported")],
        "id bigint, path string, size bigint, crc32 bigint, raw_id string, status string",
    )
    source = spark.createDataFrame([("x.dng", 5, 9, "C:2"), ("y.DNG", 5, 9, "C:1"), ("z.dng", 5, 9, None), ("w", 5, 9, None), ("v.jpg", 6, 9, None)], "path string, size bigint, crc32 bigint, raw_id string")
    got = {r.path: r.c_id for r in dedup.fingerprint_lookup(source, files).collect()}
    assert got == {"x.dng": 2, "y.DNG": 1, "z.dng": 1, "w": None, "v.jpg": None}
    disk = spark.createDataFrame([("b.dng",)], "path string")
    status = {r.path: r.status for r in dedup.classify(dedup.fingerprint_lookup(source, files), disk).collect()}
    assert status == {"x.dng": "duplicate", "y.DNG": "moved", "z.dng": "moved", "w": "new", "v.jpg": "new"}


def test_missing_rows_pass_unseen(spark):
    batch = spark.createDataFrame([("1", "x", "h", None), ("2", "x", "h", None), ("3", "x", "n", None), ("4", "x", "n", None), ("5", "x", None, "hash error: io")], "path string, algo string, hash string, error string")
    files = spark.createDataFrame([(1, "old", "missing", "x", "h")], "id bigint, path string, status string, algo string, hash string")
    got = {r.path: r.reason for r in dedup.strong_hash_decision(batch, files, files.select("path").limit(0)).collect()}
    assert got == {"1": None, "2": None, "3": None, "4": "batch (x)", "5": "hash error: io"}


def test_conflict_rename_avoids_taken_and_generated(spark):
    p = spark.createDataFrame([("1", "d/a.jpg"), ("2", "d/a.jpg"), ("3", "d/a.1.jpg"), ("4", "noext"), ("5", "noext")], "path string, dest string")
    taken = spark.createDataFrame([("d/a.jpg",)], "path string")
    for t in (None, taken):
        final = [r.final for r in dedup.conflict_rename(p, t).collect()]
        assert len(set(final)) == 5 and (t is None or "d/a.jpg" not in final)
    assert {r.path: r.final for r in dedup.conflict_rename(p.where("path >= '4'")).collect()} == {"4": "noext", "5": "noext.1"}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["d/a.jpg", "d/a.1.jpg", "d/a.4.jpg", "d/b", "b", "b.1", "b.1.2", "e/a.jpg"]), max_size=14), st.sets(st.sampled_from(["d/a.jpg", "d/a.1.jpg", "d/a.4.jpg", "d/b.1", "b.2", "d/c"])), st.sampled_from([dedup.DEFAULT_RENAME, "$n-$filename.$ext"]))
def test_conflict_rename_is_the_sequential_loop(spark, dests, taken, template):
    want, used = {}, set(taken)
    for k, dest in enumerate(dests):
        name, n = dest, 0
        while name in used:
            n += 1
            name = dedup.renamed(dest, template, n)
        used.add(name)
        want[f"{k:03d}"] = name
    p = spark.createDataFrame([(f"{k:03d}", x) for k, x in enumerate(dests)], "path string, dest string")
    t = spark.createDataFrame([(x,) for x in taken], "path string")
    assert {r.path: r.final for r in dedup.conflict_rename(p, t, template).collect()} == want


def test_equal_files_are_not_paired(spark):
    """20,000 equal files on both sides: all pairs would be 4e8 rows."""
    n = 20_000
    files = spark.range(n).select("id", F.concat(F.lit("a/"), F.col("id"), F.lit(".jpg")).alias("path"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("crc32"), F.lit(None).cast("string").alias("raw_id"), F.lit("imported").alias("status"), F.lit("h").alias("xxh3_128"), F.lit("s").alias("sha256"))
    disk = files.withColumn("path", F.concat(F.lit("b/"), F.col("id"), F.lit(".jpg")))
    assert dedup.fingerprint_lookup(disk, files).where("c_id = 0").count() == n
    moves = reconcile.reconcile_moves(files, disk)  # the k-th by path is at the k-th path
    assert moves.count() == n and moves.where("substr(old_path, 2) <> substr(new_path, 2) or confidence <> 'definitive'").isEmpty()


def test_moves_prefer_first_names(spark):
    cols = "id bigint, path string, size bigint, xxh3_128 string, sha256 string"
    missing = spark.createDataFrame([(1, "b", 5, "h", None), (2, "a", 5, "h", "s"), (3, "c", 5, "k", "other")], cols)
    disk = spark.createDataFrame([("n2", 5, "h", "s"), ("n1", 5, "h", "s"), ("n3", 5, "k", "s")], "path string, size bigint, xxh3_128 string, sha256 string")
    got = [tuple(r) for r in reconcile.reconcile_moves(missing, disk).collect()]
    assert sorted(got) == [(1, "b", "n2", "fast"), (2, "a", "n1", "definitive")]


def test_moves_match_each_row_and_file_once(spark):
    cols = "id bigint, path string, size bigint, xxh3_128 string, sha256 string"
    missing = spark.createDataFrame([(1, "o1", 5, "h", "s"), (2, "o2", 5, "h", "s"), (3, "o3", 5, "u", "s"), (4, "o4", 5, None, None)], cols)
    disk = spark.createDataFrame([("n1", 5, "h", "s"), ("n2", 5, "h", "s"), ("n3", 5, "u", None), ("n4", 5, None, None)], "path string, size bigint, xxh3_128 string, sha256 string")
    got = sorted(tuple(r)[:1] + tuple(r)[2:] for r in reconcile.reconcile_moves(missing, disk).collect())
    assert got == [(1, "n1", "definitive"), (2, "n2", "definitive"), (3, "n3", "fast")]
    assert reconcile.reconcile_moves(missing.limit(0), disk).collect() == []


def test_numbered(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i) for i in rng.sample(range(10_000), 3_000)]
    got = [tuple(r) for r in numbering.numbered(spark.createDataFrame(rows, "k string, v bigint"), ["k"], ["v"], "n").collect()]
    want, seen = [], {}
    for k, v in sorted(rows, key=lambda r: r[1]):
        seen[k] = seen.get(k, 0) + 1
        want.append((k, v, seen[k]))
    assert sorted(got, key=lambda r: r[1]) == want
    whole = numbering.numbered(spark.createDataFrame(rows, "k string, v bigint"), [], ["v"], "n")
    assert [r.n for r in whole.orderBy("v").collect()] == list(range(1, len(rows) + 1))


def test_matched_is_the_kth_with_the_kth(spark):
    rng = random.Random(6)
    left = [(rng.choice("abcde"), i) for i in range(400)] + [(None, 1_000), ("solo", 5), ("many", 7)]
    right = [(rng.choice("abcxy"), i) for i in range(300)] + [(None, 1), ("solo", 3), ("solo", 9), ("many", 1)] + [("e", 999)]
    got = {tuple(r) for r in numbering.matched(spark.createDataFrame(left, "g string, l bigint"), spark.createDataFrame(right, "g string, r bigint"), ["g"], ["l"], ["r"]).collect()}
    want = set()
    for g in {k for k, _ in left if k}:
        want |= {(g, x, y) for x, y in zip(sorted(v for k, v in left if k == g), sorted(v for k, v in right if k == g), strict=False)}
    assert got == want


def brute(paths):
    """Greedy grouping, pair by pair."""
    parts, done, out = [binding._parts(p) for p in paths], set(), []
    for i in range(len(paths)):
        if i in done:
            continue
        group = [i, *[j for j in range(i + 1, len(paths)) if j not in done and binding.related(parts[i], parts[j])]]
        done.update(group)
        out.append(group)
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.sampled_from(["IMG_", "x"]), st.integers(0, 6), st.sampled_from(["jpg", "heic", "mov", "dng", "png", "txt"])), max_size=14))
def test_greedy_bindings(spark, names):
    paths = sorted(f"f/{a}{n}.{e}" for a, n, e in names)
    df = spark.createDataFrame([(p, 1) for p in paths], "path string, size bigint")
    got = sorted(sorted([r.primary, *r.secondaries]) for r in binding.greedy_bindings(df).collect())
    want = sorted(sorted(paths[j] for j in g) for g in brute(paths) if len(g) > 1 or not paths[g[0]].endswith(("png", "txt")))
    assert got == want


def test_first_wins_with_nulls_and_ties(spark):
    rows = spark.createDataFrame([("h", "b"), ("h", "a"), (None, "c"), (None, "d")], "k string, path string")
    assert {r.path: r.is_first for r in dedup.first_wins(rows, "k", ["path"]).collect()} == {"a": True, "b": False, "c": True, "d": True}
    assert dedup.first_wins(rows.limit(0), "k", ["path"]).count() == 0


def test_stream_imports_once(spark, tmp_path):
    src, cat, check = (f"file://{tmp_path}/{x}" for x in ("in", "cat", "check"))

    def drop(rows):
        spark.createDataFrame([(p, 1, 1, None, h, None, 1) for p, h in rows], ingest.INVENTORY).coalesce(1).write.mode("append").parquet(src)

    drop([("a", b"1"), ("b", b"1"), ("c", b"2")])
    for _ in range(2):
        ingest.import_stream(ingest.inventory_stream(spark, src), cat, check).awaitTermination()
    assert sorted(r.path for r in spark.read.parquet(cat).collect()) == ["a", "c"]
    drop([("d", b"2"), ("e", b"3")])
    ingest.import_stream(ingest.inventory_stream(spark, src), cat, check).awaitTermination()
    assert sorted(r.path for r in spark.read.parquet(cat).collect()) == ["a", "c", "e"]
