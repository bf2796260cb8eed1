"""The driver's tables as archive relations, each written once for Spark and once for DuckDB.

Every relation's DuckDB form is in SQL, as a common table expression of the same name and columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW_MS = 1_700_000_000_000
EXTENSIONS = ("jpg", "mov", "dng", "heic", "txt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    ext = F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.col("id") % 5 + 1).cast("int"))
    return d.select(
        "id",
        F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("id"), F.lit("."), ext)).alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha256"),
        F.unhex(F.md5(F.col("text").cast("binary"))).alias("xxh3_128"),
        F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 8), 16, 10).cast("long").alias("crc32"),
        F.when(ext == "dng", F.concat(F.lit("CAM"), F.col("id") % 3, F.lit(":SHOT"), F.col("id") % 50)).alias("raw_id"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog: every document; a third under other paths and with other contents than on disk, every fifth
    missing, every fourth without SHA-256."""
    c, old = _content(spark, sf_dir), F.col("id") % 3 == 0
    return c.select(
        "id",
        F.when(old, F.concat(F.lit("old/"), F.col("path"))).otherwise(F.col("path")).alias("path"),
        (F.col("size") + F.when(old, 7).otherwise(0)).alias("size"),
        "crc32", "raw_id",
        F.when(old, F.unhex(F.md5(F.concat(F.lit("old"), F.hex("xxh3_128")).cast("binary")))).otherwise(F.col("xxh3_128")).alias("xxh3_128"),
        F.when(F.col("id") % 4 != 0, F.when(old, F.unhex(F.sha2(F.concat(F.lit("old"), F.hex("sha256")).cast("binary"), 256))).otherwise(F.col("sha256"))).alias("sha256"),
        F.when(F.col("id") % 5 == 0, "missing").otherwise("imported").alias("status"),
        (F.lit(NOW_MS) - (F.col("id") * 7919 % 4_000_000) * 1000).alias("imported_at"),
    )


def disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is there: every document; some at other paths, some with another size or content (or both: the catalog's
    file is gone and a new one is there), some unreadable."""
    c = _content(spark, sf_dir)
    fresh = F.col("id") % 11 == 0
    flipped = (F.col("id") % 17 == 0) | fresh
    return c.select(
        F.when(fresh, F.concat(F.lit("new/"), F.col("path"))).when(F.col("id") % 7 == 0, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path")).alias("path"),
        (F.col("size") + F.when(F.col("id") % 13 == 0, 1).when(fresh, 3).otherwise(0)).alias("size"),
        "crc32", "raw_id",
        F.when(flipped, F.unhex(F.md5(F.hex("xxh3_128").cast("binary")))).otherwise(F.col("xxh3_128")).alias("xxh3_128"),
        F.when(flipped, F.unhex(F.sha2(F.hex("sha256").cast("binary"), 256))).otherwise(F.col("sha256")).alias("sha256"),
        F.when(F.col("id") % 19 == 0, "permission denied").alias("error"),
    )


_C = """
c AS (
  SELECT doc_id AS id, source || '/' || lang || '/doc_' || doc_id || '.' || (['jpg','mov','dng','heic','txt'])[doc_id % 5 + 1] AS path,
    CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, sha256(coalesce(text, '')) AS sha256, md5(coalesce(text, '')) AS xxh3_128,
    CAST('0x' || substr(md5(coalesce(text, '')), 1, 8) AS BIGINT) AS crc32,
    CASE WHEN doc_id % 5 = 2 THEN 'CAM' || (doc_id % 3) || ':SHOT' || (doc_id % 50) END AS raw_id
  FROM documents
)"""
SQL = {
    "files": _C + """,
files AS (
  SELECT id, CASE WHEN id % 3 = 0 THEN 'old/' ELSE '' END || path AS path, size + CASE WHEN id % 3 = 0 THEN 7 ELSE 0 END AS size, crc32, raw_id,
    CASE WHEN id % 3 = 0 THEN md5('old' || upper(xxh3_128)) ELSE xxh3_128 END AS xxh3_128,
    CASE WHEN id % 4 = 0 THEN NULL WHEN id % 3 = 0 THEN sha256('old' || upper(sha256)) ELSE sha256 END AS sha256,
    CASE WHEN id % 5 = 0 THEN 'missing' ELSE 'imported' END AS status,
    1700000000000 - (id * 7919 % 4000000) * 1000 AS imported_at
  FROM c
)""",
    "disk": """
disk AS (
  SELECT CASE WHEN id % 11 = 0 THEN 'new/' || path WHEN id % 7 = 0 THEN 'moved/' || path ELSE path END AS path,
    size + CASE WHEN id % 13 = 0 THEN 1 WHEN id % 11 = 0 THEN 3 ELSE 0 END AS size, crc32, raw_id,
    CASE WHEN id % 17 = 0 OR id % 11 = 0 THEN md5(upper(xxh3_128)) ELSE xxh3_128 END AS xxh3_128,
    CASE WHEN id % 17 = 0 OR id % 11 = 0 THEN sha256(upper(sha256)) ELSE sha256 END AS sha256,
    CASE WHEN id % 19 = 0 THEN 'permission denied' END AS error
  FROM c
)""",
}


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog with dates and devices in its paths, from orders and customers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    ext = F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.date_format("o_orderdate", "yyyy/MM-dd"), F.lit("/"), F.col("c_mktsegment"), F.lit("/ORD_"), F.col("o_orderkey"), F.lit("."), ext).alias("path"),
        (F.col("o_orderkey") % 100000).cast("long").alias("size"),
        F.when(F.col("o_orderstatus") == "P", "missing").otherwise("imported").alias("status"),
        F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("long").alias("imported_at"),
        F.unhex(F.md5(F.col("o_orderkey").cast("string").cast("binary"))).alias("xxh3_128"),
    )


SQL["dated"] = """
dated AS (
  SELECT o_orderkey AS id, strftime(o_orderdate, '%Y/%m-%d') || '/' || c_mktsegment || '/ORD_' || o_orderkey || '.' || (['jpg','mov','dng','heic','txt'])[o_orderkey % 5 + 1] AS path,
    CAST(o_orderkey % 100000 AS BIGINT) AS size, CASE WHEN o_orderstatus = 'P' THEN 'missing' ELSE 'imported' END AS status,
    CAST(epoch_us(o_orderdate) // 1000 AS BIGINT) AS imported_at, md5(CAST(o_orderkey AS VARCHAR)) AS xxh3_128
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unchained event log."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("occurred_at"), "event_type",
        F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id"), F.col("props").alias("payload"),
    )


SQL["events_log"] = """
events_log AS (
  SELECT event_id AS seq, epoch_us(ts) AS occurred_at, event_type, 'user' AS entity_type, user_id AS entity_id, props AS payload FROM events
)"""


#: Rows of lineitem that one task groups into items, however many there are.
ITEM_ROWS = 1_000_000


def manifest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of import sessions, from lineitem: a session an order.

    Rows are dealt by their key first: hardly two have one, so sorting a task's input to combine it gains nothing.
    """
    rows = table(spark, sf_dir, "lineitem")
    n = max(spark.sparkContext.defaultParallelism, -(-rows.count() // ITEM_ROWS))
    li = rows.repartition(n, "l_orderkey", "l_partkey").groupBy("l_orderkey", "l_partkey").agg(
        F.max("l_returnflag").alias("f"), F.max("l_linestatus").alias("s"), F.sum(F.col("l_quantity").cast("long")).alias("q"), F.max("l_shipdate").alias("d"))
    status = F.when((F.col("f") == "R") & (F.col("s") == "F"), "duplicate").when(F.col("f") == "A", "failed").when(F.col("s") == "O", "added").otherwise(F.lit(None).cast("string"))
    return li.select(
        F.concat(F.lit("S"), F.col("l_orderkey")).alias("session_id"),
        F.concat(F.lit("card/IMG_"), F.col("l_partkey"), F.lit(".jpg")).alias("src_path"),
        F.when(status == "added", F.concat(F.lit("2024/"), F.col("l_partkey"), F.lit(".jpg"))).alias("dest_path"),
        F.col("q").cast("long").alias("size"),
        F.floor(F.unix_micros(F.col("d").cast("timestamp")) / 1000).cast("long").alias("mtime_ms"),
        (F.lit(NOW_MS) + F.col("l_orderkey")).cast("long").alias("imported_at"),
        status.alias("status"),
    )


SQL["items"] = """
items AS (
  SELECT 'S' || l_orderkey AS session_id, 'card/IMG_' || l_partkey || '.jpg' AS src_path,
    CASE WHEN st = 'added' THEN '2024/' || l_partkey || '.jpg' END AS dest_path, q AS size, CAST(epoch_us(d) // 1000 AS BIGINT) AS mtime_ms,
    1700000000000 + l_orderkey AS imported_at, st AS status
  FROM (
    SELECT l_orderkey, l_partkey, q, d, CASE WHEN f = 'R' AND s = 'F' THEN 'duplicate' WHEN f = 'A' THEN 'failed' WHEN s = 'O' THEN 'added' END AS st
    FROM (SELECT l_orderkey, l_partkey, max(l_returnflag) AS f, max(l_linestatus) AS s, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, max(l_shipdate) AS d FROM lineitem GROUP BY ALL)
  )
)"""


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of `batch.imported` events, from orders: one session an order, some payloads with keys missing or broken."""
    o = table(spark, sf_dir, "orders")
    full = F.to_json(F.struct(
        (F.col("o_orderkey") % 9).cast("long").alias("added"), (F.col("o_orderkey") % 4).cast("long").alias("duplicate"), (F.col("o_orderkey") % 3).cast("long").alias("failed"),
        F.concat(F.lit("m/"), F.col("o_orderkey"), F.lit(".json")).alias("manifest"), F.concat(F.lit("S"), F.col("o_orderkey")).alias("session_id"),
        F.lit("add").alias("session_type"), F.lit(0).cast("long").alias("skipped"), F.concat(F.lit("/card/"), F.col("o_custkey")).alias("source"), (F.col("o_orderkey") % 16).cast("long").alias("total_files")))
    payload = F.when(F.col("o_orderkey") % 50 == 0, F.lit("{broken")).when(F.col("o_orderkey") % 20 == 0, F.concat(F.lit('{"session_id":"S'), F.col("o_orderkey"), F.lit('"}'))).otherwise(full)
    kind = F.when(F.col("o_orderkey") % 10 == 3, "file.sha256_resolved").otherwise("batch.imported")
    return o.select(
        F.col("o_orderkey").alias("seq"), F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("long").alias("occurred_at"),
        kind.alias("event_type"), F.lit("batch").alias("entity_type"), F.lit(0).cast("long").alias("entity_id"), payload.alias("payload"),
    )


SQL["session_events"] = """
session_events AS (
  SELECT o_orderkey AS seq, CAST(epoch_us(o_orderdate) // 1000 AS BIGINT) AS occurred_at,
    CASE WHEN o_orderkey % 10 = 3 THEN 'file.sha256_resolved' ELSE 'batch.imported' END AS event_type,
    CASE WHEN o_orderkey % 50 = 0 THEN '{broken' WHEN o_orderkey % 20 = 0 THEN '{"session_id":"S' || o_orderkey || '"}'
      ELSE '{"added":' || (o_orderkey % 9) || ',"duplicate":' || (o_orderkey % 4) || ',"failed":' || (o_orderkey % 3) || ',"manifest":"m/' || o_orderkey || '.json","session_id":"S' || o_orderkey
        || '","session_type":"add","skipped":0,"source":"/card/' || o_custkey || '","total_files":' || (o_orderkey % 16) || '}' END AS payload
  FROM orders
)"""


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media files in folders by customer, from orders: pairs of one stem, and bursts."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    burst = k % 3 == 0
    stem = F.when(burst, F.concat(F.lit("IMG_"), F.floor(k / 3))).otherwise(F.concat(F.lit("DSC_"), F.floor(k / 2), F.lit("x")))
    ext = F.when(burst, "jpg").when(k % 2 == 0, F.element_at(F.array(*[F.lit(x) for x in ("jpg", "heic", "png")]), (k % 3 + 1).cast("int"))).otherwise(F.element_at(F.array(*[F.lit(x) for x in ("dng", "mov", "cr2", "txt")]), (k % 4 + 1).cast("int")))
    return o.select(F.concat(F.lit("f"), F.floor(k / 500), F.lit("/"), stem, F.lit("."), ext).alias("path"), (k % 1000).cast("long").alias("size"))


SQL["media"] = """
media AS (
  SELECT 'f' || (o_orderkey // 500) || '/' || stem || '.' || ext AS path, CAST(o_orderkey % 1000 AS BIGINT) AS size, 'f' || (o_orderkey // 500) AS folder, stem, ext
  FROM (
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'IMG_' || (o_orderkey // 3) ELSE 'DSC_' || (o_orderkey // 2) || 'x' END AS stem,
      CASE WHEN o_orderkey % 3 = 0 THEN 'jpg' WHEN o_orderkey % 2 = 0 THEN (['jpg','heic','png'])[o_orderkey % 3 + 1] ELSE (['dng','mov','cr2','txt'])[o_orderkey % 4 + 1] END AS ext
    FROM orders
  )
)"""


def with_relations(*names: str, body: str) -> str:
    """DuckDB SQL: body after the relations that it names."""
    parts = []
    for n in names:
        if n == "disk" and "files" not in names:
            parts.append(_C.strip())
        parts.append(SQL[n].strip())
    return "WITH " + ",\n".join(parts) + "\n" + body
