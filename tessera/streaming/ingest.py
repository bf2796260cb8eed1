"""Streams: idempotent import of inventories, first sight of contents by keyed state, and the event log as a change feed."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators import dedup
from ..session import ship
from ..sources.event_feed import EventFeed

# Spark's process for stateful processors on the driver has no package but its own, so what runs there is sent whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

INVENTORY = "path string, size bigint, crc32 bigint, raw_id string, xxh3_128 binary, sha256 binary, imported_at bigint"


def inventory_stream(spark: SparkSession, folder: str, schema: str = INVENTORY, files_per_trigger: int | None = 100) -> DataFrame:
    """The Parquet files of folder as a stream; with files_per_trigger None, a batch is all that is there when it starts."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(folder)


def import_stream(stream: DataFrame, catalog_path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's new contents to the catalog at catalog_path, in a folder per batch.

    A batch that runs again replaces its own folder and is compared with all other batches only, so a restart
    never imports twice. Contents that earlier batches have, or an earlier path of the same batch, by either hash that
    both sides have, are left out.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = batch
        for key in ("xxh3_128", "sha256"):
            first = dedup.first_wins(first, key, ["path"]).where("is_first").drop("is_first")
        if _exists(spark, catalog_path):
            before = spark.read.option("basePath", catalog_path).parquet(catalog_path).where(F.col("batch") < batch_id)
            for key in ("xxh3_128", "sha256"):
                first = first.join(before.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
        first.select(*batch.columns).write.mode("overwrite").parquet(f"{catalog_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a batch under path already."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and any(s.getPath().getName().startswith("batch=") for s in fs.listStatus(p))


def distinct_contents(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """First sight of each content within the watermark; the state of older contents is dropped."""
    timed = stream.withColumn("seen_at", F.timestamp_millis("imported_at")).withWatermark("seen_at", delay)
    return timed.dropDuplicatesWithinWatermark(["xxh3_128"])


class FirstSight(StatefulProcessor):
    """Of each content, the first row (by path) of the first batch that has it; what it has seen is all that it keeps."""

    def __init__(self, columns: list[str], keep_ms: int | None):
        self.columns, self.keep_ms = columns, keep_ms

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "at bigint", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802  names of the interface
        if self.seen.exists():
            return
        first = None
        for frame in rows:  # in pieces; one row is held
            own = frame.loc[[frame["path"].idxmin()]]
            if first is None or own["path"].iloc[0] < first["path"].iloc[0]:
                first = own
        if first is not None:
            self.seen.update((1,))
            yield first[self.columns]

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_sights(stream: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """The rows of an inventory stream whose content (by fast hash) no earlier row had: the first by path in its batch.

    The state is a mark a content, dropped keep_ms after it was set (never by default); the catalog isn't read. Rows without
    hash are left out, since nothing tells them apart. It needs Spark's RocksDB state store (see import_first_sights()).
    """
    names = stream.columns
    keyed = stream.where("xxh3_128 is not null").withColumn("content", F.hex("xxh3_128")).groupBy("content")
    return keyed.transformWithStateInPandas(FirstSight(names, keep_ms), stream.schema, "Append", "None" if keep_ms is None else "ProcessingTime")


def import_first_sights(stream: DataFrame, target: str, checkpoint: str, keep_ms: int | None = None) -> StreamingQuery:
    """Writes first_sights() of what is there to Parquet files at target; each row once, however often it is restarted from checkpoint."""
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    ship(spark)
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        return first_sights(stream, keep_ms).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    finally:  # a query keeps the settings that it was started with
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def event_feed(spark: SparkSession, root: str, after: int = 0, event_type: str | None = None) -> DataFrame:
    """The events of the store below root with a seq over after, as a stream in the order of commits: a batch has those that were
    committed since the one before it. Each event comes once, also after a restart."""
    ship(spark)
    spark.dataSource.register(EventFeed)
    out = spark.readStream.format(EventFeed.name()).option("after", after).load(root)
    return out.where(F.col("event_type") == event_type) if event_type else out
