"""Session defaults, and shipping this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SHIPPED: set[str] = set()


def session(app_name: str = "tessera", **conf: str) -> SparkSession:
    """A session with the settings that results rely on: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app_name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application; Python workers import it by name."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tessera-ship-")
    target = os.path.join(folder, "tessera_package.zip")
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, f"tessera/{file.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


#: Rows and bytes of an Arrow batch on its way to and from Python; a session that sets its own keeps them.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow with this package at hand on the executors, in batches of bounded size.

    The bound is a setting of the session (spark.sql.execution.arrow.maxRecordsPerBatch and maxBytesPerBatch), which Spark reads when the
    frame runs, later than this returns: where the session has Spark's defaults, they are set to BATCH_ROWS and BATCH_BYTES and stay so. When a task ends, its worker (which Spark uses again) gives back the memory that it has freed.
    """
    spark = df.sparkSession
    ship(spark)
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, None) in (None, "10000"):  # unset, or Spark's default
            spark.conf.set(key, str(value))
    return df.mapInArrow(_tidy(function), schema)


def _tidy(function):
    def run(batches):
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Returns freed memory of this process to the system, where the C library can (glibc)."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def with_fields(schema: StructType, **kinds: str) -> StructType:
    """A copy of schema with more fields (StructType.add() would change the frame's own)."""
    out = StructType(list(schema.fields))
    for name, kind in kinds.items():
        out = out.add(name, kind)
    return out


def shuffle_parts(spark: SparkSession) -> int:
    """Partitions of a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
