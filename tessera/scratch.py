"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, by its full name. Where that is unset, a local master gets a folder of this process; a cluster
    is refused, since its executors don't share such a folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        # the full name, so that every reader takes a path without a scheme for the same store
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
        full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
        return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="tessera-shared-"))
    return f"file://{_OWN_DIR[0]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is removed when the driver ends."""
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{name}"
    _WRITTEN.append((spark, path.rsplit("/", 1)[0]))
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df cut from its lineage: written as a table in the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def mark() -> int:
    """How many scratch folders there are, for release()."""
    return len(_WRITTEN)


def release(since: int, keep: str | None = None) -> None:
    """Deletes the scratch folders named since a mark(), but for the one that path keep lies in: what was made of them is written."""
    gone = [x for x in _WRITTEN[since:] if keep is None or not keep.startswith(f"{x[1]}/")]
    for x in gone:
        _delete(*x)
        _WRITTEN.remove(x)


@atexit.register
def _sweep() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is scratch
            return
