"""One text document out of many tasks' rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Fragments:
    """The lines of lines(value), written by the tasks of its partitions, a file each, to a folder beside path."""

    def __init__(self, lines: DataFrame, path: str):
        self.folder = f"{path}.{uuid.uuid4().hex}.parts"
        # A comma before each row; JSON rows have no line breaks inside
        lines.select(F.concat(F.lit(","), F.col("value")).alias("value")).write.text(self.folder)


def join_document(spark: SparkSession, path: str, pieces: list[str | Fragments]) -> None:
    """Writes texts and fragments (their lines with commas between), in this order, as one file at path, in place of an older one.

    Fragments are joined as streams of bytes, in the order of the partitions that wrote them, and deleted; no row passes through the
    driver's Python. The document gets its name when it is whole.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path
    target, temp = hadoop(path), hadoop(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(conf)
    out = fs.create(temp, True)
    try:
        for piece in pieces:
            if isinstance(piece, str):
                out.write(bytearray(piece.encode()))
                continue
            first = True
            for status in sorted(fs.listStatus(hadoop(piece.folder)), key=lambda s: s.getPath().getName()):
                if not status.getPath().getName().startswith("part-") or not status.getLen():
                    continue
                stream = fs.open(status.getPath())
                try:
                    if first:
                        stream.skip(1)  # no comma before the first row
                        first = False
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
                finally:
                    stream.close()
    finally:
        out.close()
    for piece in pieces:
        if not isinstance(piece, str):
            fs.delete(hadoop(piece.folder), True)
    fs.delete(target, False)
    fs.rename(temp, target)
