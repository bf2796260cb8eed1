"""The event log as a stream: a Python data source over the segments that commits name.

An offset is a sequence number. A batch's partitions are the segments that overlap it, so what a batch holds depends on its
two offsets alone, and a restart reads the same again.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..sinks import commits
from ..sinks.commits import folded, version_numbers

# The process in which the driver plans a stream has no package but Spark's, so what runs there is sent whole.
for module in (commits, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(module)

SCHEMA = "seq bigint, occurred_at bigint, event_type string, entity_type string, entity_id bigint, payload string, prev_hash string, self_hash string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class _Piece(InputPartition):
    """One file of a segment, of which the events in (after, upto] count."""

    def __init__(self, path: str, after: int, upto: int):
        super().__init__(path)
        self.path, self.after, self.upto = path, after, upto


class _Log:
    """The log of a store, by pyarrow's file systems: a source has no session."""

    def __init__(self, options):
        self.root, self.first = options["path"].rstrip("/"), int(options.get("after", "0"))

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")

    def _state(self) -> dict:
        from pyarrow import fs

        store, base = self._open()

        def text(name: str) -> str:
            with store.open_input_stream(f"{base}/{name}") as f:
                return f.read().decode()

        there = store.get_file_info(fs.FileSelector(f"{base}/commits", allow_not_found=True))
        return folded(version_numbers([i.base_name for i in there]), text)

    def _pieces(self, after: int, upto: int) -> list[_Piece]:
        from pyarrow import fs

        store, base = self._open()
        out = []
        for s in self._state()["segments"]:
            if s["table"] == "events" and s["last"] > after and s["first"] <= upto:
                files = store.get_file_info(fs.FileSelector(f"{base}/{s['path']}"))
                out += [_Piece(i.path, after, upto) for i in files if i.base_name.startswith("part-")]
        return sorted(out, key=lambda p: p.path)

    def read(self, partition):
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        store, _ = self._open()
        with store.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=10_000, columns=COLUMNS):
                seq = batch.column("seq")
                kept = batch.filter(pc.and_(pc.greater(seq, partition.after), pc.less_equal(seq, partition.upto)))
                if len(kept):
                    yield kept


class _Stream(_Log, DataSourceStreamReader):
    def initialOffset(self):  # noqa: N802  names of the interface
        return {"seq": self.first}

    def latestOffset(self):  # noqa: N802
        return {"seq": max(self._state()["values"].get("next_seq", 0), self.first)}

    def partitions(self, start, end):
        return self._pieces(start["seq"], end["seq"])


class _Batch(_Log, DataSourceReader):
    def partitions(self):
        return self._pieces(self.first, self._state()["values"].get("next_seq", 0))


class EventFeed(DataSource):
    @classmethod
    def name(cls):
        return "event_feed"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):  # noqa: N802
        return _Stream(self.options)
