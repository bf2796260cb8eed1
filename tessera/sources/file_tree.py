"""A directory tree as a table: a Python data source that splits the tree into as many subtrees as there are tasks."""

from __future__ import annotations

import io
import os
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import shuffle_parts

SCHEMA = "path string, size bigint, mtime_ms bigint, nlink int, error string"


def walk(root: str, sub: str, extensions: frozenset[str], skip: frozenset[str], recurse: bool = True):
    """(path below root, size, mtime_ms, nlink, error) of the files; dot-files and empty files are kept."""
    stack = [sub]
    while stack:
        here = stack.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, here) if here else root), key=lambda e: e.name)
        except OSError as e:
            yield here, None, None, None, str(e)
            continue
        for e in entries:
            rel = f"{here}/{e.name}" if here else e.name
            if e.is_dir(follow_symlinks=False):
                if e.name not in skip and rel not in skip and recurse:
                    stack.append(rel)
                continue
            stem, _, ext = e.name.rpartition(".")
            if extensions and not (stem and ext.lower() in extensions):
                continue
            try:
                s = e.stat()
                yield rel, s.st_size, s.st_mtime_ns // 1_000_000, s.st_nlink, None
            except OSError as x:
                yield rel, None, None, None, str(x)


class _Part(InputPartition):
    def __init__(self, sub: str, recurse: bool):
        super().__init__(sub)
        self.sub, self.recurse = sub, recurse


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].removeprefix("file://")
        self.extensions = frozenset(x.strip().lower() for x in options.get("extensions", "").split(",") if x.strip())
        self.tasks = int(options.get("tasks", "32"))
        self.skip = frozenset([".tessera", *(x for x in options.get("skip", "").split(",") if x)])

    def partitions(self):
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        # Folders are opened from the top, breadth first, until there are as many subtrees as tasks or no more folders: what
        # was opened lists its own files only, what is left is walked as a whole.
        opened, waiting = [], deque([""])
        while waiting and len(waiting) < self.tasks:
            here = waiting.popleft()
            opened.append(_Part(here, False))
            try:
                waiting.extend(rel for e in sorted(os.scandir(os.path.join(self.root, here)), key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and not {e.name, rel := f"{here}/{e.name}" if here else e.name} & self.skip)
            except OSError:  # its own partition says so
                continue
        return opened + [_Part(sub, True) for sub in waiting]

    def read(self, partition):
        yield from walk(self.root, partition.sub, self.extensions, self.skip, partition.recurse)


class FileTree(DataSource):
    @classmethod
    def name(cls):
        return "file_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def file_tree(spark: SparkSession, root: str, extensions: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """Files below root: path (relative), size, mtime_ms, nlink, error. The filter by extension and the
    pruning of folders happen while walking."""
    from ..session import ship

    ship(spark)
    spark.dataSource.register(FileTree)
    return spark.read.format("file_tree").option("extensions", ",".join(extensions or [])).option("skip", ",".join(skip or [])).option("tasks", 4 * spark.sparkContext.defaultParallelism).load(root)


#: Bytes read of a file's start for its tags: of JPEG and the like, and of formats that hold them further in.
HEAD, DEEP_HEAD, REGION = 128 << 10, 1 << 20, 65536


def dealt(files: DataFrame) -> DataFrame:
    """files over all tasks, however few folders they were listed by."""
    return files.repartition(shuffle_parts(files.sparkSession), F.xxhash64("path"))


def with_fingerprint(files: DataFrame, root: str) -> DataFrame:
    """files(path, ...) with crc32, raw_id, original, modified, make, model, video_s, xxh3_whole, hash_error.

    Only what these need is read: a file's start and end, a video's header; of formats without a region the whole
    file, in pieces. A file that can't be read has an error and nothing else. xxh3_whole is the fast hash of files whose start
    is all of them: with_digests() takes it and doesn't open them again.
    """

    def one(rel: str, row: dict) -> None:
        import zlib

        import xxhash

        from ..functions.formats import BY_EXTENSION, RAW_EXTENSIONS
        from ..functions.media import exif_tags, mp4_seconds

        ext = rel.rsplit("/", 1)[-1].rpartition(".")[2].lower()
        how = BY_EXTENSION[ext][4] if ext in BY_EXTENSION else "full"
        with open(os.path.join(root, rel), "rb", buffering=0) as f:
            size = os.fstat(f.fileno()).st_size
            head = _start(f, min(size, DEEP_HEAD if ext in RAW_EXTENSIONS or ext in ("heic", "heif") else HEAD))
            whole = len(head) == size
            if how == "full":
                crc = zlib.crc32(head)
                while not whole and (piece := f.read(4 << 20)):
                    crc = zlib.crc32(piece, crc)
            else:
                tail = head[-REGION:]
                if how != "head" and not whole:
                    f.seek(max(size - REGION, 0))
                    tail = _start(f, REGION)
                crc = zlib.crc32({"head": head[:REGION], "tail": tail, "head_tail": head[:REGION] + tail}[how])
            if ext in ("mov", "mp4", "m4v"):
                row["video_s"] = _mvhd(io.BytesIO(head) if whole else f, size, mp4_seconds)
        row["crc32"] = crc
        row["xxh3_whole"] = xxhash.xxh3_128_digest(head)[::-1] if whole else None
        tags = exif_tags(head)
        row.update({k: tags.get(k) for k in ("original", "modified", "make", "model")})
        if ext in RAW_EXTENSIONS:
            serial, image = (tags.get(k, "").strip().strip('"').strip("'") for k in ("serial", "image_id"))
            row["raw_id"] = f"{serial}:{image}" if serial and image else None

    kinds = {"crc32": "long", "raw_id": "string", "original": "string", "modified": "string", "make": "string", "model": "string", "video_s": "long", "xxh3_whole": "binary", "hash_error": "string"}
    return _read_each(dealt(files), kinds, one)


def with_digests(files: DataFrame, root: str, sha256: bool = False, due: str | None = None) -> DataFrame:
    """files(path, hash_error, ...) with xxh3_128 and, if asked for, sha256, of whole files read in pieces.

    The fast hash that with_fingerprint() may have found, xxh3_whole, is taken in place of reading; files is evaluated more than once then,
    here too, and should be a written table. due names a boolean column: files where it isn't true aren't read and have no digests.
    """

    def one(rel: str, row: dict) -> None:
        import hashlib

        import xxhash

        x, s = xxhash.xxh3_128(), hashlib.sha256()
        with open(os.path.join(root, rel), "rb") as f:
            while piece := f.read(4 << 20):
                x.update(piece)
                if sha256:
                    s.update(piece)
        row["xxh3_128"] = x.digest()[::-1]
        row["sha256"] = s.digest() if sha256 else None

    kinds = {"xxh3_128": "binary", "sha256": "binary", "hash_error": "string"}
    if sha256 or due or "xxh3_whole" not in files.columns:
        return _read_each(dealt(files.drop("xxh3_whole")), kinds, one, due)
    held = [c for c in files.columns if c not in kinds and c != "xxh3_whole"]
    done = files.where("xxh3_whole is not null").select(*held, F.col("xxh3_whole").alias("xxh3_128"), F.lit(None).cast("binary").alias("sha256"), F.lit(None).cast("string").alias("hash_error"))
    rest = files.where("xxh3_whole is null").drop("xxh3_whole")
    # Most often nothing is left: then no tasks are started for it.
    return done if rest.isEmpty() else done.unionByName(_read_each(dealt(rest), kinds, one))


def with_hashes(files: DataFrame, root: str, sha256: bool = False) -> DataFrame:
    """with_fingerprint() and with_digests() of all files."""
    return with_digests(with_fingerprint(files, root).drop("xxh3_whole"), root, sha256)


def _read_each(files: DataFrame, kinds: dict[str, str], one, due: str | None = None) -> DataFrame:
    """files with what one(path, row) puts into row, a dict of kinds; a hash_error that files has already stays. Files where the column
    due isn't true are passed over."""
    from ..session import arrow_map, with_fields

    held = [c for c in files.columns if c not in kinds]

    def run(batches):
        import pyarrow as pa

        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        for batch in batches:
            out: dict[str, list] = {k: [] for k in kinds}
            before = batch.column("hash_error").to_pylist() if "hash_error" in batch.schema.names else [None] * len(batch)
            wanted = batch.column(due).to_pylist() if due else [True] * len(batch)
            for rel, error, read in zip(batch.column("path").to_pylist(), before, wanted, strict=True):
                row = dict.fromkeys(kinds)
                try:
                    if error is not None:
                        row["hash_error"] = error
                    elif read:
                        one(rel, row)
                except OSError as e:
                    row = dict.fromkeys(kinds) | {"hash_error": f"xxh3_128 error: {e}"}
                for k in kinds:
                    out[k].append(row[k])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in held], *[pa.array(out[k], types[t]) for k, t in kinds.items()]], names=[*held, *kinds])

    return arrow_map(files, run, with_fields(files.select(*held).schema, **kinds))


def _start(f, n: int) -> bytes:
    """The next n bytes of an unbuffered file, fewer at its end."""
    out = f.read(n)
    while len(out) < n and (piece := f.read(n - len(out))):
        out += piece
    return out


def _mvhd(f, size: int, parse) -> int | None:
    """Creation time of a video of some size, skipping over all boxes but moov."""
    import struct

    at = 0
    while at + 8 <= size:
        f.seek(at)
        head = _start(f, 16)
        n, kind = struct.unpack_from(">I4s", head)
        n = struct.unpack_from(">Q", head, 8)[0] if n == 1 and len(head) == 16 else (size - at if n == 0 else n)
        if kind == b"moov":
            f.seek(at)
            return parse(_start(f, min(n, size - at)))
        if n < 8:
            return None
        at += n
    return None
