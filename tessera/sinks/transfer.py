"""Copying files into and out of archives. Effects run on the executors, a row a file."""

from __future__ import annotations

import errno
import filecmp
import os
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import arrow_map, shuffle_parts, with_fields

FICLONE = 0x40049409  # fixed value: Linux ioctl number of a reflink
NO_CLONES = (errno.EOPNOTSUPP, errno.ENOTTY, errno.ENOSYS)


def _device(folder: str) -> int:
    """The device of a folder, which is made if it isn't there."""
    try:
        return os.stat(folder).st_dev
    except FileNotFoundError:
        os.makedirs(folder, exist_ok=True)
        return os.stat(folder).st_dev


def place(src: str, dest: str, strategies: tuple[str, ...], unable: set[tuple[int, int]] | None = None) -> str:
    """Puts src at dest by the first strategy that works; the copy is always last. Never overwrites.

    unable holds the pairs of devices whose file systems were found to have no reflinks: there, none is tried again.
    """
    unable = set() if unable is None else unable
    to = _device(os.path.dirname(dest) or ".")
    if os.path.exists(dest):
        raise FileExistsError(dest)
    devices = (os.stat(src).st_dev, to)
    for s in strategies:
        try:
            if s == "reflink":
                if devices in unable:
                    continue
                import fcntl

                with open(src, "rb") as a, open(dest, "xb") as b:
                    fcntl.ioctl(b, FICLONE, a.fileno())
                shutil.copystat(src, dest)
                return s
            if s == "hardlink":
                os.link(src, dest)
                return s
            if s == "copy":
                break
        except OSError as e:
            if s == "reflink":
                if os.path.exists(dest):
                    os.unlink(dest)
                if e.errno in NO_CLONES:
                    unable.add(devices)
    temp = f"{dest}.part"
    shutil.copy2(src, temp)
    os.link(temp, dest)
    os.unlink(temp)
    return "copy"


def _run(action, drop: tuple[str, ...] = ()):
    """A function of batches: action on each row; the columns named by drop end here."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            done, errors = [], []
            for row in batch.to_pylist():
                try:
                    done.append(action(row))
                    errors.append(None)
                except OSError as e:
                    done.append(None)
                    errors.append(str(e))
            held = [c for c in batch.schema.names if c not in drop]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in held], pa.array(done, pa.string()), pa.array(errors, pa.string())], names=[*held, "how", "copy_error"])

    return run


def _carried_out(rows: DataFrame, action, drop: tuple[str, ...] = ()) -> DataFrame:
    """rows with how and copy_error, without the columns named by drop. Rows are dealt over all tasks, however few parts a small table of
    many files was read from."""
    dealt = rows.repartition(shuffle_parts(rows.sparkSession), F.xxhash64(*[c for c in rows.columns if c not in drop]))
    return arrow_map(dealt, _run(action, drop), with_fields(rows.drop(*drop).schema, how="string", copy_error="string"))


def transfer(rows: DataFrame, strategies: tuple[str, ...] = ("reflink", "hardlink", "copy")) -> DataFrame:
    """rows(src, dest, ...) with how and copy_error, once each file has been placed. A re-run task finds a file
    with the same content in place and leaves it; another content there is an error, and stays."""
    unable: set[tuple[int, int]] = set()  # each task has its own

    def action(row):
        if os.path.exists(row["dest"]) and filecmp.cmp(row["src"], row["dest"], shallow=False):
            return "present"
        return place(row["src"], row["dest"], strategies, unable)

    return _carried_out(rows, action)


def clone_copy(plan: DataFrame, source_root: str, target_root: str) -> DataFrame:
    """A clone plan's rows of action `copied`, carried out."""
    unable: set[tuple[int, int]] = set()

    def action(row):
        return place(os.path.join(source_root, row["path"]), os.path.join(target_root, row["path"]), ("reflink", "copy"), unable) if row["action"] == "copied" else row["action"]

    return _carried_out(plan, action)


def make_independent(rows: DataFrame, root: str) -> DataFrame:
    """rows(path, nlink): hard links become files of their own, through a synced copy that takes the name."""

    def action(row):
        path = os.path.join(root, row["path"])
        if os.stat(path).st_nlink < 2:
            return "single"
        temp = f"{path}.unlink"
        shutil.copy2(path, temp)
        with open(temp, "rb") as f:
            os.fsync(f.fileno())
        os.replace(temp, path)
        return "copied"

    return _carried_out(rows, action)


def write_contents(rows: DataFrame, root: str) -> DataFrame:
    """rows(path, content, mtime_ms) as files below root: path, mtime_ms, how and copy_error; a task that runs again writes the same files
    again."""

    def action(row):
        dest = os.path.join(root, row["path"])
        try:
            f = open(f"{dest}.part", "wb")
        except FileNotFoundError:  # the folder's first file
            os.makedirs(os.path.dirname(dest), exist_ok=True)
            f = open(f"{dest}.part", "wb")
        with f:
            f.write(row["content"] or b"")
        os.utime(f"{dest}.part", ns=(row["mtime_ms"] * 1_000_000,) * 2)
        os.replace(f"{dest}.part", dest)
        return "written"

    return _carried_out(rows, action, ("content",))


def move_or_remove(rows: DataFrame, root: str) -> DataFrame:
    """rows(path, new_path): files below root that are renamed, or removed where new_path is null, with how and copy_error. A file that isn't
    there any more has been dealt with already."""

    def action(row):
        path = os.path.join(root, row["path"])
        if not os.path.exists(path):
            return "gone"
        if row["new_path"] is None:
            os.unlink(path)
            return "removed"
        dest = os.path.join(root, row["new_path"])
        os.makedirs(os.path.dirname(dest), exist_ok=True)
        os.rename(path, dest)
        return "moved"

    return _carried_out(rows, action)
