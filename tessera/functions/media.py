"""What only the bytes tell: XXH3-128, EXIF tags, RAW ids, MP4 times. Arrow UDFs over binary columns."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: TIFF tags that are read, by directory.
TAGS = {0x010F: "make", 0x0110: "model", 0x0132: "modified", 0x9003: "original", 0xA431: "serial", 0xA420: "image_id"}
EXIF_POINTER = 0x8769


def _udf(function, schema: str):
    """A pandas UDF, made where it is used: executors import this module without a session."""
    session = SparkSession.getActiveSession()
    if session is not None:
        ship(session)
    return F.pandas_udf(function, schema)


def xxh3_bytes(data: bytes) -> bytes:
    """XXH3-128 as archives store it: little-endian, low half first."""
    import xxhash

    return xxhash.xxh3_128(data).digest()[::-1]


def xxh3_128(content: Column) -> Column:
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else xxh3_bytes(bytes(b)))

    return _udf(run, "binary")(content)


def tiff_tags(data: bytes) -> dict[str, str]:
    """ASCII values of TAGS in a TIFF structure; what can't be read is left out."""
    out: dict[str, str] = {}
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return out
    pending, seen = [struct.unpack_from(order + "I", data, 4)[0]], set()
    while pending:
        at = pending.pop()
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        for k in range(n):
            entry = at + 2 + 12 * k
            if entry + 12 > len(data):
                break
            tag, kind, count, value = struct.unpack_from(order + "HHII", data, entry)
            if tag == EXIF_POINTER:
                pending.append(value)
            elif tag in TAGS and kind == 2:
                start = entry + 8 if count <= 4 else value
                out.setdefault(TAGS[tag], data[start : start + count].split(b"\0")[0].decode("ascii", "replace").strip())
    return out


def exif_tags(data: bytes) -> dict[str, str]:
    """Tags of a JPEG's APP1 segment, or of a TIFF-based RAW file."""
    if data[:2] != b"\xff\xd8":
        return tiff_tags(data)
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return tiff_tags(data[at + 10 : at + 2 + size])
        if marker == 0xDA:
            break
        at += 2 + size
    return {}


_EXIF = "original string, modified string, make string, model string, serial string, image_id string"


def exif(content: Column) -> Column:
    """Struct of the tags of _EXIF, each null where it isn't found."""
    names = [c.split()[0] for c in _EXIF.split(", ")]

    def run(content: pd.Series) -> pd.DataFrame:
        rows = [exif_tags(bytes(b)) if b is not None else {} for b in content]
        return pd.DataFrame([[r.get(c) for c in names] for r in rows], columns=names, dtype=object)

    return _udf(run, _EXIF)(content)


def _boxes(data: bytes, at: int, end: int):
    """(type, start of content, end) of the boxes in a span; sizes of 64 bits, and to the end, included."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                return
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        elif size == 0:
            size = end - at
        if size < head:
            return
        yield kind, at + head, min(at + size, end)
        at += size


def mp4_seconds(data: bytes) -> int | None:
    """Creation time of moov/mvhd in QuickTime seconds; null if there is none."""
    for kind, start, end in _boxes(data, 0, len(data)):
        if kind == b"moov":
            for inner, s, e in _boxes(data, start, end):
                if inner == b"mvhd" and e - s >= 8:
                    if data[s] == 1:
                        return struct.unpack_from(">Q", data, s + 4)[0] if e - s >= 12 else None
                    return struct.unpack_from(">I", data, s + 4)[0]
    return None


def mp4_created(content: Column) -> Column:
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else mp4_seconds(bytes(b))).astype("Int64")

    return _udf(run, "bigint")(content)
