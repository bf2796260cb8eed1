"""Media formats, and what follows from a file's extension."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, canonical extension, category, MIME type, fingerprint region, further extensions.
FORMATS = [
    ("Jpeg", "jpg", "image", "image/jpeg", "head", ["jpeg"]),
    ("Png", "png", "image", "image/png", "tail", []),
    ("Heif", "heif", "image", "image/heif", "head", []),
    ("Heic", "heic", "image", "image/heic", "head", []),
    ("Avif", "avif", "image", "image/avif", "head", []),
    ("Webp", "webp", "image", "image/webp", "head", []),
    ("Mov", "mov", "video", "video/quicktime", "head_tail", []),
    ("Mp4", "mp4", "video", "video/mp4", "head_tail", ["m4v"]),
    ("Avi", "avi", "video", "video/avi", "head", []),
    ("Mkv", "mkv", "video", "video/x-matroska", "head", []),
    ("Dng", "dng", "raw", "image/dng", "head_tail", []),
    ("Arw", "arw", "raw", "image/x-sony-arw", "head_tail", []),
    ("Cr2", "cr2", "raw", "image/x-canon-cr2", "head_tail", []),
    ("Cr3", "cr3", "raw", "image/x-canon-cr3", "head_tail", []),
    ("Nef", "nef", "raw", "image/x-nikon-nef", "head_tail", []),
    ("Raf", "raf", "raw", "image/x-fuji-raf", "head_tail", []),
    ("Rw2", "rw2", "raw", "image/x-panasonic-rw2", "head_tail", []),
]
#: The extensions that an archive takes in by default, without and with written settings.
EXTENSIONS_BUILT_IN = ["jpg", "jpeg", "heic", "heif", "dng", "cr2", "cr3", "nef", "nrw", "arw", "raf", "orf", "rw2", "pef", "iiq", "png", "tiff", "tif", "mp4", "mov", "avi", "mkv"]
EXTENSIONS_WRITTEN = ["jpg", "jpeg", "heic", "heif", "dng", "cr2", "cr3", "nef", "nrw", "arw", "raf", "orf", "rw2", "pef", "raw", "mov", "mp4"]

BY_EXTENSION = {ext: row for row in FORMATS for ext in (row[1], *row[5])}
RAW_EXTENSIONS = [e for e, row in BY_EXTENSION.items() if row[2] == "raw"]
LIVE_PHOTO = ["Heic", "Heif", "Jpeg", "Mov", "Mp4"]
RAW_PARTNER = ["Jpeg", "Heic", "Heif"]


def _lookup(ext: Column, k: int, default: Column) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(e), F.lit(row[k])) for e, row in BY_EXTENSION.items()))
    return F.coalesce(F.try_element_at(table, ext), default)


def format_name(ext: Column) -> Column:
    return _lookup(ext, 0, F.concat(F.lit("Unknown("), ext, F.lit(")")))


def category(ext: Column) -> Column:
    return _lookup(ext, 2, F.lit("unknown"))


def mime_type(ext: Column) -> Column:
    return _lookup(ext, 3, F.lit("application/octet-stream"))


def canonical_extension(ext: Column) -> Column:
    return _lookup(ext, 1, ext)


def region(ext: Column) -> Column:
    """Which bytes the fingerprint is taken over: head, tail, head_tail or full."""
    return _lookup(ext, 4, F.lit("full"))


def is_raw(ext: Column) -> Column:
    return F.coalesce(ext.isin(RAW_EXTENSIONS), F.lit(False))


def is_live_photo_component(ext: Column) -> Column:
    return format_name(ext).isin(LIVE_PHOTO)


def is_raw_partner(ext: Column) -> Column:
    return format_name(ext).isin(RAW_PARTNER)


def is_supported(ext: Column, only: str | None = None) -> Column:
    """Whether an extension, in any case, is of a known format; only: of one category."""
    return F.coalesce(F.lower(ext).isin([e for e, row in BY_EXTENSION.items() if only in (None, row[2])]), F.lit(False))


def format_dimension(spark: SparkSession, only: str | None = None, more: list[tuple] | None = None) -> DataFrame:
    """extension, format, category, mime, canonical, region: a row an extension; only: one category.

    more: formats as in FORMATS that are added, in place of those whose extensions they name.
    """
    known = BY_EXTENSION | {ext: row for row in more or [] for ext in (row[1], *row[5])}
    rows = [(e, r[0], r[2], r[3], r[1], r[4]) for e, r in known.items() if only in (None, r[2])]
    return spark.createDataFrame(rows, "extension string, format string, category string, mime string, canonical string, region string")
