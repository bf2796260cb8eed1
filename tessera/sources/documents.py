"""Manifests, file lists and settings."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats

MANIFEST = (
    "session_id string, session_type string, source_root string, imported_at bigint, hash_algorithm string, "
    "files array<struct<src_path: string, dest_path: string, size: bigint, mtime_ms: bigint, crc32c: bigint, xxh3_128: string, sha256: string, imported_at: bigint, status: string, error: string>>, "
    "summary struct<total: bigint, added: bigint, duplicate: bigint, failed: bigint, skipped: bigint>"
)


def manifests(spark: SparkSession, found: str | list[str]) -> DataFrame:
    """One row a manifest of a folder or of some files, newest first; files that aren't valid JSON are passed over."""
    schema = MANIFEST + ", _corrupt_record string"
    if not found:
        return spark.createDataFrame([], MANIFEST)
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(schema).json(found)
    return raw.where("_corrupt_record is null and session_id is not null").drop("_corrupt_record").orderBy(F.desc("imported_at"), F.desc("session_id"))


def manifest_items(found: DataFrame) -> DataFrame:
    """One row a file of manifests; a missing status is `added`."""
    rows = found.select("session_id", F.col("imported_at").alias("session_at"), F.explode("files").alias("f")).select("session_id", "session_at", "f.*")
    return rows.withColumn("status", F.coalesce("status", F.lit("added")))


ITEM = [c.split(": ")[0] for c in re.search(r"files array<struct<(.*?)>>", MANIFEST)[1].split(", ")]


def item_records(items: DataFrame):
    """A manifest's entry for a row of items, as JSON: its fields in the manifest's order, without those that are null."""
    return F.to_json(F.struct(*[c for c in ITEM if c in items.columns]))


def read_record(record):
    """An entry as a struct; a missing status is `added`."""
    item = F.from_json(record, re.search(r"files array<(struct<.*?>)>", MANIFEST)[1])
    return item.withField("status", F.coalesce(item["status"], F.lit("added")))


def file_list(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """Paths of the `new:` lines of a scan's output, unescaped, names with spaces whole; below root if relative."""
    lines = spark.read.text(path).where("value like 'new:%'")
    name = F.replace(F.replace(F.substr("value", F.lit(5)), F.lit("\\:"), F.lit(":")), F.lit("\\ "), F.lit(" "))
    if root:
        name = F.when(F.startswith(name, F.lit("/")), name).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), name))
    return lines.select(name.alias("path"))


def listed(wanted: DataFrame, inventory: DataFrame) -> DataFrame:
    """The list against what is there: a path that isn't is a row with an error."""
    there = inventory.withColumn("_there", F.lit(True))
    out = wanted.join(there, "path", "left")
    return out.withColumn("error", F.coalesce("error", F.when(F.col("_there").isNull(), F.lit("no such file")))).drop("_there")


@dataclass
class Settings:
    sync_strategy: tuple[str, ...] = ("reflink", "hardlink", "copy")
    path_template: str = "$year/$mon-$day/$device/$filename"
    rename_template: str = "$filename.$n.$ext"
    allowed_extensions: list[str] = field(default_factory=lambda: list(formats.EXTENSIONS_BUILT_IN))


def strategies(value: str | list[str]) -> tuple[str, ...]:
    """A list, or words with commas between, in any case; a copy always ends the list."""
    names = value.split(",") if isinstance(value, str) else value
    out = []
    for n in (x.strip().lower() for x in names):
        if n not in ("reflink", "hardlink", "copy"):
            raise ValueError(f"unknown strategy {n!r}")
        if n == "copy":
            break
        out.append(n)
    return (*out, "copy")


def settings(path: str | None) -> Settings:
    if path is None or not Path(path).exists():
        return Settings()
    doc = tomllib.loads(Path(path).read_text())
    imp, out = doc.get("import", {}), Settings(allowed_extensions=list(formats.EXTENSIONS_WRITTEN))
    if "sync_strategy" in doc.get("global", {}):
        out.sync_strategy = strategies(doc["global"]["sync_strategy"])
    for key in ("path_template", "rename_template"):
        setattr(out, key, imp.get(key, getattr(out, key)))
    if "allowed_extensions" in imp:
        out.allowed_extensions = [x.lower().lstrip(".") for x in imp["allowed_extensions"]]
    return out


def clean_root(path: str) -> str:
    """A root without trailing quotes and separators."""
    return re.sub(r"""[\\/"']+$""", "", path.strip()) or "/"


def parse_time(text: str | None) -> int | None:
    """RFC 3339 or a day, as UTC milliseconds; without a zone it is local time, a day its midnight. What isn't either filters nothing."""
    from datetime import datetime

    try:
        t = datetime.fromisoformat(text) if text else None
    except ValueError:
        return None
    if t is None:
        return None
    return int(t.timestamp() * 1000)
