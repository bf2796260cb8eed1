"""Related media: live photos, RAW with JPEG, bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import formats, paths


def binding_keys(files: DataFrame) -> DataFrame:
    """path, stem, kind: the key under which a single file would be bound; others are left out."""
    ext = paths.extension("path")
    kind = F.when(formats.is_live_photo_component(ext), "live_photo").when(formats.is_raw(ext) | formats.is_raw_partner(ext), "raw_plus_jpg")
    return files.select("path", paths.stem("path").alias("stem"), kind.alias("kind")).where("kind is not null")


def stem_bindings(files: DataFrame) -> DataFrame:
    """Groups of files with one folder and stem: kind, primary, secondaries (sorted), group_id, total_size.

    A group with image and video is a live photo; one with RAW and JPEG or HEIF is such a pair. A
    group is as large as there are formats of one name, so gathering it is bounded.
    """
    ext = paths.extension("path")
    rows = files.select(
        "path", "size", paths.parent("path").alias("folder"), paths.stem("path").alias("stem"),
        formats.category(ext).alias("category"), formats.format_name(ext).alias("format"),
    )
    picture = F.col("format").isin("Heic", "Heif", "Jpeg")
    grouped = rows.groupBy("folder", "stem").agg(
        F.bool_or((F.col("category") == "image") & picture).alias("img"),
        F.bool_or(F.col("format").isin("Mov", "Mp4")).alias("vid"),
        F.bool_or(F.col("category") == "raw").alias("raw"),
        F.min(F.when(picture, F.col("path"))).alias("best"),
        F.array_sort(F.collect_list("path")).alias("all"),
        F.sum("size").cast("long").alias("total_size"),
        F.count(F.lit(1)).alias("n"),
    )
    kind = F.when(F.col("img") & F.col("vid"), "live_photo").when(F.col("img") & F.col("raw"), "raw_plus_jpg")
    out = grouped.where("n > 1").withColumn("kind", kind).where("kind is not null")
    return out.select("kind", F.col("best").alias("primary"), F.array_remove("all", F.col("best")).alias("secondaries"), F.col("stem").alias("group_id"), "total_size")


def burst_islands(files: DataFrame, least: int = 3) -> DataFrame:
    """Runs of images whose names end in successive numbers: folder, prefix, first_number, last_number, n, primary."""
    ext = paths.extension("path")
    rows = files.where(formats.category(ext) == "image").select("path", paths.parent("path").alias("folder"), paths.stem("path").alias("s"))
    rows = rows.select("path", "folder", paths.burst_prefix("s").alias("prefix"), paths.burst_number("s").alias("num")).where("prefix is not null")
    w = Window.partitionBy("folder", "prefix").orderBy("num", "path")
    rows = rows.withColumn("_new", (F.col("num") - F.lag("num").over(w) > 1).cast("int"))
    rows = rows.withColumn("island", F.sum(F.coalesce("_new", F.lit(0))).over(w))
    out = rows.groupBy("folder", "prefix", "island").agg(F.min("num").alias("first_number"), F.max("num").alias("last_number"), F.count(F.lit(1)).alias("n"), F.min_by("path", F.struct("num", "path")).alias("primary"))
    return out.where(F.col("n") >= least).drop("island")


def greedy_bindings(files: DataFrame) -> DataFrame:
    """Bindings by seeds, exactly: files in the order of path; a file joins the first seed that it is directly related to.

    One folder is one group, which a task holds whole: whether a file is a seed depends on files before it, and so on along a
    whole burst. Relations ask for an equal stem, or an equal prefix with numbers at most 1 apart.
    """
    rows = files.select("path", F.coalesce("size", F.lit(0)).cast("long").alias("size"), paths.parent("path").alias("folder"))
    return rows.groupBy("folder").applyInArrow(_greedy, "folder string, kind string, primary string, secondaries array<string>, group_id string, total_size bigint")


def _parts(path: str):
    import re

    name = path.rsplit("/", 1)[-1]
    stem, _, ext = name.rpartition(".") if "." in name[1:] else (name, "", "")
    row = formats.BY_EXTENSION.get(ext.lower())
    burst = re.match(r"^(.*?)(\d+)$", stem, re.DOTALL)
    number = int(burst[2]) if burst else None
    return stem, row[0] if row else "Unknown", row[2] if row else "unknown", (burst[1], number if number < 1 << 64 else 0) if burst else None


def related(a, b) -> bool:
    """Whether two files (as _parts gives them) belong together directly."""
    (stem_a, form_a, cat_a, burst_a), (stem_b, form_b, cat_b, burst_b) = a, b
    if stem_a == stem_b:
        for image, other, kind in ((form_a, form_b, cat_b), (form_b, form_a, cat_a)):
            if image in formats.RAW_PARTNER and (other in ("Mov", "Mp4") or kind == "raw"):
                return True
    return cat_a == cat_b == "image" and bool(burst_a and burst_b) and burst_a[0] == burst_b[0] and abs(burst_a[1] - burst_b[1]) <= 1


def _greedy(table):
    import pyarrow as pa

    rows = sorted(zip(table["path"].to_pylist(), table["size"].to_pylist(), strict=True))
    parts = [_parts(p) for p, _ in rows]
    # candidates by stem, and by prefix and number: only these can be related
    by_stem: dict = {}
    by_burst: dict = {}
    for i, (stem, _, _, burst) in enumerate(parts):
        by_stem.setdefault(stem, []).append(i)
        if burst:
            by_burst.setdefault(burst, []).append(i)
    done, out = [False] * len(rows), []
    for i, own in enumerate(parts):
        if done[i]:
            continue
        near = set(by_stem[own[0]])
        if own[3]:
            for d in (-1, 0, 1):
                near.update(by_burst.get((own[3][0], own[3][1] + d), ()))
        group = [i, *sorted(j for j in near if j > i and not done[j] and related(own, parts[j]))]
        for j in group:
            done[j] = True
        forms, cats = [parts[j][1] for j in group], [parts[j][2] for j in group]
        candidate = own[1] in formats.LIVE_PHOTO or own[2] == "raw" or own[1] in formats.RAW_PARTNER
        if len(group) == 1 and not candidate:
            continue
        partner = next((j for j in group if parts[j][1] in formats.RAW_PARTNER), group[0])
        if "image" in cats and "video" in cats:
            kind, primary = "live_photo", partner
        elif "raw" in cats and any(f in formats.RAW_PARTNER for f in forms):
            kind, primary = "raw_plus_jpg", partner
        else:
            kind, primary = ("burst" if len(group) > 2 else "unknown"), group[0]
        out.append((table["folder"][0].as_py(), kind, rows[primary][0], sorted(rows[j][0] for j in group if j != primary), own[0], sum(rows[j][1] for j in group)))
    cols = list(zip(*out, strict=True)) if out else [[]] * 6
    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64()]
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["folder", "kind", "primary", "secondaries", "group_id", "total_size"])
