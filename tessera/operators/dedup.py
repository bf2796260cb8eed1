"""Fingerprint lookup, classification, strong-hash dedup and what an insert does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, values
from ..session import arrow_map, shuffle_parts, with_fields
from .numbering import matched, numbered

NEW_LABELS = ("new", "recover")


def fingerprint_lookup(source: DataFrame, files: DataFrame) -> DataFrame:
    """source with the catalog row that has the same size, fingerprint and extension: c_id, c_path, c_status, c_raw.

    Where both sides have a RAW id and these differ, a candidate isn't admissible; of those that are, the
    one with the smallest id counts. Files without an extension never match.
    """
    key, c = ["_size", "_crc", "_ext"], F.struct(F.col("id").alias("c_id"), F.col("path").alias("c_path"), F.col("status").alias("c_status"), F.col("raw_id").alias("c_raw"))
    right = files.where(F.col("crc32").isNotNull()).select(F.col("size").alias("_size"), F.col("crc32").alias("_crc"), paths.extension("path").alias("_ext"), F.col("raw_id").alias("_raw"), c.alias("_c"))
    # Each side of a join below has a key once at most: a fingerprint that many files share is combined before.
    shared = right.groupBy(*key).agg(F.min("_c").alias("_any"), F.min(F.when(F.col("_raw").isNull(), F.col("_c"))).alias("_bare"))
    exact = right.where("_raw is not null").groupBy(*key, "_raw").agg(F.min("_c").alias("_own"))
    left = source.withColumns({"_size": F.col("size"), "_crc": F.col("crc32"), "_ext": paths.extension("path"), "_raw": F.col("raw_id")})
    found = left.join(shared, key, "left").join(exact, [*key, "_raw"], "left")
    found = found.withColumn("c", F.when(F.col("_raw").isNull(), F.col("_any")).otherwise(F.least("_bare", "_own")))
    return found.select(*source.columns, "c.c_id", "c.c_path", "c.c_status", "c.c_raw")


def classify(looked_up: DataFrame, disk: DataFrame) -> DataFrame:
    """Rows of fingerprint_lookup() with status: new, recover, duplicate or moved.

    disk(path) is the inventory of what is there. Recover comes before duplicate, duplicate before moved.
    """
    there = disk.select(F.col("path").alias("c_path"), F.lit(True).alias("on_disk")).distinct()
    status = (
        F.when(F.col("c_id").isNull(), "new")
        .when(F.col("c_status") == "missing", "recover")
        .when(F.col("on_disk"), "duplicate")
        .otherwise("moved")
    )
    return looked_up.join(there, "c_path", "left").select(*looked_up.columns, status.alias("status"))


def filter_new(classified: DataFrame, force: bool = False) -> DataFrame:
    """What goes on to the copy: new and recovered rows; under force, known ones again."""
    wanted = NEW_LABELS + (("duplicate", "moved") if force else ())
    return classified.where(F.col("status").isin(*wanted))


def pipe_lines(classified: DataFrame, show_dup: bool = False) -> DataFrame:
    """The scan's text protocol: new: and, if asked for, dup: lines with escaped paths; fail: for failures."""
    kind = F.when(F.col("status").isin("new", "recover"), "new").when(F.col("status").isin("duplicate", "moved"), "dup").when(F.col("status") == "failed", "fail")
    out = classified.select(kind.alias("kind"), F.concat(kind, F.lit(":"), paths.pipe_escape("path")).alias("line")).where("kind is not null")
    return (out if show_dup else out.where("kind <> 'dup'")).select("line")


def first_wins(rows: DataFrame, key: Column | str, order: list[str]) -> DataFrame:
    """rows with is_first: of the rows with one key, the first by order; a null key is always first.

    Built from a pre-aggregated minimum and a join, so one key with very many rows is not gathered.
    """
    k = F.col(key) if isinstance(key, str) else key
    keyed = rows.withColumn("_k", k).withColumn("_o", F.struct(*order))
    least = keyed.where("_k is not null").groupBy("_k").agg(F.min("_o").alias("_m"))
    joined = keyed.join(least, "_k", "left")
    return joined.select(*rows.columns, (F.col("_m").isNull() | (F.col("_o") == F.col("_m"))).alias("is_first"))


def survivors(rows: DataFrame, key: str) -> DataFrame:
    """rows with survivor: the first path of those with one key; rows with a null key are left out."""
    least = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("path").alias("survivor"))
    return rows.join(least, key)


def known_hashes(files: DataFrame) -> DataFrame:
    """A row a file and hash that it has, as algo and hash: an incoming hash is compared with its own kind."""
    kinds = F.array(F.struct(F.lit("sha256").alias("algo"), F.col("sha256").alias("hash")), F.struct(F.lit("xxh3_128").alias("algo"), F.col("xxh3_128").alias("hash")))
    return files.withColumn("h", F.explode(kinds)).select("*", "h.algo", "h.hash").drop("h").where("hash is not null")


def with_identity(rows: DataFrame) -> DataFrame:
    """rows with algo and hash: SHA-256 where there is one, else the fast hash."""
    i = values.identity(F.col("sha256"), F.col("xxh3_128"))
    return rows.withColumn("algo", i["algo"]).withColumn("hash", i["hash"])


def missing_contents(files: DataFrame, other: DataFrame) -> DataFrame:
    """Imported rows of files whose content (by its own kind of hash) other doesn't have."""
    have = known_hashes(other).select("algo", "hash").distinct()
    return with_identity(files.where("status = 'imported'")).join(have, ["algo", "hash"], "left_anti").drop("algo", "hash")


def status_counts(classified: DataFrame, column: str = "status") -> DataFrame:
    """How many rows each status (or action) has."""
    return classified.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def batch_summary(rows: DataFrame, key: str) -> DataFrame:
    """How many rows carry a key that an earlier row has too: groups with more than one row."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")).where("n > 1")


def strong_hash_decision(batch: DataFrame, files: DataFrame, disk: DataFrame, add: bool = False) -> DataFrame:
    """batch(path, algo, hash, error) with reason: null if the row passes.

    In this order: an error stays; a catalog row that is missing lets the row pass, unseen; a catalog row
    that is on disk makes it a duplicate (but for the same file under add); an earlier row of the batch
    with the same hash makes it one; the first by path passes.
    """
    known = files.where("hash is not null").groupBy("algo", "hash").agg(F.min(F.struct("id", "path", "status")).alias("c"))
    there = disk.select(F.col("path").alias("_there"), F.lit(True).alias("on_disk")).distinct()
    rows = batch.join(known, ["algo", "hash"], "left").join(there, F.col("c.path") == F.col("_there"), "left")
    missing = F.coalesce(F.col("c.status") == "missing", F.lit(False))
    other = F.lit(True) if not add else F.col("c.path") != F.col("path")
    in_db = F.coalesce(~missing & F.col("on_disk") & other, F.lit(False))
    open_ = F.col("error").isNull() & ~missing & ~in_db & F.col("hash").isNotNull()
    rows = rows.withColumn("_missing", missing).withColumn("_db", in_db).withColumn("_open", open_)
    rows = rows.withColumn("_key", F.when(F.col("_open"), F.struct("algo", "hash")))
    least = rows.where("_key is not null").groupBy("_key").agg(F.min("path").alias("_first"))
    rows = rows.join(least, "_key", "left")
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("_missing"), F.lit(None).cast("string"))
        .when(F.col("_db"), F.concat(F.lit("db ("), F.col("algo"), F.lit(")")))
        .when(F.col("_open") & (F.col("path") > F.col("_first")), F.concat(F.lit("batch ("), F.col("algo"), F.lit(")")))
    )
    return rows.select(*batch.columns, reason.alias("reason"))


def insert_outcome(rows: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """rows(dest_path, algo, hash, reason) with outcome, recovers_id and manifest_dest.

    A path that the catalog tracks already (and isn't missing) is skipped, before anything else; an error is
    failed; another reason is a duplicate; what is left is added. Of the added rows of one content, the k-th by destination goes
    into the k-th missing row (by id) that has it; a row that finds none is a new one.
    """
    tracked = files.where("status <> 'missing'").select(F.col("path").alias("dest_path"), F.lit(True).alias("_tracked")).distinct()
    out = rows.join(tracked, "dest_path", "left")
    skipped = F.lit(False) if force else F.coalesce(F.col("_tracked"), F.lit(False))
    failed = F.coalesce(F.col("reason").rlike("^(hash|xxh3_128|sha256) error"), F.lit(False))
    outcome = F.when(skipped, "skipped").when(failed, "failed").when(F.col("reason").isNotNull(), "duplicate").otherwise("added")
    out = out.withColumn("outcome", outcome)
    found = recoveries(out.where("outcome = 'added'"), files)
    out = out.join(found.select("dest_path", "recovers_id"), "dest_path", "left")
    return out.select(*rows.columns, "outcome", "recovers_id", F.when(F.col("outcome").isin("added", "skipped"), F.col("dest_path")).alias("manifest_dest"))


def recoveries(rows: DataFrame, files: DataFrame) -> DataFrame:
    """dest_path and recovers_id: which of rows(dest_path, algo, hash) stands for which missing row of files.

    A missing row that has both hashes is found by either; it is recovered once, by SHA-256 first.
    """
    lost = files.where("status = 'missing' and hash is not null").select("algo", "hash", F.col("id").alias("recovers_id"))
    pairs = matched(rows.select("algo", "hash", "dest_path"), lost, ["algo", "hash"], ["dest_path"], ["recovers_id"])
    return pairs.groupBy("recovers_id").agg(F.min(F.struct("algo", "dest_path")).alias("b")).select(F.col("b.dest_path").alias("dest_path"), "recovers_id")


def recovered_rows(files: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of files that rows (of insert_outcome()) recover, as they are then: with their new path, status and times;
    sizes and hashes stay."""
    taken = [c for c in ("mtime", "imported_at") if c in files.columns and c in rows.columns]
    back = rows.where("outcome = 'added' and recovers_id is not null").select(F.col("recovers_id").alias("id"), F.struct("dest_path", *taken).alias("_b"))
    new = {"path": F.col("_b.dest_path"), "status": F.lit("imported")} | {c: F.col(f"_b.{c}") for c in taken}
    return files.where("status = 'missing'").join(back, "id").select(*[new.get(c, F.col(c)).alias(c) for c in files.columns])


def new_rows(files: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows (of insert_outcome()) that are added and recover nothing, with the columns of files but for the id; what they don't
    have is null."""
    cells, have = {"path": F.col("dest_path"), "status": F.lit("imported")}, {*rows.columns}
    fresh = rows.where("outcome = 'added' and recovers_id is null")
    return fresh.select(*[cells.get(c, F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in files.dtypes if c != "id"])


def apply_outcomes(files: DataFrame, rows: DataFrame) -> DataFrame:
    """The catalog after an import, whole: recovered rows as recovered_rows() has them, new ones numbered on from the largest id in
    the order of path. Archives keep their catalogs by sinks.store, which writes what changes only."""
    back = recovered_rows(files, rows)
    top = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    fresh = numbered(new_rows(files, rows), [], ["path"], "id").withColumn("id", F.col("id") + F.lit(top))
    return files.join(back.select("id"), "id", "left_anti").select(*files.columns).unionByName(back).unionByName(fresh.select(*files.columns))


def outcome_summary(rows: DataFrame) -> DataFrame:
    """Counts by outcome as one row."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.coalesce(F.count_if(F.col("outcome") == k), F.lit(0)).alias(k) for k in ("added", "duplicate", "failed", "skipped")])


DEFAULT_RENAME = "$filename.$n.$ext"


def conflict_rename(planned: DataFrame, taken: DataFrame | None = None, template: str = DEFAULT_RENAME) -> DataFrame:
    """planned(path, dest) with final: every destination once, and none of taken(path).

    Rows come one by one in the order of path: each keeps its destination if that is free, or gets the template with the
    smallest n from 1 that makes a free name. Names that can meet are a family: those of one folder that are alike
    without their numbers (for other templates than the default one, all of a folder). A family of one
    free name needs no more; the others stream through a task each, which holds the family's names.
    Paths are not null. A null destination stays null; an empty table gives an empty result.
    """
    folder, name = paths.parent("dest"), paths.file_name("dest")
    alike = F.regexp_replace(name, r"\.\d+(?=\.|$)", "") if template == DEFAULT_RENAME else F.lit("")
    family = F.concat_ws("/", F.coalesce(folder, F.lit("")), alike)
    rows = planned.withColumn("_family", F.when(F.col("dest").isNotNull(), family))
    held = (planned.limit(0).select("dest") if taken is None else taken.select(F.col("path").alias("dest"))).where("dest is not null").withColumn("_family", family)
    sizes = rows.select("_family").unionAll(held.select("_family")).groupBy("_family").agg(F.count(F.lit(1)).alias("_n"))
    crowded = sizes.where("_n > 1 and _family is not null").select("_family", F.lit(True).alias("_crowded"))
    rows = rows.join(crowded, "_family", "left")
    simple = rows.where("_crowded is null").select(*planned.columns, F.col("dest").alias("final"))
    both = rows.where("_crowded").drop("_crowded").unionByName(held.join(crowded.select("_family"), "_family", "left_semi").distinct(), allowMissingColumns=True)
    names = planned.columns

    def run(batches):
        import pyarrow as pa

        now, used, numbers = None, set(), {}
        for batch in batches:
            keep, final = [], []
            for family, path, dest in zip(*[batch.column(k).to_pylist() for k in ("_family", "path", "dest")], strict=True):
                if family != now:
                    now, used, numbers = family, set(), {}
                own = dest
                if path is not None:  # what is taken has no path, and comes first
                    n = numbers.get(dest, 0)
                    while own in used:  # what is taken stays so: the search goes on from the last number
                        n += 1
                        own = renamed(dest, template, n)
                    numbers[dest] = max(n - 1, 0)
                    final.append(own)
                keep.append(path is not None)
                used.add(own)
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in names], pa.array(final, pa.string())], names=[*names, "final"])

    # By a hash of the family: by the family itself, Spark takes the union for partitioned already, which it then isn't.
    sorted_rows = both.select("_family", *names).repartition(shuffle_parts(planned.sparkSession), F.xxhash64("_family")).sortWithinPartitions("_family", F.asc_nulls_first("path"), "dest")
    return simple.unionAll(arrow_map(sorted_rows, run, with_fields(planned.schema, final="string")))


def renamed(dest: str, template: str, n: int) -> str:
    """dest under the template with number n; a name without extension has no dot at its end."""
    folder, _, name = dest.rpartition("/")
    base, dot, ext = name.rpartition(".")
    if not dot:
        base, ext = name, ""
    out = template.replace("$filename", base).replace("$ext", ext).replace("$n", str(n))
    out = out[:-1] if out.endswith(".") else out
    return f"{folder}/{out}" if folder else out
