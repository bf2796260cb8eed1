"""Numbers within keys, and matches by them, without gathering a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import kept
from ..session import shuffle_parts


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str = "k") -> DataFrame:
    """rows with name: 1, 2, ... within each value of key, in the order of order.

    Rows are cut into ranges by key and order, so that a key with very many rows lies in many ranges; a range numbers its
    own, after the counts of the ranges before it. Null keys are numbered like a value; rows that agree in key and order take
    their numbers in either order. No key at all numbers the whole table.
    """
    parts = shuffle_parts(rows.sparkSession)
    # written once: the ranges of a second evaluation could be others
    ranged = kept(rows.repartitionByRange(parts, *key, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_range", *key).orderBy(*order)))
    sizes = ranged.groupBy("_range", *key).agg(F.count(F.lit(1)).alias("_n"))
    if key:
        before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    else:  # as many rows as ranges
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_key_{c}") for c in key], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    return own.join(starts, same).select(*rows.columns, (F.col("_own") + F.col("_before")).cast("long").alias(name))


def matched(left: DataFrame, right: DataFrame, key: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Pairs of left and right that agree in key: of each key, the k-th of left with the k-th of right.

    A row is in one pair at most; null keys match nothing. Columns other than key have names of their own. A key that one
    side has once pairs its first rows, by pre-aggregated minima; only rows of keys that both sides repeat are numbered.
    """

    def first(rows: DataFrame, order: list[str], side: str) -> tuple[DataFrame, DataFrame]:
        for c in key:
            rows = rows.where(F.col(c).isNotNull())
        rest = [c for c in rows.columns if c not in key and c not in order]
        own = F.struct(*order, *rest)
        return rows, rows.groupBy(*key).agg(F.min(own).alias(f"_{side}"), F.count(F.lit(1)).alias(f"_n_{side}"))

    left, a = first(left, left_order, "a")
    right, b = first(right, right_order, "b")
    both = kept(a.join(b, key), "keys")
    alone = F.least("_n_a", "_n_b") == 1
    names = [c for c in left.columns if c not in key] + [c for c in right.columns if c not in key]
    pairs = both.where(alone).select(*key, "_a.*", "_b.*").select(*key, *names)
    crowded = both.where(~alone).select(*key)
    if crowded.isEmpty():
        return pairs
    many = [numbered(rows.join(crowded, key, "left_semi"), key, order, "_k") for rows, order in ((left, left_order), (right, right_order))]
    return pairs.unionByName(many[0].join(many[1], [*key, "_k"]).select(*key, *names))
