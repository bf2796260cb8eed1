"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source's repetition rate is what takes it from its present share to its target share. Each document's
copies are the inverse Poisson distribution function at a number hashed from the seed and its id, so
the draw needs no state, is the same on a re-run, and the copies' expectation is the rate exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shuffle_parts

SEED, TEMPERATURE, MAX_BROADCAST_SOURCES = "mix-1", 0.5, 10_000


def uniform(*parts: Column) -> Column:
    """52 hashed bits as a number in (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, size: float, temperature: float) -> DataFrame:
    """source, n, rate and the distribution function at 0, 1, ..., until its tail is below 2**-60."""
    counts = docs.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            if not (w >= 0 and math.isfinite(w)):
                raise ValueError(f"weight of {name!r} is {w}")
            weight = F.when(F.col("of").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("w", weight)
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    rate = F.lit(totals["n"] * size) * (F.col("w") / F.lit(totals["w"])) / F.col("n") if totals["w"] > 0 else F.lit(0.0)
    rates = counts.withColumn("rate", rate)
    last = "cast(ceil(rate + 12 * sqrt(rate) + 24) as int)"
    cdf = f"""aggregate(sequence(0, {last}), struct(0.0D as logs, 0.0D as sum, cast(array() as array<double>) as cdf),
        (s, k) -> struct(
            s.logs + case when k > 0 then ln(cast(k as double)) else 0.0D end as logs,
            s.sum + exp(k * ln(rate) - rate - (s.logs + case when k > 0 then ln(cast(k as double)) else 0.0D end)) as sum,
            array_append(s.cdf, s.sum + exp(k * ln(rate) - rate - (s.logs + case when k > 0 then ln(cast(k as double)) else 0.0D end))) as cdf),
        s -> s.cdf)"""
    return rates.select("of", "n", "rate", F.expr(f"case when rate > 0 then {cdf} else array() end").alias("cdf"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    size: float = 1.0,
    temperature: float = TEMPERATURE,
    seed: str = SEED,
    max_broadcast_sources: int = MAX_BROADCAST_SOURCES,
) -> DataFrame:
    """The columns of docs, each document as often as its draw says, with copy_no (from 1) and mix_key.

    Sources get the given weights; without them, the present counts to the power `temperature`, so that
    large sources shrink and small ones grow. size is the expected number of rows out for each row in.
    The result is range-partitioned and sorted by mix_key, a hash of seed, id and copy: a global
    shuffle that is the same on a re-run.

    Defined edge cases: null is a source like any other; a source that isn't in `weights` has weight 0;
    a null doc_id is hashed as 'null', so such rows share a draw, as repeated ids do; an empty table
    gives an empty result; columns of docs called copy_no or mix_key are replaced.
    """
    rates = source_rates(docs.select("source"), weights, float(size), temperature)
    base = docs.drop("copy_no", "mix_key")
    rates = rates.select(F.col("of").alias("_mix_of"), F.col("cdf").alias("_mix_cdf"))
    few = rates.limit(max_broadcast_sources + 1).count() <= max_broadcast_sources
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    drawn = base.join(F.broadcast(rates) if few else rates, F.col("source").eqNullSafe(F.col("_mix_of")))
    drawn = drawn.withColumn("_mix_u", uniform(F.lit(seed), ident))
    drawn = drawn.withColumn("_mix_copies", F.expr("size(filter(_mix_cdf, c -> _mix_u >= c))"))
    copies = drawn.where("_mix_copies > 0").withColumn("copy_no", F.explode(F.expr("sequence(1, _mix_copies)")))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), ident, F.col("copy_no")).cast("binary")))
    keyed = keyed.drop("_mix_of", "_mix_cdf", "_mix_u", "_mix_copies")
    return keyed.repartitionByRange(shuffle_parts(docs.sparkSession), "mix_key").sortWithinPartitions("mix_key")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, n ** {TEMPERATURE} AS w FROM n),
r AS (SELECT source, (SELECT sum(n) FROM n) * (w / (SELECT sum(w) FROM w)) / n AS rate FROM w),
p AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM r, (SELECT unnest(generate_series(0, 200)) AS k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 24)
),
u AS (SELECT *, (CAST('0x' || substr(md5('{SEED}|' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
c AS (SELECT u.doc_id, count(*) AS copies FROM u JOIN p ON p.source IS NOT DISTINCT FROM u.source AND u.u >= p.cdf GROUP BY u.doc_id)
SELECT d.*, CAST(i AS INTEGER) AS copy_no, md5('{SEED}:order|' || d.doc_id || '|' || i) AS mix_key
FROM documents d JOIN c USING (doc_id), LATERAL (SELECT unnest(generate_series(1, c.copies)) AS i)
"""
