"""Embedding whitening with matrix-free block Lanczos.

The covariance is never formed: a pass over the vectors multiplies it with a block of directions, by sums of
centred rows times their projections. The basis stays fully orthogonal on the driver, which holds a few
numbers a dimension and direction; vectors stay in the tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import arrow_map
from .common import read_table, written

#: Entries become whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components, directions of a pass, the residual (of the largest eigenvalue) at which a component has converged, and the share
#: of it under which an eigenvalue is rounding only.
COMPONENTS, BLOCK, CONVERGED, LEAST = 32, 16, 1e-13, 1e-11


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and x (whole numbers) of the rows whose vector is not null and holds finite numbers only."""
    v = F.col(vec_col)
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = rows.where(v.isNotNull()).where(~odd)
    return kept.select(F.col(id_col).alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT)).alias("x"))


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _summed(vectors: DataFrame, d: int, numbers: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray:
    """Sums over all vectors of numbers(block of rows), a flat array: tasks add up their own, Spark the tasks'."""
    kind = "decimal(38,0)" if exact else "double"

    def run(batches):
        total = None
        for batch in batches:
            if len(batch):
                own = numbers(_matrix(batch.column(0), d))
                total = own if total is None else total + own
        if total is not None:
            values = pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0)) if exact else pa.array(total.astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), values], names=["i", "s"])

    parts = arrow_map(vectors.select("x"), run, f"i int, s {kind}")
    rows = parts.groupBy("i").agg(F.sum("s").alias("s")).collect()  # a number an i: dimensions x directions
    out = np.zeros(len(rows), object if exact else np.float64)
    for r in rows:
        out[r["i"]] = int(r["s"]) if exact else r["s"]
    return out


class Centre:
    """The mean S / n of the fit list, taken off in whole numbers first, so that nothing is lost."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, np.array(sums, np.int64)
        self.whole, self.rest = self.sums // n, (self.sums % n) / n

    def off(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sums of (n * x - S)**2 over the dimensions, exact; OverflowError where 64 bits can't hold one."""
        d = x.shape[1]
        reach = (self.n * max(abs(int(x.max())), abs(int(x.min()))) + int(np.abs(self.sums).max())) if x.size else 0
        off = self.n * x - self.sums if reach < 1 << 63 else self.n * x.astype(object) - self.sums.astype(object)
        most = int(np.abs(off).max()) if off.size else 0
        if most * most * d < 1 << 63:
            return (off.astype(np.int64) ** 2).sum(axis=1)
        out = (off.astype(object) ** 2).sum(axis=1)
        if max(out) >= 1 << 63:
            raise OverflowError("a deviation doesn't fit into 64 bits")
        return out.astype(np.int64)


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], d: int, want: int, block: int = BLOCK, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The want largest eigenvalues and unit eigenvectors (as columns) of a symmetric d x d matrix, given by its product with d x b
    blocks.

    New blocks are orthogonalised against the whole basis, twice. Directions that vanish (a breakdown: the basis is
    invariant) are replaced by random ones. The residuals of the wanted pairs decide on convergence, which one more
    random block has to leave as it is: it would show repeated eigenvalues that the first block missed.
    """
    rng, want = np.random.Generator(np.random.PCG64(seed)), min(want, d)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))

    def fresh(m: int) -> np.ndarray:
        return rng.standard_normal((d, m))

    def orthogonal(new: np.ndarray) -> np.ndarray:
        """The directions that new adds to the basis, as many as there are, at most to d in all."""
        size, room, out = np.linalg.norm(new, axis=0), d - basis.shape[1], np.zeros((d, 0))
        for k in range(new.shape[1]):
            v = new[:, k]
            for _ in range(2):
                v = v - basis @ (basis.T @ v)
                v = v - out @ (out.T @ v)
            norm = np.linalg.norm(v)
            if out.shape[1] < room and norm > 1e-10 * max(size[k], scale):
                v = v / norm
                v = v - basis @ (basis.T @ v)
                v = v - out @ (out.T @ v)
                out = np.column_stack([out, v / np.linalg.norm(v)])
        return out

    scale, new, confirmed = 0.0, fresh(min(block, d)), None
    while True:
        own = orthogonal(new)
        while not own.shape[1] and basis.shape[1] < d:
            own = orthogonal(fresh(min(block, d - basis.shape[1])))
        basis, image = np.column_stack([basis, own]), np.column_stack([image, product(own)])
        small = basis.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][:want]
        values, vectors = values[order], basis @ turns[:, order]
        scale = max(float(values[0]), 0.0)
        left = image @ turns[:, order] - vectors * values
        done = len(order) == want and (np.linalg.norm(left, axis=0) <= CONVERGED * scale).all()
        if basis.shape[1] == d or (done and confirmed is not None and np.allclose(confirmed, values, rtol=0, atol=CONVERGED * scale)):
            return values, vectors
        confirmed = values if done else None
        rest = min(block, d - basis.shape[1])
        if done:
            new = fresh(rest)
        else:
            new = image[:, -own.shape[1] :]
            new = orthogonal(new)
            if new.shape[1] < rest:  # a breakdown
                new = np.column_stack([new, fresh(rest - new.shape[1])])


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained,
    identity_error.

    Vectors that are null or hold nulls or numbers that aren't finite are left out, and so are those of another length than
    most have (ties: the longest). Repeated rows and ids count each, a null id stays null. Components whose
    eigenvalue is rounding only (LEAST of the largest) are left out: without any spread, and for an empty table, the result is empty.
    Directions of equal eigenvalues are those of one choice, the same for all rows. Other columns are not read.
    """
    spark = rows.sparkSession
    vectors = written(whole_vectors(rows, id_col, vec_col), "vectors")
    kind = dict(vectors.dtypes)["vec_id"]
    schema = f"{id_col} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    sizes = vectors.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d > 0")
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    d, n = most["d"], most["n"]
    vectors = vectors.where(F.size("x") == d)
    centre = Centre(n, list(_summed(vectors, d, lambda x: x.sum(axis=0), exact=True)))
    # of (n * x - S)**2 over all: n**3 times the covariance's trace
    spread = int(_summed(vectors, d, lambda x: np.array([sum(map(int, centre.deviation(x)))], object), exact=True)[0])
    if not spread:
        return spark.createDataFrame([], schema)
    trace = spread / n**3

    def product(block: np.ndarray) -> np.ndarray:
        def numbers(x: np.ndarray) -> np.ndarray:
            off = centre.off(x)
            return (off.T @ (off @ block)).ravel()

        return _summed(vectors, d, numbers).reshape(block.shape) / n

    values, directions = block_lanczos(product, d, components)
    good = values > LEAST * values[0]
    values, directions = values[good], directions[:, good]
    directions = directions * np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(len(values))])
    scaled, k = directions / np.sqrt(values), len(values)

    def products(x: np.ndarray) -> np.ndarray:
        w = centre.off(x) @ scaled
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    sums = _summed(vectors, d, products) / n
    error = float(np.abs(sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k]) - np.eye(k)).max())
    shares = values / trace

    def out(batches):
        for batch in batches:
            for at in range(0, len(batch), 1_000):
                part = batch.slice(at, 1_000)
                x = _matrix(part.column(1), d)
                m = len(x)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(np.repeat(centre.deviation(x), k)), pa.array((centre.off(x) @ scaled).ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return arrow_map(vectors, out, schema.replace(f"{id_col} ", "vec_id ", 1)).withColumnRenamed("vec_id", id_col)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
