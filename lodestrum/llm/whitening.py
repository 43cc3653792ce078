"""Whitening of embeddings by a randomised range finder.

The fit list is every distinct vector once, as whole numbers. A random basis with some columns more than asked for is
multiplied by the covariance in passes over all centred rows; after each pass the Rayleigh-Ritz step gives components and
their residuals. If these fail, or won't become small enough within the passes allowed, the basis is completed to the
full dimension, where the step is exact. What the driver holds depends on the dimension only: tasks send sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrum.llm.common import Store, bounded_batches

SCALE, SHIFT = 64, 1_000_000
#: Entries become whole numbers of at most this size before the shift, so that they fit 32 bits.
LARGEST = 2.0**30
#: Columns of a product that travel in one row.
WIDE = 32
#: An eigenvalue of less than this share of the largest is rounding: there is nothing to scale to one.
FLAT = 1e-12


def whole(vec: Column) -> Column:
    """The vector as whole numbers, null where it has none, a null entry or one that isn't finite."""
    sound = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    entry = lambda c: F.least(F.greatest(F.floor(c.cast("double") * SCALE).cast("double"), F.lit(-LARGEST)), F.lit(LARGEST))
    return F.when(sound & (F.size(vec) > 0), F.transform(vec, lambda c: (entry(c) + SHIFT).cast("int")))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


@dataclass
class Whitening:
    """n vectors with sums per dimension, unit components as columns, by falling eigenvalue; explained shares of the whole
    variance; and the largest entry of the whitened fit list's covariance less the identity."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int
    expanded: bool

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n times the centred rows, exactly."""
        if self.n < 2**31:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of the squared numerators of each row, exactly; None where a long can't hold it."""
        t = self.numerators(x)
        if t.size and float(np.abs(t).max()) ** 2 * t.shape[1] < 2**62:
            return (t * t).sum(1).tolist()
        return [v if v < 2**63 else None for v in (sum(int(e) ** 2 for e in row) for row in t)]

    def transform(self, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """id, deviation and whitened, an array with a place for each component, of every row whose vector counts."""
        own = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scaled = own.components / np.sqrt(own.eigenvalues)
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column("x"))
                    w = own.centred(x) @ scaled
                    arrays = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(own.deviation(x), pa.int64()), arrays], ["vec_id", "deviation", "whitened"])

        rows = df.select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vec_col)).alias("x")).where(F.size("x") == len(self.sums))
        return rows.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def _summed(fit: DataFrame, parts: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of fit (x) of left' right, of which parts gives both for a batch. A task sends one sum, in rows of
    WIDE columns that are added by key."""
    height, width = shape
    names = [f"c{j}" for j in range(min(WIDE, width))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                left, right = parts(matrix(b.column("x")))
                total += left.T @ right
        for at in range(0, width, len(names)):
            block = np.zeros((height, len(names)))
            block[:, : min(len(names), width - at)] = total[:, at : at + len(names)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(height, dtype=np.int32)), pa.array(np.full(height, at, np.int32)), *(pa.array(c) for c in block.T.copy())], ["i", "at", *names])

    sums = fit.mapInArrow(run, "i int, at int, " + ", ".join(f"{c} double" for c in names)).groupBy("i", "at").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    out = np.zeros((height, width + len(names)))
    for i, at, *values in zip(*(sums.column(c).to_pylist() for c in ("i", "at", *names)), strict=True):
        out[i, at : at + len(names)] = values
    return out[:, :width]


def _totals(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """How many vectors, and their sum for each dimension, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(d, np.int64), 0
        for b in batches:
            if b.num_rows:
                sums += matrix(b.column("x")).sum(0)
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d, dtype=np.int32)), pa.array([n, *sums.tolist()], pa.int64())], ["i", "s"])

    found = {r["i"]: int(r["s"]) for r in fit.mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return found[-1], np.array([found[i] for i in range(d)], object)


def _ritz(basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values by size, vectors and residuals' lengths of the best components within an orthonormal basis."""
    small = basis.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = basis @ turn
    return values, vectors, np.linalg.norm(product @ turn - vectors * values, axis=0)


def _errors(values: np.ndarray, residuals: np.ndarray, k: int) -> float:
    """A bound on the angle between the first k components and the true ones: residual over the distance to the next value,
    where a residual at the rounding of the largest value is none."""
    worst = 0.0
    for i in range(min(k, len(values))):
        gap = min(abs(values[i] - v) for j, v in enumerate(values) if j != i) if len(values) > 1 else values[i]
        if residuals[i] > 16 * np.finfo(float).eps * abs(values[0]):
            worst = max(worst, residuals[i] / gap if gap > 0 else math.inf)
    return worst


def fit_whitening(df: DataFrame, components: int = 16, oversample: int = 8, passes: int = 8, tolerance: float = 1e-12, seed: int = 12, vec_col: str = "embedding") -> Whitening | None:
    """The whitening of the distinct vectors of df, None if there are none.

    Rows without a vector, or with a null or non-finite entry, don't count, nor do empty vectors. An entry of more than
    16 million times one is taken as that. Vectors must have one length to have a covariance: the one that most distinct
    vectors have counts (of two, the longer), others don't take part. Vectors that repeat count once. Components without
    variance, which can't be scaled to one, are left out: of equal vectors all of them. Other columns are ignored.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    fit = Store(spark, "whitening").put(df.select(whole(F.col(vec_col)).alias("x")).where("x is not null").distinct(), "fit")
    lengths = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return None
    d = lengths["d"]
    fit = fit.where(F.size("x") == d)
    n, sums = _totals(fit, d)
    out = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0), 0.0, 0, False)
    centred = out.centred
    k = min(components, d)

    def multiplied(basis: np.ndarray) -> np.ndarray:
        """The covariance times a basis, in one pass over all rows."""
        out.passes += 1

        def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            z = centred(x)
            return z, z @ basis

        return _summed(fit, parts, (d, basis.shape[1])) / n

    def squares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = centred(x).reshape(-1, 1)
        return z, z

    trace = float(_summed(fit, squares, (1, 1))[0, 0]) / n
    rng = np.random.default_rng(seed)
    basis, before = np.linalg.qr(rng.standard_normal((d, min(d, k + oversample))))[0], None
    while True:
        product = multiplied(basis)
        values, vectors, residuals = _ritz(basis, product)
        error = _errors(values, residuals, k)
        if error <= tolerance or basis.shape[1] == d:
            break
        # From two passes on, their ratio says how many more it would take.
        falls = before is not None and 0 < error < before
        more = math.log(tolerance / error) / math.log(error / before) if falls else math.inf
        if out.passes >= 3 and out.passes + more > passes or out.passes >= passes:
            basis, out.expanded = np.linalg.qr(np.hstack([vectors, rng.standard_normal((d, d - vectors.shape[1]))]))[0], True
        else:
            basis, before = np.linalg.qr(product)[0], error
    used = int((values[:k] > FLAT * max(values[0], 0.0)).sum()) if trace > 0 else 0
    out.components, out.eigenvalues = vectors[:, :used], values[:used]
    out.explained = out.eigenvalues / trace if used else np.zeros(0)
    if used:
        scaled = out.components / np.sqrt(out.eigenvalues)

        def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            w = np.hstack([centred(x) @ scaled, np.ones((len(x), 1))])
            return w, w

        m = _summed(fit, moments, (used + 1, used + 1)) / n
        out.identity_error = float(np.abs(m[:used, :used] - np.outer(m[:used, used], m[used, :used]) - np.eye(used)).max())
    return out


def whitened_rows(df: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding", **how) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for every row of df whose vector
    counts and every component that has variance; as fit_whitening() says. Rows that repeat are each returned, a null id
    too. A deviation that a long can't hold is null."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    w = fit_whitening(df, components, vec_col=vec_col, **how)
    if w is None or not len(w.eigenvalues):
        return df.sparkSession.createDataFrame([], schema)
    shares = F.array(*(F.lit(float(e)) for e in w.explained))
    each = w.transform(df, id_col, vec_col).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(w.identity_error).alias("identity_error"))
