"""Whitening of vectors: projections on leading components of unit variance and no correlation.

The components come from a randomised range finder: a random block of `most` + `oversample` directions is multiplied by
the covariance in passes over all centred rows, orthogonalised between passes, and solved by Rayleigh-Ritz. Where the
residuals of the leading pairs don't fall to TOLERANCE in `passes` passes, the block is widened to all dimensions, in
strips, whose Rayleigh-Ritz pairs are those of the covariance itself. A task keeps one dimensions x directions block;
blocks are summed number by number on their way, so that the driver gets one of them a pass, whatever the rows.

Vectors are whole numbers x = floor(64 c) + 1000000, so that sums and deviations are exact.

Defined for odd rows: vectors that are null, hold null, NaN or infinite entries, or entries whose x no long holds, are
dropped, and so are vectors of another length than most have (of two lengths as frequent, the longer counts); a null
vec_id and repeated rows are rows like others. Components whose variance is nothing beside the first's don't exist:
fewer than `most` come back, and none of an empty table, a single vector or equal vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, released

SCALE, SHIFT = 64.0, 1_000_000
MOST, OVERSAMPLE, PASSES = 32, 8, 3
#: Of the largest eigenvalue: the residuals that a pair may leave, and the variance under which there is no component.
TOLERANCE, NOTHING = 1e-13, 1e-12
#: Directions multiplied at once when the block has to span all dimensions; rows worked on at once.
STRIP, ROWS = 256, 1024


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v (doubles): vectors whose entries are all finite and have an x."""
    v = F.col(vector).cast("array<double>")
    fits = F.forall(v, lambda c: F.coalesce(F.abs(c) < float(1 << 56), F.lit(False)))  # NaN is larger than any number
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & fits).select(F.col(key).cast("bigint").alias("vec_id"), v.alias("v"))


def whole(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batch in slices, each with its x as longs."""
    for k in range(0, batch.num_rows, ROWS):
        part = batch.slice(k, ROWS)
        c = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
        yield part, np.floor(SCALE * c).astype(np.int64) + SHIFT


def lengths(vectors: DataFrame) -> int:
    """The most frequent length, the longer of equally frequent ones; 0 of no vectors."""
    found = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found[0] if found else 0


def summed(vectors: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> list:
    """The sum over all rows of an array of `size` numbers that `of` makes of each task's rows."""
    arrow = pa.float64() if kind == "double" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in released(batches):
            for _, x in whole(batch):
                total = of(x) if total is None else total + of(x)
        if total is not None:
            flat = np.ravel(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat, arrow)], names=["k", "v"])

    rows = vectors.mapInArrow(run, f"k int, v {kind}").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)") if kind == "bigint" else "v")).collect()
    out = [0] * size
    for k, v in rows:
        out[k] = float(v) if kind == "double" else int(v)
    return out


@dataclass(frozen=True)
class Fit:
    """What the rows are projected with; everything is of the size of a dimensions x directions block."""

    n: int
    sums: list[int]  # exact
    components: np.ndarray  # a column each
    eigenvalues: np.ndarray
    trace: float
    widened: bool
    residual: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, the whole part taken off in whole numbers."""
        base = np.array([s // self.n for s in self.sums])
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - base) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues))

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - sums)^2, exact."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums))
        widest = max(abs(int(np.max(x[:, k])) * self.n - s) + abs(int(np.min(x[:, k])) * self.n - s) for k, s in enumerate(self.sums))
        if most < 1 << 62 and widest * widest * len(self.sums) < 1 << 62:
            off = x * self.n - np.array(self.sums)
            return (off * off).sum(axis=1).tolist()
        off = x.astype(object) * self.n - np.array(self.sums, object)
        return (off * off).sum(axis=1).tolist()


def fit(vectors: DataFrame, dims: int, most: int = MOST, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = 13) -> Fit:
    """Mean and leading components of rows (vec_id, v) of dims entries each."""
    *sums, n = summed(vectors, lambda x: np.append(x.sum(axis=0), len(x)), dims + 1, "bigint")
    centre = Fit(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0, False, 0.0)

    def times(block: np.ndarray) -> np.ndarray:
        """The covariance times a block of directions, in one pass over the rows."""

        def of(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return c.T @ (c @ block)

        return np.array(summed(vectors, of, block.size)).reshape(block.shape) / n

    trace = summed(vectors, lambda x: np.array([(centre.centred(x) ** 2).sum()]), 1)[0] / n
    wide = min(dims, most + oversample)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, wide)))[0] if wide < dims else np.eye(dims)
    widened = wide == dims

    def solved(block: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Rayleigh-Ritz pairs of the block by falling eigenvalue, and the largest residual of the leading ones over the first eigenvalue."""
        small = block.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        left = np.linalg.norm(product @ turn - (block @ turn) * values, axis=0)[:most]
        return values, block @ turn, float(left.max(initial=0.0) / max(values[0], 1e-300))

    if trace <= 0:
        return Fit(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0, widened, 0.0)
    for _ in range(1 if widened else passes + 1):
        product = times(block)
        values, found, residual = solved(block, product)
        if widened or residual <= TOLERANCE:
            break
        block = np.linalg.qr(product)[0]
    else:
        widened, block = True, np.eye(dims)
        values, found, residual = solved(block, np.hstack([times(block[:, k : k + STRIP]) for k in range(0, dims, STRIP)]))
    kept = [k for k in range(min(most, len(values))) if values[k] > NOTHING * values[0]]
    return Fit(n, sums, found[:, kept], values[kept], trace, widened, residual)


def identity_error(vectors: DataFrame, fitted: Fit) -> float:
    """The largest absolute entry of the projections' covariance minus the identity, in one pass over the rows."""
    m = len(fitted.eigenvalues)
    product = np.array(summed(vectors, lambda x: (w := fitted.whitened(x)).T @ w, m * m)).reshape(m, m) / fitted.n
    return float(np.abs(product - np.eye(m)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST, oversample: int = OVERSAMPLE, passes: int = PASSES) -> DataFrame:
    """A row for each usable vector and component: vec_id, component (from 1), n, deviation (decimal), whitened, explained, identity_error."""
    schema = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    prepare(spark)
    rows = usable(vectors, key, vector)
    if not (dims := lengths(rows)):
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == dims)
    fitted = fit(rows, dims, most, oversample, passes)
    m = len(fitted.eigenvalues)
    if not m:
        return spark.createDataFrame([], schema)
    explained, error = fitted.eigenvalues / fitted.trace, identity_error(rows, fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            for part, x in whole(batch):
                size = len(x) * m
                each = pa.array(np.repeat(np.arange(len(x)), m))
                far = pa.array([str(d) for d in fitted.deviations(x)]).cast(pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(size, fitted.n)),
                    far.take(each), pa.array(fitted.whitened(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(size, error)),
                ], names=names)

    return rows.mapInArrow(run, schema)


def report(vectors: DataFrame) -> DataFrame:
    """op13: up to 32 components; deviation as a long, null where it is beyond one (`whiten` has it as a decimal)."""
    out = whiten(vectors)
    return out.withColumn("deviation", F.when(F.col("deviation") <= F.lit((1 << 63) - 1).cast("decimal(38,0)"), F.col("deviation")).cast("bigint"))
