"""Whitening of embeddings by matrix-free block Lanczos.

Entries become integers x = floor(64 * c) + 1,000,000, so sums and deviations are exact. The covariance V of the x-vectors is never formed:
a pass over the rows gives V·Q for a block Q of as many vectors as components are wanted, each
row centred before it is multiplied. The driver keeps the basis alone (dimensions x basis, whatever the
number of rows), orthogonalises every new block twice against all of it, and takes Ritz pairs from the whole basis. Where the
residual block loses rank (breakdown) the lost directions are drawn anew, orthogonal to the basis; a basis that grows too large is restarted from its best Ritz vectors. It ends when the residuals of
all wanted pairs are at rounding level, or the basis spans the space. A block as wide as the number of components meets every
eigenvalue as often as it can be wanted, however often it repeats. The trace comes from the rows' deviations in the first pass.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped. Vectors of the commonest length (of
several, the longest) are the fit list; a vector of another length or without entries, and every vector if none varies, has no components and
gives one row with null results. Directions with less than 1e-10 of the largest variance are no components. 64 * c is held
within ±2^52. Ids are only carried: null and repeated ids are rows like others, and nothing is shuffled but partial sums. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from .runtime import TASKS_A_CORE, Scratch, fresh, lean, prepare

SCALE, SHIFT, EXTREME = 64.0, 1_000_000, float(1 << 52)
#: Residual of a converged pair against the largest eigenvalue, and what may pass if it no longer falls; variance under which a direction is none; residual directions that count as lost; columns of the basis at most (at least four blocks).
EXACT, STALLED, NONE, LOST, BASIS = 1e-13, 1e-11, 1e-10, 1e-11, 2048
ADDED = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def rows_of(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as a matrix of integers; all have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def integers(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Id and x-vector of the rows whose vector has finite entries only."""
    read = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vector"))
    schema = StructType([read.schema["id"], StructField("x", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            lists = b.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            value = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
            row = np.repeat(np.arange(len(sizes)), sizes)
            good = np.ones(len(sizes), bool)
            good[row[~np.isfinite(value)]] = False
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(np.clip(SCALE * value[good[row]], -EXTREME, EXTREME)).astype(np.int64) + SHIFT
            ends = np.concatenate([[0], np.cumsum(sizes[good])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(ends), pa.array(x))], names=["id", "x"])

    return read.mapInArrow(lean(run), schema)


class Fit:
    """The fit list's vectors ``rows`` (id, x), their exact sums, and passes over them."""

    def __init__(self, rows: DataFrame, size: int):
        spark = rows.sparkSession
        self.rows, self.size = rows.coalesce(TASKS_A_CORE * spark.sparkContext.defaultParallelism), size
        found = self.sums()
        self.n = found.pop(size, 0)
        sums = [found.get(i, 0) for i in range(size)]
        self.whole = [s // self.n for s in sums]
        self.rest = [s % self.n for s in sums]
        self.sums_of = sums

    def sums(self) -> dict[int, int]:
        """Exact sums by dimension, and the number of rows under the key ``size``."""
        size, schema = self.size, "i int, s decimal(38,0)"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = [0] * size, 0
            for b in batches:
                x = rows_of(b.column(1))
                high, low = x >> 26, x & ((1 << 26) - 1)
                total = [t + (h << 26) + lo for t, h, lo in zip(total, high.sum(axis=0).tolist(), low.sum(axis=0).tolist(), strict=True)]
                n += len(x)
            yield pa.RecordBatch.from_arrays([pa.array([*range(size), size], pa.int32()), pa.array([*total, n], pa.int64()).cast(pa.decimal128(38, 0)) if max(map(abs, total), default=0) < 1 << 62 else _decimals([*total, n])], names=["i", "s"])

        return {r.i: int(r.s) for r in self.rows.mapInArrow(lean(run), schema).groupBy("i").agg(F.sum("s").alias("s")).collect()}

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.whole, np.int64)).astype(np.float64) - np.array(self.rest, np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - S)^2 of each row, exactly."""
        near = x - np.array(self.whole, np.int64)
        if self.n * (int(np.abs(near).max(initial=0)) + 1) < 1 << 51 and self.size <= 1 << 10:
            v = np.abs(self.n * near - np.array(self.rest, np.int64))
            high, low = v >> 26, v & ((1 << 26) - 1)
            return [(h << 52) + (m << 27) + lo for h, m, lo in zip((high * high).sum(axis=1).tolist(), (high * low).sum(axis=1).tolist(), (low * low).sum(axis=1).tolist(), strict=True)]
        return [sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in near.tolist()]

    def total(self, height: int, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all rows of ``part`` of their centred vectors, a height x width matrix: one partial sum per task, added up by Spark row by row."""
        fit, schema = self.plain(), "i int, y array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y = np.zeros((height, width))
            for b in batches:
                if b.num_rows:
                    y += part(fit.centred(rows_of(b.column(1))))
            ends = pa.array(np.arange(height + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(height, dtype=np.int32)), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], names=["i", "y"])

        added = self.rows.mapInArrow(lean(run), schema).groupBy("i").agg(F.array(*[F.sum(F.col("y")[j]) for j in range(width)]).alias("y"))
        out = np.zeros((height, width))
        for r in added.collect():  # height x width numbers, whatever the input
            out[r.i] = r.y
        return out

    def plain(self) -> Fit:
        """The same without its rows, for tasks."""
        out = object.__new__(Fit)
        out.__dict__ = {k: v for k, v in self.__dict__.items() if k != "rows"}
        return out

    def times(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        """V·q and the trace of V, in one pass."""
        d, k = q.shape

        def part(c: np.ndarray) -> np.ndarray:
            return np.vstack([c.T @ (c @ q), np.full((1, k), (c * c).sum())])

        y = self.total(d + 1, k, part) / self.n
        return y[:d], float(y[d, 0]) if k else 0.0


def _decimals(values: list[int]) -> pa.Array:
    from decimal import Decimal

    return pa.array([Decimal(v) if abs(v) < 10**38 else None for v in values], pa.decimal128(38, 0))


def orthonormal(block: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """An orthonormal basis of the part of ``block`` outside ``basis``; directions not longer than ``least`` are left out."""
    for _ in range(2):  # twice is enough
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    out = u[:, s > least]
    out = out - basis @ (basis.T @ out)
    return np.linalg.qr(out)[0]


def lanczos(times: Callable[[np.ndarray], tuple[np.ndarray, float]], d: int, wanted: int, seed: int = 5, most: int = BASIS) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The ``wanted`` largest eigenvalues, their eigenvectors (columns), the trace and the number of passes."""
    draw, wanted = np.random.default_rng(seed), min(wanted, d)
    width, most = wanted, max(most, 4 * wanted)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    block, trace, passes, worst = np.linalg.qr(draw.standard_normal((d, width)))[0], None, 0, []
    while True:
        y, found = times(block)
        trace, passes = found if trace is None else trace, passes + 1
        basis, image = np.hstack([basis, block]), np.hstack([image, y])
        small = basis.T @ image
        value, vector = np.linalg.eigh((small + small.T) / 2)
        value, vector = value[::-1], vector[:, ::-1]
        top = max(float(value[0]), 0.0)
        best = basis @ vector[:, :wanted]
        left = np.linalg.norm(image @ vector[:, :wanted] - best * value[:wanted], axis=0).max(initial=0.0)
        worst.append(left)
        stalled = len(worst) > 8 and left <= STALLED * top and left > 0.9 * min(worst[-9:-1])  # nothing gained in eight passes
        if left <= EXACT * top or stalled or basis.shape[1] >= d:
            return value[:wanted], best, trace, passes
        residual = y - basis @ (basis.T @ y)
        if basis.shape[1] + width > most:  # restart from the best Ritz vectors; the residual block stays orthogonal to them
            hold = vector[:, : 2 * wanted]
            basis, image = basis @ hold, image @ hold
        room = min(width, d - basis.shape[1])
        block = orthonormal(residual, basis, LOST * max(top, 1e-300))[:, :room]
        while block.shape[1] < room:  # breakdown: what is lost is drawn anew
            fresh_ones = orthonormal(draw.standard_normal((d, room - block.shape[1])), np.hstack([basis, block]), 1e-8)
            block = np.hstack([block, fresh_ones])


def whiten(df: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """One row per kept vector and component: id, component (from 1), n, deviation (decimal; null beyond 38 digits), whitened, explained, identity_error."""
    spark = df.sparkSession
    prepare(spark)
    scratch = scratch or Scratch(spark, "whitening")
    names = dict(zip(ADDED, fresh(df.select(F.col(f"`{id_col}`")), *ADDED), strict=True))
    kept = scratch.save(integers(df, id_col, vec_col))
    kind = df.select(F.col(f"`{id_col}`")).schema.fields[0]
    kinds = {"component": IntegerType(), "n": LongType(), "deviation": DecimalType(38, 0), "whitened": DoubleType(), "explained": DoubleType(), "identity_error": DoubleType()}
    schema = StructType([kind, *[StructField(names[a], kinds[a]) for a in ADDED]])
    size = F.size("x")
    common = kept.where(size > 0).groupBy(size.alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    without = lambda rows, n: rows.select(F.col("id").alias(id_col), *[F.lit(n if a == "n" else None).cast(kinds[a]).alias(names[a]) for a in ADDED])
    if common is None:
        return without(kept, 0)
    fit = Fit(kept.where(size == common.d), common.d)
    value, vector, trace, _ = lanczos(fit.times, fit.size, components)
    real = value > max(NONE * value[0], 0.0)
    value, vector = value[real], vector[:, real]
    k, n = len(value), fit.n
    if not k:
        return without(kept, n)
    vector *= np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(k)])  # one sign, whatever the passes gave
    onto = vector / np.sqrt(value)

    def squares(c: np.ndarray) -> np.ndarray:
        w = c @ onto
        return np.vstack([w.T @ w, w.sum(axis=0)])

    sums = fit.total(k + 1, k, squares) / n
    error = float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())
    light, shares = fit.plain(), (value / trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = rows_of(b.column(1))
            m = len(x)
            take = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), _decimals(light.deviations(x)).take(take), pa.array((light.centred(x) @ onto).ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error))],
                names=schema.names,
            )

    out = kept.where(size == common.d).mapInArrow(lean(run), schema)
    return out.unionByName(without(kept.where(size != common.d), n))
