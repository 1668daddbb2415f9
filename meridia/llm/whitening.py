"""Whitening of embeddings: pivoted Cholesky, then one-sided Jacobi on the triangular factor.

Spark sums the vectors, then, centred, their products; each task returns one
matrix, and only sums by cell shuffle.  The covariance V, dimensions by
dimensions, is factored on the driver as V = L L' with pivots, largest first,
which shows the rank.  Jacobi rotations make the columns of L orthogonal: their
squared norms are the eigenvalues of V and the columns, normalised, its
eigenvectors; V itself is never squared or iterated on.

Entries become whole numbers, floor(SCALE * c) + OFFSET, so sums and deviations
are exact and reruns on other partitions agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
#: Rotations smaller than this, relative to both columns, are left out; sweeps end when none is left.
TOLERANCE, SWEEPS = 1e-15, 60
#: Whole numbers up to here are exact as doubles.
EXACT = 1 << 53


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not empty, and all its entries are finite and exact after scaling."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < EXACT / SCALE / 2)
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fine), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length, without nulls, as whole numbers, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * flat).astype(np.int64) + OFFSET).reshape(len(column), -1)


def decimals(values: list[int]) -> pa.Array:
    return pa.array([str(v) for v in values]).cast(pa.decimal128(38, 0))


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L of as many columns as the rank of ``v``, in the order of its rows, with L L' = v."""
    rest, size = np.diag(v).astype(np.float64).copy(), len(v)
    least = size * np.finfo(np.float64).eps * max(rest.max(initial=0.0), 0.0)
    columns: list[np.ndarray] = []
    done = np.zeros(size, bool)
    for _ in range(size):
        pivot = int(np.argmax(np.where(done, -np.inf, rest)))
        if not rest[pivot] > least:
            break
        column = v[:, pivot].astype(np.float64).copy()
        for known in columns:
            column -= known * known[pivot]
        column /= np.sqrt(rest[pivot])
        column[done] = 0.0
        rest -= column * column
        done[pivot] = True
        columns.append(column)
    return np.array(columns).T.reshape(size, -1)


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of factor factor'."""
    a = factor.copy()
    for _ in range(SWEEPS):
        turned = False
        for i in range(a.shape[1] - 1):
            for j in range(i + 1, a.shape[1]):
                x, y = a[:, i], a[:, j]
                xx, yy, xy = x @ x, y @ y, x @ y
                if abs(xy) <= TOLERANCE * np.sqrt(xx * yy):
                    continue
                turned = True
                zeta = (yy - xx) / (2 * xy)
                t = np.copysign(1.0, zeta) / (abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                a[:, i], a[:, j] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    values = (a * a).sum(0)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > 0]
    unit = a[:, order] / np.sqrt(values[order])
    # of either sign, that with its largest entry above zero
    largest = unit[np.abs(unit).argmax(0), np.arange(unit.shape[1])] if unit.size else np.ones(unit.shape[1])
    return values[order], unit * np.sign(largest)


@dataclass
class Whitening:
    """A fitted transform: n vectors, their sums, and components with their eigenvalues."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    def project(self, x: np.ndarray, most: int) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ self.components[:, :most] / np.sqrt(self.eigenvalues[:most])

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact at any size."""
        reach = max(abs(int(x.max())), abs(int(x.min()))) * self.n + max(map(abs, self.sums))
        kind = np.int64 if reach * reach * x.shape[1] < 1 << 63 else object
        apart = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return [int(d) for d in (apart * apart).sum(1)]


def _summed(vectors: DataFrame, centre: np.ndarray | None, left: np.ndarray | None = None) -> np.ndarray:
    """Sum over all vectors of z z', where z is the vector less ``centre``, times ``left`` if given."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                z = matrix(batch.column(0)) - centre
                z = z if left is None else z @ left
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            i, j = np.indices(total.shape).reshape(2, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

    cells = vectors.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    side = int(max(cells["i"].to_pylist(), default=-1)) + 1
    out = np.zeros((side, side))
    out[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy()
    return out


def fit(vectors: DataFrame) -> Whitening | None:
    """Fit on a frame of one usable vector column of one length; None if it is empty.

    Only sums, dimensions by dimensions at most, reach the driver.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = None
        n = 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                n += len(x)
                # halves, so that no sum of a task passes 63 bits
                high = (x >> 32).sum(0) + (0 if high is None else high)
                low = (x & 0xFFFFFFFF).sum(0) + (0 if low is None else low)
        if n:
            totals = [n, *((int(h) << 32) + int(w) for h, w in zip(high, low))]
            at = pa.array(np.arange(-1, len(totals) - 1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([at, decimals(totals)], ["i", "v"])

    exact = vectors.mapInArrow(sums, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v"))
    found = {r.i: int(r.v) for r in exact.collect()}
    if not found:
        return None
    n, totals = found.pop(-1), [found[i] for i in sorted(found)]
    v = _summed(vectors, np.array([s / n for s in totals])) / n
    values, components = one_sided_jacobi(pivoted_cholesky(v))
    return Whitening(n, totals, values, components, float(np.trace(v)))


def whiten(rows: DataFrame, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds a null, a non-finite entry or one
    of 2^42 or more take no part.  Vectors of another length than the commonest
    (of equally common ones the longest) take no part either.  Repeated rows,
    repeated ids and null ids count and are returned one by one; other columns
    are not read, whatever their names.  Components end at the rank: constant
    dimensions have none, and of a table of equal vectors, of one vector or of
    none no row is returned.  ``deviation`` is decimal(38,0), exact; one of more
    digits fails the query instead of wrapping round.  Very many dimensions cost
    memory by their square, in each task and in the driver.
    """
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    schema = schema.replace("vec_id long", f"vec_id {rows.schema[id_col].dataType.simpleString()}")
    kept = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")))
    lengths = kept.groupBy(F.size("vector").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first()
    if lengths.m is None:
        return rows.sparkSession.createDataFrame([], schema)
    kept = kept.where(F.size("vector") == lengths.m.d)
    model = fit(kept.select("vector"))
    most = min(most, len(model.eigenvalues))
    mean = np.array([s / model.n for s in model.sums])
    left = model.components[:, :most] / np.sqrt(model.eigenvalues[:most])
    error = float(np.abs(_summed(kept.select("vector"), mean, left) / model.n - np.eye(most)).max()) if most else 0.0
    explained = model.eigenvalues[:most] / model.trace if most else np.zeros(0)

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_in = batch.num_rows
            if not rows_in or not most:
                continue
            x = matrix(batch.column(1))
            each = np.repeat(np.arange(rows_in), most)
            far = decimals(model.deviation(x))
            size = rows_in * most
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), rows_in)),
                    pa.array(np.full(size, model.n)),
                    far.take(pa.array(each)),
                    pa.array(model.project(x, most).ravel()),
                    pa.array(np.tile(explained, rows_in)),
                    pa.array(np.full(size, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return kept.mapInArrow(transformed, schema)
