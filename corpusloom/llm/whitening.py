"""Whitening of embeddings by a matrix-free block Lanczos iteration.

Entries c become integers x = floor(scale * c) + offset, so that the sums S of each
dimension, and with them n * x - S, are exact however far the values lie from zero. The
covariance V = sum (x - S/n)(x - S/n)' / n is never formed, nor are uncentred products: a
pass over the rows centres them and multiplies them with a block Q of vectors, V Q =
X'(X Q) / n, by partition, and the shares are added up by dimension.

Block Lanczos: each pass takes the block's products; what they add to the basis is
orthogonalised twice against all of it (full reorthogonalisation). Directions that vanish
there (a breakdown: the basis holds an invariant subspace) are replaced by random ones, a
restart. Ritz pairs come from the projection of V on the basis. It ends when the residuals
|V u - e u| of all wanted pairs are under ``TOLERANCE`` times the largest eigenvalue, or when the
basis is the whole space. After a restart it goes on up to the next one, until that leaves the
eigenvalues as they were: one of them may repeat more often than the block is wide. The driver holds the basis and its products, two matrices of at most d x d.

The trace comes from the deviations, sum of (n x - S)^2, which are exact: trace(V) = their sum / n^3.

Rows whose vector is null or holds null or non-finite entries go; zero vectors stay.
Vectors of another length than most have (ties: the longer) go as well. Null and repeated
vec_ids keep their rows, and all count in the fit. Components whose eigenvalue is under
``NOISE`` of the largest one are rounding noise and left out: equal vectors, a single one or an empty
table give no rows. A component's largest entry is positive. Extra columns are ignored.
Entries so large that deviations would leave a long fail the query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .vectors import all_finite, floored, matrix, parts, summed, usual_length

BLOCK = 16
TOLERANCE, NOISE = 1e-13, 1e-11


def lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric d x d operator."""
    rng = np.random.default_rng(seed)
    basis = products = np.zeros((d, 0))
    new, _ = _extended(basis, rng.normal(size=(d, min(block, d))), 0.0, rng)
    at_restart = None
    while True:
        image = apply(new)
        basis, products = np.column_stack((basis, new)), np.column_stack((products, image))
        inner = basis.T @ products
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        vectors = basis @ turn
        residual = np.linalg.norm(products @ turn - vectors * values, axis=0)
        slack = tolerance * max(abs(values[0]), np.finfo(float).tiny)
        new, restarted = _extended(basis, image[:, : d - basis.shape[1]], 1e-12 * np.abs(values).max(), rng)
        unchanged = at_restart is not None and len(at_restart) == k and np.abs(values - at_restart).max() <= slack
        settled = unchanged if restarted else at_restart is None
        if basis.shape[1] == d or (len(values) == k and residual.max() <= slack and settled):
            return values, vectors / np.linalg.norm(vectors, axis=0)
        at_restart = values if restarted else at_restart


def _extended(basis: np.ndarray, block: np.ndarray, least: float, rng: np.random.Generator) -> tuple[np.ndarray, bool]:
    """As many directions as block has that continue it, orthonormal to basis and each other, and whether some had to be random."""
    out, restarted = basis, False
    for v in block.T:
        floor = least
        while True:
            for _ in range(2):
                v = v - out @ (out.T @ v)
            size = np.linalg.norm(v)
            if size > floor:
                break
            v, floor, restarted = rng.normal(size=len(v)), 0.0, True
        v = v / size
        v = v - out @ (out.T @ v)
        out = np.column_stack((out, v / np.linalg.norm(v)))
    return out[:, basis.shape[1] :], restarted


@dataclass
class Fit:
    """What whitening needs: sizes that depend on the dimension alone."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: with S = n * m + r it is n * (x - m) - r."""
        m = np.array([s // self.n for s in self.sums], np.int64)
        r = np.array([s % self.n for s in self.sums], np.int64)
        return (x - m) * self.n - r

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n) @ self.vectors / np.sqrt(self.values)


def _totals(table: DataFrame, d: int) -> tuple[int, list[int], int]:
    """Rows, exact sum by dimension, and the largest distance of an entry from its dimension's mean, rounded up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, [0] * d, np.full(d, 1 << 62), np.full(d, -(1 << 62))
        for b in batches:
            x = matrix(b.column(0), d)
            if len(x):
                n += len(x)
                # Halves of 2^20 keep a batch's sums within a long.
                upper, lower = (x >> 20).sum(0).tolist(), (x & ((1 << 20) - 1)).sum(0).tolist()
                total = [t + (u << 20) + v for t, u, v in zip(total, upper, lower, strict=True)]
                low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array([n] * d, pa.int64()), pa.array(list(map(Decimal, total)), pa.decimal128(38, 0)), pa.array(low), pa.array(high)], ["pos", "n", "total", "low", "high"])

    got = table.select("x").mapInArrow(run, "pos int, n long, total decimal(38,0), low long, high long")
    rows = got.groupBy("pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("pos").collect()
    if not rows:
        return 0, [], 0
    n = rows[0]["n"]
    return n, [int(r["total"]) for r in rows], max(1 + max(r["high"] - int(r["total"]) // n, int(r["total"]) // n - r["low"]) for r in rows)


def fit(table: DataFrame, components: int = 32, block: int = BLOCK) -> Fit | None:
    """Fit of table(x), x arrays of whole numbers of one length; None without rows or variance."""
    first = table.select("x").first()
    if first is None:
        return None
    d = len(first["x"])
    n, sums, far = _totals(table, d)
    if d * (n * far) ** 2 >= 1 << 63:
        raise OverflowError("deviations of these vectors leave a long")
    start = Fit(n, sums, np.ones(1), np.zeros((d, 1)))

    def apply(q: np.ndarray) -> np.ndarray:
        """One pass over the rows: V q."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(q.shape)
            for b in batches:
                centred = start.deviations(matrix(b.column(0), d)) / n
                total += centred.T @ (centred @ q)
            yield parts(total)

        return summed(table.select("x").mapInArrow(run, "pos int, w array<double>"), q.shape[1]) / n

    values, vectors = lanczos(apply, d, min(components, d), block)
    real = values > NOISE * max(values[0], 0.0)
    if not real.any():
        return None
    values, vectors = values[real], vectors[:, real]
    at = np.abs(vectors).argmax(0)
    return Fit(n, sums, values, vectors * np.sign(vectors[at, np.arange(len(at))]))


def _checked(table: DataFrame, found: Fit) -> tuple[float, Fraction]:
    """Largest entry of the whitened rows' covariance minus the identity, and trace(V)."""
    d, k, n = len(found.sums), len(found.values), found.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, total, squares = np.zeros((k, k)), np.zeros(k), 0
        for b in batches:
            away = found.deviations(matrix(b.column(0), d))
            z = found.whitened(away)
            products += z.T @ z
            total += z.sum(0)
            squares += sum((away * away).sum(1).tolist())
        rows = np.vstack((np.column_stack((products, np.zeros(k))), [*total, 0.0]))
        yield pa.RecordBatch.from_arrays([*parts(rows).columns, pa.array([Decimal(squares)] + [Decimal(0)] * k, pa.decimal128(38, 0))], ["pos", "w", "squares"])

    got = table.select("x").mapInArrow(run, "pos int, w array<double>, squares decimal(38,0)")
    sums = got.groupBy("pos").agg(F.sum("squares").alias("squares"), *[F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(k)]).orderBy("pos").collect()
    rows = np.array([r[2 : 2 + k] for r in sums], float)
    mean = rows[k] / n
    error = np.abs(rows[:k] / n - np.outer(mean, mean) - np.eye(k)).max()
    return float(error), Fraction(int(sums[0]["squares"])) / n**3


def whiten(embeddings: DataFrame, components: int = 32, scale: int = 64, offset: int = 1_000_000, block: int = BLOCK) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of embeddings(vec_id, embedding)."""
    sc = Scratch(embeddings.sparkSession, "whitening")
    rows = embeddings.select("vec_id", "embedding").where(all_finite("embedding"))
    d = usual_length(rows, "embedding")
    shifted = F.transform(floored("embedding", scale), lambda e: e + offset)
    table = sc.save(rows.where(F.size("embedding") == d).select("vec_id", shifted.alias("x")), "rows")
    kind = rows.schema["vec_id"].dataType.simpleString()
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = fit(table, components, block) if d else None
    if found is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    error, trace = _checked(table, found)
    explained = found.values / float(trace)
    k = len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            away = found.deviations(matrix(b.column(1), d))
            m = len(away)
            each = np.repeat(np.arange(m), k)
            squares = (away * away).sum(1)
            cols = [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, found.n)), pa.array(squares[each]), pa.array(found.whitened(away).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return table.mapInArrow(run, schema)
