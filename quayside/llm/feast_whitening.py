"""Whitening of embeddings by FEAST contour integration.

Vectors become integers; each distinct one is fitted once. Spark sums them (exactly), then their centred products, so
that only a matrix of the vectors' dimension reaches the driver. There its leading eigenvalues are found by intervals:
the inertia of shifted matrices (pivoted LDL', Bunch and Parlett 1971) counts eigenvalues, bisection gives intervals
of few of them, a contour around each interval is integrated by Gauss-Legendre quadrature of complex shifted solves
(Polizzi 2009), which projects a random block onto the eigenvectors inside, and Rayleigh-Ritz extracts them. A block is
refined until every residual is at rounding level and the pairs inside are as many as the inertia says; otherwise
it is widened. All rows are then projected, and the covariance of what comes out is measured.

Cases: vectors that are null, empty, or hold null, non-finite or too large entries (64 times the entry beyond 2**53)
are left out, and so are those whose length is not the most frequent one (of equally frequent lengths the largest); copies are
fitted once and all returned; repeated rows and null ids are returned like any other; components without variance (below
1e-13 of the trace) cannot be whitened and are left out, so one distinct vector gives no rows; a deviation beyond
a long is null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import in_workers
from quayside.storage import materialise

STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 16
# Quadrature nodes of the half circle, eigenvalues of one interval at most (if they can be told apart), refinements.
NODES, PER_INTERVAL, ROUNDS = 12, 8, 12
# Shares of an interval that ends keep from eigenvalues, as far as there is room; width of what is not divided any more.
GAPS, CLUSTER = (1e-2, 1e-4, 1e-7), 1e-6
NO_VARIANCE = 1e-13
_EXACT, _LONG = float(1 << 53), (1 << 63) - 1
# Values of a batch that are projected at once.
_PART = 1 << 21
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# -- the matrix on the driver

def inertia(matrix: np.ndarray) -> tuple[int, int]:
    """Negative and positive eigenvalues of a symmetric matrix, from the pivots of ``P M P' = L D L'``."""
    a = np.array(matrix, float)
    alpha = (1 + 17**0.5) / 8
    negative = positive = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        at = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        i, j = divmod(int(off.argmax()), len(a))
        if diagonal[at] == 0 and off[i, j] == 0:
            break  # what is left is zero
        chosen = [at] if diagonal[at] >= alpha * off[i, j] else [i, j]
        rest = np.setdiff1d(np.arange(len(a)), chosen)
        block, side = a[np.ix_(chosen, chosen)], a[np.ix_(rest, chosen)]
        if len(chosen) == 1:
            negative, positive = negative + int(block[0, 0] < 0), positive + int(block[0, 0] > 0)
        else:
            negative, positive = negative + 1, positive + 1  # a pivot of two has one of either sign
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return negative, positive


def above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``."""
    return inertia(matrix - shift * np.eye(len(matrix)))[1]


def gap_in(matrix: np.ndarray, low: float, high: float) -> tuple[float, int] | None:
    """A point between ``low`` and ``high`` with no eigenvalue near it, and the eigenvalues above it."""
    for apart in GAPS:
        for share in (0.5, 0.35, 0.65, 0.2, 0.8):
            # Covariances have eigenvalues of many sizes: divide the exponent while the ends are far apart.
            at = low ** (1 - share) * high**share if low > 0 and high > 4 * low else low + share * (high - low)
            reach = apart * min(at, high - low)
            upper = above(matrix, at + reach)
            if upper == above(matrix, at - reach):
                return at, upper
    return None


def intervals(matrix: np.ndarray, wanted: int, floor: float) -> list[tuple[float, float, int]]:
    """``low, high, count`` from the largest eigenvalue down, until ``wanted`` are covered or ``floor`` is reached.

    Ends lie in gaps, so that eigenvalues that are equal but for rounding stay together.
    """
    top = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-6)
    found, stack, covered = [], [(floor, top, above(matrix, floor))], 0
    while stack and covered < wanted:
        low, high, count = stack.pop()
        if not count:
            continue
        fits = count <= PER_INTERVAL and high <= 4 * low or high - low <= CLUSTER * high
        if not fits and (cut := gap_in(matrix, low, high)):
            upper = cut[1] - covered
            stack += [(low, cut[0], count - upper), (cut[0], high, upper)]
            continue
        found.append((low, high, count))
        covered += count
    return found


def contour(matrix: np.ndarray, low: float, high: float, block: np.ndarray) -> np.ndarray:
    """The block filtered by the spectral projector of the interval: quadrature over a circle through its ends.

    The matrix is real, so the nodes of the lower half circle are the conjugates of those above.
    """
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    out = np.zeros_like(block)
    for x, w in zip(points, weights):
        turn = np.exp(0.5j * np.pi * (x + 1))
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(matrix)) - matrix, block.astype(complex))
        out += (0.5 * w * radius * turn * solved).real
    return out


def feast(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs between ``low`` and ``high``, largest first."""
    size, scale = len(matrix), float(np.abs(matrix).sum(axis=1).max())
    # The circle passes a little outside; what it lets in besides is told apart by the values.
    pad = 0.02 * (high - low)
    width = min(size, max(2 * count, count + 6))
    while True:
        block = np.random.default_rng(width).standard_normal((size, width))
        best = np.inf
        for _ in range(ROUNDS):
            basis, _ = np.linalg.qr(contour(matrix, low - pad, high + pad, block))
            values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ turn
            inside = (values > low) & (values <= high)
            residual = np.linalg.norm(matrix @ block - block * values, axis=0)[inside].max(initial=0.0)
            if inside.sum() == count and residual <= 1e-13 * scale and residual >= 0.5 * best:
                order = np.argsort(values[inside])[::-1]
                return values[inside][order], block[:, inside][:, order]
            best = min(best, residual) if inside.sum() == count else np.inf
        if inside.sum() == count and residual <= 1e-11 * scale:
            order = np.argsort(values[inside])[::-1]
            return values[inside][order], block[:, inside][:, order]
        if width == size:
            raise ArithmeticError(f"the inertia tells {count} eigenvalues in ({low}, {high}], the contour found {int(inside.sum())}")
        width = min(size, 2 * width)


def leading_pairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``wanted`` largest eigenvalues with variance, and their unit vectors as columns."""
    trace = float(np.trace(matrix))
    if not trace > 0:
        return np.empty(0), np.empty((len(matrix), 0))
    parts = [feast(matrix, *x) for x in intervals(matrix, wanted, NO_VARIANCE * trace)]
    if not parts:
        return np.empty(0), np.empty((len(matrix), 0))
    # Close eigenvalues of neighbouring intervals: one more Rayleigh-Ritz over all makes the vectors orthogonal.
    basis, _ = np.linalg.qr(np.hstack([x for _, x in parts]))
    values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    values, vectors = values[::-1][:wanted], (basis @ turn)[:, ::-1][:, :wanted]
    # One sign for all rows: the entry of largest size is positive.
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values, vectors * np.where(largest < 0, -1.0, 1.0) / np.linalg.norm(vectors, axis=0)


# -- the rows

@dataclass
class Fitted:
    """Counts and sums of the fit list, and its components. ``base`` and ``rest``: ``S = n * base + rest``."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    vectors: np.ndarray | None = None
    roots: np.ndarray | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n`` with the whole part taken off exactly."""
        return (x - self.base) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of ``(n * x - S) ** 2``, exactly."""
        shifted = x - self.base
        if float(np.abs(shifted).max(initial=0)) * self.n + self.n < (_LONG / (x.shape[1] + 1)) ** 0.5:
            moved = shifted * self.n - self.rest
            return (moved * moved).sum(axis=1).tolist()
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest.tolist())) for row in shifted.tolist()]
        return [v if v <= _LONG else None for v in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / self.roots


def matrices(batch: pa.RecordBatch, name: str = "x") -> Iterator[np.ndarray]:
    """The vectors of a batch as rows, a part at a time."""
    if batch.num_rows:
        column = batch.column(name)
        whole = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        step = max(1, _PART // whole.shape[1])
        for i in range(0, len(whole), step):
            yield whole[i : i + step]


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, x`` of the rows that can be used, of the most frequent length."""
    entries = F.transform(rows[vector_col], lambda c: c.cast("double"))
    usable = rows.select(rows[id_col].cast("long").alias("vec_id"), entries.alias("e")).where(
        (F.size("e") > 0) & F.forall("e", lambda c: F.coalesce(F.abs(c * STEPS) < F.lit(_EXACT), F.lit(False))))
    lengths = usable.groupBy(F.size("e").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    return usable.where(F.size("e") == F.lit(lengths["length"] if lengths else 0)).select(
        "vec_id", F.transform("e", lambda c: F.floor(c * STEPS).cast("long") + F.lit(OFFSET)).alias("x"))


def summed(fit: DataFrame) -> Fitted | None:
    """``n`` and the exact sums. Sums of a task are taken around the task's first vector, so that they fit a long."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for x in matrices(batch):
                own = [int(v) for v in x[0]]
                step = max(1, (1 << 62) // max(1, int(np.abs(x - x[0]).max(initial=1))))
                for i in range(0, len(x), step):
                    part = x[i : i + step]
                    sums = [s + len(part) * o for s, o in zip((part - x[0]).sum(axis=0).tolist(), own)]
                    total = sums if total is None else [a + b for a, b in zip(total, sums)]
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(total)), pa.array(range(len(total)), pa.int32()),
                                              pa.array([str(v) for v in total])], ["n", "axis", "total"])

    parts = in_workers(fit.select("x"), partial, "n long, axis int, total string").groupBy("axis").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("axis").collect()
    if not parts:
        return None
    n, sums = parts[0]["n"], [int(r["total"]) for r in parts]
    return Fitted(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))


def covariance(fit: DataFrame, values: str, make, size: int, n: int) -> np.ndarray:
    """Covariance (divisor ``n``) of ``make(x)``, which is centred but for rounding; that rest is taken off as well.

    A task adds its products; Spark adds the tasks' cells, so the driver gets one matrix.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = None, None
        for batch in batches:
            for x in matrices(batch, values):
                y = make(x)
                products = y.T @ y if products is None else products + y.T @ y
                sums = y.sum(axis=0) if sums is None else sums + y.sum(axis=0)
        if products is not None:
            cells = np.concatenate([products.ravel(), sums])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "value"])

    rows = in_workers(fit.select(values), partial, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    cells = np.zeros(size * size + size)
    cells[rows["cell"].to_numpy()] = rows["value"].to_numpy()
    mean = cells[size * size :] / n
    found = cells[: size * size].reshape(size, size) / n - np.outer(mean, mean)
    return (found + found.T) / 2


def whitened_embeddings(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows, id_col, vector_col)
    fit = materialise(vectors.select("x").distinct(), "whitening-fit")
    fitted = summed(fit)
    if fitted is None:
        return spark.createDataFrame([], SCHEMA)
    matrix = covariance(fit, "x", fitted.centred, len(fitted.base), fitted.n)
    values, fitted.vectors = leading_pairs(matrix, components)
    if not len(values):
        return spark.createDataFrame([], SCHEMA)
    fitted.roots = np.sqrt(values)
    error = float(np.abs(covariance(fit, "x", fitted.whitened, len(values), fitted.n) - np.eye(len(values))).max())
    explained = values / float(np.trace(matrix))
    shared = spark.sparkContext.broadcast(fitted)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, k = shared.value, len(values)
        for batch in batches:
            at = 0
            for x in matrices(batch):
                ids = batch.column("vec_id").slice(at, len(x))
                at += len(x)
                number = np.repeat(np.arange(len(x)), k)
                component = np.tile(np.arange(k, dtype=np.int32), len(x))
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(number)), pa.array(component + 1), pa.array(np.full(len(number), known.n)),
                    pa.array(known.deviations(x), pa.int64()).take(pa.array(number)), pa.array(known.whitened(x).ravel()),
                    pa.array(explained[component]), pa.array(np.full(len(number), error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return in_workers(vectors, project, SCHEMA)
