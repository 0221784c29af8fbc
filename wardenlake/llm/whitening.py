"""Whitening of vectors by spectrum slicing.

Sums and centred products of all vectors are added up by Spark; the driver gets numbers by dimension
only.  The inertia of an LDLᵀ factorisation of the covariance less a shift counts the eigenvalues
above the shift.  Bisection on these counts isolates each leading eigenvalue, Rayleigh quotient
iteration finds it with its vector, and the counts on both sides of the result certify its number.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenlake.llm.common import send

COMPONENTS = 32
#: Shift that makes the integers of ordinary vectors positive, and their scale.
OFFSET, SCALE = 1_000_000, 64
#: Integers beyond this are taken as this.
LARGEST = 1 << 61
LOW_BITS = 20
_ALPHA = (1 + np.sqrt(17)) / 8


def usable(vector: Column) -> Column:
    """Not null, not empty, without null and non-finite entries."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size(vector) > 0)


def positives(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are positive: the inertia of LDLᵀ with complete pivoting."""
    a, count = a.copy(), 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(a)
        np.fill_diagonal(off, 0)
        r, s = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[p] >= _ALPHA * off[r, s]:
            if not diagonal[p]:
                break  # nothing but zeros is left
            count += a[p, p] > 0
            rest = np.delete(np.arange(len(a)), p)
            column = a[rest, p]
            a = a[np.ix_(rest, rest)] - np.outer(column, column) / a[p, p]
        else:  # a block of two rows has an eigenvalue of each sign
            count += 1
            rest, pair = np.delete(np.arange(len(a)), [r, s]), [r, s]
            columns = a[np.ix_(rest, pair)]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(a[np.ix_(pair, pair)], columns.T)
    return int(count)


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues lie above the shift."""
    return positives(matrix - shift * np.eye(len(matrix)))


def isolate(matrix: np.ndarray, wanted: int, least: float, width: float) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues in it) from the largest down, of one eigenvalue or narrower than ``width``."""
    reach = float(np.abs(matrix).sum(axis=1).max())
    todo, found, seen = [(least, reach * (1 + 1e-12) + width, above(matrix, least), 0)], [], 0
    while todo and seen < wanted:
        low, high, n_low, n_high = todo.pop()
        if n_low == n_high:
            continue
        if n_low - n_high == 1 or high - low <= width:
            found.append((low, high, n_low - n_high))
            seen += n_low - n_high
            continue
        middle = (low + high) / 2
        n = above(matrix, middle)
        todo += [(low, middle, n_low, n), (middle, high, n, n_high)]  # the upper half is next
    return found


def _solve(matrix: np.ndarray, shift: float, vector: np.ndarray, nudge: float) -> np.ndarray:
    try:
        out = np.linalg.solve(matrix - shift * np.eye(len(matrix)), vector)
    except np.linalg.LinAlgError:
        out = np.linalg.solve(matrix - (shift + nudge) * np.eye(len(matrix)), vector)
    return out / np.sqrt(out @ out)


def _clear(vector: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in others:
            vector = vector - (vector @ other) * other
    return vector / np.sqrt(vector @ vector)


def leading(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest positive eigenvalues of a symmetric matrix, falling, and their unit vectors as columns.

    Eigenvalues that rounding can't tell from zero are left out.  A vector's largest entry is positive.
    """
    size = len(matrix)
    scale = float(np.abs(matrix).max(initial=0)) if size else 0.0
    if not scale:
        return np.zeros(0), np.zeros((size, 0))
    a, eps = matrix / scale, np.finfo(float).eps
    reach = float(np.abs(a).sum(axis=1).max())
    narrow = 64 * eps * reach
    least = size * eps * reach * 8
    rng = np.random.default_rng(17)
    values, vectors = [], []
    for low, high, times in isolate(a, min(wanted, size), least, narrow):
        for _ in range(times):
            a_low, a_high = low, high
            while True:
                shift = (a_low + a_high) / 2
                vector = _clear(rng.normal(size=size), vectors)
                for _ in range(2):
                    vector = _clear(_solve(a, shift, vector, narrow), vectors)
                value = vector @ a @ vector
                for _ in range(12):
                    error = a @ vector - value * vector
                    if np.sqrt(error @ error) <= 4 * eps * reach:
                        break
                    vector = _clear(_solve(a, value, vector, narrow), vectors)
                    value = vector @ a @ vector
                if low - narrow <= value <= high + narrow or a_high - a_low <= narrow:
                    break
                middle = (a_low + a_high) / 2  # a neighbour drew the iteration away: halve the interval by a count
                a_low, a_high = (middle, a_high) if above(a, middle) > above(a, a_high) else (a_low, middle)
            values.append(float(value))
            vectors.append(vector)
    values, vectors = values[:wanted], vectors[:wanted]
    slack = 64 * narrow
    for k, value in enumerate(values):
        if above(a, value - slack) < k + 1 or above(a, value + slack) > k:
            raise ArithmeticError(f"eigenvalue {k + 1} isn't number {k + 1} of the spectrum")
    order = np.argsort(-np.array(values), kind="stable")
    columns = np.stack([vectors[k] for k in order], axis=1) if values else np.zeros((size, 0))
    if values:
        columns = columns * np.sign(columns[np.abs(columns).argmax(axis=0), np.arange(columns.shape[1])])
    return np.array(values)[order] * scale, columns


def _blocks(column: pa.Array):
    """(length, row numbers, integers) of the vectors of each length in a batch."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(ends)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        wide = values[ends[own][:, None] + np.arange(size)].astype(np.float64)
        with np.errstate(over="ignore"):
            yield int(size), own, np.clip(np.floor(SCALE * wide), -LARGEST, LARGEST).astype(np.int64) + OFFSET


class Fit:
    """Mean, components and eigenvalues of the vectors of one length."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.base = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)  # the nearest integers to the means
        self.left = np.array([s - n * int(b) for s, b in zip(sums, self.base)], np.int64)
        self.rest = np.array([float(Fraction(int(x), n)) for x in self.left])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest

    def solve(self, covariance: np.ndarray, wanted: int) -> None:
        self.values, vectors = leading(covariance, wanted)
        self.explained = self.values / np.trace(covariance) if len(self.values) else self.values
        self.scaled = vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S) squared, exactly; None where a long can't hold it."""
        y = x - self.base
        rough = ((self.n * y.astype(np.float64) - self.left) ** 2).sum(axis=1)
        small = rough < 2.0**62
        with np.errstate(over="ignore"):
            exact = ((self.n * np.where(small[:, None], y, 0) - self.left) ** 2).sum(axis=1)
        out = [int(v) if ok else None for v, ok in zip(exact, small)]
        for k in np.flatnonzero(~small & (rough < 2.0**64)):
            value = sum((self.n * int(a) - int(b)) ** 2 for a, b in zip(y[k], self.left))
            out[k] = value if value < 1 << 63 else None
        return out


def _products(rows: DataFrame, wide, size_of) -> dict[int, np.ndarray]:
    """The sums over all rows of the products of each two columns of ``wide(size, x)``, by vector length."""

    def run(batches):
        sums = {}
        for batch in batches:
            for size, _, x in _blocks(batch.column(0)):
                w = wide(size, x)
                sums[size] = sums.get(size, 0) + w.T @ w
        for size, total in sums.items():
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), size), pa.int32()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["size", "i", "j", "p"])

    out = {}
    for r in rows.select("v").mapInArrow(run, "size int, i int, j int, p double").groupBy("size", "i", "j").agg(F.sum("p").alias("p")).collect():
        matrix = out.setdefault(r["size"], np.zeros((size_of(r["size"]),) * 2))
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["p"]
    return out


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty or hold null or non-finite entries are dropped.  An entry c counts as
    floor(64 c) + 1000000, bounded at 2**61.  All usable vectors are fitted, those of each length apart.
    ``deviation`` is null where a long can't hold it.  Components whose eigenvalue rounding can't tell
    from zero are left out, so vectors that are all equal give no rows; equal eigenvalues are numbered
    as they are found.  Null keys and repeated rows come out as they went in; an empty table gives no
    rows; other columns, whatever their names, are ignored.  The driver holds one matrix of dimensions
    squared for each length.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def add_up(batches):
        sums = {}
        for batch in batches:
            for size, own, x in _blocks(batch.column(0)):
                n, high, low = sums.get(size, (0, 0, 0))
                sums[size] = n + len(own), high + (x >> LOW_BITS).sum(axis=0), low + (x & ((1 << LOW_BITS) - 1)).sum(axis=0)
        for size, (n, high, low) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, size), pa.int32()), pa.array(np.arange(size), pa.int32()), pa.array(np.full(size, n), pa.int64()), pa.array(high), pa.array(low)], names=["size", "i", "n", "high", "low"])

    totals = rows.select("v").mapInArrow(add_up, "size int, i int, n long, high long, low long").groupBy("size", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    sums = {}
    for r in totals.collect():
        n, own = sums.setdefault(r["size"], (r["n"], [0] * r["size"]))
        own[r["i"]] = (int(r["high"]) << LOW_BITS) + int(r["low"])
    fits = {size: Fit(n, own) for size, (n, own) in sums.items()}

    received = send(spark, fits)
    for size, total in _products(rows, lambda size, x: received()[size].centred(x), lambda size: size).items():
        fits[size].solve(total / fits[size].n, components)
    solved = send(spark, fits)

    def with_one(size: int, x: np.ndarray) -> np.ndarray:
        white = solved()[size].centred(x) @ solved()[size].scaled
        return np.concatenate([white, np.ones((len(x), 1))], axis=1)

    errors = {}
    for size, total in _products(rows, with_one, lambda size: len(fits[size].values) + 1).items():
        mean = total[-1, :-1] / fits[size].n
        errors[size] = float(np.abs(total[:-1, :-1] / fits[size].n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0))

    def project(batches):
        for batch in batches:
            for size, own, x in _blocks(batch.column(1)):
                fit = solved()[size]
                k = len(fit.values)
                white = fit.centred(x) @ fit.scaled
                out = [
                    batch.column(0).take(pa.array(np.repeat(own, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))),
                    pa.array(np.full(len(own) * k, fit.n), pa.int64()), pa.array(fit.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(own)), k))),
                    pa.array(white.ravel()), pa.array(np.tile(fit.explained, len(own))), pa.array(np.full(len(own) * k, errors[size]))]
                yield pa.RecordBatch.from_arrays(out, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, "id long, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("id", key)
