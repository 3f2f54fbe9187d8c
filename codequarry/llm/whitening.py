"""Whitening of embeddings, with the components found by FEAST contour integration.

Vectors are turned into integers.  Spark finds the distinct ones, their exact
sums and their covariance, a matrix of ``dims`` squared whatever the number of
vectors.  Inertia counts (the signs of the pivots of a symmetric
factorisation) cut the top of its spectrum into intervals; one task for each
interval integrates the resolvent around it by quadrature, which projects a
few random vectors onto the interval's eigenvectors, and Rayleigh-Ritz steps
extract these.  The counts say whether any is missing.  Every vector is then
projected, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.tables import stored
from codequarry.llm.vectors import exact_sums, matrices, packed, pieces, stepped, unpacked

SCALE = 64
OFFSET = 1_000_000
LIMIT = 2.0**61
COMPONENTS = 16
MOST_IN_SLICE = 8
NODES = 16
MAX_ROUNDS = 80
ROUNDING = 1e-13
RANK_FLOOR = 1e-11
_PIVOT = (1 + 17**0.5) / 8


@dataclass(frozen=True)
class Whitening:
    """A fit over ``n`` distinct vectors of one length.

    ``vectors[k]`` is the unit eigenvector to ``values[k]``; the values fall.
    ``identity_error`` is measured over the fit list.
    """

    dims: int
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def offsets(self) -> tuple[np.ndarray, np.ndarray]:
        """Per dimension the whole part of the mean and ``sum - n * whole``, which is below ``n``."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([s - self.n * w for s, w in zip(self.sums, whole, strict=True)], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.offsets
        return (x - whole) - rest / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int] | np.ndarray:
        """``sum((n * x - sums) ** 2)`` for every row, exactly."""
        whole, rest = self.offsets
        apart = x - whole
        widest = (int(np.abs(apart).max(initial=0)) + 1) * self.n
        if widest * widest * self.dims < 2**63:
            return ((apart * self.n - rest) ** 2).sum(axis=1)
        return ((apart.astype(object) * self.n - rest.astype(object)) ** 2).sum(axis=1).tolist()


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``: the positive pivots of the shifted matrix.

    Pivots are single entries or blocks of two, whichever is larger (Bunch and
    Parlett, 1971); a block of two has one positive and one negative eigenvalue.
    """
    a = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        apart = np.abs(a)
        np.fill_diagonal(apart, 0)
        r, (p, q) = int(diagonal.argmax()), np.unravel_index(apart.argmax(), a.shape)
        if diagonal[r] == 0 and apart[p, q] == 0:
            break
        chosen = [r] if diagonal[r] >= _PIVOT * apart[p, q] else [p, q]
        above += 1 if len(chosen) == 2 else int(a[r, r] > 0)
        kept = np.delete(np.arange(len(a)), chosen)
        side = a[np.ix_(kept, chosen)]
        a = a[np.ix_(kept, kept)] - side @ np.linalg.solve(a[np.ix_(chosen, chosen)], side.T)
        a = (a + a.T) / 2
    return above


def slices(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals ``(low, high, eigenvalues within)`` over the ``wanted`` largest eigenvalues above the rank's floor.

    Intervals are halved until each holds ``MOST_IN_SLICE`` eigenvalues at
    most.  Eigenvalues that are equal up to rounding stay together.
    """
    top = float(np.abs(matrix).sum(axis=1).max(initial=0)) * (1 + 1e-9)
    low, high = RANK_FLOOR * top, top
    if top == 0 or not (n_low := eigenvalues_above(matrix, low)):
        return []
    n_high, tight = 0, top * 1e-10
    wanted = min(wanted, n_low)
    while n_low > wanted and high - low > tight:
        middle = (low + high) / 2
        count = eigenvalues_above(matrix, middle)
        if count >= wanted:
            low, n_low = middle, count
        else:
            high, n_high = middle, count
    open_, done = [(low, top, n_low, 0)], []
    while open_:
        low, high, n_low, n_high = open_.pop()
        if n_low == n_high:
            continue
        middle = (low + high) / 2
        within = eigenvalues_above(matrix, middle)
        if high - low > tight and (n_low - n_high > MOST_IN_SLICE or within == n_high):
            open_ += [(low, middle, n_low, within), (middle, high, within, n_high)]
        else:
            done.append((low, high, n_low - n_high))
    return sorted(done)


def contour_vectors(matrix: np.ndarray, low: float, high: float, count: int) -> np.ndarray:
    """The ``count`` unit eigenvectors whose eigenvalues lie in the interval, as rows.

    Quadrature over the upper half of a circle around the interval stands for
    the whole contour, since the matrix is real.  Rounds of projection and
    Rayleigh-Ritz go on until the residuals are down to rounding.
    """
    dims = len(matrix)
    width = min(dims, 2 * count + 4)
    centre, radius = (low + high) / 2, (high - low) / 2
    at, weight = np.polynomial.legendre.leggauss(NODES)
    turn = radius * np.exp(0.5j * np.pi * (1 + at))
    scale = np.abs(matrix).sum(axis=1).max()
    guess = np.random.default_rng(dims * 64 + count).standard_normal((dims, width))
    for _ in range(MAX_ROUNDS):
        solved = sum(w / 2 * np.real(z * np.linalg.solve((centre + z) * np.eye(dims) - matrix, guess)) for z, w in zip(turn, weight, strict=True))
        basis, _ = np.linalg.qr(solved)
        values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
        guess = basis @ turned
        nearest = np.argsort(np.abs(values - centre), kind="stable")[:count]
        residual = np.linalg.norm(matrix @ guess[:, nearest] - guess[:, nearest] * values[nearest], axis=0)
        if residual.max() <= ROUNDING * scale * dims**0.5:
            break
    return guess[:, nearest].T


def components(spark: SparkSession, covariance: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues (falling) and their unit eigenvectors (as rows, largest entry positive).

    Fewer where the rank is lower.  Raises if the inertia counts say that one
    was missed.
    """
    dims = len(covariance)
    cut = slices(covariance, wanted)
    if not cut:
        return np.empty(0), np.empty((0, dims))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield pd.DataFrame({"vector": list(contour_vectors(covariance, row.low, row.high, row.count_in))})

    # one task a slice; what returns is one vector of `dims` entries for each wanted component and its equals
    dealt = spark.createDataFrame(cut, "low double, high double, count_in int").repartition(len(cut))
    found = np.array([row.vector for row in dealt.mapInPandas(run, "vector array<double>").collect()])
    basis, _ = np.linalg.qr(found.T)
    values, turned = np.linalg.eigh(basis.T @ covariance @ basis)
    vectors = (basis @ turned).T
    slack = ROUNDING * np.abs(covariance).sum(axis=1).max() * dims
    residual = np.linalg.norm(vectors @ covariance - values[:, None] * vectors, axis=1)
    counts = [(low, sum(n for other, _, n in cut if other >= low)) for low, _, _ in cut]
    if residual.max() > slack or any(not (values > low + slack).sum() <= n <= (values > low - slack).sum() for low, n in counts):
        raise ArithmeticError("inertia counts and extracted components differ")
    order = np.argsort(-values, kind="stable")[:wanted]
    values, vectors = values[order], vectors[order]
    largest = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], 1)
    return values, vectors * np.sign(largest)


def integers(vectors: DataFrame, column: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``vec_id, dims, x``: ``floor(scale * c) + offset`` of every entry as 64-bit integers, packed.

    Vectors that are null or empty, hold null or non-finite entries, or whose
    integers do not fit (``LIMIT``) take no part.
    """
    id_type = vectors.schema["vec_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 256):
                for rows, matrix in matrices(batch.column(1)):
                    x, small = stepped(matrix, scale, LIMIT)
                    ids = batch.column(0).take(pa.array(rows[small]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(x), matrix.shape[1], np.int32)), packed(x + offset)], ["vec_id", "dims", "x"])

    return vectors.select("vec_id", column).mapInArrow(run, f"vec_id {id_type.simpleString()}, dims int, x binary")


def _summed(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, dims):
                high, low = exact_sums(unpacked(batch.column(0), dims))
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (np.arange(dims), high, low, np.full(dims, batch.num_rows))], ["i", "high", "low", "n"])

    total = fit.select("x").mapInArrow(run, "i long, high long, low long, n long").groupBy("i").agg(
        F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"), F.sum("n").alias("n"))
    found = {r.i: r for r in total.collect()}
    return (found[0].n, [int(found[i].high) * 2**32 + int(found[i].low) for i in range(dims)]) if found else (0, [])


def _products(fit: DataFrame, dims: int, turned: Whitening, project: bool) -> np.ndarray:
    """The mean of ``y y'`` over the fit list, ``y`` being its centred vectors or their projections."""
    size = len(turned.values) if project else dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for whole in batches:
            for batch in pieces(whole, dims):
                x = unpacked(batch.column(0), dims)
                y = turned.project(x) if project else turned.centred(x)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    rows = fit.select("x").mapInArrow(run, "i long, row array<double>")
    cells = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    for r in cells.collect():  # dims squared numbers
        out[r.i, r.j] = r.v
    return out / turned.n


def fit(fit_list: DataFrame, dims: int, wanted: int = COMPONENTS) -> Whitening:
    """The whitening of distinct packed vectors ``x`` of ``dims`` entries."""
    spark = fit_list.sparkSession
    n, sums = _summed(fit_list, dims)
    if n == 0:
        return Whitening(dims, 0, (), np.empty(0), np.empty((0, dims)), 0.0, 0.0)
    blank = Whitening(dims, n, tuple(sums), np.empty(0), np.empty((0, dims)), 0.0, 0.0)
    covariance = _products(fit_list, dims, blank, False)
    covariance = (covariance + covariance.T) / 2
    values, vectors = components(spark, covariance, wanted)
    held = Whitening(dims, n, tuple(sums), values, vectors, float(np.trace(covariance)), 0.0)
    if len(values) == 0:
        return held
    error = np.abs(_products(fit_list, dims, held, True) - np.eye(len(values))).max()
    return Whitening(dims, n, held.sums, values, vectors, held.trace, float(error))


def projected(held: DataFrame, model: Whitening) -> DataFrame:
    """One row for each vector of :func:`integers` of the model's length and each component.

    ``deviation`` is exact, a decimal of 38 digits, and null beyond these.
    """
    dims, k = model.dims, len(model.values)
    explained = model.values / model.trace if k else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, dims * 4):
                if k == 0 or batch.num_rows == 0:
                    continue
                x = unpacked(batch.column(1), dims)
                deviation = [d if d < 10**38 else None for d in map(int, model.deviations(x))]
                rows = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(deviation, pa.decimal128(38, 0)).take(rows), pa.array(model.project(x).ravel()), pa.array(np.tile(explained, len(x)))],
                    ["vec_id", "component", "deviation", "whitened", "explained"])

    id_type = held.schema["vec_id"].dataType.simpleString()
    out = held.filter(F.col("dims") == dims).select("vec_id", "x").mapInArrow(
        run, f"vec_id {id_type}, component int, deviation decimal(38,0), whitened double, explained double")
    return out.withColumn("n", F.lit(model.n).cast("long"))


def whitened(vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable row of ``vectors``.

    Vectors of another length are a space of their own with its own fit;
    ``identity_error`` is the largest over all.  Components number as many as
    the covariance has eigenvalues above rounding, ``wanted`` at most; a space
    of one distinct vector has none and gives no rows.  Repeated rows count
    once in the fit and all appear in the result; a null ``vec_id`` stays.
    Null and empty vectors, null and non-finite entries, and magnitudes that
    do not fit leave the row out.  Extra columns are ignored.
    """
    held = stored(integers(vectors), "integers")
    distinct = stored(held.select("dims", "x").distinct(), "fit_list")
    lengths = sorted(r.dims for r in distinct.select("dims").distinct().collect())
    models = [fit(distinct.filter(F.col("dims") == dims), dims, wanted) for dims in lengths]
    if not models:
        models = [Whitening(1, 0, (), np.empty(0), np.empty((0, 1)), 0.0, 0.0)]
    out = projected(held, models[0])
    for model in models[1:]:
        out = out.union(projected(held, model))
    return (out.withColumn("identity_error", F.lit(max(m.identity_error for m in models)))
            .select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"))
