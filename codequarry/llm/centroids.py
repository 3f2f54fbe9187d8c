"""k-means over integers, exact, with a lower bound from rotated coordinates.

Vectors are rotated once onto the principal axes of all vectors.  Each keeps
its leading coordinates and the norm of the rest; the squared distance of the
leading coordinates plus the squared difference of those norms can not exceed
the squared distance to a centroid.  A vector is compared in full, in
integers, only with the centroids whose bound does not exceed the distance to
the most promising one.  A round is one pass without a shuffle of vectors:
tasks return the sums of their clusters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.tables import stored
from codequarry.llm.vectors import exact_sums, matrices, packed, pieces, stepped, unpacked

SCALE = 256
LIMIT = 2.0**27
CLUSTERS = 40
ROUNDS = 5
LEADING = 16
PAIRS_AT_ONCE = 1 << 14
_SAFE = 1e-9


def integers(vectors: DataFrame, dims: int, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: ``floor(scale * c)`` of every entry of the vectors with exactly ``dims`` entries, packed in 32 bits.

    Null and non-finite entries leave a vector out, and so do integers of
    ``LIMIT`` or more in magnitude, whose squared distances need not fit in 64
    bits.
    """
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, dims):
                for rows, matrix in matrices(batch.column(1)):
                    if matrix.shape[1] == dims:
                        x, small = stepped(matrix, scale, LIMIT)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[small])), packed(x.astype(np.int32))], ["vec_id", "x"])

    return vectors.select("vec_id", column).mapInArrow(run, f"vec_id {id_type}, x binary")


def first_centroids(held: DataFrame, dims: int, clusters: int, salt: str) -> np.ndarray:
    """The vectors with the smallest sha256 of ``salt:vec_id``, in that order; equal hashes are ordered by their bytes.

    A null id counts as an empty text.
    """
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    front = held.select(key.alias("key"), "x").orderBy("key", F.hex("x")).limit(clusters).collect()
    return np.array([np.frombuffer(r.x, np.int32) for r in front], np.int64).reshape(-1, dims)


def principal_axes(held: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the principal axes (as columns, by falling variance) of all vectors.

    Any rotation gives right bounds; this one makes them tight.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for whole in batches:
            for batch in pieces(whole, dims):
                y = np.hstack((unpacked(batch.column(0), dims, np.int32).astype(float), np.ones((batch.num_rows, 1))))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    cells = (held.select("x").mapInArrow(run, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
             .groupBy("i", "j").agg(F.sum("v").alias("v")))
    total = np.zeros((dims + 1, dims + 1))
    for r in cells.collect():  # dims squared numbers
        total[r.i, r.j] = r.v
    n = max(1.0, total[dims, dims])
    mean = total[dims, :dims] / n
    _, axes = np.linalg.eigh(total[:dims, :dims] / n - np.outer(mean, mean))
    return mean, axes[:, ::-1].copy()


def rotated(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading coordinates of integer vectors and the norms of their other coordinates."""
    y = (x - mean) @ axes
    return y[:, :leading], np.linalg.norm(y[:, leading:], axis=1)


def with_coordinates(held: DataFrame, dims: int, mean: np.ndarray, axes: np.ndarray, leading: int) -> DataFrame:
    """``vec_id, x, lead, rest`` of :func:`integers`: what the bound needs, computed once."""
    id_type = held.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, dims):
                lead, rest = rotated(unpacked(batch.column(1), dims, np.int32), mean, axes, leading)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed(lead), pa.array(rest)], ["vec_id", "x", "lead", "rest"])

    return held.select("vec_id", "x").mapInArrow(run, f"vec_id {id_type}, x binary, lead binary, rest double")


def squared(x: np.ndarray, centroids: np.ndarray, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Exact squared distances of the pairs ``x[rows[i]]``, ``centroids[of[i]]``, a bounded number at once."""
    out = np.empty(len(rows), np.int64)
    for begin in range(0, len(rows), PAIRS_AT_ONCE):
        part = slice(begin, begin + PAIRS_AT_ONCE)
        apart = x[rows[part]] - centroids[of[part]]
        out[part] = np.einsum("ij,ij->i", apart, apart)
    return out


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray,
            slack: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of every row (ties: the smaller number), its squared distance and how many pairs were verified.

    Bounds are lowered by their own rounding and by ``slack``, that of the rotation.
    """
    rows = np.arange(len(x))
    of_row, of_centroid = (lead**2).sum(axis=1) + rest**2, (c_lead**2).sum(axis=1) + c_rest**2
    # |a - b|^2 + (r - s)^2 = |a|^2 + r^2 + |b|^2 + s^2 - 2 (a.b + r s)
    both = of_row[:, None] + of_centroid
    bound = both - 2 * (lead @ c_lead.T + np.outer(rest, c_rest)) - _SAFE * (both + 1) - slack
    guess = bound.argmin(axis=1)
    reach = squared(x, centroids, rows, guess)
    survives = bound <= reach[:, None]
    survives[rows, guess] = False
    row, of = np.nonzero(survives)
    far = squared(x, centroids, row, of)
    row, of, far = np.concatenate((rows, row)), np.concatenate((guess, of)), np.concatenate((reach, far))
    order = np.lexsort((of, far, row))
    first = order[np.searchsorted(row[order], rows)]
    return of[first], far[first], len(far)


def _assigner(centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int):
    dims = centroids.shape[1]
    c_lead, c_rest = rotated(centroids, mean, axes, leading)
    slack = float(mean @ mean) * _SAFE**2 * 10

    def assign(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        x = unpacked(batch.column("x"), dims, np.int32).astype(np.int64)
        lead = unpacked(batch.column("lead"), min(leading, dims), np.float64)
        return x, *nearest(x, lead, batch.column("rest").to_numpy(), centroids, c_lead, c_rest, slack)

    return assign


def moved(table: DataFrame, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int) -> np.ndarray:
    """The centroids after one round; an empty cluster keeps its own."""
    k, dims = centroids.shape
    assign = _assigner(centroids, mean, axes, leading)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros((k, dims), np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for whole in batches:
            for batch in pieces(whole, dims):
                x, cluster, _, _ = assign(batch)
                for c in np.unique(cluster):
                    more_high, more_low = exact_sums(x[cluster == c])
                    high[c] += more_high
                    low[c] += more_low
                n += np.bincount(cluster, minlength=k)
        found = np.flatnonzero(n)
        columns = (np.repeat(found, dims), np.tile(np.arange(dims), len(found)), high[found].ravel(), low[found].ravel(), np.repeat(n[found], dims))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cluster", "i", "high", "low", "n"])

    sums = table.select("x", "lead", "rest").mapInArrow(run, "cluster long, i long, high long, low long, n long").groupBy("cluster", "i").agg(
        F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():  # clusters times dims numbers
        out[r.cluster, r.i] = (int(r.high) * 2**32 + int(r.low)) // r.n
    return out


def assigned(table: DataFrame, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int) -> DataFrame:
    """``vec_id, cluster, distance, n_verified``: the nearest centroid of every vector."""
    id_type = table.schema["vec_id"].dataType.simpleString()
    dims = centroids.shape[1]
    assign = _assigner(centroids, mean, axes, leading)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, dims):
                _, cluster, distance, verified = assign(batch)
                each = np.full(len(cluster), verified / max(1, len(cluster)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(each)],
                                                 ["vec_id", "cluster", "distance", "n_verified"])

    return table.select("vec_id", "x", "lead", "rest").mapInArrow(run, f"vec_id {id_type}, cluster int, distance long, n_verified double")


def clustered(vectors: DataFrame, dims: int, clusters: int = CLUSTERS, rounds: int = ROUNDS, leading: int = LEADING, salt: str = "2") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance, n_verified`` for every usable row of ``vectors``, and the final centroids.

    ``n_verified`` is the mean number of centroids that a vector of its piece
    was compared with in full.  Centroids start as the vectors with the
    smallest hashes; ``rounds`` rounds of assignment and floored means follow,
    then a last assignment.  Fewer vectors than ``clusters`` give fewer
    centroids; no vectors give no rows.  Repeated rows count each time and
    stay; a null ``vec_id`` stays.  Rows left out: see :func:`integers`.
    Extra columns are ignored.
    """
    held = stored(integers(vectors, dims), "integers")
    centroids = first_centroids(held, dims, clusters, salt)
    mean, axes = principal_axes(held, dims)
    table = stored(with_coordinates(held, dims, mean, axes, leading), "rotated")
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(table, centroids, mean, axes, leading)
    return assigned(table, centroids, mean, axes, leading), centroids


def fingerprint(centroid: np.ndarray) -> str:
    """sha256 of a centroid's components as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def digest(result: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``result`` with the inertia of each cluster and of all, and the fingerprint of each centroid.

    An inertia beyond 64 bits is null.
    """
    spark = result.sparkSession
    held = stored(result, "assigned")
    # one row a cluster
    inertia = {r.cluster: int(r.s) for r in held.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def fits(value: int) -> int | None:
        return value if value < 2**63 else None

    whole = fits(sum(inertia.values()))
    rows = [(c, fits(s), whole, fingerprint(centroids[c])) for c, s in inertia.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return held.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
