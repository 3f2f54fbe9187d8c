"""Exact top-k inner products by the threshold algorithm.

Vectors are dealt into shards.  Each shard sorts every dimension once; a
query walks the lists of its dimensions in step, scores each vector it meets
in full, and stops as soon as no vector further down can reach its k-th
result.  Queries travel in blocks, so every (shard, block) pair is one
bounded piece of work, and only k rows per query leave a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 4096
QUERY_BLOCK = 1024
FIRST_STEP = 16
# Integers below this give scores that fit into 64 bits for up to 2,048 dimensions.
LIMIT = 1 << 26
# A query block meets the shards in up to so many tasks.
SALTS = 64


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, dims, v``: components as ``floor(scale * x)`` of the usable vectors.

    A vector with an integer of ``LIMIT`` or more in magnitude is not usable:
    its scores need not fit into 64 bits.
    """
    fits = F.forall("embedding", lambda x: F.abs(x.cast("double") * scale) < LIMIT)
    kept = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull() & fits)
    return kept.select(F.col("vec_id").cast("long"), F.size("embedding").alias("dims"),
                       F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def threshold_top(x: np.ndarray, ids: np.ndarray, order: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (ids, scores) of a shard; ``order[d]`` sorts dimension ``d`` upwards."""
    n = len(ids)
    up, down = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
    seen = ids == own
    best_id, best = np.empty(0, np.int64), np.empty(0, x.dtype)
    depth, step = 0, FIRST_STEP
    while depth < n:
        to = min(n, depth + step)
        if len(up) + len(down):
            met = np.concatenate((order[up, depth:to].ravel(), order[down, n - to:n - depth].ravel()))
        else:
            met, to = np.arange(n), n
        fresh = np.zeros(n, bool)
        fresh[met] = True
        fresh &= ~seen
        new = np.flatnonzero(fresh)
        seen |= fresh
        best_id, best = np.append(best_id, ids[new]), np.append(best, x[new] @ query)
        if len(best) > k:
            least = np.partition(best, len(best) - k)[len(best) - k]
            near = best >= least
            best_id, best = best_id[near], best[near]
            front = np.lexsort((best_id, -best))[:k]
            best_id, best = best_id[front], best[front]
        if len(best) == k and to < n:
            bound = x[order[up, to - 1], up] @ query[up] + x[order[down, n - to], down] @ query[down]
            if best.min() > bound:
                break
        depth, step = to, step * 2
    front = np.lexsort((best_id, -best))
    return best_id[front], best[front]


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group with its ids and its matrix; groups are bounded by how they were dealt."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        head = {key: [group[key].iat[0]] for key in keys}
        matrix = np.array(group["v"].tolist(), np.int64)
        return pd.DataFrame(head | {"ids": [group["vec_id"].to_numpy(np.int64).tobytes()], "matrix": [matrix.tobytes()]})

    return rows.groupBy(*keys).applyInPandas(run, f"{', '.join(k + ' int' for k in keys)}, ids binary, matrix binary")


def _dealt(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows with a number below the count of shards that holds about ``size`` rows each."""
    shards = max(1, -(-rows.count() // size))
    return rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")), shards


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every query vector against every other vector of its dimension.

    Takes tables of :func:`quantised`.  Ties go to the smaller id; fewer than
    ``k`` candidates are all returned; a candidate that carries the query's
    own id is the query itself and never returned; repeated rows of one vector
    are one candidate and one query.  No vectors or no queries give no rows.
    """
    held, n_shards = _dealt(vectors.distinct(), shard, "shard")
    asked, blocks = _dealt(queries.distinct(), block, "block")
    salts = min(SALTS, n_shards)
    shards = (_packed(held, ["dims", "shard"]).withColumn("salt", F.pmod("shard", F.lit(salts)))
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    questions = (_packed(asked, ["dims", "block"]).withColumnsRenamed({"ids": "q_ids", "matrix": "q_matrix"})
                 .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, ids = np.frombuffer(row["matrix"], np.int64).reshape(-1, row["dims"]), np.frombuffer(row["ids"], np.int64)
                q, q_ids = np.frombuffer(row["q_matrix"], np.int64).reshape(-1, row["dims"]), np.frombuffer(row["q_ids"], np.int64)
                if float(np.abs(x).max()) * float(np.abs(q).max()) * row["dims"] < 2**53:
                    x, q = x.astype(np.float64), q.astype(np.float64)  # exact, and multiplied faster
                order = np.argsort(x, axis=0, kind="stable").T
                query, found, score = [], [], []
                for own, weights in zip(q_ids.tolist(), q, strict=True):
                    best_id, best = threshold_top(x, ids, order, weights, own, k)
                    query.append(np.full(len(best), own, np.int64))
                    found.append(best_id)
                    score.append(best.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (query, found, score)], ["query_id", "vec_id", "score"])

    local = (shards.join(questions, ["dims", "block", "salt"]).select("dims", "ids", "matrix", "q_ids", "q_matrix")
             .mapInArrow(run, "query_id long, vec_id long, score long").distinct())
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
