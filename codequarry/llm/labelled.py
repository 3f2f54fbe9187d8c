"""A bounded sample of labelled texts, and logistic calibration on it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.tables import remainder


@dataclass
class Sample:
    """Texts by label, and how many rows carry each label in all."""

    texts: dict[int, list[str]]
    totals: dict[int, int]


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, divisor: int, held_out: int,
                    per_class: int, max_chars: int) -> Sample:
    """At most ``per_class`` texts of each label, none longer than ``max_chars``, in a fixed pseudo-random order.

    Rows whose id's remainder is ``held_out`` are never looked at, nor are
    null labels, ids with contradicting labels and null texts.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
             .filter("doc_id is not null and label in (0, 1)").filter(remainder(F.col("doc_id"), divisor) != held_out)
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_other")).filter("label = _other").drop("_other"))
    totals = {row.label: row.n for row in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("_chars"))
    fitting = sizes.filter(F.col("_chars") <= max_chars).select("doc_id").distinct()
    order = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    usable = known.join(fitting, "doc_id", "left_semi")
    chosen = None
    for label in (0, 1):
        some = usable.filter(F.col("label") == label).orderBy(order, "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.union(some)
    ids = docs.sparkSession.createDataFrame(chosen.collect(), "doc_id long, label int")  # bounded by 2 * per_class
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") <= max_chars)
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    by_label: dict[int, list[str]] = {0: [], 1: []}
    for row in sorted(rows.collect(), key=lambda r: (hash_order(r.doc_id), r.doc_id)):
        by_label[row.label].append(row.text)
    return Sample(by_label, {k: totals.get(k, 0) for k in (0, 1)})


def hash_order(doc_id: int) -> int:
    """A fixed shuffle of ids."""
    return (doc_id * 0x9E3779B97F4A7C15 & (1 << 64) - 1) ^ 0x5851F42D4C957F2D


def fit_logistic(features: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.column_stack((features, np.ones(len(features))))
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + penalty * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def logistic(features: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Scores between 0 and 1."""
    z = np.atleast_2d(features) @ beta[:-1] + beta[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
