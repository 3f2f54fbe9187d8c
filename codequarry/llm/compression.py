"""A quality classifier by compression with dictionaries of good and bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.labelled import Sample, fit_logistic, labelled_sample, logistic
from codequarry.llm.tables import remainder

PER_CLASS = 2000
MAX_SAMPLE_CHARS = 50_000
DICTIONARY_BYTES = 112_640
LEVEL = 3
PRIOR_BYTES = 20
THRESHOLD = 0.7


@dataclass
class Model:
    """Two dictionaries and the logistic curve over the normalised size differences."""

    good: bytes
    bad: bytes
    beta: np.ndarray

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        ready = []
        for content in (self.good, self.bad):
            if content:
                shared = zstandard.ZstdCompressionDict(content)
                shared.precompute_compress(level=LEVEL)
                ready.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=shared))
            else:
                ready.append(zstandard.ZstdCompressor(level=LEVEL))
        return ready


def features(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> list[float]:
    """What the good dictionary saves over the bad one, normalised by the text's and by the compressed size.

    Both differences say little about texts that either dictionary packs into
    almost nothing, so the compressed share is given with them.
    """
    by_good, by_bad = (len(c.compress(text)) if text else 0 for c in (good, bad))
    saved, packed, size = by_bad - by_good, by_bad + by_good + PRIOR_BYTES, len(text) + PRIOR_BYTES
    return [100 * saved / size, 10 * saved / packed, saved / packed ** 0.5, packed / size]


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary, or all of the texts when they are too few or too short to train one."""
    samples = [t.encode() for t in texts if t]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(samples)


def fit(sample: Sample) -> Model:
    """Two thirds of each label's texts build the dictionaries, the rest calibrate the score.

    Without texts of both labels every text gets the base rate of label 1
    (one half without any).
    """
    parts = {k: (v[:len(v) * 2 // 3], v[len(v) * 2 // 3:]) for k, v in sample.texts.items()}
    total = sum(sample.totals.values())
    if not parts[0][0] or not parts[1][0]:
        rate = (sample.totals[1] + 1) / (total + 2)
        return Model(b"", b"", np.array([0.0] * 4 + [np.log(rate / (1 - rate))]))
    model = Model(_dictionary(parts[1][0]), _dictionary(parts[0][0]), np.zeros(5))
    pair = model.compressors()
    x, y, weight = [], [], []
    for label, (_, held) in parts.items():
        for text in held:
            x.append(features(text.encode(), *pair))
            y.append(label)
            weight.append(sample.totals[label] / total * sum(len(h) for _, h in parts.values()) / len(held))
    model.beta = fit_logistic(np.array(x), np.array(y), np.array(weight))
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_SAMPLE_CHARS) -> Model:
    """The model from at most ``per_class`` labelled rows of each label whose id's remainder by 4 is not 2."""
    return fit(labelled_sample(docs, labels, "quality", 4, 2, per_class, max_chars))


def _scores(texts: pa.Array, pair: list[zstandard.ZstdCompressor], beta: np.ndarray) -> np.ndarray:
    values = [features(t.as_buffer().to_pybytes() if t.is_valid else b"", *pair) for t in texts]
    return logistic(np.array(values, float).reshape(-1, 4), beta)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row of ``docs (doc_id, text)``; a null text scores as an empty one.

    The score is the calibrated probability of label 1.  Whole texts are
    compressed, rows may repeat, extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = shared.value.compressors()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(_scores(batch.column("text"), pair, shared.value.beta))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = shared.value.compressors()
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column("text"), pair, shared.value.beta) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    rows = scored(docs, train(docs, labels))
    return rows.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
