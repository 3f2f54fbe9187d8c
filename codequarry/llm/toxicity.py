"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, replaces look-alike letters and digit or sign
substitutions inside words, and turns everything between words into one
space, so entries are whole words (`` word ``) or beginnings of words
(`` wor``).  Weights are log-odds learned from a bounded labelled sample.  A
word counts once, with its heaviest entry, unless it lies inside an exception
phrase.  Sums are normalised by the text's length before calibration.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.labelled import Sample, fit_logistic, labelled_sample, logistic
from codequarry.llm.tables import remainder

PER_CLASS = 2500
MAX_SAMPLE_CHARS = 50_000
MAX_ENTRIES = 600
BEGINNINGS = (3, 4, 5, 6, 7)
LEAST_WEIGHT = math.log(3)
THRESHOLD = 0.5

# Letters of other scripts that look like Latin ones, in two parallel rows.
LOOK_ALIKE = "аеорсухіјѕһԁԛԝѵɡɩαεικνορτυχϲϳօսոհցⅼ"
LATIN_LIKE = "aeopcyxijshdqwvgiaeiknoptuxcjouonhgl"[:len(LOOK_ALIKE)]
# Digits and signs written for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e"}
# Phrases in which a listed word means no harm.
EXCEPTIONS = ("clown fish", "clown car", "class clown", "trash can", "trash bin", "trash bag", "pathetic fallacy",
              "stupid question", "sore loser", "pond scum", "soap scum")

_MIXED = re.compile(r"(?<!\S)[^\s0134578@$!€]*+[0134578@$!€]\S*")
_APART = re.compile(r"[\W_]+")
_SUBSTITUTE = str.maketrans(SUBSTITUTES)
_LATIN = str.maketrans(dict(zip(LOOK_ALIKE, LATIN_LIKE, strict=True)) | {c: None for c in "­​‌‍⁠﻿"})


def _substituted(token: re.Match) -> str:
    """A token with signs read as letters, unless it has no letter; signs at its end are punctuation."""
    body = token[0].rstrip("!$@€")
    return body.translate(_SUBSTITUTE) + " " if any(c.isalpha() for c in body) else token[0]


def fold(text: str) -> str:
    """The text as words between single spaces, with a space at each end."""
    low = text.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKC", low).translate(_LATIN)
    return f" {_APART.sub(' ', _MIXED.sub(_substituted, low)).strip()} "


@dataclass
class Model:
    """Entries with weights, exception phrases, and the calibration."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: Sequence[str] = EXCEPTIONS
    beta: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def automaton(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            machine.add_word(entry, (entry, weight))
        for phrase in self.exceptions:
            entry = fold(phrase)
            machine.add_word(entry, (entry, -1.0))
        if len(machine):
            machine.make_automaton()
        return machine


def matched(folded: str, machine: ahocorasick.Automaton) -> dict[int, tuple[float, str]]:
    """The heaviest entry at each word, by where the word begins, without words inside exceptions."""
    best: dict[int, tuple[float, str]] = {}
    spans = []
    if len(machine):
        for end, (entry, weight) in machine.iter(folded):
            begin = end - len(entry) + 1
            if weight < 0:
                spans.append((begin, end))
            elif weight > best.get(begin, (0.0, ""))[0]:
                best[begin] = weight, entry
    for begin, end in spans:
        for at in [x for x in best if begin <= x < end]:
            del best[at]
    return best


def features(folded: str, best: dict[int, tuple[float, str]]) -> tuple[float, float, float]:
    """On log scales: the summed weight, the weight per hundred words, and the weight of distinct entries."""
    total = sum(weight for weight, _ in best.values())
    distinct = sum(weight for weight, _ in set(best.values()))
    return math.log1p(total), math.log1p(100 * total / (folded.count(" ") + 20)), math.log1p(distinct)


def learn(sample: Sample, exceptions: Sequence[str] = EXCEPTIONS, max_entries: int | None = MAX_ENTRIES) -> Model:
    """Lexicon from half of the sample, calibration on the other half.

    Entries are the words and word beginnings that most favour label 1 by
    their log-odds between texts of either label, at most ``max_entries`` of
    them (all with ``None``).  Without texts of both labels there is no
    lexicon and every text gets the base rate.
    """
    halves = {k: (v[0::3] + v[1::3], v[2::3]) for k, v in sample.texts.items()}
    total = sum(sample.totals.values())
    rate = (sample.totals[1] + 1) / (total + 2)
    if not halves[0][0] or not halves[1][0]:
        return Model({}, exceptions, np.array([0.0, 0.0, 0.0, math.log(rate / (1 - rate))]))
    counts = {}
    for label, (texts, _) in halves.items():
        counts[label] = Counter()
        for text in texts:
            words = set(fold(text).split())
            counts[label].update({f" {x} " for x in words} | {f" {x[:n]}" for x in words for n in BEGINNINGS if len(x) >= n})
    n_bad, n_fine = len(halves[1][0]), len(halves[0][0])
    entries = {}
    for entry, seen in counts[1].items():
        weight = math.log((seen + 0.5) / (n_bad + 1)) - math.log((counts[0][entry] + 0.5) / (n_fine + 1))
        if seen >= max(3, 0.004 * n_bad) and weight > LEAST_WEIGHT and seen * weight > 8:
            entries[entry] = weight
    chosen = sorted(entries, key=lambda e: (-entries[e] * math.sqrt(counts[1][e]), e))[:max_entries]
    model = Model({e: entries[e] for e in chosen}, exceptions)
    machine = model.automaton()
    x, y, weight = [], [], []
    held_rows = sum(len(h) for _, h in halves.values())
    for label, (_, held) in halves.items():
        for text in held:
            folded = fold(text)
            x.append(features(folded, matched(folded, machine)))
            y.append(label)
            weight.append(sample.totals[label] / total * held_rows / len(held))
    model.beta = fit_logistic(np.array(x).reshape(-1, 3), np.array(y), np.array(weight))
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_SAMPLE_CHARS,
          max_entries: int | None = MAX_ENTRIES) -> Model:
    """The model from at most ``per_class`` labelled rows of each label whose id's remainder by 5 is not 0."""
    return learn(labelled_sample(docs, labels, "toxic", 5, 0, per_class, max_chars), max_entries=max_entries)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, weight, n_matches`` for every row of ``docs (doc_id, text)``.

    Null and empty texts match nothing and get the score of a clean text.
    Whole texts are read, rows may repeat, extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value.automaton()
        for batch in batches:
            x, sums, found = [], [], []
            for text in batch.column("text"):
                folded = fold(text.as_py() or "")
                best = matched(folded, machine)
                x.append(features(folded, best))
                sums.append(sum(weight for weight, _ in best.values()))
                found.append(len(best))
            score = logistic(np.array(x, float).reshape(-1, 3), shared.value.beta)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array(sums, pa.float64()), pa.array(found, pa.int64())],
                ["doc_id", "score", "weight", "n_matches"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, weight double, n_matches long")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    rows = scored(docs, train(docs, labels))
    return rows.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "weight", "n_matches")
