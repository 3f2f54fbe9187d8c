"""From raw documents to a mixed training set: five stages, each an operator of ``codequarry.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import compression, minhash, mixing, pseudonyms, suffixes
from codequarry.llm.catalog import TEST_KEY
from codequarry.llm.tables import read, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_DUPLICATE_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; an empty or null text is scored like any other."""
    model = compression.train(docs, read(spark, sf_dir, "labels"))
    return compression.accepted(docs.select(*COLUMNS), model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id.

    Repeated rows of that document are reduced to one; rows without an id, and
    texts without words, are in no group and stay.
    """
    judged = minhash.near_duplicates(docs, NEAR_DUPLICATE_PERCENT)
    dropped = judged.filter("not kept").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti").select(*COLUMNS)
    repeated = judged.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    repeated = stored(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi").select(*COLUMNS).dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").select(*COLUMNS).union(again)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return suffixes.decontaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal values and ``n_chars`` of the new text."""
    safe = pseudonyms.pseudonymised(docs.select(*COLUMNS), TEST_KEY)
    return safe.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics approach their target weights."""
    return mixing.mixed(docs.select(*COLUMNS)).filter("_kept").select(*COLUMNS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

# The quality classifier, MinHash and the pseudonyms cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
