import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, _hit string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) pairs, with extra columns whose names clash with private ones."""
    def build(*rows):
        data = [(i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in rows]
        return spark.createDataFrame(data, T._parse_datatype_string(DOCS))

    return build


@pytest.fixture(scope="session")
def make_labels(spark):
    def build(*rows):
        return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")

    return build
