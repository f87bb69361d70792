import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, langs=None, sources=None):
        return spark.createDataFrame(
            [(i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows."""
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t\n", None, "a", 3), (None, "no id here", "en", "a", 10),
        (4, "word " * 60_000, "en", "a", 300_000), (5, "x" * 200_000, "en", "b", 200_000), (6, "same text of two rows", "en", "a", 21),
        (6, "same text of two rows", "en", "a", 21), (7, "\x1c\x00é\U0001f600 'll  <|endoftext|>", "fr", "a", None),
    ]
    return spark.createDataFrame(rows, DOCS)
