import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def sf001(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts001(sf001):
    return {r["doc_id"]: r["text"] for r in sf001.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents table from (doc_id, text[, lang, source]) rows."""

    def build(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return build


LONG = "Lorem ipsum dolor sit amet. " * 20_000
ODD_ROWS = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "same text here, twice over. And more of it follows."),
    (4, "same text here, twice over. And more of it follows."),
    (5, "same text here, twice over. And more of it follows."),
    (6, LONG),
    (7, "é ü ß 日本 🙂 | ### $$$"),
    (None, "a row without an id but with words in it"),
]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD_ROWS)
