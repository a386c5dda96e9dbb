import pytest
from pyspark.sql import types as T

from limpid.llm.common import read

# an id, a text, and columns that are called like what the operators append
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(n, T.StringType()) for n in (
        "score", "predicted", "spans", "ids", "decoded", "fp", "id", "word", "digest", "n_words", "detections", "first", "last", "_row",
        "_kept_id", "_hit_id", "shard", "slot", "size", "start", "items", "rank", "term", "part", "root",
    )],
])
PASSAGE = "This passage of many words is held by several texts, and it is long enough to be cut out of all but one of them. "
ROWS = [
    (1, PASSAGE + "first"), (2, "alpha beta gamma " + PASSAGE + "zweite Zeile"), (3, None), (4, ""), (5, "   \n\t "),
    (None, "a text without an id " + PASSAGE), (6, "word " * 30_000), (6, "word " * 30_000), (7, "word " * 30_000 + "end"),
    (8, PASSAGE + "first"), (9, "ÄÖÜ straße 数据 😀 mit License, CC BY 4.0"), (1, PASSAGE + "first"), (10, "x"), (10, "y z"),
    (11, "a\x00b\x1cc <|endoftext|> </s>"), (12, "=" * 500),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing names."""
    more = len(SCHEMA) - 5
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), *[None] * more) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return read(spark, sf, "documents")


@pytest.fixture(scope="session")
def medium(spark):
    return read(spark, "/root/testdata/sf0.01", "documents")
