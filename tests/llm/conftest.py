import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    T.StructField("id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("words", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("n", T.StringType()),
])


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with further columns of clashing names."""
    def make(rows, langs=None):
        full = [(i, t, (langs or {}).get(i), "src", None, "x", None, "y", "z", None, "") for i, t in rows]
        return spark.createDataFrame(full, DOCUMENTS)
    return make


@pytest.fixture(scope="session")
def edge(frame):
    """Nulls, empty, very long and repeated texts, ties, repeated rows and null ids."""
    long = " ".join(f"word{i % 977} tail{i % 31}." for i in range(60_000))
    return frame([(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a"), (5, "a"), (None, "a"), (None, None),
                  (6, long), (7, long + " end"), (8, "é ñ ß 日本"), (9, "x" * 5000), (10, "one two"), (11, "ONE two")])
