import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"

#: Names that the operators use inside, as columns of the caller.
CLASHING = ("k", "h", "t", "n", "label", "rep", "_k", "_h", "_id", "_terms", "_cuts", "_score", "component_id", "matches", "s")


def table(spark, rows):
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), *["x"] * len(CLASHING)) for i, t, lang, source in rows], schema)


def edge_rows():
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    near = " ".join(f"near{i}" for i in range(60))
    return [
        (1, "", "en", "a"), (2, None, "en", "a"), (3, " \n\t ", None, None), (4, "one", "en", None), (5, "A bé CÉ", None, "a"), (6, long, "en", "a"), (7, long, "en", "a"),
        (8, "dup dup dup dup dup dup", "en", "a"), (8, "dup dup dup dup dup dup", "en", "a"), (None, "no id here at all", "en", "b"), (None, None, None, None),
        (9, near, "en", "b"), (10, near + " tail", "en", "b"), (11, near.upper(), "en", "b"), (12, "mail a@b.co and 10.0.0.1 or +1 555 123 4567 card 4111 1111 1111 1111.", "en", "b"),
        (13, "x" * 20_000, "de", "b"), (14, "\U0001f600 ä \n\n \U0001f600 ä \n", "de", "c"),
    ]


@pytest.fixture(scope="session")
def edges(spark):
    return table(spark, edge_rows()).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
