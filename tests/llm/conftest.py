import os

import pytest
from pyspark.sql import types as T

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Columns whose names operators use themselves: they must be ignored.
    T.StructField("size", T.StringType()), T.StructField("score", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("batch", T.StringType()), T.StructField("rate", T.StringType()), T.StructField("key", T.StringType())])


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (id, text, source) rows, with columns of clashing names."""

    def make(rows):
        full = [(i, t, None if i is None else "en", s, None if t is None else len(t), "x", "x", "x", "x", "x", "x") for i, t, s in rows]
        return spark.createDataFrame(full, DOCS)

    return make


LONG = " ".join(f"w{i % 997} tail{i}." for i in range(30_000))


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls, empty, blank and very long texts, repeated rows, ties."""
    return frame([
        (None, None, None), (1, None, "a"), (2, "", None), (3, " \t\n", "a"), (4, LONG, "b"), (5, LONG, "b"), (5, LONG, "b"),
        (6, "one two", "c"), (7, "one two", "c"), (None, "one two", "c"), (8, "日本 語 x² <|endoftext|> 🙂", "ü"), (9, "word", "")])


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
