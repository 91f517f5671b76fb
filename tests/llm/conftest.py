"""Small document tables with every awkward case, and the driver's smallest tables."""

import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        T.StructField("shard", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("matches", T.StringType()),
    ]
)

SENTENCE = "The quick brown fox jumps over the lazy dog while seven wizards quietly juggle boxes of glowing fruit."
LONG = " ".join(f"word{i} is followed by another number {i * 7 % 1000}." for i in range(3000))
TEXTS = [
    None, "", " ", "\n\n", "...", SENTENCE, SENTENCE, SENTENCE.upper(), LONG, LONG + " end", LONG.replace("word77 ", "weird77 "),
    "one two", "One  TWO", "ünïcödé çà et là, naïve façade", "日本語のテキスト", "a\x00b\tc\x0bd\re", "!!! ??? ***", "x" * 5000,
    "Released under the MIT License.\nAll rights reserved.\n" + SENTENCE, SENTENCE + "\n" + SENTENCE + "\n" + SENTENCE,
    "mit license mit license apache license. general public license", "home | about | help | more | legal",
]


def rows(texts):
    out = [(i, t, ["en", None, "de"][i % 3], "s", None if t is None else len(t), "x", "y", "z", "m") for i, t in enumerate(texts)]
    return [*out, (None, SENTENCE, None, None, None, None, None, None, None), out[5], out[8]]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing column names."""
    return spark.createDataFrame(rows(TEXTS), DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
