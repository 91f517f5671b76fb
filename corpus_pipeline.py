"""A corpus-cleaning pipeline over the documents table.

quality rules -> near duplicates -> repeated passages -> benchmark passages ->
tokens.  Each stage is (spark, docs, sf_dir) -> DataFrame and works on all rows
its predecessor kept; all but the last return the columns of documents.

Defined results: a null or empty text has too few words and goes in the first
stage; null ids, repeated ids and repeated rows are kept row by row, but for
near_duplicates, which keeps one row of each group, that with the least id (a
null id comes last; ties are settled by digests of the row); an empty table, or
one of which nothing is kept, gives an empty one; a text of any length is worked
on whole; further columns pass through until the last stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard, quality, repeats


def _resized(docs: DataFrame) -> DataFrame:
    """docs with n_chars counted again, in the same columns."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without their failing lines."""
    return _resized(quality.clean(docs, drop_lines=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words that occur twice; documents with nothing but white space left go."""
    length, words = repeats.PASSAGE
    left = _resized(repeats.remove(docs, length=length, least_words=words))
    return left.where(F.col("text").rlike(r"\S"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the decoded bytes."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("tokens", tokens),
]

#: SQL can express neither the line rules nor the encoder; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return reduce(lambda d, stage: stage[1](spark, d, sf_dir), STAGES, docs)
