"""Table checks as counts of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column], key: str | None = None) -> DataFrame:
    """(rule, violations): rows for which each condition holds, and repeats of a key; one pass."""
    counts = {name: F.count_if(bad) for name, bad in rules.items()}
    if key:
        counts["repeated_key"] = F.count("*") - F.countDistinct(key)
    one = df.agg(*(c.alias(n) for n, c in counts.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in counts))
    return one.select(F.inline(pairs))


def schema_violations(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(rule, violations): columns that are missing, of another type, out of order or too many."""
    found = dict(df.dtypes)
    wrong = sum(found.get(name) != kind for name, kind in expected.items()) + sum(name not in expected for name in found)
    wrong += int(not wrong and list(found) != list(expected))
    return df.sparkSession.createDataFrame([("wrong_schema", wrong)], "rule string, violations long")
