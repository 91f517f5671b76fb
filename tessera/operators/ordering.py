"""Global row numbers and exact quantiles without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as x
from tessera.plans.materialize import checkpointed


def row_numbers(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with gapless numbers from 0 in the order of keys.

    Rows are dealt by ranges of all the keys, whatever their types, each range is
    numbered by itself, and the ranges' counts, one row each, give the offsets.
    The ranges are drawn once and kept in a checkpoint, since both uses of them
    must see the same.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as ranges
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy(*keys)))
    return numbered.join(F.broadcast(offsets), "_range").select(*df.columns, (F.col("_offset") + F.col("_k") - 1).alias(name))


def group_numbers(df: DataFrame, groups: list[str], keys: list[str], name: str) -> DataFrame:
    """df with gapless numbers from 0 in each of a few large groups, in the order of keys, without a task for a whole group.

    The groups must be few, such as years or strata: their first numbers, a row
    each, are broadcast.
    """
    numbered = row_numbers(df, [*groups, *keys], "_at")
    first = numbered.groupBy(*groups).agg(F.min("_at").alias("_first"))
    return numbered.join(F.broadcast(first), groups).select(*df.columns, (F.col("_at") - F.col("_first")).alias(name))


def quantiles(df: DataFrame, column: str, at: dict[str, float], linear: bool = True) -> DataFrame:
    """One row of exact quantiles of a column's finite values, by name; null where there are none.

    Linear between the two nearest places, or the value at the nearest rank.
    Values are numbered by ranges, and only the asked places are looked up.
    """
    numbered = row_numbers(df.select(F.col(column).cast("double").alias("_x")).where(x.finite(F.col("_x"))), ["_x"], "_at")
    n = numbered.agg(F.count("*").alias("_n"))
    return numbered.join(F.broadcast(n), F.lit(True)).agg(*(_between(q, linear).alias(name) for name, q in at.items()))


def _between(q: float, linear: bool) -> Column:
    """An aggregate over values _x, numbered _at of _n."""
    place = F.lit(q) * (F.col("_n") - 1) if linear else F.greatest(F.ceil(F.lit(q) * F.col("_n")), F.lit(1)) - 1
    low, high = F.floor(place), F.ceil(place)
    value = lambda p: F.max(F.when(F.col("_at") == p, F.col("_x")))
    return value(low) + (value(high) - value(low)) * F.max(place - low)


def column_quantiles(df: DataFrame, columns: list[str], at: dict[str, float], linear: bool = True) -> DataFrame:
    """(column, a quantile by each name): the same for several columns at once, a row each; none for a column without finite values."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_x")) for c in columns))
    numbered = group_numbers(df.select(F.inline(pairs)).where(x.finite(F.col("_x"))), ["column"], ["_x"], "_at")
    n = numbered.groupBy("column").agg(F.count("*").alias("_n"))
    return numbered.join(F.broadcast(n), "column").groupBy("column").agg(*(_between(q, linear).alias(name) for name, q in at.items()))  # a row a column


def shares(available: dict[str, int], wanted: int) -> dict[str, int]:
    """Near-equal quotas of strata in their order; what a short one lacks goes to the others."""
    quota = dict.fromkeys(available, 0)
    left = min(wanted, sum(available.values()))
    while left:
        open_ = [s for s in available if quota[s] < available[s]]
        each = max(1, left // len(open_))
        for s in open_:
            more = min(each, available[s] - quota[s], left)
            quota[s] += more
            left -= more
    return quota


def dealt(df: DataFrame, stratum: str, strata: tuple[str, ...], keys: list[str], wanted: int) -> DataFrame:
    """So many rows of df, the first of each stratum by the keys, as evenly as the strata allow."""
    counts = {row[stratum]: row["n"] for row in df.groupBy(stratum).agg(F.count("*").alias("n")).collect()}  # a few strata
    quota = shares({s: counts.get(s, 0) for s in strata}, wanted)
    limit = F.coalesce(*(F.when(F.col(stratum) == s, n) for s, n in quota.items()), F.lit(0))
    most = max(quota.values(), default=0)
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(*keys))
    return df.withColumn("_place", place).where((F.col("_place") <= most) & (F.col("_place") <= limit)).drop("_place")
