"""Sessions for the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> None:
    """Settings that results depend on.

    With this one on, Spark 4.1 takes a union of equally partitioned children
    for partitioned alike, though adaptive execution may coalesce the children
    differently; groups then come out in parts.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def get_spark(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, Arrow transfer and UTC; on a cluster the deploy mode decides the rest."""
    builder = SparkSession.builder.appName("tessera").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    prepare(spark)
    return spark
