"""The catalog, seen through the driver's tables, for Spark and as SQL.

An order is a track, its customer the artist, its date the release, its total
the duration; a part's brand and size are a term of those who bought it, its
name a second kind of tag; customers who bought a part one after another are
similar artists, in that direction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.materialize import checkpointed, sized


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("track_id"), F.col("o_custkey").alias("artist_id"), F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("duration"), F.date_format("o_orderdate", "yyyyMMdd").cast("long").alias("release_id"),
        F.col("o_orderstatus").alias("mode"), F.col("o_orderpriority").alias("title"),
    )


def _orders(spark: SparkSession, sf_dir: str, artists: DataFrame | None) -> DataFrame:
    """(o_orderkey, o_custkey), of some artists (artist_id) only if they are given; few are broadcast."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    if artists is None:
        return orders
    return sized(checkpointed(orders.join(sized(artists), F.col("o_custkey") == F.col("artist_id"), "left_semi")))


def tags(spark: SparkSession, sf_dir: str, artists: DataFrame | None = None) -> DataFrame:
    """Distinct (artist_id, tag, source), of some artists (a checkpoint of distinct artist_id) only if they are given."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    # Numbers travel first, so that names are shuffled once.
    bought = lines.join(_orders(spark, sf_dir, artists), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey")
    owned = bought.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    both = F.array(F.struct(F.concat_ws("-", "p_brand", "p_size").alias("tag"), F.lit("term").alias("source")), F.struct(F.col("p_name").alias("tag"), F.lit("mbtag").alias("source")))
    return owned.select(F.col("o_custkey").alias("artist_id"), F.inline(both)).distinct()  # one pass for both kinds


def follows(spark: SparkSession, sf_dir: str, artists: DataFrame | None = None) -> DataFrame:
    """(l_partkey, artist_id, similar_artist_id) of customers who bought a part one after another, repeated; out of some artists (a checkpoint of distinct artist_id) only if they are given."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = _orders(spark, sf_dir, None)
    if artists is not None:
        lines, orders = _beside(lines, orders, _orders(spark, sf_dir, artists))
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    after = F.lead("o_custkey").over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "o_custkey"))
    pairs = bought.select("l_partkey", F.col("o_custkey").alias("artist_id"), after.alias("similar_artist_id")).where("similar_artist_id is not null and artist_id <> similar_artist_id")
    return pairs if artists is None else pairs.join(sized(artists), "artist_id", "left_semi").select(*pairs.columns)


def _beside(lines: DataFrame, orders: DataFrame, mine: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of a part in some orders and in the next order of that part, and the orders of these: what is bought after a line of those orders is the same as among all lines.

    A part's whole lines are kept where the next order is unknown (a line without an order).
    """
    asked = checkpointed(lines.join(mine, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("order")).distinct())
    same_part = F.col("l_partkey").eqNullSafe(F.col("part"))
    later = lines.select("l_orderkey", "l_partkey").join(sized(asked), same_part & (F.col("l_orderkey") > F.col("order")))
    later = checkpointed(later.groupBy("part", "order").agg(F.min("l_orderkey").alias("next")).select("part", F.col("next").alias("order")).distinct())
    units = checkpointed(asked.union(later).distinct())
    known = checkpointed(orders.join(sized(checkpointed(units.select("order").distinct())), F.col("o_orderkey") == F.col("order"), "left_semi"))
    near = lines.join(sized(units), same_part & (F.col("l_orderkey") == F.col("order")), "left_semi")
    broken = checkpointed(later.join(known, F.col("order") == F.col("o_orderkey"), "left_anti").select("part").distinct())
    if broken.isEmpty():
        return near, sized(known)
    return near.join(sized(broken), same_part, "left_anti").union(lines.join(sized(broken), same_part, "left_semi")), orders


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct directed (artist_id, similar_artist_id, edge_order) without self loops."""
    return follows(spark, sf_dir).groupBy("artist_id", "similar_artist_id").agg(F.min("l_partkey").alias("edge_order"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as segments: start in seconds, value, class."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), F.col("event_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start"), "value", "event_type")


#: The same as common table expressions.
CTE = {
    "tracks": """tracks AS (SELECT o_orderkey AS track_id, o_custkey AS artist_id, CAST(year(o_orderdate) AS INT) AS year, o_totalprice AS duration,
        CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS release_id, o_orderstatus AS mode, o_orderpriority AS title FROM orders)""",
    "tags": """owned AS (SELECT o_custkey AS artist_id, p_brand, p_size, p_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
        tags AS (SELECT DISTINCT artist_id, p_brand || '-' || p_size AS tag, 'term' AS source FROM owned UNION SELECT DISTINCT artist_id, p_name, 'mbtag' FROM owned)""",
    "similar": """follows AS (SELECT l_partkey, o_custkey AS artist_id, lead(o_custkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, o_custkey) AS similar_artist_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        similar_ AS (SELECT artist_id, similar_artist_id, min(l_partkey) AS edge_order FROM follows WHERE similar_artist_id IS NOT NULL AND artist_id <> similar_artist_id GROUP BY 1, 2)""",
    "segments": """segments AS (SELECT user_id AS track_id, event_id, epoch_us(ts) / 1e6 AS start, value, event_type FROM events)""",
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """A statement over the named views; body may go on with further ``, x AS (...)`` before its SELECT."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(CTE[n] for n in names) + "\n" + body
