"""Reader and writer queries: tables go out to a scratch folder of the session and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as x
from tessera.operators import ranking
from tessera.plans import views as v
from tessera.plans.materialize import checkpointed
from tessera.queries import query
from tessera.sources import readers, sinks

S, D = SparkSession, DataFrame


def scratch(spark: S, name: str) -> str:
    """A new path in the folder that all executors share."""
    checkpointed(spark.range(1))  # makes sure that there is one
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@query("src_parquet_file", "SELECT o_orderkey, o_totalprice FROM orders")
def src_parquet_file(spark: S, d: str) -> D:
    return readers.parquet(spark, f"{d}/orders.parquet").select("o_orderkey", "o_totalprice")


@query("src_parquet_glob", _NATION)
def src_parquet_glob(spark: S, d: str) -> D:
    path = scratch(spark, "glob")
    v.table(spark, d, "nation").write.parquet(path)
    return readers.parquet_glob(spark, path, "part-*.parquet").select("n_nationkey", "n_name", "n_regionkey")


@query("src_hive_partition", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def src_hive_partition(spark: S, d: str) -> D:
    path = scratch(spark, "hive")
    sinks.partitioned(v.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), path, "c_mktsegment")
    return readers.partition(spark, path, c_mktsegment="BUILDING").select("c_custkey", "c_mktsegment")


@query("src_basepath", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def src_basepath(spark: S, d: str) -> D:
    path = scratch(spark, "base")
    sinks.partitioned(v.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), path, "c_mktsegment")
    return readers.with_base(spark, path, f"{path}/c_mktsegment=BUILDING").select("c_custkey", "c_mktsegment")


@query("src_projected_rows", "SELECT n_nationkey, n_name FROM nation")
def src_projected_rows(spark: S, d: str) -> D:
    batches = readers.projected_rows(v.table(spark, d, "nation"), ["n_nationkey", "n_name"], 10)
    return spark.createDataFrame([tuple(r) for batch in batches for r in batch], "n_nationkey int, n_name string")


@query("src_parts_listing", "SELECT count(*) AS n FROM supplier")
def src_parts_listing(spark: S, d: str) -> D:
    path = scratch(spark, "parts")
    v.table(spark, d, "supplier").repartition(3).write.parquet(f"{path}/a=1")
    return spark.read.option("recursiveFileLookup", "true").parquet(path).agg(F.count("*").alias("n"))


@query("src_text_ids", "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer")
def src_text_ids(spark: S, d: str) -> D:
    path = scratch(spark, "ids")
    v.table(spark, d, "customer").select(F.concat(F.lit("  "), "c_custkey", F.lit(" \n")).alias("value")).write.text(path)
    return readers.text_ids(spark, path)


@query("src_sep_text", "SELECT s_name AS name, s_suppkey AS key, s_acctbal AS balance FROM supplier")
def src_sep_text(spark: S, d: str) -> D:
    path = scratch(spark, "sep")
    v.table(spark, d, "supplier").select(F.concat_ws("<SEP>", "s_name", "s_suppkey", "s_acctbal").alias("value")).write.text(path)
    return readers.separated(spark, path, ["name", "key", "balance"], casts={"key": "bigint", "balance": "double"})


@query("src_json_rows", _NATION)
def src_json_rows(spark: S, d: str) -> D:
    path = scratch(spark, "json")
    v.table(spark, d, "nation").write.option("compression", "gzip").json(path)
    return readers.json_rows(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("src_sql_union", v.sql("SELECT artist_id, tag, source FROM tags", "tags"))
def src_sql_union(spark: S, d: str) -> D:
    return v.tags(spark, d)


@query("src_hdf5_summary", "SELECT event_id, CASE WHEN value - 20 > 0 THEN round(value - 20, 6) END AS value FROM events")
def src_hdf5_summary(spark: S, d: str) -> D:
    e = v.table(spark, d, "events").select("event_id", F.round(F.col("value") - 20, 6).alias("value"))
    return readers.without_sentinels(e, ["value"])


@query("sink_parquet_strict", _NATION)
def sink_parquet_strict(spark: S, d: str) -> D:
    path = scratch(spark, "strict")
    sinks.parquet_strict(v.table(spark, d, "nation"), path)
    return spark.read.parquet(path).select("n_nationkey", "n_name", "n_regionkey")


@query("sink_partitioned", "SELECT o_orderkey, o_orderstatus FROM orders")
def sink_partitioned(spark: S, d: str) -> D:
    path = scratch(spark, "split")
    sinks.partitioned(v.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, "o_orderstatus", rows_a_file=5000)
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus")


@query("sink_partition_by_path", "SELECT o_orderkey, o_orderpriority FROM orders")
def sink_partition_by_path(spark: S, d: str) -> D:
    path = scratch(spark, "paths")
    sinks.partitioned(v.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), path, "o_orderpriority")
    return spark.read.parquet(path).select("o_orderkey", "o_orderpriority")


@query("sink_sorted_parts", "SELECT o_custkey, o_orderkey FROM orders")
def sink_sorted_parts(spark: S, d: str) -> D:
    path = scratch(spark, "sorted")
    sinks.sorted_parts(v.table(spark, d, "orders").select("o_custkey", "o_orderkey"), path, 4, "o_custkey")
    return spark.read.parquet(path)


@query("sink_rowgroups", "SELECT p_partkey FROM part")
def sink_rowgroups(spark: S, d: str) -> D:
    path = scratch(spark, "rows")
    v.table(spark, d, "part").select("p_partkey").write.option("maxRecordsPerFile", 100).parquet(path)
    return spark.read.parquet(path)


# Joins and samples that need more than one operator.


@query("join_frontier", v.sql("SELECT DISTINCT similar_artist_id AS id FROM similar_ WHERE artist_id = (SELECT min(artist_id) FROM similar_)", "similar"))
def join_frontier(spark: S, d: str) -> D:
    e = v.similar(spark, d)
    near = e.groupBy("artist_id").agg(F.collect_list("similar_artist_id").alias("neighbors"))
    return near.join(F.broadcast(e.agg(F.min("artist_id").alias("artist_id"))), "artist_id").select(F.explode("neighbors").alias("id")).distinct()


@query("join_cross_threshold", "SELECT a.vec_id AS q, b.vec_id AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.45")
def join_cross_threshold(spark: S, d: str) -> D:
    """Pairs of unit vectors above a threshold, by blocks that meet as a matrix product."""
    from tessera.operators import vectors

    e = v.table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.above(e, 0.45, "vec_id", "embedding").select(F.col("query").alias("q"), F.col("candidate").alias("c"))


@query("smp_cross_artist", v.sql(", s AS (SELECT artist_id, track_id, CAST(('0x' || substr(sha256('42' || chr(0) || track_id), 1, 8))::UBIGINT % (SELECT count(*) FROM tracks) AS BIGINT) AS slot FROM tracks) SELECT s.track_id AS a, t.track_id AS b FROM s JOIN tracks t ON t.track_id = slot AND t.artist_id <> s.artist_id", "tracks"))
def smp_cross_artist(spark: S, d: str) -> D:
    t = v.tracks(spark, d).select("track_id", "artist_id")
    slot = F.conv(F.substring(x.digest(42, F.col("track_id")), 1, 8), 16, 10).cast("long") % F.col("n")
    s = t.join(F.broadcast(t.agg(F.count("*").alias("n"))), F.lit(True)).select(F.col("track_id").alias("a"), F.col("artist_id").alias("mine"), slot.alias("b"))
    return s.join(t.withColumnRenamed("track_id", "b"), "b").where("artist_id <> mine").select("a", "b")


@query("smp_quota", v.sql(", h AS (SELECT mode, track_id, row_number() OVER (PARTITION BY mode ORDER BY sha256('42' || chr(0) || track_id), track_id) AS k FROM tracks), turns AS (SELECT *, row_number() OVER (ORDER BY k, CASE mode WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) AS turn FROM h) SELECT mode, track_id FROM turns WHERE turn <= 1000", "tracks"))
def smp_quota(spark: S, d: str) -> D:
    """1,000 rows in all, near-equally of the strata; a short one's share goes to the others."""
    from tessera.operators.ordering import dealt

    t = v.tracks(spark, d).select("mode", "track_id").withColumn("h", x.digest(42, F.col("track_id")))
    return dealt(t, "mode", ("F", "O", "P"), ["h", "track_id"], 1000).select("mode", "track_id")


_ADJACENCY = v.sql(", n AS (SELECT artist_id AS id, string_agg(CAST(similar_artist_id AS VARCHAR), ',' ORDER BY similar_artist_id) AS neighbors, count(*) AS degree FROM similar_ GROUP BY 1) SELECT id, neighbors, CAST(degree AS INT) AS degree FROM n", "similar")


def _adjacency(spark: S, d: str) -> D:
    """(id, neighbors, degree) as records with an array."""
    grouped = v.similar(spark, d).groupBy(F.col("artist_id").alias("id")).agg(F.sort_array(F.collect_list("similar_artist_id")).alias("neighbors"))
    return grouped.withColumn("degree", F.size("neighbors"))


@query("sink_avro", _ADJACENCY)
def sink_avro(spark: S, d: str) -> D:
    """Adjacency out to Avro files and back."""
    path = scratch(spark, "avro")
    sinks.avro(_adjacency(spark, d), path, "Adjacency", "tessera.graph")
    return readers.avro(spark, path).select("id", F.array_join(F.transform("neighbors", lambda n: n.cast("string")), ",").alias("neighbors"), "degree")


@query("src_avro", "SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_orderkey % 2 = 0 AS even FROM orders")
def src_avro(spark: S, d: str) -> D:
    """Records with nulls, texts, numbers and flags from Avro files."""
    path, o = scratch(spark, "avro"), v.table(spark, d, "orders")
    sinks.avro(o.select("o_orderkey", "o_orderstatus", "o_totalprice", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("o_custkey"), (F.col("o_orderkey") % 2 == 0).alias("even")), path, "Order", "tessera.orders")
    return readers.avro(spark, path)


@query("sink_csv_result", _NATION)
def sink_csv_result(spark: S, d: str) -> D:
    path = f"{scratch(spark, 'csv')}.csv"
    sinks.csv_published(spark, v.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return spark.read.csv(path, header=True, schema="n_nationkey int, n_name string, n_regionkey int")


@query("sink_json_atomic", "SELECT count(*) AS n, count(DISTINCT n_regionkey) AS regions FROM nation")
def sink_json_atomic(spark: S, d: str) -> D:
    """Written twice: readers see the second as a whole."""
    path = f"{scratch(spark, 'json')}.json"
    row = v.table(spark, d, "nation").agg(F.count("*").alias("n"), F.countDistinct("n_regionkey").alias("regions")).first()
    sinks.json_published(spark, {"n": 0, "regions": 0}, path)
    sinks.json_published(spark, row.asDict(), path)
    return spark.read.json(path, schema="n long, regions long")


@query("sink_dir_publish", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT -1, 'refused'")
def sink_dir_publish(spark: S, d: str) -> D:
    """A folder published, published again by its owner, and refused to another."""
    path, t = scratch(spark, "published"), v.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    for region, owner in ((0, "me"), (1, "me"), (2, "you")):
        staged = f"{path}-{region}"
        t.where(F.col("n_regionkey") == region).drop("n_regionkey").write.parquet(staged)
        try:
            sinks.folder_published(spark, staged, path, owner)
        except FileExistsError:
            refused = spark.createDataFrame([(-1, "refused")], "n_nationkey int, n_name string")
    return spark.read.parquet(path).unionByName(refused)


@query("udf_closure_shipping", v.sql("SELECT track_id, CAST(floor(year / 10) * 10 AS BIGINT) AS decade FROM tracks", "tracks"))
def udf_closure_shipping(spark: S, d: str) -> D:
    """A function of this package in tasks that cannot import it: it goes as code."""
    from tessera.plans import shipping

    def run(frames):
        for frame in frames:
            yield frame.assign(decade=shipping.decade_of(frame["year"]))[["track_id", "decade"]]

    return v.tracks(spark, d).select("track_id", "year").mapInPandas(run, "track_id bigint, decade bigint")


@query("src_hdf5_tracks")
def src_hdf5_tracks(spark: S, d: str) -> D:
    """One file a track, read as bytes, decoded and aggregated in the tasks, those done before left out; JSON files here, HDF5 where its module is installed."""
    from tessera.queries import audio as a

    path = scratch(spark, "tracks")
    t = a.tracks(spark, d)
    t.withColumn("name", F.col("track_id")).write.partitionBy("name").json(path)
    first = readers.track_files(spark, path, "*.json", readers.json_arrays).where("track_id % 2 = 0")
    done = checkpointed(first)
    return done.unionByName(readers.track_files(spark, path, "*.json", readers.json_arrays, done=done))


@query("sink_python_parts", "SELECT s_suppkey, s_name FROM supplier")
def sink_python_parts(spark: S, d: str) -> D:
    path = scratch(spark, "zstd")
    sinks.parquet_strict(v.table(spark, d, "supplier").select("s_suppkey", "s_name"), path, compression="zstd")
    return spark.read.parquet(path)


# Functions of the user's own: what they are replaced by, and where they stay.


@query("udf_scalar", v.sql(", n AS (SELECT artist_id, row_number() OVER (ORDER BY artist_id) - 1 AS node FROM (SELECT DISTINCT artist_id FROM tracks)) SELECT track_id, node FROM tracks JOIN n USING (artist_id)", "tracks"))
def udf_scalar(spark: S, d: str) -> D:
    """A vocabulary lookup is a join, not a function over a broadcast dictionary."""
    from tessera.operators.ordering import row_numbers

    t = v.tracks(spark, d).select("track_id", "artist_id")
    return t.join(row_numbers(t.select("artist_id").distinct(), ["artist_id"], "node"), "artist_id").select("track_id", "node")


@query("udf_grouped", v.sql("SELECT artist_id AS query, CAST(count(*) AS BIGINT) AS n, round(sum(duration), 2) AS total FROM tracks GROUP BY 1", "tracks"))
def udf_grouped(spark: S, d: str) -> D:
    """A query's rows as one frame: for sequential scoring of bounded lists."""
    import pandas as pd

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"query": [frame["artist_id"].iloc[0]], "n": [len(frame)], "total": [frame["duration"].sum()]})

    found = v.tracks(spark, d).select("artist_id", "duration").groupBy("artist_id").applyInPandas(score, "query bigint, n bigint, total double")
    return found.withColumn("total", F.round("total", 2))


@query("udf_partition", "SELECT event_id, round((value - 40.0::DOUBLE) / 30.0::DOUBLE, 6) AS z FROM events")
def udf_partition(spark: S, d: str) -> D:
    """A frozen model over Arrow batches."""

    def scale(frames):
        for frame in frames:
            yield frame.assign(z=(frame["value"] - 40.0) / 30.0)[["event_id", "z"]]

    found = v.table(spark, d, "events").select("event_id", "value").mapInPandas(scale, "event_id bigint, z double")
    return found.withColumn("z", F.round("z", 6))


@query("hof_lambda", "SELECT vec_id, CAST(len(list_filter(embedding, lambda e: e > 0)) AS INT) AS positive, round(list_sum(list_transform(embedding, lambda e: abs(CAST(e AS DOUBLE)))), 4) AS total FROM embeddings")
def hof_lambda(spark: S, d: str) -> D:
    e = v.table(spark, d, "embeddings")
    total = F.aggregate(F.transform("embedding", lambda c: F.abs(c.cast("double"))), F.lit(0.0), lambda s, c: s + c)
    return e.select("vec_id", F.size(F.filter("embedding", lambda c: c > 0)).alias("positive"), F.round(total, 4).alias("total"))


@query("s_split", v.sql(", k AS (SELECT track_id, CASE WHEN mode = 'P' THEN 'track:' || track_id ELSE 'song:' || artist_id END AS k FROM tracks), u AS (SELECT track_id, CAST(('0x' || substr(sha256('42' || chr(0) || k), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0 AS h FROM k) SELECT track_id, CASE WHEN h < 0.10 THEN 'A' WHEN h < 0.11 THEN 'B_tune' WHEN h < 0.13 THEN 'C' WHEN h >= 0.15 AND h < 0.17 THEN 'B_confirm' ELSE 'remaining' END AS split FROM u", "tracks"))
def s_split(spark: S, d: str) -> D:
    """Splits by song where it is known, so that versions of a song stay together."""
    key = F.when(F.col("mode") == "P", F.concat(F.lit("track:"), "track_id")).otherwise(F.concat(F.lit("song:"), "artist_id"))
    h = x.unit_hash(42, key)
    split = F.when(h < 0.10, "A").when(h < 0.11, "B_tune").when(h < 0.13, "C").when((h >= 0.15) & (h < 0.17), "B_confirm").otherwise("remaining")
    return v.tracks(spark, d).select("track_id", split.alias("split"))


@query("src_sqlite", "SELECT n_nationkey, n_name FROM nation")
def src_sqlite(spark: S, d: str) -> D:
    """A small table out to a SQLite file and back through the row-range source.

    The file is written beside the session's checkpoints, which must be in a
    file system that SQLite can open.
    """
    import os
    import sqlite3
    from urllib.parse import urlparse

    path = urlparse(scratch(spark, "sqlite"))
    rows = v.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    if path.scheme not in ("", "file"):
        raise ValueError(f"SQLite cannot open files of {path.scheme}")
    os.makedirs(os.path.dirname(path.path), exist_ok=True)
    with sqlite3.connect(path.path) as con:
        con.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT)")
        con.executemany("INSERT INTO nation VALUES (?, ?)", [tuple(r) for r in rows.toLocalIterator()])
    found = readers.sqlite(spark, path.path, "nation", 3)
    return found.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")
