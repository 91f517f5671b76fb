"""Interval, target and quality features, and regression models."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as x
from tessera.operators import features, models
from tessera.operators.ordering import group_numbers
from tessera.plans import views as v
from tessera.queries import query
from tessera.queries.relational import _GUESS, _PART, guesses

S, D = SparkSession, DataFrame

# Intervals: a user's events are segments, the value is the signal.

_LENGTHS = """, len AS (SELECT track_id, event_id, start, value, event_type, coalesce(lead(start) OVER (PARTITION BY track_id ORDER BY start, event_id) - start, 60.0) AS length FROM segments)"""


def lengths(spark: S, d: str) -> D:
    return features.segment_lengths(v.segments(spark, d), "track_id", "start", "event_id", 60.0)


@query("a_intervals", v.sql(_LENGTHS + " SELECT event_id, round(length, 3) AS length, start >= 0 AND length > 0 AS valid FROM len", "segments"))
def a_intervals(spark: S, d: str) -> D:
    return lengths(spark, d).select("event_id", F.round("length", 3).alias("length"), "valid")


def _quantile_sql(q: float) -> str:
    return f"coalesce(max(CASE WHEN p <= {q} AND np > {q} THEN value + ({q} - p) / (np - p) * (nv - value) END), CASE WHEN min(p) > {q} THEN min(value) ELSE max(value) END)"


@query("a_weighted_stats", v.sql(_LENGTHS + f""", p AS (SELECT track_id, event_id, value, length, (sum(length) OVER (PARTITION BY track_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) - length / 2) / sum(length) OVER (PARTITION BY track_id) AS p FROM len WHERE length > 0),
n AS (SELECT *, lead(p) OVER (PARTITION BY track_id ORDER BY value, event_id) AS np, lead(value) OVER (PARTITION BY track_id ORDER BY value, event_id) AS nv FROM p)
SELECT track_id, round(sum(value * length) / sum(length), 4) AS mean, round(sqrt(greatest(sum(value * value * length) / sum(length) - (sum(value * length) / sum(length)) ** 2, 0)), 3) AS std, {", ".join(f"round({_quantile_sql(q)}, 4) AS {n}" for n, q in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9)))} FROM n GROUP BY 1""", "segments"))  # fmt: skip
def a_weighted_stats(spark: S, d: str) -> D:
    s = lengths(spark, d).where("length > 0")
    w, value = F.col("length"), F.col("value")
    mean = F.sum(value * w) / F.sum(w)
    std = F.sqrt(F.greatest(F.sum(value * value * w) / F.sum(w) - mean * mean, F.lit(0.0)))
    moments = s.groupBy("track_id").agg(F.round(mean, 4).alias("mean"), F.round(std, 3).alias("std"))
    q = features.weighted_quantiles(s, "track_id", "value", "length", "event_id", {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    return moments.join(q, "track_id").select("track_id", "mean", "std", *(F.round(c, 4).alias(c) for c in ("q10", "q50", "q90")))


@query("a_unweighted_stats", "SELECT user_id, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(quantile_cont(value, 0.1), 4) AS q10, round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.9), 4) AS q90, round(CASE WHEN abs(avg(value)) <= 1e-12 THEN 0 ELSE stddev_pop(value) / avg(value) END, 4) AS cv FROM events GROUP BY 1")
def a_unweighted_stats(spark: S, d: str) -> D:
    value = F.col("value")
    cv = F.when(F.abs(F.avg(value)) <= 1e-12, 0.0).otherwise(x.ratio(F.stddev_pop(value), F.avg(value)))
    at = lambda q: F.round(F.percentile(value, q), 4)
    return v.table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_pop(value), 4).alias("std"), at(0.1).alias("q10"), at(0.5).alias("q50"), at(0.9).alias("q90"), F.round(cv, 4).alias("cv"))


@query("a_interval_stats", v.sql(", g AS (SELECT track_id, start - lag(start) OVER (PARTITION BY track_id ORDER BY start, event_id) AS gap FROM segments) SELECT track_id, round(quantile_cont(gap, 0.5), 3) AS median, round(quantile_cont(gap, 0.75) - quantile_cont(gap, 0.25), 3) AS iqr, round(stddev_pop(gap) / avg(gap), 4) AS cv FROM g WHERE gap > 0 GROUP BY 1", "segments"))
def a_interval_stats(spark: S, d: str) -> D:
    gap = F.col("start") - F.lag("start").over(Window.partitionBy("track_id").orderBy("start", "event_id"))
    g = v.segments(spark, d).select("track_id", gap.alias("gap")).where("gap > 0")
    at = lambda q: F.percentile("gap", q)
    return g.groupBy("track_id").agg(F.round(at(0.5), 3).alias("median"), F.round(at(0.75) - at(0.25), 3).alias("iqr"), F.round(F.stddev_pop("gap") / F.avg("gap"), 4).alias("cv"))


@query("a_pool_window", v.sql(_LENGTHS + """, s AS (SELECT track_id, min(start) AS t0, (max(start + length) - min(start)) / 4 AS step FROM len GROUP BY 1), c AS (SELECT track_id, t0, step, CAST(i AS INT) AS part FROM s, range(4) r(i)),
o AS (SELECT c.track_id, part, value, greatest(least(start + length, t0 + (part + 1) * step) - greatest(start, t0 + part * step), 0) AS w FROM c JOIN len USING (track_id))
SELECT track_id, part, round(sum(value * w) / nullif(sum(w), 0), 4) AS mean, sum(w) > 0 AS available FROM o GROUP BY 1, 2""", "segments"))  # fmt: skip
def a_pool_window(spark: S, d: str) -> D:
    return features.pooled(lengths(spark, d), "track_id", "start", "length", "value", 4).withColumn("mean", F.round("mean", 4))


@query("join_interval_overlap", v.sql(_LENGTHS + ", a AS (SELECT * FROM len WHERE event_type = 'view'), b AS (SELECT * FROM len WHERE event_type = 'click') SELECT a.event_id AS a, b.event_id AS b, round(least(a.start + 3 * a.length, b.start + 3 * b.length) - greatest(a.start, b.start), 3) AS overlap FROM a JOIN b ON a.track_id = b.track_id AND a.start < b.start + 3 * b.length AND b.start < a.start + 3 * a.length", "segments"))
def join_interval_overlap(spark: S, d: str) -> D:
    s = lengths(spark, d).select("track_id", "event_id", "start", (F.col("start") + 3 * F.col("length")).alias("end"), "event_type")
    a = s.where("event_type = 'view'").select("track_id", F.col("event_id").alias("a"), F.col("start").alias("s"), F.col("end").alias("e"))
    b = s.where("event_type = 'click'").select("track_id", F.col("event_id").alias("b"), "start", "end")
    overlap = F.least("e", "end") - F.greatest("s", "start")
    return a.join(b, "track_id").where("s < end and start < e").select("a", "b", F.round(overlap, 3).alias("overlap"))


@query("a_key_relative", "SELECT vec_id, round(CAST(embedding[(label % 12) + 1] AS DOUBLE), 6) AS head, round(CAST(list_sum(embedding[1:12]) AS DOUBLE), 4) AS total FROM embeddings")
def a_key_relative(spark: S, d: str) -> D:
    e = v.table(spark, d, "embeddings").select("vec_id", features.rotated(F.slice("embedding", 1, 12), F.col("label") % 12).alias("r"))
    return e.select("vec_id", F.round(F.col("r")[0].cast("double"), 6).alias("head"), F.round(F.aggregate("r", F.lit(0.0), lambda s, c: s + c), 4).alias("total"))


@query("a_profile", "WITH p AS (SELECT vec_id, list_transform(embedding[1:12], lambda e: abs(CAST(e AS DOUBLE))) AS p FROM embeddings) SELECT vec_id, round(list_sum(list_transform(p, lambda e: CASE WHEN e > 0 THEN -(e / list_sum(p)) * ln(e / list_sum(p)) ELSE 0 END)) / ln(12), 5) AS entropy, round(list_max(p) / list_sum(p), 5) AS top FROM p")
def a_profile(spark: S, d: str) -> D:
    p = v.table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 12), lambda e: F.abs(e.cast("double"))).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda s, e: s + e)
    return p.select("vec_id", F.round(features.entropy(F.col("p")), 5).alias("entropy"), F.round(F.array_max("p") / total, 5).alias("top"))


@query("a_section_change", v.sql(_LENGTHS + """, s AS (SELECT track_id, min(start) AS t0, (max(start + length) - min(start)) / 4 AS step FROM len GROUP BY 1), c AS (SELECT track_id, t0, step, i AS part FROM s, range(4) r(i)),
o AS (SELECT c.track_id, part, value, greatest(least(start + length, t0 + (part + 1) * step) - greatest(start, t0 + part * step), 0) AS w FROM c JOIN len USING (track_id)), m AS (SELECT track_id, part, sum(value * w) / nullif(sum(w), 0) AS mean FROM o GROUP BY 1, 2),
g AS (SELECT track_id, abs(mean - lag(mean) OVER (PARTITION BY track_id ORDER BY part)) AS change FROM m) SELECT track_id, round(avg(change), 4) AS change FROM g GROUP BY 1""", "segments"))  # fmt: skip
def a_section_change(spark: S, d: str) -> D:
    m = features.pooled(lengths(spark, d), "track_id", "start", "length", "value", 4)
    change = F.abs(F.col("mean") - F.lag("mean").over(Window.partitionBy("track_id").orderBy("part")))
    return m.select("track_id", change.alias("change")).groupBy("track_id").agg(F.round(F.avg("change"), 4).alias("change"))


# Preprocessing.


@query("y_fill_median", "WITH m AS (SELECT quantile_disc(quality::DOUBLE, 0.5) AS q FROM labels) SELECT doc_id, coalesce(quality::DOUBLE, q) AS quality FROM documents LEFT JOIN labels USING (doc_id), m")
def y_fill_median(spark: S, d: str) -> D:
    joined = v.table(spark, d, "documents").select("doc_id").join(v.table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id", "left")
    return features.filled_with_median(joined, ["quality"])


@query("y_clip_log", "WITH b AS (SELECT quantile_disc(value, 0.01) AS lo, quantile_disc(value, 0.99) AS hi FROM events) SELECT event_id, round(ln(1 + greatest(least(greatest(value, lo), hi), 0)), 6) AS value FROM events, b")
def y_clip_log(spark: S, d: str) -> D:
    return features.clipped_log(v.table(spark, d, "events").select("event_id", "value"), ["value"]).withColumn("value", F.round("value", 6))


@query("y_drop_constant", "SELECT p_partkey, p_retailprice, p_size FROM part")
def y_drop_constant(spark: S, d: str) -> D:
    p = v.table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size", F.lit(1.0).alias("constant"))
    return p.select("p_partkey", *features.varying(p, ["p_retailprice", "p_size", "constant"]))


@query("y_frozen_preprocess", "WITH f AS (SELECT value FROM events WHERE event_id % 2 = 0), a AS (SELECT quantile_disc(value, 0.5) AS m, quantile_disc(value, 0.01) AS lo, quantile_disc(value, 0.99) AS hi FROM f), e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value FROM events) SELECT event_id, round(ln(1 + greatest(least(greatest(coalesce(value, m), lo), hi), 0)), 6) AS value FROM e, a")
def y_frozen_preprocess(spark: S, d: str) -> D:
    """Medians and bounds of one half, saved with the columns they are for, read again, checked and applied to all."""
    import json

    from tessera.queries.sources import scratch
    from tessera.sources import sinks

    e = v.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"))
    fitted = features.fitted(v.table(spark, d, "events").where("event_id % 2 = 0"), ["value"])
    path = scratch(spark, "preprocess")
    sinks.json_published(spark, fitted, path)
    saved = json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))
    return features.applied(e, ["value"], saved).select("event_id", F.round("value", 6).alias("value"))


# Tags, neighbours, priors.


@query("t_tag_counts", v.sql("SELECT artist_id, count(*) FILTER (source = 'term') AS terms, count(*) FILTER (source = 'mbtag') AS mbtags, count(*) AS total FROM tags GROUP BY 1", "tags"))
def t_tag_counts(spark: S, d: str) -> D:
    return v.tags(spark, d).groupBy("artist_id").agg(F.count_if(F.col("source") == "term").alias("terms"), F.count_if(F.col("source") == "mbtag").alias("mbtags"), F.count("*").alias("total"))


@query("t_tag_indicator", v.sql(", top AS (SELECT tag, row_number() OVER (ORDER BY count(*) DESC, tag) AS k FROM tags WHERE source = 'mbtag' GROUP BY tag) SELECT artist_id, " + ", ".join(f"CAST(coalesce(max(CASE WHEN k = {k} THEN 1 END), 0) AS INT) AS tag_{k}" for k in range(1, 6)) + " FROM tags LEFT JOIN top ON top.tag = tags.tag AND source = 'mbtag' GROUP BY 1", "tags"))
def t_tag_indicator(spark: S, d: str) -> D:
    t = v.tags(spark, d)
    top = [r["tag"] for r in t.where("source = 'mbtag'").groupBy("tag").count().orderBy(F.desc("count"), "tag").limit(5).collect()]
    hot = [F.coalesce(F.max(F.when((F.col("tag") == tag) & (F.col("source") == "mbtag"), 1)), F.lit(0)).alias(f"tag_{k}") for k, tag in enumerate(top, 1)]
    return t.groupBy("artist_id").agg(*hot)


@query("t_loo_prior", v.sql(""", y AS (SELECT artist_id, avg(year)::DOUBLE AS target FROM tracks WHERE artist_id % 5 <> 0 GROUP BY 1), g AS (SELECT avg(target) AS g FROM y), o AS (SELECT artist_id, tag FROM tags WHERE source = 'mbtag'),
s AS (SELECT tag, sum(target) AS s, count(*) AS n FROM o JOIN y USING (artist_id) GROUP BY 1), p AS (SELECT o.artist_id, (s - coalesce(target, 0) + 5.0 * g) / (n - CASE WHEN target IS NULL THEN 0 ELSE 1 END + 5.0) AS prior, n FROM o JOIN s USING (tag) LEFT JOIN y ON y.artist_id = o.artist_id, g)
SELECT artist_id, count(*) AS n, round(avg(prior), 5) AS mean, round(stddev_pop(prior), 4) AS std, round(min(prior), 5) AS least, round(max(prior), 5) AS most, round(avg(n), 4) AS support FROM p GROUP BY 1""", "tracks", "tags"))  # fmt: skip
def t_loo_prior(spark: S, d: str) -> D:
    targets = v.tracks(spark, d).where("artist_id % 5 <> 0").groupBy("artist_id").agg(F.avg("year").alias("target"))
    tags = v.tags(spark, d).where("source = 'mbtag'").select("artist_id", "tag")
    found = features.leave_one_out_prior(tags, targets, 5.0)
    return found.select("artist_id", "n", F.round("mean", 5).alias("mean"), F.round("std", 4).alias("std"), F.round("least", 5).alias("least"), F.round("most", 5).alias("most"), F.round("support", 4).alias("support"))


@query("t_neighbor_year", v.sql(""", y AS (SELECT artist_id, avg(year)::DOUBLE AS year FROM tracks GROUP BY 1), r AS (SELECT e.artist_id, y.year, row_number() OVER (PARTITION BY e.artist_id ORDER BY edge_order, similar_artist_id) AS k FROM similar_ e JOIN y ON y.artist_id = similar_artist_id)
SELECT artist_id, count(*) AS n, round(avg(year), 5) AS mean, round(stddev_pop(year), 4) AS std, round(min(year), 5) AS least, round(max(year), 5) AS most, round(quantile_disc(year, 0.5), 5) AS q50, """ + ", ".join(f"round(avg(year) FILTER (k <= {k}), 5) AS top{k}" for k in (1, 3, 5)) + ", round(max(year) FILTER (k = 2), 5) AS second FROM r GROUP BY 1", "tracks", "similar"))  # fmt: skip
def t_neighbor_year(spark: S, d: str) -> D:
    y = v.tracks(spark, d).groupBy(F.col("artist_id").alias("similar_artist_id")).agg(F.avg("year").alias("year"))
    k = F.row_number().over(Window.partitionBy("artist_id").orderBy("edge_order", "similar_artist_id"))
    r = v.similar(spark, d).join(y, "similar_artist_id").withColumn("k", k)
    year, rank = F.col("year"), F.col("k")
    tops = [F.round(F.avg(F.when(rank <= n, year)), 5).alias(f"top{n}") for n in (1, 3, 5)]
    return r.groupBy("artist_id").agg(F.count("*").alias("n"), F.round(F.avg(year), 5).alias("mean"), F.round(F.stddev_pop(year), 4).alias("std"), F.round(F.min(year), 5).alias("least"), F.round(F.max(year), 5).alias("most"), F.round(F.percentile_approx(year, 0.5, 1_000_000), 5).alias("q50"), *tops, F.round(F.max(F.when(rank == 2, year)), 5).alias("second"))


@query("t_location", "SELECT c_custkey, CASE WHEN c_acctbal / 100 BETWEEN -90 AND 90 THEN round(c_acctbal / 100, 6) END AS latitude, CASE WHEN c_acctbal / 100 BETWEEN -90 AND 90 THEN CAST(c_nationkey * 15 - 180 AS DOUBLE) END AS longitude, CASE WHEN c_acctbal / 100 BETWEEN -90 AND 90 THEN 0.0::DOUBLE ELSE 1.0 END AS location_missing, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 480000 GROUP BY 1) ON o_custkey = c_custkey")
def t_location(spark: S, d: str) -> D:
    """Places off the map are missing and stay so; only counts and indicators are filled with zero."""
    n = v.table(spark, d, "orders").where("o_totalprice > 480000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    c = v.table(spark, d, "customer").join(n, "c_custkey", "left")
    latitude = F.col("c_acctbal") / 100
    known = latitude.between(-90, 90)
    return c.select("c_custkey", F.when(known, F.round(latitude, 6)).alias("latitude"), F.when(known, (F.col("c_nationkey") * 15 - 180).cast("double")).alias("longitude"), F.when(known, 0.0).otherwise(1.0).alias("location_missing"), "orders").fillna(0, ["orders"])


_ERA = """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'the ' || year(o_orderdate) // 10 * 10 || 's' WHEN 1 THEN 'rock 80s hits' WHEN 2 THEN '00s' ELSE 'no era' END AS t FROM orders),
n AS (SELECT o_orderkey, list_filter(regexp_extract_all(t, '([0-9]+)', 1), lambda w: len(w) = 4 AND w[4] = '0' AND CAST(w AS INT) BETWEEN 1920 AND 2010) AS years, list_filter(regexp_extract_all(t, '([0-9]+)s', 1), lambda w: len(w) = 2 AND w[2] = '0' AND w <> '10') AS decades FROM t)
SELECT o_orderkey, CASE WHEN len(years) > 0 THEN CAST(years[1] AS INT) WHEN decades[1] = '00' THEN 2000 WHEN len(decades) > 0 THEN 1900 + CAST(decades[1] AS INT) END AS era FROM n"""


@query("str_era", _ERA)
def str_era(spark: S, d: str) -> D:
    key = F.col("o_orderkey") % 4
    text = F.when(key == 0, F.concat(F.lit("the "), x.decade(F.year("o_orderdate")).cast("string"), F.lit("s"))).when(key == 1, "rock 80s hits").when(key == 2, "00s").otherwise("no era")
    return v.table(spark, d, "orders").select("o_orderkey", x.era(text).alias("era"))


# Splits, metrics, models.


_SPLIT = _PART + ", split AS (SELECT track_id, artist_id, CASE WHEN year BETWEEN 1922 AND 2011 THEN year END AS label, CASE WHEN artist_id % 10 = 0 THEN 'test' WHEN part < 1000 THEN 'validation' ELSE 'train' END AS split FROM tracks JOIN part USING (artist_id))"


@query("d_split_artist", v.sql(_SPLIT + " SELECT * FROM split", "tracks"))
def d_split_artist(spark: S, d: str) -> D:
    part = F.pmod(F.xxhash64(F.concat(F.lit("472:"), "artist_id")), F.lit(10000))
    label = F.when(F.col("year").between(1922, 2011), F.col("year"))
    return v.tracks(spark, d).select("track_id", "artist_id", label.alias("label"), F.when(F.col("artist_id") % 10 == 0, "test").when(part < 1000, "validation").otherwise("train").alias("split"))


@query("d_isolation", v.sql(""", s AS (SELECT artist_id, release_id % 7 = 0 AS odd FROM tracks), by_artist AS (SELECT artist_id, count(DISTINCT CASE WHEN artist_id % 10 = 0 THEN 'test' ELSE 'train' END) AS n FROM s GROUP BY 1), by_row AS (SELECT artist_id, count(DISTINCT odd) AS n FROM s GROUP BY 1)
SELECT (SELECT count(*) FROM by_artist WHERE n > 1) AS by_artist, (SELECT count(*) FROM by_row WHERE n > 1) AS by_row""", "tracks"))  # fmt: skip
def d_isolation(spark: S, d: str) -> D:
    """Artists in two splits: of the split by artist, and of one by release, which breaks the rule."""
    t = v.tracks(spark, d).select("artist_id", F.when(F.col("artist_id") % 10 == 0, "test").otherwise("train").alias("split"), (F.col("release_id") % 7 == 0).alias("odd"))
    n = t.groupBy("artist_id").agg(F.countDistinct("split").alias("a"), F.countDistinct("odd").alias("b"))
    return n.agg(F.count_if(F.col("a") > 1).alias("by_artist"), F.count_if(F.col("b") > 1).alias("by_row"))


@query("r_constant", v.sql(", c AS (SELECT avg(year) AS m, quantile_disc(year, 0.5) AS q FROM tracks WHERE artist_id % 10 <> 0) SELECT round(avg(abs(year - m)), 6) AS mean_mae, round(sqrt(avg((year - m) ** 2)), 6) AS mean_rmse, round(avg(abs(year - q)), 6) AS median_mae, round(avg(q - year), 6) AS median_signed FROM tracks, c WHERE artist_id % 10 = 0", "tracks"))
def r_constant(spark: S, d: str) -> D:
    t = v.tracks(spark, d)
    c = t.where("artist_id % 10 <> 0").agg(F.avg("year").alias("m"), F.percentile_approx("year", 0.5, 1_000_000).alias("q"))  # a hundred years: exact
    test = t.where("artist_id % 10 = 0").join(F.broadcast(c), F.lit(True))
    e, f = F.col("year") - F.col("m"), F.col("year") - F.col("q")
    return test.agg(F.round(F.avg(F.abs(e)), 6).alias("mean_mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("mean_rmse"), F.round(F.avg(F.abs(f)), 6).alias("median_mae"), F.round(F.avg(-f), 6).alias("median_signed"))


def _training(spark: S, d: str) -> D:
    lines = v.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("track_id")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("k"), F.count("*").alias("n"))
    t = v.tracks(spark, d).join(lines, "track_id").select("track_id", "artist_id", ((F.col("year") - 1995) / 6).alias("y"), (F.col("q") / 50 - 0.5).alias("f1"), (F.col("k") * 10 - 0.5).alias("f2"), (F.col("n") / 7.0 - 0.5).alias("f3"))
    return t


_LINES = """WITH RECURSIVE l AS (SELECT l_orderkey, avg(l_quantity) / 50 - 0.5 AS f1, avg(l_discount) * 10 - 0.5 AS f2, count(*) / 7.0::DOUBLE - 0.5 AS f3 FROM lineitem GROUP BY 1),
t AS (SELECT f1::DOUBLE AS f1, f2::DOUBLE AS f2, f3::DOUBLE AS f3, (year(o_orderdate) - 1995) / 6.0::DOUBLE AS y0, o_custkey FROM orders JOIN l ON l_orderkey = o_orderkey), t1 AS (SELECT *, y0 - (SELECT avg(y0) FROM t) AS y FROM t)"""
_F = ("f1", "f2", "f3", "1")
_PRODUCTS = ", ".join(f"sum({_F[a]} * {_F[b]}) AS g{a}{b}" for a in range(4) for b in range(4)) + ", " + ", ".join(f"sum({_F[a]} * y) AS c{a}" for a in range(4))
_SLOPE = [f"2 * ({' + '.join(f'g{a}{b} * w{b}' for b in range(4))} - c{a}) / n" for a in range(4)]
_LOSS = "(" + " + ".join(f"w{a} * g{a}{b} * w{b}" for a in range(4) for b in range(4)) + " - 2 * (" + " + ".join(f"w{a} * c{a}" for a in range(4)) + ") + yy) / n + 0.001::DOUBLE * (w0 * w0 + w1 * w1 + w2 * w2)"


@query("r_ridge_gd", _LINES + f""", g AS (SELECT count(*)::DOUBLE AS n, sum(y * y) AS yy, {_PRODUCTS} FROM t1),
s(step, w0, w1, w2, w3) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT step + 1, {", ".join(f"w{a} - 0.08::DOUBLE * ({_SLOPE[a]}{f' + 0.002::DOUBLE * w{a}' if a < 3 else ''})" for a in range(4))} FROM s, g WHERE step < 100)
SELECT step, round({_LOSS}, 6) AS loss, round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2, round(w3 + (SELECT avg(y0) FROM t), 6) AS intercept FROM s, g WHERE step IN (0, 1, 10, 50, 99, 100)""")  # fmt: skip
def r_ridge_gd(spark: S, d: str) -> D:
    """A hundred full steps from two passes over the rows: weights before some steps and after the last, with their losses."""
    t = _training(spark, d)
    center = float(t.agg(F.avg("y")).first()[0] or 0.0)
    sums = models.moments(t, F.array("f1", "f2", "f3"), "y", center).get(0, np.zeros((5, 5)))
    rows, w, decay = [], np.zeros(4), np.array([1.0, 1.0, 1.0, 0.0])
    for step in range(101):
        loss, gradient = models.quadratic(sums, w)
        if step in (0, 1, 10, 50, 99, 100):
            rows.append((step, float(loss + 0.001 * (decay * w) @ w), *(float(e) for e in w[:3]), float(w[3]) + center))
        w = w - 0.08 * (gradient + 0.002 * decay * w)
    found = spark.createDataFrame(rows, "step int, loss double, w0 double, w1 double, w2 double, intercept double")
    return found.select("step", *(F.round(c, 6).alias(c) for c in found.columns[1:]))


@query("r_ridge_minibatch")
def r_ridge_minibatch(spark: S, d: str) -> D:
    """A hundred steps, each on its own quarter of the rows."""
    weights, intercept, losses = models.ridge_descent(_training(spark, d), ["f1", "f2", "f3"], "y", fraction=0.25, id_col="track_id")
    return spark.createDataFrame([(i, float(loss), float(intercept), [float(w) for w in weights]) for i, loss in enumerate(losses)], "step int, loss double, intercept double, weights array<double>")


@query("r_kernel_gd")
def r_kernel_gd(spark: S, d: str) -> D:
    """A hundred steps at most on random features, stopped by the held-out loss."""
    t = models.fourier_features(_training(spark, d), ["f1", "f2", "f3"], 64, 0.5, 42)
    weights, bias, history = models.kernel_descent(t.where("artist_id % 10 <> 0"), "rff", "y", held=t.where("artist_id % 10 = 0"))
    return spark.createDataFrame([(i, float(a), float(b), float(bias), [float(w) for w in weights]) for i, (a, b) in enumerate(history)], "step int, loss double, held_loss double, intercept double, weights array<double>")


@query("r_kernel_huber")
def r_kernel_huber(spark: S, d: str) -> D:
    """The same on Huber's loss, a pass a step."""
    t = models.fourier_features(_training(spark, d), ["f1", "f2", "f3"], 16, 0.5, 42)
    _, bias, history = models.kernel_descent(t.where("artist_id % 10 <> 0"), "rff", "y", held=t.where("artist_id % 10 = 0"), steps=10, huber=0.5)
    return spark.createDataFrame([(i, float(a), float(b), float(bias)) for i, (a, b) in enumerate(history)], "step int, loss double, held_loss double, intercept double")


@query("r_rff")
def r_rff(spark: S, d: str) -> D:
    return models.fourier_features(_training(spark, d), ["f1", "f2", "f3"], 1024, 0.5, 42).select("track_id", F.transform(F.slice("rff", 1, 8), lambda e: F.round(e, 6)).alias("first"), F.round(F.aggregate("rff", F.lit(0.0), lambda s, e: s + e * e), 6).alias("square"))


@query("r_lightgbm")
def r_lightgbm(spark: S, d: str) -> D:
    """Trees with row weights by decade, categories, and early stopping on validation artists."""
    t = _training(spark, d).withColumn("year", F.round(F.col("y") * 6 + 1995))
    weighed = t.join(F.broadcast(models.decade_weights(t, "year")), x.decade(F.col("year")) == F.col("decade"))  # a row a decade
    fitted = weighed.where("artist_id % 10 <> 0").withColumn("validation", F.col("artist_id") % 10 == 1)
    model = models.boosted_trees(fitted, ["f1", "f2", "f3"], "y", weight="weight", validation="validation", slots=8, maxIter=20, maxDepth=3)
    return model.transform(t.where("artist_id % 10 = 0")).select("track_id", "prediction", F.lit(model.stages[-1].getNumTrees).alias("trees"))


@query("m_logistic")
def m_logistic(spark: S, d: str) -> D:
    """The penalty grid; a constant column gets nothing."""
    t = _training(spark, d).withColumn("label", (F.col("f1") + F.col("f2") > F.col("y") - 0.2).cast("double")).withColumn("w", 1 + F.col("track_id") % 3).withColumn("constant", F.lit(1.0))
    found = models.logistic(t, ["f1", "f2", "f3", "constant"], "label", "w")
    return spark.createDataFrame([(penalty, bias, [float(c) for c in w]) for penalty, (bias, w) in found.items()], "penalty double, intercept double, coefficients array<double>")


@query("r_decade_weight", v.sql(", c AS (SELECT CAST(floor(year / 10) * 10 AS INT) AS decade, count(*) AS n FROM tracks GROUP BY 1), w AS (SELECT *, least(power((SELECT max(n) FROM c) / n::DOUBLE, 0.5), 5.0) AS w FROM c) SELECT decade, n, round(w / (SELECT sum(w * n) / sum(n) FROM w), 6) AS weight FROM w", "tracks"))
def r_decade_weight(spark: S, d: str) -> D:
    return models.decade_weights(v.tracks(spark, d), "year").withColumn("weight", F.round("weight", 6))


@query("r_folds", v.sql(", a AS (SELECT artist_id, CAST(floor(max(year) / 10) * 10 AS INT) AS decade FROM tracks GROUP BY 1), f AS (SELECT CAST((row_number() OVER (PARTITION BY decade ORDER BY sha256('472' || chr(0) || artist_id), artist_id) - 1) % 5 AS INT) AS fold, artist_id FROM a) SELECT fold, count(*) AS artists FROM f GROUP BY 1", "tracks"))
def r_folds(spark: S, d: str) -> D:
    a = v.tracks(spark, d).groupBy("artist_id").agg(x.decade(F.max("year")).alias("decade"))
    numbered = group_numbers(a.withColumn("h", x.digest(472, F.col("artist_id"))), ["decade"], ["h", "artist_id"], "k")
    return numbered.select(F.pmod("k", F.lit(5)).cast("int").alias("fold")).groupBy("fold").agg(F.count("*").alias("artists"))


@query("r_oof_merge", v.sql(f", g AS ({_GUESS}) SELECT track_id, CAST(artist_id % 5 AS INT) AS fold, guess FROM g", "tracks"))
def r_oof_merge(spark: S, d: str) -> D:
    g = guesses(spark, d).select("track_id", (F.col("artist_id") % 5).cast("int").alias("fold"), "guess")
    folds = [g.where(F.col("fold") == k) for k in range(5)]
    merged = folds[0]
    for part in folds[1:]:
        merged = merged.unionByName(part)
    return merged


@query("r_stack", v.sql(f", g AS ({_GUESS}), p AS (SELECT year, guess AS a, year + (track_id % 7 - 3) AS b FROM g) SELECT round(least(greatest(sum((a - b) * (year - b)) / sum((a - b) ** 2), 0), 1), 6) AS weight FROM p", "tracks"))
def r_stack(spark: S, d: str) -> D:
    p = guesses(spark, d).select("year", F.col("guess").alias("a"), (F.col("year") + (F.col("track_id") % 7 - 3)).alias("b"))
    return models.stack_weight(p, "a", "b", "year").withColumn("weight", F.round("weight", 6))


def _det(m: list[list[str]]) -> str:
    """A determinant of three rows, as SQL."""
    minor = lambda i, j: f"({m[1][i]} * {m[2][j]} - {m[1][j]} * {m[2][i]})"
    return f"({m[0][0]} * {minor(1, 2)} - {m[0][1]} * {minor(0, 2)} + {m[0][2]} * {minor(0, 1)})"


_NORMAL = [["n", "sa", "sb"], ["sa", "aa", "ab"], ["sb", "ab", "bb"]]
_CRAMER = [f"{_det([[('sy', 'ta', 'tb')[i] if j == k else _NORMAL[i][j] for j in range(3)] for i in range(3)])} / {_det(_NORMAL)}" for k in range(3)]


@query("r_linear_ensemble", v.sql(f", g AS ({_GUESS}), p AS (SELECT year - 1995.0::DOUBLE AS y, guess - 1995.0::DOUBLE AS a, year - 1995.0::DOUBLE + (track_id % 7 - 3) AS b FROM g), s AS (SELECT count(*)::DOUBLE AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(y) AS sy, sum(a * y) AS ta, sum(b * y) AS tb FROM p) SELECT round({_CRAMER[0]}, 6) AS intercept, round({_CRAMER[1]}, 6) AS a, round({_CRAMER[2]}, 6) AS b FROM s", "tracks"))
def r_linear_ensemble(spark: S, d: str) -> D:
    p = guesses(spark, d).select((F.col("year") - 1995.0).alias("y"), (F.col("guess") - 1995).alias("a"), (F.col("year") - 1995 + (F.col("track_id") % 7 - 3)).alias("b"))
    found = np.round(models.linear_ensemble(p, ["a", "b"], "y"), 6)
    return spark.createDataFrame([tuple(float(c) for c in found)], "intercept double, a double, b double")


_Q = "round(avg(abs(c - year)), 6) AS mae, round(sqrt(avg((c - year) ** 2)), 6) AS rmse, round(quantile_cont(abs(c - year), 0.5), 6) AS median_ae, round(avg(CASE WHEN abs(c - year) <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_5, round(avg(CASE WHEN abs(c - year) <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_10, round(avg(c - year), 6) AS signed, round(avg(abs(guess - year)), 6) AS raw_mae, round(sqrt(avg((guess - year) ** 2)), 6) AS raw_rmse, round(avg(CASE WHEN guess < 1922 OR guess > 2000 THEN 1.0::DOUBLE ELSE 0 END), 6) AS out_of_range, CAST(min(guess) AS DOUBLE) AS least, CAST(max(guess) AS DOUBLE) AS most"


def _rounded(df: D) -> D:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("q_metrics", v.sql(f", g AS ({_GUESS}), p AS (SELECT year, guess, least(greatest(guess, 1922), 2000) AS c FROM g) SELECT count(*) AS n, {_Q} FROM p", "tracks"))
def q_metrics(spark: S, d: str) -> D:
    return _rounded(models.regression_metrics(guesses(spark, d), "guess", "year", 1922.0, 2000.0))


@query("q_decade", v.sql(f", g AS ({_GUESS}), p AS (SELECT CAST(floor(year / 10) * 10 AS INT) AS decade, year, guess, least(greatest(guess, 1922), 2000) AS c FROM g) SELECT decade, count(*) AS n, {_Q} FROM p GROUP BY 1", "tracks"))
def q_decade(spark: S, d: str) -> D:
    g = guesses(spark, d).withColumn("decade", x.decade(F.col("year")))
    return _rounded(models.regression_metrics(g, "guess", "year", 1922.0, 2000.0, ["decade"]))


@query("q_validators", """SELECT 'orders' AS part, 'null_key' AS rule, count(*) FILTER (o_orderkey IS NULL) AS violations FROM orders UNION ALL SELECT 'orders', 'repeated_key', count(*) - count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'orders', 'not_finite', count(*) FILTER (o_totalprice IS NULL OR isnan(o_totalprice) OR isinf(o_totalprice)) FROM orders UNION ALL SELECT 'orders', 'not_positive', count(*) FILTER (o_totalprice <= 0) FROM orders UNION ALL SELECT 'orders', 'unknown_status', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders
UNION ALL SELECT 'orders', 'no_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'labels', 'not_binary', count(*) FILTER (quality NOT IN (0, 1) OR toxic NOT IN (0, 1)) FROM labels UNION ALL SELECT 'labels', 'unlabelled', (SELECT count(*) FROM documents) - count(*) FROM labels
UNION ALL SELECT 'events', 'out_of_bounds', count(*) FILTER (value NOT BETWEEN 0 AND 100) FROM events UNION ALL SELECT 'events', 'masked', count(*) FILTER (event_type = 'error' AND value > 50) FROM events
UNION ALL SELECT 'embeddings', 'wrong_size', count(*) FILTER (len(embedding) <> 64) FROM embeddings UNION ALL SELECT 'embeddings', 'wrong_schema', 0 FROM embeddings HAVING count(*) > 0""")
def q_validators(spark: S, d: str) -> D:
    """Schema, keys, nulls, finite and binary values, bounds, masks, references and counts, each as violations."""
    from tessera.operators.checks import schema_violations, violations

    t = lambda name: v.table(spark, d, name)
    price = F.col("o_totalprice")
    parts = {
        "orders": violations(t("orders"), {"null_key": F.col("o_orderkey").isNull(), "not_finite": ~x.finite(price), "not_positive": price <= 0, "unknown_status": ~F.col("o_orderstatus").isin("F", "O")}, key="o_orderkey"),
        "labels": violations(t("labels"), {"not_binary": ~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0, 1)}),
        "events": violations(t("events"), {"out_of_bounds": ~F.col("value").between(0, 100), "masked": (F.col("event_type") == "error") & (F.col("value") > 50)}),
        "embeddings": violations(t("embeddings"), {"wrong_size": F.size("embedding") != 64}).unionByName(schema_violations(t("embeddings"), {"vec_id": "bigint", "embedding": "array<float>", "label": "int"})),
    }
    lost = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.lit("no_customer").alias("rule"), F.count("*").alias("violations"))
    parts["orders"] = parts["orders"].unionByName(lost)
    gap = t("documents").agg(F.count("*").alias("n")).join(F.broadcast(t("labels").agg(F.count("*").alias("m"))), F.lit(True))
    parts["labels"] = parts["labels"].unionByName(gap.select(F.lit("unlabelled").alias("rule"), (F.col("n") - F.col("m")).alias("violations")))
    named = [df.select(F.lit(part).alias("part"), "rule", "violations") for part, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


@query("q_mask_nulls", "SELECT count(*) FILTER (quality IS NULL AND toxic IS NOT NULL) AS violations FROM documents LEFT JOIN labels USING (doc_id)")
def q_mask_nulls(spark: S, d: str) -> D:
    joined = v.table(spark, d, "documents").select("doc_id").join(v.table(spark, d, "labels"), "doc_id", "left")
    return joined.agg(F.count_if(F.col("quality").isNull() & F.col("toxic").isNotNull()).alias("violations"))


@query("q_ratio_identity", v.sql(", f AS (SELECT track_id, duration, duration * (track_id % 10) / 100 AS a, CASE WHEN track_id % 7 = 0 THEN NULL ELSE duration * (60 + track_id % 30) / 100 END AS b FROM tracks), r AS (SELECT track_id, a / duration AS x, (b - a) / duration AS y, (duration - b) / duration + CASE WHEN track_id % 13 = 0 THEN 1e-9::DOUBLE ELSE 0 END AS z FROM f) SELECT count(*) AS rows, count(x + y + z) AS judged, count(*) FILTER (abs(x + y + z - 1) > 1e-12::DOUBLE) AS violations FROM r", "tracks"))
def q_ratio_identity(spark: S, d: str) -> D:
    """Where all three are known, the parts of a track add up to one; some rows break this."""
    t, k, n = v.tracks(spark, d), F.col("track_id"), F.col("duration")
    a, b = n * (k % 10) / 100, F.when(k % 7 != 0, n * (60 + k % 30) / 100)
    total = x.ratio(a, n) + x.ratio(b - a, n) + (x.ratio(n - b, n) + F.when(k % 13 == 0, 1e-9).otherwise(0.0))
    return t.select(total.alias("total")).agg(F.count("*").alias("rows"), F.count("total").alias("judged"), F.count_if(F.abs(F.col("total") - 1) > 1e-12).alias("violations"))


@query("q_coverage", "SELECT lang AS split, round(avg(CASE WHEN quality IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS labelled, round(avg(CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def q_coverage(spark: S, d: str) -> D:
    joined = v.table(spark, d, "documents").select("doc_id", "lang").join(v.table(spark, d, "labels"), "doc_id", "left")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return joined.groupBy(F.col("lang").alias("split")).agg(share(F.col("quality").isNotNull()).alias("labelled"), share(F.col("toxic") == 1).alias("toxic"))


@query("q_availability_score", "SELECT l_orderkey, l_linenumber, l_partkey, CAST((l_discount > 0)::INT + (l_tax > 0)::INT + (l_quantity > 25)::INT AS INT) AS score FROM lineitem")
def q_availability_score(spark: S, d: str) -> D:
    score = sum((F.when(c, 1).otherwise(0) for c in (F.col("l_discount") > 0, F.col("l_tax") > 0, F.col("l_quantity") > 25)), F.lit(0))
    return v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", score.alias("score"))


_UNIT = "list_transform({0}, lambda z: z / sqrt(list_inner_product({0}, {0})))"


@query("q_reproduction", f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_transform(CAST(embedding AS DOUBLE[]), lambda z: round(z, 2)) AS f FROM embeddings), u AS (SELECT vec_id, {_UNIT.format("e")} AS a, {_UNIT.format("f")} AS b FROM e WHERE vec_id % 10 <> 3 OR vec_id < 100),
w AS (SELECT e.vec_id, list_max(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))) AS worst FROM e LEFT JOIN u USING (vec_id)) SELECT count(*) AS compared, count(*) FILTER (worst IS NULL) AS missing, count(*) FILTER (worst > 0.0051::DOUBLE) AS off, round(max(worst), 6) AS worst FROM w""")
def q_reproduction(spark: S, d: str) -> D:
    """Vectors made again from coarser input: how many are missing, how many differ by more than a tolerance."""
    e = v.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("e"))
    again = e.where("vec_id % 10 <> 3 or vec_id < 100").select("vec_id", x.unit(F.transform("e", lambda c: F.round(c, 2))).alias("b"))
    worst = F.array_max(F.zip_with("a", "b", lambda p, q: F.abs(p - q)))
    w = e.select("vec_id", x.unit(F.col("e")).alias("a")).join(again, "vec_id", "left").select(worst.alias("worst"))
    return w.agg(F.count("*").alias("compared"), F.count_if(F.col("worst").isNull()).alias("missing"), F.count_if(F.col("worst") > 0.0051).alias("off"), F.round(F.max("worst"), 6).alias("worst"))


# Supervision.


@query("s_loss_weights", v.sql(", n AS (SELECT artist_id, count(*) FILTER (mode = 'F') AS p, count(*) FILTER (mode = 'O') AS h, count(*) FILTER (mode = 'P') AS r FROM tracks GROUP BY 1) SELECT artist_id, p, CASE WHEN h > 0 THEN round(least((0.75 * (h + r)) / h, 20.0), 6) END AS hard_weight, CASE WHEN r > 0 THEN round(((h + r) - CASE WHEN h > 0 THEN least((0.75 * (h + r)) / h, 20.0) * h ELSE 0 END) / r, 6) END AS random_weight FROM n", "tracks"))
def s_loss_weights(spark: S, d: str) -> D:
    n = v.tracks(spark, d).groupBy("artist_id").agg(*(F.count_if(F.col("mode") == m).alias(c) for m, c in (("F", "p"), ("O", "h"), ("P", "r"))))
    h, r = F.col("h"), F.col("r")
    hard = F.when(h > 0, F.least(x.ratio(0.75 * (h + r), h), F.lit(20.0)))
    rest = F.when(r > 0, x.ratio((h + r) - F.coalesce(hard * h, F.lit(0.0)), r))
    return n.select("artist_id", "p", F.round(hard, 6).alias("hard_weight"), F.round(rest, 6).alias("random_weight"))


@query("s_source_balanced", v.sql(""", c AS (SELECT release_id AS q, track_id AS c, mode AS source FROM tracks UNION ALL SELECT release_id, track_id, title FROM tracks), n AS (SELECT q, source, count(*) AS n FROM c GROUP BY 1, 2),
o AS (SELECT c.q, c.c, c.source, row_number() OVER (PARTITION BY c.q, c.c ORDER BY n, c.source) AS k FROM c JOIN n ON n.q = c.q AND n.source = c.source), r AS (SELECT q, c, source, row_number() OVER (PARTITION BY q, source ORDER BY sha256('42' || chr(0) || c), c) AS pass FROM o WHERE k = 1)
SELECT q, c, source, row_number() OVER (PARTITION BY q ORDER BY pass, source) AS place FROM r QUALIFY place <= 3""", "tracks"))  # fmt: skip
def s_source_balanced(spark: S, d: str) -> D:
    t = v.tracks(spark, d)
    c = t.select(F.col("release_id").alias("q"), F.col("track_id").alias("c"), F.col("mode").alias("source")).unionByName(t.select(F.col("release_id").alias("q"), F.col("track_id").alias("c"), F.col("title").alias("source")))
    n = c.groupBy("q", "source").agg(F.count("*").alias("n"))
    owned = c.join(n, ["q", "source"]).groupBy("q", "c").agg(F.min(F.struct("n", "source")).alias("m")).select("q", "c", "m.source")
    each = owned.withColumn("pass", F.row_number().over(Window.partitionBy("q", "source").orderBy(x.digest(42, F.col("c")), "c")))
    return each.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("pass", "source")).cast("long")).where("place <= 3").drop("pass")


@query("s_nohard_delta", v.sql("SELECT track_id, mode FROM tracks WHERE mode <> 'O' UNION ALL SELECT track_id, 'random' FROM tracks WHERE mode = 'O'", "tracks"))
def s_nohard_delta(spark: S, d: str) -> D:
    t = v.tracks(spark, d).select("track_id", "mode")
    return t.where("mode <> 'O'").unionByName(t.where("mode = 'O'").withColumn("mode", F.lit("random")))


def _mixture(spark: S, d: str, epochs: int):
    from tessera.operators import moe

    t = _training(spark, d).select("track_id", "artist_id", F.array("f1", "f2", "f3").alias("x"), F.round(F.col("y") * 6 + 1995).alias("year"))
    shape = moe.Shape(3)
    p, history = moe.train(t.where("artist_id % 10 <> 0"), shape, "track_id", "x", "year", held=t.where("artist_id % 10 = 1"), epochs=epochs)
    return t, shape, p, history


@query("r_ordinal_moe")
def r_ordinal_moe(spark: S, d: str) -> D:
    from tessera.operators import moe

    t, shape, p, _ = _mixture(spark, d, 8)
    return moe.predict(t.where("artist_id % 10 = 0"), shape, p, "track_id", "x")


@query("r_moe_schedule")
def r_moe_schedule(spark: S, d: str) -> D:
    """Epochs with rate, sampled rows, loss, gradient norm and held-out error of each head."""
    *_, history = _mixture(spark, d, 8)
    kinds = {int: "long", float: "double", bool: "boolean"}
    return spark.createDataFrame([tuple(h.values()) for h in history], ", ".join(f"{k} {kinds[type(e)]}" for k, e in history[0].items()))


@query("r_tune")
def r_tune(spark: S, d: str) -> D:
    """The search over four stages."""
    t = _training(spark, d).persist()
    _, rows = models.tuned(t.where("artist_id % 10 <> 0"), t.where("artist_id % 10 = 0"), ["f1", "f2", "f3"], "y", maxIter=3)
    t.unpersist()
    return spark.createDataFrame(rows, "stage string, settings string, mae double, chosen boolean")


@query("hash_schema")
def hash_schema(spark: S, d: str) -> D:
    """Digests of each table's ordered columns."""
    import hashlib

    rows = [(t, hashlib.sha256(v.table(spark, d, t).schema.json().encode()).hexdigest()) for t in ("orders", "lineitem", "part", "customer")]
    return spark.createDataFrame(rows, "name string, digest string")


@query("hash_assignments", v.sql(_SPLIT + " SELECT CAST(sum(CAST('0x' || substr(sha256(track_id || chr(0) || split), 1, 15) AS HUGEINT)) AS VARCHAR) AS digest, count(*) AS n FROM split", "tracks"))
def hash_assignments(spark: S, d: str) -> D:
    """One digest of a table's rows that does not depend on their order: the sum of the rows' hashes."""
    t = d_split_artist(spark, d)
    row = F.conv(F.substring(F.sha2(F.concat_ws("\0", "track_id", "split"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return t.agg(F.sum(row).cast("string").alias("digest"), F.count("*").alias("n"))


@query("agg_partial_fold", _LINES + f" SELECT {', '.join(f'round(sum({_F[a]} * {_F[b]}), 4) AS g{a}{b}' for a in range(4) for b in range(a, 4))}, {', '.join(f'round(sum({_F[a]} * y), 4) AS c{a}' for a in range(4))} FROM t1")
def agg_partial_fold(spark: S, d: str) -> D:
    """Sums of products: a matrix from each task, added up."""
    t = _training(spark, d)
    m = models.moments(t, F.array("f1", "f2", "f3"), "y", float(t.agg(F.avg("y")).first()[0] or 0.0)).get(0, np.zeros((5, 5)))
    names = [f"g{a}{b}" for a in range(4) for b in range(a, 4)] + [f"c{a}" for a in range(4)]
    values = [float(m[a, b]) for a in range(4) for b in range(a, 4)] + [float(m[a, 4]) for a in range(4)]
    found = spark.createDataFrame([tuple(values)], ", ".join(f"{n} double" for n in names))
    return found.select(*(F.round(n, 4).alias(n) for n in names))


@query("r_lightgbm_eval")
def r_lightgbm_eval(spark: S, d: str) -> D:
    """A saved model, loaded again, on the test artists; the columns must be those it was fitted on."""
    import hashlib

    from pyspark.ml import PipelineModel

    from tessera.queries.sources import scratch

    t, columns = _training(spark, d), ["f1", "f2", "f3"]
    contract = lambda names: hashlib.sha256("\0".join(names).encode()).hexdigest()
    path = scratch(spark, "model")
    models.boosted_trees(t.where("artist_id % 10 <> 0"), columns, "y", maxIter=5, maxDepth=3).write().save(f"{path}/model")
    spark.createDataFrame([(contract(columns),)], "contract string").write.json(f"{path}/contract")
    model = PipelineModel.load(f"{path}/model")
    if spark.read.json(f"{path}/contract").first()[0] != contract(model.stages[0].getInputCols()):
        raise ValueError("the model was fitted on other columns")
    return models.regression_metrics(model.transform(t.where("artist_id % 10 = 0")), "prediction", "y", -5.0, 5.0)
