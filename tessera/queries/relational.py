"""Projections, filters, joins, aggregations, windows, orders, sets and row generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as x
from tessera.operators.graph import apart_two
from tessera.operators.ordering import group_numbers
from tessera.plans import hashes
from tessera.plans import views as v
from tessera.queries import query

S, D = SparkSession, DataFrame


# Catalog queries: four shapes with total orders.


@query("agg_global", v.sql("SELECT CAST(min(year) AS INT) AS min_year, CAST(max(year) AS INT) AS max_year, count(*) AS n, round(avg(duration), 4) AS avg_duration FROM tracks", "tracks"))
def agg_global(spark: S, d: str) -> D:
    return v.tracks(spark, d).agg(F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.count("*").alias("n"), F.round(F.avg("duration"), 4).alias("avg_duration"))


@query("top_lexicographic", v.sql(""", lines AS (SELECT l_orderkey, count(*) AS n, max(l_discount) AS hot FROM lineitem GROUP BY 1)
SELECT t.track_id, t.title, coalesce(hot, 0.0) AS hot, t.duration, CAST(CASE WHEN n IS NULL THEN 1 ELSE 0 END AS INT) AS missing FROM tracks t LEFT JOIN lines ON l_orderkey = track_id
WHERE t.duration > 0 ORDER BY missing ASC, hot DESC, t.duration ASC, t.year DESC, t.track_id ASC LIMIT 1""", "tracks"))  # fmt: skip
def top_lexicographic(spark: S, d: str) -> D:
    lines = v.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_discount").alias("hot"))
    joined = v.tracks(spark, d).where("duration > 0").join(lines, F.col("l_orderkey") == F.col("track_id"), "left")
    rows = joined.select("track_id", "title", F.coalesce("hot", F.lit(0.0)).alias("hot"), "duration", "year", F.col("n").isNull().cast("int").alias("missing"))
    return rows.orderBy(F.asc("missing"), F.desc("hot"), F.asc("duration"), F.desc("year"), F.asc("track_id")).limit(1).drop("year")


@query("top_group_agg", v.sql("SELECT release_id, count(DISTINCT track_id) AS n_tracks FROM tracks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", "tracks"))
def top_group_agg(spark: S, d: str) -> D:
    return v.tracks(spark, d).groupBy("release_id").agg(F.countDistinct("track_id").alias("n_tracks")).orderBy(F.desc("n_tracks"), "release_id").limit(1)


@query("top_row", v.sql("SELECT track_id, artist_id, duration FROM tracks ORDER BY duration DESC, track_id LIMIT 1", "tracks"))
def top_row(spark: S, d: str) -> D:
    return v.tracks(spark, d).orderBy(F.desc("duration"), "track_id").limit(1).select("track_id", "artist_id", "duration")


# Projections.


@query("prj_select_alias", v.sql("SELECT CAST(track_id AS VARCHAR) AS id, CAST(duration AS BIGINT) AS seconds, year AS y FROM tracks".replace("CAST(duration AS BIGINT)", "CAST(floor(duration) AS BIGINT)"), "tracks"))
def prj_select_alias(spark: S, d: str) -> D:
    return v.tracks(spark, d).select(F.col("track_id").cast("string").alias("id"), F.floor("duration").cast("bigint").alias("seconds"), F.col("year").alias("y"))


@query("prj_contract_view", v.sql("SELECT track_id, artist_id, year, duration, release_id FROM tracks", "tracks"))
def prj_contract_view(spark: S, d: str) -> D:
    audit, features = ["track_id", "artist_id", "year"], ["duration", "release_id"]
    return v.tracks(spark, d).select(*audit, *features)


@query("prj_literal_edge", v.sql("SELECT 'track' AS src_type, CAST(track_id AS VARCHAR) AS src_id, 'artist' AS dst_type, CAST(artist_id AS VARCHAR) AS dst_id, false AS directed, 'track_artist' AS edge_type FROM tracks", "tracks"))
def prj_literal_edge(spark: S, d: str) -> D:
    return v.tracks(spark, d).select(F.lit("track").alias("src_type"), F.col("track_id").cast("string").alias("src_id"), F.lit("artist").alias("dst_type"), F.col("artist_id").cast("string").alias("dst_id"), F.lit(False).alias("directed"), F.lit("track_artist").alias("edge_type"))


@query("prj_case_bucket", v.sql(", n AS (SELECT artist_id, count(*) AS tracks FROM tracks GROUP BY 1) SELECT CASE WHEN tracks < 2 THEN '1' WHEN tracks = 2 THEN '2' WHEN tracks <= 5 THEN '3_5' WHEN tracks <= 20 THEN '6_20' ELSE '21_plus' END AS stratum, count(*) AS artists FROM n GROUP BY 1", "tracks"))
def prj_case_bucket(spark: S, d: str) -> D:
    n = v.tracks(spark, d).groupBy("artist_id").agg(F.count("*").alias("tracks"))
    stratum = F.when(F.col("tracks") < 2, "1").when(F.col("tracks") == 2, "2").when(F.col("tracks") <= 5, "3_5").when(F.col("tracks") <= 20, "6_20").otherwise("21_plus")
    return n.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("artists"))


@query("prj_slices", v.sql(", r AS (SELECT release_id, count(*) AS degree FROM tracks GROUP BY 1) SELECT track_id, CASE WHEN degree = 1 THEN 'single' WHEN degree <= 5 THEN 'small' ELSE 'large' END AS release_slice, CASE WHEN duration IS NULL THEN 'missing' WHEN duration < 100000 THEN 'low' WHEN duration < 300000 THEN 'middle' ELSE 'high' END AS popularity_slice FROM tracks JOIN r USING (release_id)", "tracks"))
def prj_slices(spark: S, d: str) -> D:
    t = v.tracks(spark, d)
    degree = t.groupBy("release_id").agg(F.count("*").alias("degree"))
    size = F.when(F.col("degree") == 1, "single").when(F.col("degree") <= 5, "small").otherwise("large")
    popular = F.when(F.col("duration").isNull(), "missing").when(F.col("duration") < 100000, "low").when(F.col("duration") < 300000, "middle").otherwise("high")
    return t.join(degree, "release_id").select("track_id", size.alias("release_slice"), popular.alias("popularity_slice"))


@query("prj_coalesce_key", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'song:' || user_id ELSE 'track:' || event_id END AS song_key FROM events")
def prj_coalesce_key(spark: S, d: str) -> D:
    e = v.table(spark, d, "events")
    return e.select("event_id", F.coalesce(F.when(F.col("event_type") == "view", F.concat(F.lit("song:"), "user_id")), F.concat(F.lit("track:"), "event_id")).alias("song_key"))


@query("prj_decade", v.sql("SELECT track_id, CAST(floor(year / 10) * 10 AS INT) AS decade FROM tracks", "tracks"))
def prj_decade(spark: S, d: str) -> D:
    return v.tracks(spark, d).select("track_id", x.decade(F.col("year")).alias("decade"))


@query("prj_normalize_year", v.sql("SELECT track_id, round((year - 1922) / 89.0, 9) AS scaled, CAST(round((year - 1922) / 89.0 * 89 + 1922, 6) AS DOUBLE) AS back FROM tracks", "tracks"))
def prj_normalize_year(spark: S, d: str) -> D:
    scaled = x.normalized_year(F.col("year"))
    return v.tracks(spark, d).select("track_id", F.round(scaled, 9).alias("scaled"), F.round(scaled * 89 + 1922, 6).alias("back"))


@query("prj_clip", "SELECT event_id, CASE WHEN value IS NULL THEN NULL ELSE least(greatest(value, 10.0), 100.0) END AS clipped FROM events")
def prj_clip(spark: S, d: str) -> D:
    return v.table(spark, d, "events").select("event_id", x.clip(F.col("value"), 10.0, 100.0).alias("clipped"))


_FADE = "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS duration, l_discount * l_extendedprice AS fade_in, (1 - l_tax) * l_extendedprice AS fade_out FROM lineitem"


def _fades(spark: S, d: str) -> D:
    price = F.col("l_extendedprice")
    return v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", price.alias("duration"), (F.col("l_discount") * price).alias("fade_in"), ((1 - F.col("l_tax")) * price).alias("fade_out"))


@query("prj_fade_ratio_strict", f"""WITH f AS ({_FADE}), m AS (SELECT *, duration > 0 AND fade_in >= 0 AND fade_out >= fade_in AND fade_out <= duration + 0.001 AS ok FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN ok THEN round(fade_in / duration, 6) END AS intro, CASE WHEN ok THEN round((fade_out - fade_in) / duration, 6) END AS body, CASE WHEN ok THEN round((duration - fade_out) / duration, 6) END AS outro FROM m""")  # fmt: skip
def prj_fade_ratio_strict(spark: S, d: str) -> D:
    f = _fades(spark, d)
    a, b, n = F.col("fade_in"), F.col("fade_out"), F.col("duration")
    ok = x.finite(a) & x.finite(b) & x.finite(n) & (n > 0) & (a >= 0) & (b >= a) & (b <= n + 0.001)
    part = lambda value, name: F.when(ok, F.round(x.ratio(value, n), 6)).alias(name)
    return f.select("l_orderkey", "l_linenumber", "l_partkey", part(a, "intro"), part(b - a, "body"), part(n - b, "outro"))


@query("prj_fade_ratio_masked", f"""WITH f AS ({_FADE}) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN duration > 0 AND fade_in >= 0 THEN round(least(greatest(fade_in / duration, 0.0), 1.0), 6) END AS intro,
CASE WHEN duration > 0 AND fade_out >= 0 THEN round(least(greatest(1.0 - fade_out / duration, 0.0), 1.0), 6) END AS outro FROM f""")  # fmt: skip
def prj_fade_ratio_masked(spark: S, d: str) -> D:
    a, b, n = F.col("fade_in"), F.col("fade_out"), F.col("duration")
    return _fades(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", F.when((n > 0) & (a >= 0), F.round(x.clip(x.ratio(a, n), 0.0, 1.0), 6)).alias("intro"), F.when((n > 0) & (b >= 0), F.round(x.clip(1.0 - x.ratio(b, n), 0.0, 1.0), 6)).alias("outro"))


@query("prj_circular", "SELECT p_partkey, CASE WHEN p_size BETWEEN 0 AND 11 THEN round(sin(p_size * 2 * pi() / 12), 6) ELSE 0.0 END AS key_sin, CASE WHEN p_size BETWEEN 0 AND 11 THEN round(cos(p_size * 2 * pi() / 12), 6) ELSE 0.0 END AS key_cos FROM part")
def prj_circular(spark: S, d: str) -> D:
    sine, cosine = x.circular(F.col("p_size"), 12)
    zero = lambda c: F.when(F.round(c, 6) == 0, 0.0).otherwise(F.round(c, 6))  # noqa: E731  no negative zero
    return v.table(spark, d, "part").select("p_partkey", zero(sine).alias("key_sin"), zero(cosine).alias("key_cos"))


@query("prj_onehot", "SELECT p_partkey, " + ", ".join(f"CASE WHEN p_size = {k} THEN 1.0::DOUBLE ELSE 0.0 END AS meter_{k}" for k in (3, 4, 5, 6, 7)) + ", CASE WHEN p_size IN (3, 4, 5, 6, 7) THEN 0.0::DOUBLE ELSE 1.0 END AS meter_unknown FROM part")
def prj_onehot(spark: S, d: str) -> D:
    size = F.col("p_size")
    hot = [F.when(size == k, 1.0).otherwise(0.0).alias(f"meter_{k}") for k in (3, 4, 5, 6, 7)]
    return v.table(spark, d, "part").select("p_partkey", *hot, F.when(size.isin(3, 4, 5, 6, 7), 0.0).otherwise(1.0).alias("meter_unknown"))


@query("prj_clean_category", "SELECT p_partkey, CASE WHEN p_size BETWEEN 0 AND 11 THEN p_size END AS key FROM part")
def prj_clean_category(spark: S, d: str) -> D:
    return v.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size").between(0, 11), F.col("p_size")).alias("key"))


@query("prj_missing_flag", "SELECT doc_id, CASE WHEN quality IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS quality_missing FROM documents LEFT JOIN labels USING (doc_id)")
def prj_missing_flag(spark: S, d: str) -> D:
    labels = v.table(spark, d, "labels").select("doc_id", "quality")
    return v.table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.when(F.col("quality").isNull(), 1.0).otherwise(0.0).alias("quality_missing"))


@query("prj_map_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.5 END AS weight FROM orders")
def prj_map_lookup(spark: S, d: str) -> D:
    weights = F.create_map(F.lit("F"), F.lit(1.0), F.lit("O"), F.lit(0.5))
    return v.table(spark, d, "orders").select("o_orderkey", F.element_at(weights, F.col("o_orderstatus")).alias("weight"))


# Filters.


@query("flt_finite", "SELECT event_id, value FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)")
def flt_finite(spark: S, d: str) -> D:
    return v.table(spark, d, "events").where(x.finite(F.col("value"))).select("event_id", "value")


@query("flt_any_nonfinite_wide", "SELECT count(*) AS bad FROM lineitem WHERE l_quantity IS NULL OR isnan(l_quantity) OR l_tax IS NULL OR isnan(l_tax) OR l_discount IS NULL OR isnan(l_discount) OR l_extendedprice > 90000")
def flt_any_nonfinite_wide(spark: S, d: str) -> D:
    columns = F.array("l_quantity", "l_tax", "l_discount")
    bad = F.exists(columns, lambda c: ~x.finite(c)) | (F.col("l_extendedprice") > 90000)
    return v.table(spark, d, "lineitem").where(bad).agg(F.count("*").alias("bad"))


@query("flt_array_exists", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda e: abs(e) > 0.35)) > 0 AND len(list_filter(embedding, lambda e: isnan(e))) = 0")
def flt_array_exists(spark: S, d: str) -> D:
    e = F.col("embedding")
    return v.table(spark, d, "embeddings").where(F.exists(e, lambda c: F.abs(c) > F.lit(0.35)) & F.forall(e, lambda c: ~F.isnan(c))).select("vec_id")


@query("flt_regex_id", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '^Customer.*[05]$')")
def flt_regex_id(spark: S, d: str) -> D:
    return v.table(spark, d, "customer").where(F.col("c_name").rlike("^Customer.*[05]$")).select("c_custkey")


@query("flt_in_between", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 200000")
def flt_in_between(spark: S, d: str) -> D:
    return v.table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(1000, 200000)).select("o_orderkey")


@query("flt_null_safe_eq", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT DISTINCT FROM (CASE WHEN toxic = 1 THEN 1 END)")
def flt_null_safe_eq(spark: S, d: str) -> D:
    joined = v.table(spark, d, "documents").select("doc_id").join(v.table(spark, d, "labels"), "doc_id", "left")
    return joined.where(F.col("quality").eqNullSafe(F.when(F.col("toxic") == 1, 1))).select("doc_id")


@query("flt_exists_probe", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS any_bad, EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 0) AS any_good")
def flt_exists_probe(spark: S, d: str) -> D:
    price = F.col("o_totalprice")
    return v.table(spark, d, "orders").agg(F.coalesce(F.bool_or(price < 0), F.lit(False)).alias("any_bad"), F.coalesce(F.bool_or(price > 0), F.lit(False)).alias("any_good"))


@query("flt_same_song", v.sql("SELECT a.track_id, b.track_id AS other FROM tracks a JOIN tracks b ON a.artist_id = b.artist_id AND a.track_id < b.track_id WHERE a.release_id IS DISTINCT FROM b.release_id AND a.year = b.year", "tracks"))
def flt_same_song(spark: S, d: str) -> D:
    a = v.tracks(spark, d)
    b = a.select(F.col("track_id").alias("other"), "artist_id", F.col("release_id").alias("other_release"), F.col("year").alias("other_year"))
    near = (F.col("track_id") < F.col("other")) & (F.col("year") == F.col("other_year"))
    return a.join(b, "artist_id").where(near & ~F.col("release_id").eqNullSafe(F.col("other_release"))).select("track_id", "other")


# Joins.


@query("join_inner_key", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner_key(spark: S, d: str) -> D:
    return v.table(spark, d, "orders").join(v.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("join_inner_multi", v.sql(", a AS (SELECT artist_id, release_id, count(*) AS n FROM tracks GROUP BY 1, 2) SELECT track_id, n FROM tracks JOIN a USING (artist_id, release_id)", "tracks"))
def join_inner_multi(spark: S, d: str) -> D:
    t = v.tracks(spark, d)
    return t.join(t.groupBy("artist_id", "release_id").agg(F.count("*").alias("n")), ["artist_id", "release_id"]).select("track_id", "n")


@query("join_left", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1) ON o_custkey = c_custkey")
def join_left(spark: S, d: str) -> D:
    n = v.table(spark, d, "orders").where("o_totalprice > 400000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return v.table(spark, d, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "n").fillna(0, ["n"])


@query("join_left_star", v.sql(""", t AS (SELECT artist_id, count(*) AS terms FROM tags WHERE source = 'term' GROUP BY 1), m AS (SELECT artist_id, count(*) AS mbtags FROM tags WHERE source = 'mbtag' GROUP BY 1),
o AS (SELECT artist_id, count(*) AS out_degree FROM similar_ GROUP BY 1), i AS (SELECT similar_artist_id AS artist_id, count(*) AS in_degree FROM similar_ GROUP BY 1), y AS (SELECT artist_id, min(year) AS first_year FROM tracks GROUP BY 1)
SELECT c_custkey AS artist_id, coalesce(terms, 0) AS terms, coalesce(mbtags, 0) AS mbtags, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree, first_year, n_name AS country
FROM customer LEFT JOIN t ON t.artist_id = c_custkey LEFT JOIN m ON m.artist_id = c_custkey LEFT JOIN o ON o.artist_id = c_custkey LEFT JOIN i ON i.artist_id = c_custkey LEFT JOIN y ON y.artist_id = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""", "tracks", "tags", "similar"))  # fmt: skip
def join_left_star(spark: S, d: str) -> D:
    tags, similar = v.tags(spark, d), v.similar(spark, d)
    counts = tags.groupBy("artist_id").agg(F.count_if(F.col("source") == "term").alias("terms"), F.count_if(F.col("source") == "mbtag").alias("mbtags"))
    out = similar.groupBy("artist_id").agg(F.count("*").alias("out_degree"))
    inward = similar.groupBy(F.col("similar_artist_id").alias("artist_id")).agg(F.count("*").alias("in_degree"))
    first = v.tracks(spark, d).groupBy("artist_id").agg(F.min("year").alias("first_year"))
    spine = v.table(spark, d, "customer").select(F.col("c_custkey").alias("artist_id"), "c_nationkey")
    country = v.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    for part in (counts, out, inward, first):
        spine = spine.join(part, "artist_id", "left")
    return spine.join(country, "c_nationkey", "left").drop("c_nationkey").fillna(0, ["terms", "mbtags", "out_degree", "in_degree"])


@query("join_left_marker", "SELECT c_custkey, h.o_custkey IS NOT NULL AS has_large FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 450000) h ON o_custkey = c_custkey")
def join_left_marker(spark: S, d: str) -> D:
    large = v.table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("marker", F.lit(True))
    return v.table(spark, d, "customer").join(large, "c_custkey", "left").select("c_custkey", F.col("marker").isNotNull().alias("has_large"))


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def join_anti(spark: S, d: str) -> D:
    large = v.table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return v.table(spark, d, "customer").join(large, "c_custkey", "left_anti").select("c_custkey")


@query("join_semi_emulated", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def join_semi_emulated(spark: S, d: str) -> D:
    large = v.table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return v.table(spark, d, "customer").join(large, "c_custkey", "left_semi").select("c_custkey")


@query("join_broadcast", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_broadcast(spark: S, d: str) -> D:
    # Nations and regions are fixed tables of tens of rows; the optimizer sees their size and broadcasts them.
    places = v.table(spark, d, "nation").join(v.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return v.table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("join_theta_post", v.sql("SELECT q.track_id AS query_track_id, c.track_id AS candidate_track_id FROM tracks q JOIN tracks c ON q.artist_id = c.artist_id AND q.track_id <> c.track_id AND q.release_id <> c.release_id", "tracks"))
def join_theta_post(spark: S, d: str) -> D:
    q = v.tracks(spark, d).select(F.col("track_id").alias("query_track_id"), "artist_id", F.col("release_id").alias("q_release"))
    c = v.tracks(spark, d).select(F.col("track_id").alias("candidate_track_id"), "artist_id", "release_id")
    return q.join(c, "artist_id").where("query_track_id <> candidate_track_id and q_release <> release_id").select("query_track_id", "candidate_track_id")


@query("join_triangular", v.sql("SELECT a.track_id AS q, b.track_id AS c FROM tracks a JOIN tracks b ON a.release_id = b.release_id AND a.track_id < b.track_id", "tracks"))
def join_triangular(spark: S, d: str) -> D:
    t = v.tracks(spark, d)
    return t.select(F.col("track_id").alias("q"), "release_id").join(t.select(F.col("track_id").alias("c"), "release_id"), "release_id").where("q < c").select("q", "c")


@query("join_self_group", v.sql("SELECT a.track_id AS q, b.track_id AS c, a.release_id = b.release_id AS same_release FROM tracks a JOIN tracks b ON a.artist_id = b.artist_id AND a.track_id <> b.track_id", "tracks"))
def join_self_group(spark: S, d: str) -> D:
    a = v.tracks(spark, d).select(F.col("track_id").alias("q"), "artist_id", F.col("release_id").alias("r"))
    b = v.tracks(spark, d).select(F.col("track_id").alias("c"), "artist_id", "release_id")
    return a.join(b, "artist_id").where("q <> c").select("q", "c", (F.col("r") == F.col("release_id")).alias("same_release"))


@query("join_two_hop", v.sql("SELECT a.artist_id AS q, b.similar_artist_id AS c, count(*) AS paths FROM similar_ a JOIN similar_ b ON a.similar_artist_id = b.artist_id WHERE a.artist_id <> b.similar_artist_id GROUP BY 1, 2", "similar"))
def join_two_hop(spark: S, d: str) -> D:
    found = apart_two(v.follows(spark, d).select(F.col("artist_id").alias("src"), F.col("similar_artist_id").alias("dst")))
    return found.where("paths > 0").select(F.col("src").alias("q"), F.col("dst").alias("c"), "paths")


@query("join_symdiff_check", "SELECT count(*) AS differences FROM (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))")
def join_symdiff_check(spark: S, d: str) -> D:
    left, right = v.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), v.table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return left.join(right, "k", "left_anti").union(right.join(left, "k", "left_anti")).agg(F.count("*").alias("differences"))


@query("join_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS first_half, b.n AS second_half FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice < 20000 GROUP BY 1) a FULL OUTER JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice >= 480000 GROUP BY 1) b ON a.k = b.k")
def join_full_outer(spark: S, d: str) -> D:
    o = v.table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    a = o.where("o_totalprice < 20000").groupBy("k").agg(F.count("*").alias("first_half"))
    return a.join(o.where("o_totalprice >= 480000").groupBy("k").agg(F.count("*").alias("second_half")), "k", "full_outer")


# Aggregations.


@query("agg_group", v.sql("SELECT year, count(*) AS n, round(avg(duration), 4) AS mean, min(duration) AS least, max(duration) AS most FROM tracks GROUP BY 1", "tracks"))
def agg_group(spark: S, d: str) -> D:
    return v.tracks(spark, d).groupBy("year").agg(F.count("*").alias("n"), F.round(F.avg("duration"), 4).alias("mean"), F.min("duration").alias("least"), F.max("duration").alias("most"))


@query("agg_count_distinct", v.sql("SELECT count(DISTINCT artist_id) AS artists, count(DISTINCT (artist_id, release_id)) AS pairs FROM tracks", "tracks"))
def agg_count_distinct(spark: S, d: str) -> D:
    return v.tracks(spark, d).agg(F.countDistinct("artist_id").alias("artists"), F.countDistinct("artist_id", "release_id").alias("pairs"))


@query("agg_conditional", v.sql("SELECT year, CAST(sum(CASE WHEN mode = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished, count(*) FILTER (duration > 250000) AS large FROM tracks GROUP BY 1", "tracks"))
def agg_conditional(spark: S, d: str) -> D:
    return v.tracks(spark, d).groupBy("year").agg(F.sum(F.when(F.col("mode") == "F", 1).otherwise(0)).alias("finished"), F.count_if(F.col("duration") > 250000).alias("large"))


@query("agg_argmin_struct", v.sql("SELECT artist_id, min(duration) AS duration, arg_min(track_id, (duration, track_id)) AS track_id FROM tracks GROUP BY 1", "tracks"))
def agg_argmin_struct(spark: S, d: str) -> D:
    least = v.tracks(spark, d).where("duration is not null").groupBy("artist_id").agg(F.min(F.struct("duration", "track_id")).alias("m"))
    return least.select("artist_id", "m.duration", "m.track_id")


@query("agg_any_flag", v.sql("SELECT artist_id, CAST(max(CASE WHEN duration > 400000 THEN 1 ELSE 0 END) AS INT) AS any_large FROM tracks GROUP BY 1", "tracks"))
def agg_any_flag(spark: S, d: str) -> D:
    return v.tracks(spark, d).groupBy("artist_id").agg(F.coalesce(F.bool_or(F.col("duration") > 400000), F.lit(False)).cast("int").alias("any_large"))


@query("agg_stddev", v.sql("SELECT year, round(stddev_pop(duration), 3) AS pop, round(stddev_samp(duration), 3) AS samp FROM tracks GROUP BY 1", "tracks"))
def agg_stddev(spark: S, d: str) -> D:
    return v.tracks(spark, d).groupBy("year").agg(F.round(F.stddev_pop("duration"), 3).alias("pop"), F.round(F.stddev_samp("duration"), 3).alias("samp"))


_GUESS = "SELECT track_id, artist_id, year, year + (track_id % 21 - 10) * 0.75::DOUBLE AS guess FROM tracks"


def guesses(spark: S, d: str) -> D:
    """Tracks with a made-up prediction of the year."""
    return v.tracks(spark, d).select("track_id", "artist_id", "year", (F.col("year") + (F.col("track_id") % 21 - 10) * 0.75).alias("guess"))


@query("agg_rmse_mae", v.sql(f", g AS ({_GUESS}) SELECT round(sqrt(avg((guess - year) ** 2)), 6) AS rmse, round(avg(abs(guess - year)), 6) AS mae FROM g", "tracks"))
def agg_rmse_mae(spark: S, d: str) -> D:
    e = F.col("guess") - F.col("year")
    return guesses(spark, d).agg(F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(F.abs(e)), 6).alias("mae"))


@query("agg_rate", v.sql(f", g AS ({_GUESS}) SELECT round(avg(CASE WHEN abs(guess - year) <= 5 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS within_5 FROM g", "tracks"))
def agg_rate(spark: S, d: str) -> D:
    return guesses(spark, d).agg(F.round(F.avg(F.when(F.abs(F.col("guess") - F.col("year")) <= 5, 1.0).otherwise(0.0)), 6).alias("within_5"))


@query("agg_percentile_approx", v.sql("SELECT year, quantile_disc(duration, 0.5) AS median, quantile_disc(duration, 0.9) AS q90 FROM tracks GROUP BY 1", "tracks"))
def agg_percentile_approx(spark: S, d: str) -> D:
    at = lambda q: F.percentile_approx("duration", q, 1_000_000)
    return v.tracks(spark, d).groupBy("year").agg(at(0.5).alias("median"), at(0.9).alias("q90"))


@query("agg_approx_quantile", v.sql("SELECT quantile_disc(duration, 0.01) AS p01, quantile_disc(duration, 0.99) AS p99 FROM tracks", "tracks"))
def agg_approx_quantile(spark: S, d: str) -> D:
    return v.tracks(spark, d).agg(F.percentile_approx("duration", 0.01, 1_000_000).alias("p01"), F.percentile_approx("duration", 0.99, 1_000_000).alias("p99"))


@query("agg_quantile_linear", v.sql("SELECT year, round(quantile_cont(duration, 0.25), 4) AS q25, round(quantile_cont(duration, 0.75), 4) AS q75 FROM tracks GROUP BY 1", "tracks"))
def agg_quantile_linear(spark: S, d: str) -> D:
    return v.tracks(spark, d).groupBy("year").agg(F.round(F.percentile("duration", 0.25), 4).alias("q25"), F.round(F.percentile("duration", 0.75), 4).alias("q75"))


@query("agg_quantile_nearest", v.sql(", r AS (SELECT year, duration, row_number() OVER (PARTITION BY year ORDER BY duration) AS k, count(*) OVER (PARTITION BY year) AS n FROM tracks) SELECT year, duration AS p90 FROM r WHERE k = ceil(0.9 * n)", "tracks"))
def agg_quantile_nearest(spark: S, d: str) -> D:
    w = Window.partitionBy("year")
    ranked = v.tracks(spark, d).select("year", "duration", F.row_number().over(w.orderBy("duration")).alias("k"), F.count("*").over(w).alias("n"))
    return ranked.where(F.col("k") == F.ceil(0.9 * F.col("n"))).select("year", F.col("duration").alias("p90"))


@query("agg_collect_sorted", v.sql("SELECT artist_id, list(track_id ORDER BY duration, track_id) AS tracks FROM tracks GROUP BY 1".replace("list(track_id ORDER BY duration, track_id)", "string_agg(CAST(track_id AS VARCHAR), ',' ORDER BY duration, track_id)"), "tracks"))
def agg_collect_sorted(spark: S, d: str) -> D:
    rows = v.tracks(spark, d).groupBy("artist_id").agg(F.sort_array(F.collect_list(F.struct("duration", "track_id"))).alias("s"))
    return rows.select("artist_id", F.array_join(F.transform("s", lambda s: s["track_id"].cast("string")), ",").alias("tracks"))


@query("agg_collect_set", v.sql("SELECT artist_id, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes FROM tracks GROUP BY 1", "tracks"))
def agg_collect_set(spark: S, d: str) -> D:
    return v.tracks(spark, d).groupBy("artist_id").agg(F.array_join(F.sort_array(F.collect_set("mode")), ",").alias("modes"))


@query("agg_pivot_indicator", v.sql("SELECT artist_id, " + ", ".join(f"CAST(max(CASE WHEN mode = '{m}' THEN 1 ELSE 0 END) AS INT) AS mode_{m}" for m in "FOP") + " FROM tracks GROUP BY 1", "tracks"))
def agg_pivot_indicator(spark: S, d: str) -> D:
    wide = v.tracks(spark, d).groupBy("artist_id").pivot("mode", ["F", "O", "P"]).agg(F.lit(1)).fillna(0)
    return wide.select("artist_id", *(F.col(m).cast("int").alias(f"mode_{m}") for m in "FOP"))


@query("agg_filtered_topk", v.sql(", r AS (SELECT artist_id, duration, row_number() OVER (PARTITION BY artist_id ORDER BY duration DESC, track_id) AS k FROM tracks) SELECT artist_id, " + ", ".join(f"round(avg(duration) FILTER (k <= {k}), 4) AS top{k}" for k in (1, 3, 5, 10)) + " FROM r GROUP BY 1", "tracks"))
def agg_filtered_topk(spark: S, d: str) -> D:
    k = F.row_number().over(Window.partitionBy("artist_id").orderBy(F.desc("duration"), "track_id"))
    ranked = v.tracks(spark, d).select("artist_id", "duration", k.alias("k"))
    return ranked.groupBy("artist_id").agg(*(F.round(F.avg(F.when(F.col("k") <= n, F.col("duration"))), 4).alias(f"top{n}") for n in (1, 3, 5, 10)))


@query("agg_distinct_rows", v.sql("SELECT DISTINCT artist_id, year FROM tracks", "tracks"))
def agg_distinct_rows(spark: S, d: str) -> D:
    return v.tracks(spark, d).select("artist_id", "year").distinct()


@query("agg_partial_vector", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS s1, round(sum(l_quantity * l_quantity), 2) AS s2, round(sum(l_discount), 2) AS t1, round(sum(l_discount * l_discount), 4) AS t2 FROM lineitem")
def agg_partial_vector(spark: S, d: str) -> D:
    q, t = F.col("l_quantity"), F.col("l_discount")
    return v.table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.round(F.sum(q), 2).alias("s1"), F.round(F.sum(q * q), 2).alias("s2"), F.round(F.sum(t), 2).alias("t1"), F.round(F.sum(t * t), 4).alias("t2"))


@query("agg_macro_mean", v.sql(", g AS (SELECT mode, avg(duration) AS m FROM tracks GROUP BY 1) SELECT round(avg(m), 4) AS macro FROM g", "tracks"))
def agg_macro_mean(spark: S, d: str) -> D:
    return v.tracks(spark, d).groupBy("mode").agg(F.avg("duration").alias("m")).agg(F.round(F.avg("m"), 4).alias("macro"))


@query("agg_histogram_pct", "WITH h AS (SELECT l_quantity AS q, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT q, sum(n) OVER (ORDER BY q) AS upto, sum(n) OVER () AS total FROM h) SELECT min(q) FILTER (upto >= 0.5 * total) AS p50, min(q) FILTER (upto >= 0.95 * total) AS p95 FROM c")
def agg_histogram_pct(spark: S, d: str) -> D:
    h = v.table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("q")).agg(F.count("*").alias("n"))
    total = h.agg(F.sum("n").alias("total"))
    upto = h.select("q", F.sum("n").over(Window.orderBy("q")).alias("upto"))  # one row for each of a bounded set of values
    joined = upto.join(F.broadcast(total), F.lit(True))  # a single row
    at = lambda share: F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("q")))
    return joined.agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


# Windows.

_HASH = "sha256('42' || chr(0) || {})"


@query("win_row_number_hash", v.sql(f", r AS (SELECT artist_id, track_id, row_number() OVER (PARTITION BY artist_id ORDER BY {_HASH.format('track_id')}, track_id) AS k FROM tracks) SELECT artist_id, track_id FROM r WHERE k = 1", "tracks"))
def win_row_number_hash(spark: S, d: str) -> D:
    # The least of a group needs no window: hash and id are one ordered value.
    least = v.tracks(spark, d).groupBy("artist_id").agg(F.min(F.struct(x.digest(42, F.col("track_id")).alias("h"), "track_id")).alias("m"))
    return least.select("artist_id", "m.track_id")


@query("win_row_number_rank", v.sql("SELECT artist_id, similar_artist_id, row_number() OVER (PARTITION BY artist_id ORDER BY edge_order, similar_artist_id) AS rank FROM similar_", "similar"))
def win_row_number_rank(spark: S, d: str) -> D:
    rank = F.row_number().over(Window.partitionBy("artist_id").orderBy("edge_order", "similar_artist_id"))
    return v.similar(spark, d).select("artist_id", "similar_artist_id", rank.cast("long").alias("rank"))


@query("win_balanced_sides", v.sql(f""", s AS (SELECT year, mode = 'F' AS side, track_id, row_number() OVER (PARTITION BY year, mode = 'F' ORDER BY {_HASH.format('track_id')}, track_id) AS k FROM tracks),
n AS (SELECT year, least(count(*) FILTER (side), count(*) FILTER (NOT side)) AS m FROM s GROUP BY 1) SELECT year, side, track_id FROM s JOIN n USING (year) WHERE k <= m""", "tracks"))  # fmt: skip
def win_balanced_sides(spark: S, d: str) -> D:
    t = v.tracks(spark, d).select("year", (F.col("mode") == "F").alias("side"), "track_id")
    m = t.groupBy("year").agg(F.least(F.count_if("side"), F.count_if(~F.col("side"))).alias("m"))
    numbered = group_numbers(t.withColumn("h", x.digest(42, F.col("track_id"))), ["year", "side"], ["h", "track_id"], "k")
    return numbered.join(F.broadcast(m), "year").where("k < m").select("year", "side", "track_id")  # a row a year


@query("win_fold_deal", v.sql(f", a AS (SELECT artist_id, CAST(floor(min(year) / 10) * 10 AS INT) AS decade FROM tracks GROUP BY 1) SELECT artist_id, CAST((row_number() OVER (PARTITION BY decade ORDER BY {_HASH.format('artist_id')}, artist_id) - 1) % 5 AS INT) AS fold FROM a", "tracks"))
def win_fold_deal(spark: S, d: str) -> D:
    a = v.tracks(spark, d).groupBy("artist_id").agg(x.decade(F.min("year")).alias("decade"))
    numbered = group_numbers(a.withColumn("h", x.digest(42, F.col("artist_id"))), ["decade"], ["h", "artist_id"], "k")
    return numbered.select("artist_id", F.pmod("k", F.lit(5)).cast("int").alias("fold"))


@query("win_lead_pairs", v.sql(f", p AS (SELECT artist_id, track_id AS a, lead(track_id) OVER (PARTITION BY artist_id ORDER BY {_HASH.format('track_id')}, track_id) AS b FROM tracks) SELECT * FROM p WHERE b IS NOT NULL", "tracks"))
def win_lead_pairs(spark: S, d: str) -> D:
    after = F.lead("track_id").over(Window.partitionBy("artist_id").orderBy(x.digest(42, F.col("track_id")), "track_id"))
    return v.tracks(spark, d).select("artist_id", F.col("track_id").alias("a"), after.alias("b")).where("b is not null")


@query("win_segment_end", v.sql("SELECT track_id, event_id, round(coalesce(lead(start) OVER (PARTITION BY track_id ORDER BY start, event_id), max(start) OVER (PARTITION BY track_id) + 60) - start, 3) AS length FROM segments", "segments"))
def win_segment_end(spark: S, d: str) -> D:
    w = Window.partitionBy("track_id")
    end = F.coalesce(F.lead("start").over(w.orderBy("start", "event_id")), F.max("start").over(w) + 60)
    return v.segments(spark, d).select("track_id", "event_id", F.round(end - F.col("start"), 3).alias("length"))


@query("win_diff", v.sql("SELECT track_id, event_id, round(value - lag(value) OVER (PARTITION BY track_id ORDER BY start, event_id), 6) AS delta FROM segments", "segments"))
def win_diff(spark: S, d: str) -> D:
    before = F.lag("value").over(Window.partitionBy("track_id").orderBy("start", "event_id"))
    return v.segments(spark, d).select("track_id", "event_id", F.round(F.col("value") - before, 6).alias("delta"))


@query("win_cumweight", v.sql("SELECT track_id, event_id, round(sum(value) OVER (PARTITION BY track_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING), 4) AS upto FROM segments", "segments"))
def win_cumweight(spark: S, d: str) -> D:
    w = Window.partitionBy("track_id").orderBy("value", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return v.segments(spark, d).select("track_id", "event_id", F.round(F.sum("value").over(w), 4).alias("upto"))


# Orders and limits.


@query("top_tags", v.sql("SELECT tag, count(*) AS artists FROM tags WHERE source = 'term' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "tags"))
def top_tags(spark: S, d: str) -> D:
    return v.tags(spark, d).where("source = 'term'").groupBy("tag").agg(F.count("*").alias("artists")).orderBy(F.desc("artists"), "tag").limit(20)


@query("top_hash_sample", v.sql(f"SELECT track_id FROM tracks ORDER BY {_HASH.format('track_id')}, track_id LIMIT 100", "tracks"))
def top_hash_sample(spark: S, d: str) -> D:
    return v.tracks(spark, d).orderBy(x.digest(42, F.col("track_id")), "track_id").limit(100).select("track_id")


@query("top_per_split_limit", v.sql(f", r AS (SELECT mode, track_id, row_number() OVER (PARTITION BY mode ORDER BY {_HASH.format('track_id')}, track_id) AS k FROM tracks) SELECT mode, track_id FROM r WHERE k <= 10", "tracks"))
def top_per_split_limit(spark: S, d: str) -> D:
    k = F.row_number().over(Window.partitionBy("mode").orderBy(x.digest(42, F.col("track_id")), "track_id"))
    return v.tracks(spark, d).select("mode", "track_id", k.alias("k")).where("k <= 10").drop("k")


@query("top_partial_sort", v.sql(", r AS (SELECT artist_id, track_id, row_number() OVER (PARTITION BY artist_id ORDER BY duration DESC, track_id) AS k FROM tracks) SELECT * FROM r WHERE k <= 3", "tracks"))
def top_partial_sort(spark: S, d: str) -> D:
    k = F.row_number().over(Window.partitionBy("artist_id").orderBy(F.desc("duration"), "track_id"))
    return v.tracks(spark, d).select("artist_id", "track_id", k.cast("long").alias("k")).where("k <= 3")


@query("top_heap", v.sql(f", r AS (SELECT year, track_id, row_number() OVER (PARTITION BY year ORDER BY {_HASH.format('track_id')}, track_id) AS k FROM tracks) SELECT year, track_id FROM r WHERE k <= 5", "tracks"))
def top_heap(spark: S, d: str) -> D:
    k = F.row_number().over(Window.partitionBy("year").orderBy(x.digest(42, F.col("track_id")), "track_id"))
    return v.tracks(spark, d).select("year", "track_id", k.alias("k")).where("k <= 5").drop("k")


@query("srt_zip_index", v.sql("SELECT track_id, row_number() OVER (ORDER BY track_id) - 1 AS row_id FROM tracks", "tracks"))
def srt_zip_index(spark: S, d: str) -> D:
    from tessera.operators.ordering import row_numbers

    return row_numbers(v.tracks(spark, d).select("track_id"), ["track_id"], "row_id")


# Sets and row generation.


@query("set_union_by_name", "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def set_union_by_name(spark: S, d: str) -> D:
    c = v.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return c.unionByName(v.table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k")))


@query("set_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(spark: S, d: str) -> D:
    return v.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(v.table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("set_intersect", v.sql("SELECT artist_id FROM tracks WHERE year < 1997 INTERSECT SELECT artist_id FROM tracks WHERE year > 1999", "tracks"))
def set_intersect(spark: S, d: str) -> D:
    t = v.tracks(spark, d)
    return t.where("year < 1997").select("artist_id").intersect(t.where("year > 1999").select("artist_id"))


@query("set_except_all", v.sql("SELECT artist_id, year FROM tracks EXCEPT ALL SELECT artist_id, year FROM tracks WHERE mode = 'F'", "tracks"))
def set_except_all(spark: S, d: str) -> D:
    t = v.tracks(spark, d)
    return t.select("artist_id", "year").exceptAll(t.where("mode = 'F'").select("artist_id", "year"))


@query("set_jaccard_like", v.sql("SELECT e.artist_id, e.similar_artist_id, count(*) AS common FROM similar_ e JOIN tags a ON a.artist_id = e.artist_id AND a.source = 'mbtag' JOIN tags b ON b.artist_id = e.similar_artist_id AND b.tag = a.tag AND b.source = 'mbtag' GROUP BY 1, 2", "tags", "similar"))
def set_jaccard_like(spark: S, d: str) -> D:
    t = v.tags(spark, d).where("source = 'mbtag'").groupBy("artist_id").agg(F.collect_set("tag").alias("tags"))
    e = v.similar(spark, d).select("artist_id", "similar_artist_id")
    both = e.join(t, "artist_id").join(t.select(F.col("artist_id").alias("similar_artist_id"), F.col("tags").alias("others")), "similar_artist_id")
    common = F.size(F.array_intersect("tags", "others")).cast("long")
    return both.select("artist_id", "similar_artist_id", common.alias("common")).where("common > 0")


@query("gen_explode", "SELECT vec_id, i AS place, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS value FROM embeddings, range(64) r(i)")
def gen_explode(spark: S, d: str) -> D:
    return v.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("place", "value")).select("vec_id", F.col("place").cast("long").alias("place"), F.round(F.col("value").cast("double"), 6).alias("value"))


@query("gen_sequence", "SELECT r_regionkey, i AS slot FROM region, range(4) t(i)")
def gen_sequence(spark: S, d: str) -> D:
    return v.table(spark, d, "region").select("r_regionkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("slot"))


@query("gen_nested_labels", v.sql(", g AS (SELECT release_id, list(track_id ORDER BY track_id) AS c, list(track_id) FILTER (mode = 'F') AS p FROM tracks GROUP BY 1) SELECT release_id, CAST(len(c) AS INT) AS candidates, CAST(coalesce(len(p), 0) AS INT) AS positives, array_to_string(list_transform(c, lambda t: CASE WHEN p IS NOT NULL AND list_contains(p, t) THEN '1' ELSE '0' END), '') AS labels FROM g", "tracks"))
def gen_nested_labels(spark: S, d: str) -> D:
    g = v.tracks(spark, d).groupBy("release_id").agg(F.sort_array(F.collect_list("track_id")).alias("c"), F.collect_list(F.when(F.col("mode") == "F", F.col("track_id"))).alias("p"))
    labels = F.transform("c", lambda t: F.struct(t.alias("track_id"), F.array_contains("p", t).cast("int").alias("label")))
    return g.select("release_id", F.size("c").alias("candidates"), F.size("p").alias("positives"), F.array_join(F.transform(labels, lambda s: s["label"].cast("string")), "").alias("labels"))


@query("gen_struct_pool", v.sql(", p AS (SELECT release_id, mode, count(*) AS n FROM tracks GROUP BY 1, 2) SELECT release_id, CAST(sum(n) AS BIGINT) AS raw_candidates, string_agg(mode || '=' || n, ',' ORDER BY mode) AS source_counts FROM p GROUP BY 1", "tracks"))
def gen_struct_pool(spark: S, d: str) -> D:
    p = v.tracks(spark, d).groupBy("release_id", "mode").agg(F.count("*").alias("n"))
    pool = p.groupBy("release_id").agg(F.struct(F.sum("n").alias("raw_candidates"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("mode", "n")))).alias("source_counts")).alias("audit"))
    shown = F.array_join(F.transform(F.map_entries("audit.source_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return pool.select("release_id", "audit.raw_candidates", shown.alias("source_counts"))


# Hashes and samples.


@query("hash_sha_split", v.sql(", u AS (SELECT track_id, CAST(('0x' || substr(sha256('42' || chr(0) || track_id), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0 AS h FROM tracks) SELECT track_id, CASE WHEN h < 0.10 THEN 'A' WHEN h < 0.11 THEN 'B_tune' WHEN h < 0.13 THEN 'C' WHEN h >= 0.15 AND h < 0.17 THEN 'B_confirm' ELSE 'remaining' END AS split FROM u", "tracks"))
def hash_sha_split(spark: S, d: str) -> D:
    h = x.unit_hash(42, F.col("track_id"))
    split = F.when(h < 0.10, "A").when(h < 0.11, "B_tune").when(h < 0.13, "C").when((h >= 0.15) & (h < 0.17), "B_confirm").otherwise("remaining")
    return v.tracks(spark, d).select("track_id", split.alias("split"))


@query("hash_sha_order", v.sql("SELECT artist_id, similar_artist_id, sha256('42' || chr(0) || artist_id || chr(0) || similar_artist_id) AS h FROM similar_", "similar"))
def hash_sha_order(spark: S, d: str) -> D:
    return v.similar(spark, d).select("artist_id", "similar_artist_id", x.digest(42, F.col("artist_id"), F.col("similar_artist_id")).alias("h"))


@query("hash_rotation", v.sql(", r AS (SELECT artist_id, track_id, row_number() OVER (PARTITION BY artist_id ORDER BY track_id) - 1 AS place, count(*) OVER (PARTITION BY artist_id) AS n FROM tracks), o AS (SELECT *, CAST(('0x' || substr(sha256('42' || chr(0) || artist_id), 1, 8))::UBIGINT % n AS BIGINT) AS turn FROM r) SELECT artist_id, track_id, (place - turn + n) % n AS rotated FROM o", "tracks"))
def hash_rotation(spark: S, d: str) -> D:
    w = Window.partitionBy("artist_id")
    r = v.tracks(spark, d).select("artist_id", "track_id", (F.row_number().over(w.orderBy("track_id")) - 1).cast("long").alias("place"), F.count("*").over(w).alias("n"))
    turn = F.conv(F.substring(x.digest(42, F.col("artist_id")), 1, 8), 16, 10).cast("long") % F.col("n")
    return r.select("artist_id", "track_id", F.pmod(F.col("place") - turn, F.col("n")).alias("rotated"))


_PART = hashes.xxhash_ctes("(SELECT DISTINCT artist_id FROM tracks)", "'472:' || artist_id", "artist_id") + ", part AS (SELECT artist_id, (h % 10000 + 10000) % 10000 AS part FROM hashed)"


@query("hash_xx_split", v.sql(_PART + " SELECT track_id, artist_id, CASE WHEN mode = 'P' THEN 'test' WHEN part < 1000 THEN 'validation' ELSE 'train' END AS split FROM tracks JOIN part USING (artist_id)", "tracks"))
def hash_xx_split(spark: S, d: str) -> D:
    part = F.pmod(F.xxhash64(F.concat(F.lit("472:"), "artist_id")), F.lit(10000))
    split = F.when(F.col("mode") == "P", "test").when(part < 1000, "validation").otherwise("train")
    return v.tracks(spark, d).select("track_id", "artist_id", split.alias("split"))


@query("hash_row_digest", v.sql("""SELECT track_id, sha256('{"track_id":' || track_id || ',"artist_id":' || artist_id || ',"year":' || year || ',"duration":' || duration || ',"release_id":' || release_id || ',"mode":"' || mode || '","title":"' || title || '"}') AS digest FROM tracks""", "tracks"))
def hash_row_digest(spark: S, d: str) -> D:
    t = v.tracks(spark, d)
    return t.select("track_id", F.sha2(F.to_json(F.struct(*t.columns)), 256).alias("digest"))


@query("smp_bernoulli", v.sql("SELECT track_id FROM tracks WHERE CAST(('0x' || substr(sha256('7' || chr(0) || track_id), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0 < 0.25", "tracks"))
def smp_bernoulli(spark: S, d: str) -> D:
    # A threshold on a hash: the same rows however the table is partitioned.
    return v.tracks(spark, d).where(x.unit_hash(7, F.col("track_id")) < 0.25).select("track_id")
