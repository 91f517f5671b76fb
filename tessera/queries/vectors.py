"""Vector, tag, recall, ranking and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as x
from tessera.operators import ranking, vectors
from tessera.operators.ordering import quantiles, row_numbers
from tessera.plans import views as v
from tessera.plans.materialize import checkpointed
from tessera.queries import query

S, D = SparkSession, DataFrame


def embedded(spark: S, d: str) -> D:
    return v.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("group"))


_DOT = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("v_dot", f"SELECT a.vec_id, round({_DOT}, 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def v_dot(spark: S, d: str) -> D:
    a = embedded(spark, d)
    b = a.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other"))
    return a.join(b, "id").select(F.col("id").alias("vec_id"), F.round(x.dot(F.col("vector"), F.col("other")), 6).alias("dot"))


@query("v_normalize", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS head FROM embeddings")
def v_normalize(spark: S, d: str) -> D:
    return embedded(spark, d).select(F.col("id").alias("vec_id"), F.round(x.unit(F.col("vector"))[0], 6).alias("head"))


@query("v_norm_check", "SELECT count(*) FILTER (len(embedding) <> 64) AS wrong_size, count(*) FILTER (abs(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 1e-4) AS wrong_norm FROM embeddings")
def v_norm_check(spark: S, d: str) -> D:
    e = embedded(spark, d)
    return e.agg(F.count_if(F.size("vector") != 64).alias("wrong_size"), F.count_if(F.abs(x.norm(F.col("vector")) - 1) > 1e-4).alias("wrong_norm"))


@query("v_standardize", "SELECT event_id, round(least(greatest((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), -10), 10), 5) AS value FROM events")
def v_standardize(spark: S, d: str) -> D:
    e = v.table(spark, d, "events").select("event_id", "value")
    return vectors.standardized(e, ["value"]).select("event_id", F.round("value", 5).alias("value"))


@query("v_pca")
def v_pca(spark: S, d: str) -> D:
    """The fewest components that explain half of the variance; a fixed number is the option without a target."""
    from pyspark.ml.functions import vector_to_array

    model, projected = vectors.pca(embedded(spark, d), 64, target=0.5)
    return projected.select("id", F.lit(model.getK()).alias("k"), F.transform(vector_to_array("projected"), lambda e: F.round(e, 4)).alias("projected"))


_KNN = f"""p AS (SELECT a.vec_id AS query, b.vec_id AS candidate, {_DOT} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS rank FROM p)"""


@query("v_knn_exact", f"WITH {_KNN} SELECT query, candidate, rank, round(score, 5) AS score FROM k WHERE rank <= 10")
def v_knn_exact(spark: S, d: str) -> D:
    e = embedded(spark, d)
    return vectors.knn(e, e, 10).select("query", "candidate", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query("v_pair_similarity", f"SELECT l_orderkey, l_linenumber, l_partkey, round({_DOT}, 5) AS cosine FROM lineitem LEFT JOIN embeddings a ON a.vec_id = l_partkey LEFT JOIN embeddings b ON b.vec_id = l_suppkey".replace(f"round({_DOT}, 5)", f"round({_DOT} / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) / sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 5)"))
def v_pair_similarity(spark: S, d: str) -> D:
    pairs = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    e = embedded(spark, d)
    # Distinct pairs first: a pair that repeats is compared once.
    distinct = pairs.select("l_partkey", "l_suppkey").distinct()
    a, b = e.select(F.col("id").alias("l_partkey"), F.col("vector").alias("a")), e.select(F.col("id").alias("l_suppkey"), F.col("vector").alias("b"))
    scored = distinct.join(a, "l_partkey", "left").join(b, "l_suppkey", "left").select("l_partkey", "l_suppkey", F.round(x.cosine(F.col("a"), F.col("b")), 5).alias("cosine"))
    return pairs.join(scored, ["l_partkey", "l_suppkey"], "left").select("l_orderkey", "l_linenumber", "l_partkey", "cosine")


@query("v_cold_query", "WITH q AS (SELECT list_transform(range(64), lambda i: CAST(((i * 7) % 13) - 6 AS DOUBLE)) AS v), n AS (SELECT v, sqrt(list_inner_product(v, v)) AS l FROM q) SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), v) / l, 6) AS score FROM embeddings, n ORDER BY list_inner_product(CAST(embedding AS DOUBLE[]), v) / l DESC, vec_id LIMIT 20")
def v_cold_query(spark: S, d: str) -> D:
    outside = [float((i * 7) % 13 - 6) for i in range(64)]
    length = sum(e * e for e in outside) ** 0.5
    given = F.array(*(F.lit(e / length) for e in outside))
    scored = embedded(spark, d).select(F.col("id").alias("vec_id"), x.dot(F.col("vector"), given).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(20).select("vec_id", F.round("score", 6).alias("score"))


_IDF = """, o AS (SELECT DISTINCT artist_id, tag FROM tags WHERE source = 'mbtag'), n AS (SELECT count(DISTINCT artist_id) AS n FROM o), i AS (SELECT tag, count(*) AS df, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM o, n GROUP BY tag, n),
w AS (SELECT artist_id, tag, df, idf FROM o JOIN i USING (tag)), norms AS (SELECT artist_id, sqrt(sum(idf * idf)) AS norm FROM w GROUP BY 1)"""
_COSINE = _IDF + """, c AS (SELECT a.artist_id AS query, b.artist_id AS candidate, sum(a.idf * a.idf) AS common FROM w a JOIN w b ON a.tag = b.tag AND a.artist_id <> b.artist_id WHERE a.artist_id IN (SELECT * FROM qs) GROUP BY 1, 2),
s AS (SELECT query, candidate, common / (x.norm * y.norm) AS score FROM c JOIN norms x ON x.artist_id = query JOIN norms y ON y.artist_id = candidate)"""


def _owners(spark: S, d: str) -> D:
    return v.tags(spark, d).where("source = 'mbtag'").select("artist_id", "tag")


@query("v_idf_artifact", v.sql(_IDF + " SELECT tag, df, round(idf, 6) AS idf FROM i", "tags"))
def v_idf_artifact(spark: S, d: str) -> D:
    return vectors.tag_weights(_owners(spark, d)).groupBy("tag").agg(F.first("df").alias("df"), F.round(F.first("idf"), 6).alias("idf"))


_QUERIES = ", qs AS (SELECT DISTINCT artist_id FROM tags WHERE artist_id % 20 = 0)"


def _cosines(spark: S, d: str) -> D:
    weights = checkpointed(vectors.tag_weights(_owners(spark, d)))
    return vectors.tag_cosine(weights, weights.select("artist_id").where("artist_id % 20 = 0"))


def _neighbors(spark: S, d: str, k: int) -> D:
    asked = v.table(spark, d, "orders").select(F.col("o_custkey").alias("artist_id")).where("artist_id % 20 = 0")
    return vectors.tag_neighbors(_owners(spark, d), asked, k)


@query("v_sparse_tfidf", v.sql(_QUERIES + _COSINE + " SELECT query, count(*) AS partners, round(avg(score), 6) AS mean, round(max(score), 6) AS top FROM s GROUP BY 1", "tags"))
def v_sparse_tfidf(spark: S, d: str) -> D:
    return _cosines(spark, d).groupBy("query").agg(F.count("*").alias("partners"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.max("score"), 6).alias("top"))


@query("v_tag_neighbors", v.sql(_QUERIES + _COSINE + ", k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, candidate) AS rank FROM s) SELECT query, candidate, rank, round(score, 4) AS score FROM k WHERE rank <= 200", "tags"))
def v_tag_neighbors(spark: S, d: str) -> D:
    ranked = _neighbors(spark, d, 200)
    return ranked.select("query", "candidate", "rank", F.round("score", 4).alias("score"))


# Recall.


@query("r_round_robin_tag", v.sql(_QUERIES + _COSINE + """, nb AS (SELECT query, candidate, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, candidate) AS artist_rank FROM s),
t AS (SELECT artist_id, track_id, row_number() OVER (PARTITION BY artist_id ORDER BY track_id) - 1 AS pos, count(*) OVER (PARTITION BY artist_id) AS m FROM tracks),
r AS (SELECT query, artist_rank, track_id, (pos - CAST(('0x' || substr(sha256('42' || chr(0) || query || chr(0) || artist_id), 1, 8))::UBIGINT % m AS BIGINT) + m) % m AS pass FROM nb JOIN t ON t.artist_id = candidate WHERE artist_rank <= 20),
k AS (SELECT query, track_id, row_number() OVER (PARTITION BY query ORDER BY pass, artist_rank) AS place FROM r WHERE pass < 3) SELECT * FROM k""", "tracks", "tags"))  # fmt: skip
def r_round_robin_tag(spark: S, d: str) -> D:
    n = _neighbors(spark, d, 20).select("query", F.col("candidate").alias("artist_id"), F.col("rank").alias("artist_rank"))
    w = Window.partitionBy("artist_id")
    t = v.tracks(spark, d).select("artist_id", "track_id", (F.row_number().over(w.orderBy("track_id")) - 1).cast("long").alias("pos"), F.count("*").over(w).alias("m"))
    turn = F.conv(F.substring(x.digest(42, F.col("query"), F.col("artist_id")), 1, 8), 16, 10).cast("long") % F.col("m")
    r = n.join(t, "artist_id").withColumn("pass", F.pmod(F.col("pos") - turn, F.col("m"))).where("pass < 3")
    return r.select("query", "track_id", F.row_number().over(Window.partitionBy("query").orderBy("pass", "artist_rank")).cast("long").alias("place"))


_POOL = f"""WITH {_KNN}, pool AS (SELECT query, candidate, 'audio' AS source, score, rank FROM k WHERE rank <= 20
UNION ALL SELECT a.vec_id, b.vec_id, 'label', 1.0, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) <= 15)"""


def pool(spark: S, d: str) -> D:
    e = embedded(spark, d)
    audio = vectors.knn(e, e, 20).select("query", "candidate", F.lit("audio").alias("source"), "score", "rank")
    # The least ids of a label are the same for all its queries: one more than the quota covers the query itself.
    first = F.row_number().over(Window.partitionBy("group").orderBy("id"))
    least = e.select("group", F.col("id").alias("candidate"), first.alias("r")).where("r <= 16")
    same = e.select(F.col("id").alias("query"), "group").join(least, "group").where("query <> candidate")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("candidate"))
    label = same.select("query", "candidate", F.lit("label").alias("source"), F.lit(1.0).alias("score"), rank.alias("rank")).where("rank <= 15")
    return audio.unionByName(label)


@query("r_merge", _POOL + " SELECT query, candidate, string_agg(source, ',' ORDER BY source) AS sources, min(rank) AS best_rank FROM pool GROUP BY 1, 2")
def r_merge(spark: S, d: str) -> D:
    return ranking.merged(pool(spark, d)).select("query", "candidate", F.array_join("sources", ",").alias("sources"), F.col("best_rank").cast("long").alias("best_rank"))


@query("r_audit", _POOL + ", m AS (SELECT query, candidate, count(*) AS n FROM pool GROUP BY 1, 2), r AS (SELECT query, source, count(*) AS n FROM pool GROUP BY 1, 2), q AS (SELECT query, CAST(sum(n) AS BIGINT) AS raw_candidates, CAST(sum(greatest(25 - n, 0)) AS BIGINT) AS shortage FROM r GROUP BY 1) SELECT m.query, count(*) AS unique_candidates, count(*) FILTER (n = 1) AS exclusive, any_value(raw_candidates) AS raw_candidates, any_value(shortage) AS shortage, any_value(raw_candidates) - count(*) AS duplicates FROM m JOIN q ON q.query = m.query GROUP BY 1")
def r_audit(spark: S, d: str) -> D:
    return ranking.audited(pool(spark, d), 25)


@query("r_pool_audit", _POOL + ", m AS (SELECT query, candidate, list(source) AS sources FROM pool GROUP BY 1, 2), l AS (SELECT m.*, a.label = b.label AS hit FROM m JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = candidate), g AS (SELECT query, avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END) AS precision, count(*) FILTER (hit AND len(sources) = 1) AS exclusive_hits FROM l GROUP BY 1) SELECT round(avg(precision), 6) AS precision, round(avg(exclusive_hits), 6) AS exclusive_hits FROM g")
def r_pool_audit(spark: S, d: str) -> D:
    e = embedded(spark, d)
    m = ranking.merged(pool(spark, d))
    l = m.join(e.select(F.col("id").alias("query"), F.col("group").alias("g")), "query").join(e.select(F.col("id").alias("candidate"), "group"), "candidate").withColumn("hit", F.col("g") == F.col("group"))
    g = l.groupBy("query").agg(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("precision"), F.count_if(F.col("hit") & (F.size("sources") == 1)).alias("exclusive_hits"))
    return g.agg(F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("exclusive_hits"), 6).alias("exclusive_hits"))


@query("r_pool_size_dist", _POOL + ", n AS (SELECT query, count(DISTINCT candidate) AS n FROM pool GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n) AS k, count(*) OVER () AS m FROM n) SELECT max(n) FILTER (k = ceil(0.1 * m)) AS p10, max(n) FILTER (k = ceil(0.5 * m)) AS p50, max(n) FILTER (k = ceil(0.9 * m)) AS p90, round(avg(CASE WHEN n < 34 THEN 1.0::DOUBLE ELSE 0 END), 6) AS under FROM r")
def r_pool_size_dist(spark: S, d: str) -> D:
    n = ranking.merged(pool(spark, d)).groupBy("query").agg(F.count("*").alias("n"))
    # Nearest ranks from the histogram of a bounded set of sizes.
    h = n.groupBy("n").agg(F.count("*").alias("c"))
    upto = h.select("n", F.sum("c").over(Window.orderBy("n")).alias("upto")).join(F.broadcast(h.agg(F.sum("c").alias("m"))), F.lit(True))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(q * F.col("m")), F.col("n")))
    sizes = upto.agg(at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"))
    return sizes.join(F.broadcast(n.agg(F.round(F.avg(F.when(F.col("n") < 34, 1.0).otherwise(0.0)), 6).alias("under"))), F.lit(True))


_BACKFILL = _POOL.replace("WITH ", "WITH RECURSIVE ", 1) + """, l AS (SELECT query, coalesce(list(candidate ORDER BY rank, candidate) FILTER (source = 'audio'), []) AS t, coalesce(list(candidate ORDER BY rank, candidate) FILTER (source = 'label'), []) AS b, list(candidate) FILTER (source = 'audio' AND rank <= 5) AS have FROM pool GROUP BY 1),
s(query, t, b, have, turn, i, j, item, source, is_new) AS (SELECT query, t, b, have, 0, 0, 0, NULL::BIGINT, NULL::VARCHAR, NULL::BOOLEAN FROM l UNION ALL
  SELECT query, t, b, CASE WHEN fresh THEN list_append(have, pick) ELSE have END, CASE WHEN pick IS NULL OR fresh THEN turn + 1 ELSE turn END, i + CASE WHEN pick IS NOT NULL AND turn % 2 = 0 THEN 1 ELSE 0 END, j + CASE WHEN pick IS NOT NULL AND turn % 2 = 1 THEN 1 ELSE 0 END, pick, CASE WHEN turn % 2 = 0 THEN 'tag' ELSE 'bfs' END, fresh
  FROM (SELECT *, NOT list_contains(have, pick) AS fresh FROM (SELECT query, t, b, have, turn, i, j, CASE WHEN turn % 2 = 0 THEN t[i + 1] ELSE b[j + 1] END AS pick FROM s WHERE len(have) < 15 AND (i < len(t) OR j < len(b)))))
SELECT query, item AS candidate, source, is_new FROM s WHERE item IS NOT NULL"""


@query("r_backfill", _BACKFILL)
def r_backfill(spark: S, d: str) -> D:
    p = pool(spark, d)
    extra = p.withColumn("source", F.when(F.col("source") == "audio", "tag").otherwise("bfs"))
    return ranking.backfill(p.where("source = 'audio' and rank <= 5").select("query", "candidate"), extra, 15)


# Metrics.

_RANKED = f"WITH {_KNN}, l AS (SELECT query, rank, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS label FROM k JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = candidate WHERE rank <= 50)"


def ranked(spark: S, d: str) -> D:
    e = embedded(spark, d)
    k = vectors.knn(e, e, 50)
    return k.join(e.select(F.col("id").alias("query"), F.col("group").alias("g")), "query").join(e.select(F.col("id").alias("candidate"), "group"), "candidate").select("query", "rank", (F.col("g") == F.col("group")).cast("int").alias("label"))


_METRICS = _RANKED + """, s AS (SELECT query, sum(label) AS p, min(rank) FILTER (label = 1) AS f, sum(label) FILTER (rank <= 10) AS h10, coalesce(sum(label / log2(rank + 1)) FILTER (rank <= 10), 0) AS d10 FROM l GROUP BY 1 HAVING sum(label) > 0),
m AS (SELECT query, 1.0::DOUBLE / f AS mrr, h10::DOUBLE / p AS recall10, CASE WHEN h10 > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS hit10, d10 / list_sum(list_transform(range(1, CAST(least(p, 10) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) AS ndcg10 FROM s)"""


@query("e_ranking_metrics", _METRICS + " SELECT query, round(mrr, 6) AS mrr, round(recall10, 6) AS recall10, hit10, round(ndcg10, 6) AS ndcg10 FROM m")
def e_ranking_metrics(spark: S, d: str) -> D:
    m = ranking.metrics(ranked(spark, d), (10,))
    return m.select("query", *(F.round(c, 6).alias(c) for c in ("mrr", "recall10", "hit10", "ndcg10")))


@query("e_macro", _METRICS + ", g AS (SELECT label, avg(mrr) AS mrr, avg(ndcg10) AS ndcg10 FROM m JOIN embeddings ON vec_id = query GROUP BY 1) SELECT round(avg(mrr), 6) AS mrr, round(avg(ndcg10), 6) AS ndcg10 FROM g")
def e_macro(spark: S, d: str) -> D:
    m = ranking.metrics(ranked(spark, d), (10,)).join(embedded(spark, d).select(F.col("id").alias("query"), "group"), "query")
    return m.groupBy("group").agg(F.avg("mrr").alias("mrr"), F.avg("ndcg10").alias("ndcg10")).agg(F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("ndcg10"), 6).alias("ndcg10"))


@query("e_random_expectation", """WITH s AS (SELECT label AS query, (SELECT count(*) FROM embeddings) - 1 AS n, count(*) - 1 AS p FROM embeddings GROUP BY 1 HAVING count(*) > 1)
SELECT query, round(10.0::DOUBLE / n, 6) AS recall10, round(1 - list_product(list_transform(range(1, 11), lambda i: (n - p - i + 1)::DOUBLE / (n - i + 1))), 6) AS hit10,
round(list_sum(list_transform(range(1, 11), lambda i: 1 / log2(i + 1))) * p / n / list_sum(list_transform(range(1, CAST(least(p, 10) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg10 FROM s""")  # fmt: skip
def e_random_expectation(spark: S, d: str) -> D:
    e = embedded(spark, d)
    sizes = e.groupBy(F.col("group").alias("query")).agg((F.count("*") - 1).alias("positives")).where("positives > 0")
    sizes = sizes.join(F.broadcast(e.agg((F.count("*") - 1).alias("n"))), F.lit(True))
    return ranking.random_expectation(sizes, (10,)).select("query", *(F.round(c, 6).alias(c) for c in ("recall10", "hit10", "ndcg10")))


@query("e_bootstrap")
def e_bootstrap(spark: S, d: str) -> D:
    diffs = v.tracks(spark, d).select("artist_id", (F.col("duration") / 100000 - F.col("track_id") % 5).alias("diff"))
    return ranking.bootstrap(diffs, "diff", "artist_id")


_FIVE = (0.05, 0.25, 0.5, 0.75, 0.95)


@query("e_hedges_g", v.sql(", s AS (SELECT mode = 'F' AS g, count(*) AS n, avg(duration) AS m, var_samp(duration) AS q FROM tracks WHERE mode IN ('F', 'O') GROUP BY 1), a AS (SELECT * FROM s WHERE g), b AS (SELECT * FROM s WHERE NOT g) SELECT a.n AS n_related, b.n AS n_random, round((a.m - b.m) / sqrt(((a.n - 1) * a.q + (b.n - 1) * b.q) / (a.n + b.n - 2)) * (1 - 3.0::DOUBLE / (4 * (a.n + b.n) - 9)), 6) AS g, (SELECT round(corr(duration, duration * (1 + track_id % 5)), 6) FROM tracks) AS correlation, (SELECT round(avg(abs(duration * (track_id % 5))), 4) FROM tracks) AS shift, " + ", ".join(f"(SELECT round(quantile_cont(duration, {q}), 4) FROM tracks WHERE mode = '{m}') AS {n}_q{int(q * 100):02d}" for m, n in (("F", "related"), ("O", "random")) for q in _FIVE) + " FROM a, b", "tracks"))
def e_hedges_g(spark: S, d: str) -> D:
    """Effect size with its small-sample correction, five quantiles of both samples, and what is kept of values after a change."""
    t = v.tracks(spark, d)
    one = lambda m: F.when(F.col("mode") == m, F.col("duration"))
    found = ranking.effect(t.select(one("F").alias("related"), one("O").alias("random")), "related", "random")
    for m, name in (("F", "related"), ("O", "random")):
        points = quantiles(t.where(F.col("mode") == m), "duration", {f"{name}_q{int(q * 100):02d}": q for q in _FIVE})
        found = found.join(F.broadcast(points), F.lit(True))
    after = F.col("duration") * (1 + F.col("track_id") % 5)
    kept = t.agg(F.corr("duration", after).alias("correlation"), F.avg(F.abs(after - F.col("duration"))).alias("shift"))
    both = found.join(F.broadcast(kept), F.lit(True))
    return both.select("n_related", "n_random", F.round("g", 6).alias("g"), F.round("correlation", 6).alias("correlation"), F.round("shift", 4).alias("shift"), *(F.round(c, 4).alias(c) for c in both.columns if "_q" in c))


@query("e_hedges_interval")
def e_hedges_interval(spark: S, d: str) -> D:
    """The effect size's 95 % interval by resampling."""
    t = v.tracks(spark, d).where("mode in ('F', 'O')").select("track_id", (F.col("mode") == "F").alias("related"), "duration")
    return ranking.effect_interval(t, "track_id", "related", "duration")


@query("e_l1_pairs", v.sql(""", h AS (SELECT *, sha256('42' || chr(0) || track_id) AS h FROM tracks), p AS (SELECT 'artist' AS kind, track_id AS a, lead(track_id) OVER (PARTITION BY artist_id ORDER BY h, track_id) AS b FROM h UNION ALL SELECT 'release', track_id, lead(track_id) OVER (PARTITION BY release_id ORDER BY h, track_id) FROM h UNION ALL SELECT 'random', track_id, lead(track_id) OVER (PARTITION BY year, mode ORDER BY h, track_id) FROM h)
SELECT kind, a, b, x.artist_id = y.artist_id AS artist_matched, x.release_id = y.release_id AS release_matched, x.year = y.year AS year_matched FROM p JOIN tracks x ON x.track_id = a JOIN tracks y ON y.track_id = b""", "tracks"))
def e_l1_pairs(spark: S, d: str) -> D:
    """Pairs of one artist, of one release, and at random within year and mode; each with its next by hash."""
    t = v.tracks(spark, d).select("track_id", "artist_id", "release_id", "year", "mode").withColumn("h", x.digest(42, F.col("track_id")))

    def matched(kind: str, numbered: D, groups: list[str], number: str) -> D:
        b = numbered.select(*groups, (F.col(number) - 1).alias(number), F.col("track_id").alias("b"), F.col("artist_id").alias("_a"), F.col("release_id").alias("_r"), F.col("year").alias("_y"))
        b = b.select(*(F.col(g).alias(f"_{g}_") if g in groups else F.col(g) for g in b.columns))
        on = [numbered[g] == b[f"_{g}_"] for g in groups] + [numbered[number] == b[number]]
        return numbered.join(b, on).select(F.lit(kind).alias("kind"), F.col("track_id").alias("a"), "b", (F.col("artist_id") == F.col("_a")).alias("artist_matched"), (F.col("release_id") == F.col("_r")).alias("release_matched"), (numbered["year"] == F.col("_y")).alias("year_matched"))

    def numbered(column: str) -> D:
        return t.withColumn("k", F.row_number().over(Window.partitionBy(column).orderBy("h", "track_id")))

    # Years and modes are few and large: numbered over all their rows by ranges, not in a task each.
    wide = row_numbers(t, ["year", "mode", "h", "track_id"], "k")
    return matched("artist", numbered("artist_id"), ["artist_id"], "k").unionByName(matched("release", numbered("release_id"), ["release_id"], "k")).unionByName(matched("random", wide, ["year", "mode"], "k"))


# Gates and fusion.


