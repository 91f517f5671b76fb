"""Recall, pair features, evidence, policies and supervision of a track recommender.

Everything works on pairs (query, candidate) of tracks.  Signals between artists
are computed for the artists that occur in a pair and joined to the pairs, so no
signal is kept for all pairs of artists.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import vectors
from tessera.operators.ordering import column_quantiles
from tessera.operators.pairwise import Dots, scored_pairs
from tessera.plans.materialize import checkpointed, sized

#: Order of the pair features (fixed).
FEATURES = (
    "cos_audio",
    "cos_graph",
    "has_graph",
    "bfs_score",
    "has_bfs",
    "tag_tfidf_cosine",
    "has_tags",
    "same_release",
    "has_release",
    "year_gap",
    "has_year",
    "audio_tag_interaction",
    "graph_bfs_interaction",
)
#: Signals that may be missing and are then filled.
FILLED = ("cos_audio", "cos_graph", "bfs_score", "tag_tfidf_cosine", "year_gap")


def hops(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(x, y, hops): artists one or two directed steps from the asked ones (x), the fewer steps."""
    one = edges.join(asked.withColumnRenamed("x", "src"), "src", "left_semi").select(F.col("src").alias("x"), F.col("dst").alias("y"))
    two = one.withColumnRenamed("y", "src").join(edges, "src").select("x", F.col("dst").alias("y")).where("x <> y")
    both = one.withColumn("hops", F.lit(1)).unionByName(two.withColumn("hops", F.lit(2)))
    return both.groupBy("x", "y").agg(F.min("hops").alias("hops"))


def round_robin(reached: DataFrame, tracks: DataFrame, limit: int, per_artist: int = 10) -> DataFrame:
    """(query, candidate, level, rank): tracks of reached artists (query, artist_id, level, likeness), level by level.

    In a level every artist gives one track in turn, the more alike first, then
    the one whose first track comes first; at most so many tracks an artist.
    Of a query's level only the first artists can have a place: one more than
    the places, since one's first track may be the query.
    """
    own = Window.partitionBy("artist_id")
    turns = checkpointed(tracks.select("artist_id", F.col("track_id").alias("candidate"), F.row_number().over(own.orderBy("track_id")).alias("_pass"), F.min("track_id").over(own).alias("_lead")).where(F.col("_pass") <= per_artist))
    first = F.row_number().over(Window.partitionBy("query", "level").orderBy(F.desc("likeness"), "_lead"))
    leads = sized(turns.where("_pass = 1").select("artist_id", "_lead"))
    reached = reached.join(leads, "artist_id").withColumn("_first", first).where(F.col("_first") <= limit + 1).drop("_first", "_lead")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("level", "_pass", F.desc("likeness"), "_lead"))
    return reached.join(turns, "artist_id").where("query <> candidate").withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "candidate", "level", "rank")


def pair_features(pairs: DataFrame, tracks: DataFrame, audio: DataFrame, graph: DataFrame, edges: DataFrame, tags: DataFrame) -> DataFrame:
    """pairs with the raw features; what is unknown is null.

    tracks: (track_id, artist_id, release_id, year); audio: (track_id, vector) of
    length 1; graph and tags: weights (artist_id, tag, idf) whose cosine counts;
    edges: (src, dst) between artists.
    """
    one = tracks.select(F.col("track_id").alias("query"), F.col("artist_id").alias("x"), F.col("release_id").alias("_r"), F.col("year").alias("_y"))
    other = tracks.select(F.col("track_id").alias("candidate"), F.col("artist_id").alias("y"), "release_id", "year")
    known = checkpointed(pairs.select("query", "candidate").join(one, "query").join(other, "candidate"))
    artists = checkpointed(known.select("x", "y").distinct())
    near = hops(edges, artists.select("x").distinct())
    signals = artists.join(near, ["x", "y"], "left")
    for name, weights in (("cos_graph", graph), ("tag_tfidf_cosine", tags)):
        signals = signals.join(vectors.tag_pair_cosine(weights, artists).withColumnRenamed("score", name), ["x", "y"])
    steps = F.when(F.col("x") == F.col("y"), 0).otherwise(F.col("hops"))
    signals = signals.withColumn("bfs_score", 1 / (1 + steps)).drop("hops")
    sounds = audio.where("vector is not null").select(F.col("track_id").alias("id"), "vector")
    asked = sounds.join(known.select(F.col("query").alias("id")).distinct(), "id", "left_semi")
    heard = scored_pairs(known.select(F.col("query").alias("x"), F.col("candidate").alias("y")), asked, sounds, Dots).select(F.col("x").alias("query"), F.col("y").alias("candidate"), F.col("score").alias("cos_audio"))
    heard = known.join(heard, ["query", "candidate"], "left")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    has_release, has_year = F.col("_r").isNotNull() & F.col("release_id").isNotNull(), F.col("_y").isNotNull() & F.col("year").isNotNull()
    return heard.join(signals, ["x", "y"]).select(
        "query", "candidate", F.col("x").alias("query_artist"), F.col("y").alias("candidate_artist"),
        "cos_audio", "cos_graph", flag(F.col("cos_graph").isNotNull()).alias("has_graph"), "bfs_score", flag(F.col("bfs_score").isNotNull()).alias("has_bfs"),
        "tag_tfidf_cosine", flag(F.col("tag_tfidf_cosine").isNotNull()).alias("has_tags"), flag(has_release & (F.col("_r") == F.col("release_id"))).alias("same_release"), flag(has_release).alias("has_release"),
        F.when(has_year, F.abs(F.col("_y") - F.col("year")).cast("double")).alias("year_gap"), flag(has_year).alias("has_year"),
    )


def fills(raw: DataFrame) -> DataFrame:
    """One row: the median of each signal that may be missing, 0 where it always is."""
    medians = column_quantiles(raw, list(FILLED), {"median": 0.5})
    return medians.agg(*(F.coalesce(F.max(F.when(F.col("column") == c, F.col("median"))), F.lit(0.0)).alias(f"_{c}") for c in FILLED))


def complete(raw: DataFrame, filled: DataFrame) -> DataFrame:
    """Raw features with missing signals filled, and then the two products."""
    joined = raw.join(F.broadcast(filled), F.lit(True))
    whole = joined.select(*(F.coalesce(c, f"_{c}").alias(c) if c in FILLED else F.col(c) for c in raw.columns))
    return whole.withColumn("audio_tag_interaction", F.col("cos_audio") * F.col("tag_tfidf_cosine")).withColumn("graph_bfs_interaction", F.col("cos_graph") * F.col("bfs_score"))


def margin(model: dict[str, tuple[float, float, float]], intercept: float) -> Column:
    """The linear score of frozen weights: by feature (weight, mean, deviation)."""
    out = F.lit(intercept)
    for name, (weight, mean, deviation) in model.items():
        out = out + weight * (F.col(name) - mean) / deviation
    return out


def evidence(whole: DataFrame) -> DataFrame:
    """(query, evidence): the densest relation among a query's candidates, of those that are known."""
    density = lambda value, known: F.sum(F.when(F.col(known) > 0, F.greatest(F.col(value), F.lit(0.0))).otherwise(0.0)) / F.count("*")
    release = F.sum(F.greatest(F.col("same_release"), F.lit(0.0))) / F.count("*")
    return whole.groupBy("query").agg(F.greatest(density("bfs_score", "has_bfs"), density("tag_tfidf_cosine", "has_tags"), release).alias("evidence"))


def is_positive(raw: DataFrame, p90: DataFrame) -> DataFrame:
    """raw with positive: one artist, or an audio or tag cosine of the threshold at least; p90: one row (audio_p90, tag_p90)."""
    joined = raw.join(F.broadcast(p90), F.lit(True))
    alike = (F.col("cos_audio") >= F.col("audio_p90")) | (F.col("tag_tfidf_cosine") >= F.col("tag_p90"))
    known = F.col("query_artist").isNotNull() & F.col("candidate_artist").isNotNull()
    return joined.withColumn("positive", F.when(known, (F.col("query_artist") == F.col("candidate_artist")) | F.coalesce(alike, F.lit(False))).otherwise(False)).drop(*p90.columns)


def taken_in_turn(listed: DataFrame, sources: tuple[str, ...], limit: int) -> DataFrame:
    """(query, candidate, place): from ranked lists (query, candidate, source, rank), one of each source in turn, none twice.

    Only the first places of a list can be taken: each other source can use up
    at most the limit's share before.
    """
    kind = dict(listed.dtypes)
    short = listed.where(F.col("rank") <= 2 * limit)

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        lists = [frame.loc[frame["source"] == s].sort_values("rank")["candidate"].tolist() for s in sources]
        at, out, used = [0] * len(lists), [], set()
        while len(out) < limit:
            before = len(out)
            for k, items in enumerate(lists):
                while at[k] < len(items) and items[at[k]] in used:
                    at[k] += 1
                if at[k] < len(items) and len(out) < limit:
                    used.add(items[at[k]])
                    out.append(items[at[k]])
            if len(out) == before:
                break
        return pd.DataFrame({"query": [frame["query"].iloc[0]] * len(out), "candidate": out, "place": range(1, len(out) + 1)})

    return short.groupBy("query").applyInPandas(pick, f"query {kind['query']}, candidate {kind['candidate']}, place long")


def splitmix(seed: Column, attempt: Column, size: Column) -> Column:
    """A counter's place in a universe: SplitMix64 of seed and attempt, unsigned, modulo size.

    The seed is the 64 bits of a long; Arrow batches, since unsigned products
    wrap in no built-in function.
    """

    @F.pandas_udf("long")
    def place(seeds: pd.Series, attempts: pd.Series, sizes: pd.Series) -> pd.Series:
        u = np.uint64
        v = seeds.to_numpy(np.int64).view(u) + attempts.to_numpy(np.int64).view(u) + u(0x9E3779B97F4A7C15)
        v = (v ^ (v >> u(30))) * u(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> u(27))) * u(0x94D049BB133111EB)
        return pd.Series(((v ^ (v >> u(31))) % sizes.to_numpy(np.int64).view(u)).astype(np.int64))

    return place(seed, attempt.cast("long"), size.cast("long"))


def first_bits(digest: Column) -> Column:
    """The first 64 bits of a hex digest, as a signed long."""
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("long")


def select_policy(scores: DataFrame, baseline: DataFrame, retention: float = 0.90, margin_confirm: float = 0.01) -> DataFrame:
    """The best policy that passes the guards on both folds, or else the all-audio one: one row.

    scores: (reg, middle, high, low_t, high_t, fold, grp, score), one row for each
    policy, fold (``tune``, ``confirm``) and stratum; baseline: (fold, grp, score).
    Guards: the audio stratum keeps its share of the baseline, the relation
    stratum gains, the mixed one does not lose, the mean gains a margin on the
    confirming fold.  Of those that pass, the largest gain of the worse fold wins,
    then the larger sum of means, then the larger settings.
    """
    policy = ["reg", "middle", "high", "low_t", "high_t"]
    at = lambda fold, grp, value: F.max(F.when((F.col("fold") == fold) & (F.col("grp") == grp), F.col(value)))
    cells = [(f, g) for f in ("tune", "confirm") for g in ("audio", "relation", "mixed")]
    base = baseline.agg(*(at(f, g, "score").alias(f"b_{f}_{g}") for f, g in cells))
    wide = scores.groupBy(*policy).agg(*(at(f, g, "score").alias(f"{f}_{g}") for f, g in cells)).join(F.broadcast(base), F.lit(True))
    mean = lambda name: (F.col(f"{name}_audio") + F.col(f"{name}_relation") + F.col(f"{name}_mixed")) / 3

    def passes(fold: str, extra: float) -> Column:
        c = lambda g: F.col(f"{fold}_{g}")
        b = lambda g: F.col(f"b_{fold}_{g}")
        return (c("audio") >= retention * b("audio")) & (c("relation") > b("relation")) & (c("mixed") >= b("mixed")) & (mean(fold) >= (1 + extra) * mean(f"b_{fold}"))

    gain = lambda fold: mean(fold) / mean(f"b_{fold}")
    judged = wide.select(*policy, (passes("tune", 0.0) & passes("confirm", margin_confirm)).alias("passes"), F.least(gain("tune"), gain("confirm")).alias("gain"), (mean("tune") + mean("confirm")).alias("total"))
    fallback = (F.col("middle") == 20) & (F.col("high") == 20)
    first = F.struct(F.col("passes"), F.when(F.col("passes"), F.round("gain", 12)), F.when(F.col("passes"), F.round("total", 12)), *policy)
    best = judged.where(F.col("passes") | fallback).agg(F.max_by(F.struct("passes", *policy), first).alias("best"), F.count_if("passes").alias("feasible"))
    return best.select(F.col("best.passes").alias("publishable"), *(F.col(f"best.{c}").alias(c) for c in policy), "feasible")
