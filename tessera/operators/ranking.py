"""Candidate merging, ranking metrics, gates and rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as x
from tessera.plans import shipping

shipping.by_value(__name__)


def merged(candidates: DataFrame) -> DataFrame:
    """One row for each (query, candidate) of rows (query, candidate, source, score, rank): sources, best rank, scores by source."""
    return candidates.where("query <> candidate").groupBy("query", "candidate").agg(
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.min("rank").alias("best_rank"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "score")))).alias("scores"),
    )


def audited(candidates: DataFrame, limit: int) -> DataFrame:
    """By query: raw, unique and duplicate candidates, and by source the shortage against a limit and exclusive finds."""
    union = merged(candidates).groupBy("query").agg(F.count("*").alias("unique_candidates"), F.count_if(F.size("sources") == 1).alias("exclusive"))
    raw = candidates.where("query <> candidate").groupBy("query", "source").agg(F.count("*").alias("n"))
    by_query = raw.groupBy("query").agg(F.sum("n").alias("raw_candidates"), F.sum(F.greatest(F.lit(limit) - F.col("n"), F.lit(0))).alias("shortage"))
    return union.join(by_query, "query").withColumn("duplicates", F.col("raw_candidates") - F.col("unique_candidates"))


def metrics(ranked: DataFrame, ks: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """By query, from (query, rank, label): reciprocal rank, recall, hit and normalised gain at each k; none without positives."""
    gain = F.col("label") / F.log2(F.col("rank") + 1)
    sums = [F.sum(F.when(F.col("rank") <= k, gain)).alias(f"dcg{k}") for k in ks] + [F.sum(F.when(F.col("rank") <= k, F.col("label"))).alias(f"hits{k}") for k in ks]
    grouped = ranked.groupBy("query").agg(F.sum("label").alias("positives"), F.min(F.when(F.col("label") > 0, F.col("rank"))).alias("first"), *sums).where("positives > 0")

    def ideal(k: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.least(F.col("positives").cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))

    out = [x.ratio(F.lit(1.0), F.col("first")).alias("mrr")]
    for k in ks:
        hits = F.coalesce(F.col(f"hits{k}"), F.lit(0))
        out += [(hits / F.col("positives")).alias(f"recall{k}"), F.when(hits > 0, 1.0).otherwise(0.0).alias(f"hit{k}"), (F.coalesce(F.col(f"dcg{k}"), F.lit(0.0)) / ideal(k)).alias(f"ndcg{k}")]
    return grouped.select("query", "positives", *out)


def random_expectation(sizes: DataFrame, ks: tuple[int, ...] = (10, 20)) -> DataFrame:
    """Exact means of the metrics over all orders, from (query, n, positives).

    The chance that a given place holds a positive is positives / n; that the
    first k hold none is a product of shrinking shares.
    """
    n, p = F.col("n").cast("double"), F.col("positives").cast("double")
    out = []
    for k in ks:
        places = F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(k)))
        none = F.aggregate(places, F.lit(1.0), lambda q, i: q * F.greatest((n - p - i + 1) / (n - i + 1), F.lit(0.0)))
        gain = F.aggregate(places, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)) * p / n
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("positives").cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        out += [(F.least(n, F.lit(float(k))) / n).alias(f"recall{k}"), (1 - none).alias(f"hit{k}"), (gain / ideal).alias(f"ndcg{k}")]
    return sizes.where("positives > 0").select("query", *out)


def gate(evidence: Column, low: float, high: float, middle_quota: int, high_quota: int, full: int = 20) -> Column:
    """How many of the places the audio list gets: all below low evidence, less above."""
    return F.when(evidence < low, full).when(evidence < high, middle_quota).otherwise(high_quota)


def interleaved(learned: list, audio: list, quota: int, size: int = 20) -> list[tuple]:
    """Places in turn: the audio list has place r if floor(r q / size) grows there; used items are skipped."""
    out, used, at = [], set(), {"learned": 0, "audio": 0}
    lists = {"learned": learned, "audio": audio}
    for r in range(1, size + 1):
        turn = "audio" if r * quota // size > (r - 1) * quota // size else "learned"
        for name in (turn, "learned" if turn == "audio" else "audio"):
            while at[name] < len(lists[name]) and lists[name][at[name]] in used:
                at[name] += 1
            if at[name] < len(lists[name]):
                item = lists[name][at[name]]
                used.add(item)
                out.append((r, item, name))
                break
    return out


def interleave(scored: DataFrame, size: int = 20) -> DataFrame:
    """(query, rank, candidate, taken_from) from (query, candidate, learned, audio, quota); a query is a bounded list."""
    import pandas as pd

    kind = dict(scored.dtypes)
    schema = f"query {kind['query']}, rank int, candidate {kind['candidate']}, taken_from string"
    by = lambda c: F.row_number().over(Window.partitionBy("query").orderBy(F.desc(c), "candidate"))
    # Only the first places of each list can be used.
    short = scored.withColumn("_l", by("learned")).withColumn("_a", by("audio")).where(f"_l <= {2 * size} or _a <= {2 * size}")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from frames

    def mix(frame: pd.DataFrame) -> pd.DataFrame:
        rows = interleaved(frame.sort_values("_l")["candidate"].tolist(), frame.sort_values("_a")["candidate"].tolist(), int(frame["quota"].iloc[0]), size)
        return pd.DataFrame([(frame["query"].iloc[0], r, c, f) for r, c, f in rows], columns=["query", "rank", "candidate", "taken_from"])

    return short.groupBy("query").applyInPandas(mix, schema)


def backfill(union: DataFrame, extra: DataFrame, target: int) -> DataFrame:
    """Fill each query's candidates to a target from two more lists in turn; duplicates met on the way stay as evidence.

    union: (query, candidate); extra: (query, candidate, source, rank) with sources ``tag`` and ``bfs``.
    """
    import pandas as pd

    kind = dict(union.dtypes)
    schema = f"query {kind['query']}, candidate {kind['candidate']}, source string, is_new boolean"
    both = union.select("query", "candidate", F.lit("union").alias("source"), F.lit(0).alias("rank")).unionByName(extra.select("query", "candidate", "source", F.col("rank").cast("int").alias("rank")))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        have = set(frame.loc[frame["source"] == "union", "candidate"])
        lists = {s: frame.loc[frame["source"] == s].sort_values(["rank", "candidate"])["candidate"].tolist() for s in ("tag", "bfs")}
        at, out, turn = {"tag": 0, "bfs": 0}, [], 0
        while len(have) < target and any(at[s] < len(lists[s]) for s in lists):
            source = ("tag", "bfs")[turn % 2]
            turn += 1
            while at[source] < len(lists[source]):
                item = lists[source][at[source]]
                at[source] += 1
                out.append((frame["query"].iloc[0], item, source, item not in have))
                if item not in have:
                    have.add(item)
                    break
        return pd.DataFrame(out, columns=["query", "candidate", "source", "is_new"])

    return both.groupBy("query").applyInPandas(fill, schema)


def bootstrap(differences: DataFrame, value: str, cluster: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and 95 % interval of a paired difference by resampling clusters: one row.

    Each cluster gets Poisson weights from its own hash, so resampling is one
    aggregation of fixed width and needs no collected rows.
    """
    import numpy as np
    import pandas as pd

    sums = differences.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"), F.xxhash64(F.lit(seed), F.first(cluster)).alias("h"))
    schema = "r int, s double, n double"

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, resamples))
        for frame in frames:
            for s, n, h in zip(frame["s"], frame["n"], frame["h"], strict=True):
                weights = np.random.default_rng(int(h) & (1 << 63) - 1).poisson(1.0, resamples)
                total[0] += weights * s
                total[1] += weights * n
        yield pd.DataFrame({"r": np.arange(resamples), "s": total[0], "n": total[1]})

    means = sums.select("s", "n", "h").mapInPandas(weigh, schema).groupBy("r").agg((F.sum("s") / F.sum("n")).alias("m"))
    point = sums.agg((F.sum("s") / F.sum("n")).alias("mean"))
    interval = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return point.join(F.broadcast(interval), F.lit(True))


def expected_mrr(n: Column, positives: Column) -> Column:
    """Mean reciprocal rank of the first positive over all orders of n: the chance that it is at a place is of none before and one there."""
    n, p = n.cast("double"), positives.cast("double")
    start = F.struct(F.lit(1.0).alias("none"), F.lit(0.0).alias("sum"))

    def place(state: Column, i: Column) -> Column:
        left = n - i + 1
        return F.struct((state["none"] * F.greatest(left - p, F.lit(0.0)) / left).alias("none"), (state["sum"] + state["none"] * F.least(p / left, F.lit(1.0)) / i).alias("sum"))

    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, place, lambda state: state["sum"])


def ranked_metrics(hits: DataFrame, scorers: list[str], ks: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """(query, grp, scorer, positives, metric, value) from the positives of a query and group with a column of ranks for each scorer; null where a list has it not.

    mrr, recall, hit and normalised gain at each k, all by the positives there are, listed or not.
    """
    p, sums = F.col("p"), [F.count("*").alias("p")]
    for s in scorers:
        sums.append(F.min(s).alias(f"{s}_first"))
        for k in ks:
            sums += [F.count_if(F.col(s) <= k).alias(f"{s}_h{k}"), F.sum(F.when(F.col(s) <= k, 1 / F.log2(F.col(s) + 1)).otherwise(0.0)).alias(f"{s}_d{k}")]
    ideal = {k: F.aggregate(F.sequence(F.lit(1), F.least(p.cast("int"), F.lit(k))), F.lit(0.0), lambda t, i: t + 1 / F.log2(i + 1)) for k in ks}
    out = []
    for s in scorers:
        found = {"mrr": F.coalesce(1 / F.col(f"{s}_first"), F.lit(0.0))}
        for k in ks:
            h = F.col(f"{s}_h{k}")
            found |= {f"recall@{k}": h / p, f"hit@{k}": (h > 0).cast("double"), f"ndcg@{k}": F.col(f"{s}_d{k}") / F.col(f"ideal{k}")}
        out += [F.struct(F.lit(s).alias("scorer"), F.lit(m).alias("metric"), value.alias("value")) for m, value in found.items()]
    by = hits.groupBy("query", "grp").agg(*sums).withColumns({f"ideal{k}": i for k, i in ideal.items()})
    return by.select("query", "grp", p.alias("positives"), F.inline(F.array(*out))).select("query", "grp", "scorer", "positives", "metric", "value")


def resampled(rows: DataFrame, key: str, values: list[str], samples: int, seed: int = 42, stratum: str | None = None, block: int = 4096) -> DataFrame:
    """(stratum, r, *values): sums over as many rows as there are, drawn with replacement; each stratum by itself.

    Rows are dealt over blocks.  How many draws fall on which block is one draw
    of all tasks alike; which rows of its own they are a task draws by itself.
    """
    import zlib

    import numpy as np
    import pandas as pd

    over = F.lit("") if stratum is None else F.col(stratum).cast("string")
    dealt = rows.select(over.alias("stratum"), F.col(key).alias("key"), *(F.col(c).cast("double").alias(c) for c in values))
    blocks = max(1, -(-dealt.count() // block))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(blocks)).cast("int"))
    sizes: dict[str, dict[int, int]] = {}
    for r in dealt.groupBy("stratum", "block").count().collect():  # a row for some thousand rows
        sizes.setdefault(r["stratum"], {})[r["block"]] = r["count"]

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        name, mine = frame["stratum"].iloc[0], int(frame["block"].iloc[0])
        m, at = len(frame), zlib.crc32(name.encode())
        order = sorted(sizes[name])
        shares = np.array([sizes[name][b] for b in order], float)
        draws = np.random.default_rng([seed, at]).multinomial(int(shares.sum()), shares / shares.sum(), samples)[:, order.index(mine)]
        data = frame.sort_values("key")[values].to_numpy(float)
        own, sums = np.random.default_rng([seed, at, mine + 1]), np.zeros((samples, len(values)))
        for i in range(0, samples, 64):
            sums[i : i + 64] = own.multinomial(draws[i : i + 64], np.full(m, 1 / m)) @ data
        out = pd.DataFrame(sums, columns=values)
        out.insert(0, "r", np.arange(samples))
        out.insert(0, "stratum", name)
        return out

    drawn = dealt.groupBy("stratum", "block").applyInPandas(draw, "stratum string, r int, " + ", ".join(f"{c} double" for c in values))
    return drawn.groupBy("stratum", "r").agg(*(F.sum(c).alias(c) for c in values))


def paired_intervals(differences: DataFrame, baselines: list[str], samples: int, seed: int = 42, cluster: str | None = None) -> DataFrame:
    """(baseline, samples, point, low, high) of differences (query, grp and a column for each baseline, and maybe a cluster): strata weigh alike.

    Queries are drawn in each stratum, or clusters with all their queries; one
    set of draws serves all baselines.  A draw of clusters without one of the
    strata does not count.
    """
    strata = sorted(r["grp"] for r in differences.select("grp").distinct().collect())  # a few
    means = differences.groupBy("grp").agg(*(F.avg(b).alias(b) for b in baselines)).agg(*(F.avg(b).alias(b) for b in baselines))
    if cluster is None:
        drawn = resampled(differences.withColumn("_n", F.lit(1.0)), "query", [*baselines, "_n"], samples, seed, "grp")
        estimates = drawn.select("r", *((F.col(b) / F.col("_n")).alias(b) for b in baselines)).groupBy("r").agg(*(F.avg(b).alias(b) for b in baselines))
    else:
        here = lambda i, c: F.sum(F.when(F.col("grp") == strata[i], c).otherwise(0.0))
        names = [f"{b}_{i}" for i in range(len(strata)) for b in [*baselines, "_n"]]
        sums = differences.groupBy(cluster).agg(*(here(i, F.lit(1.0) if b == "_n" else F.col(b)).alias(f"{b}_{i}") for i in range(len(strata)) for b in [*baselines, "_n"]))
        drawn = resampled(sums, cluster, names, samples, seed)
        for i in range(len(strata)):
            drawn = drawn.where(F.col(f"_n_{i}") > 0)
        estimates = drawn.select("r", *((sum(F.col(f"{b}_{i}") / F.col(f"_n_{i}") for i in range(len(strata))) / max(len(strata), 1)).alias(b) for b in baselines))
    rows = lambda df: df.select(F.inline(F.array(*(F.struct(F.lit(b).alias("baseline"), F.col(b).alias("v")) for b in baselines))))
    interval = rows(estimates).groupBy("baseline").agg(F.count("v").alias("samples"), F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"))  # of the draws
    return rows(means).withColumnRenamed("v", "point").join(interval, "baseline").select("baseline", "samples", "point", "low", "high")


def _corrected(na: Column, ma: Column, va: Column, nb: Column, mb: Column, vb: Column) -> Column:
    """Hedges' g of two samples from counts, means and sample variances; null where nothing varies."""
    free = na + nb - 2
    pooled = F.sqrt(((na - 1) * va + (nb - 1) * vb) / free)
    return F.when((free > 0) & (pooled > 0), (ma - mb) / pooled * (1 - 3.0 / (4 * free - 1)))


def effect(df: DataFrame, related: str, other: str) -> DataFrame:
    """One row: sizes of the two samples, columns with nulls, and Hedges' g."""
    sums = df.agg(*(f(c).alias(f"{n}_{k}") for k, c in (("a", related), ("b", other)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    c = F.col
    return sums.select(c("n_a").alias("n_related"), c("n_b").alias("n_random"), _corrected(c("n_a"), c("m_a"), c("v_a"), c("n_b"), c("m_b"), c("v_b")).alias("g"))


def effect_interval(df: DataFrame, id_col: str, flag: str, value: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """One row: Hedges' g and its 95 % interval, by Poisson weights from each row's own hash; a task sends six sums a resample."""
    import numpy as np
    import pandas as pd

    rows = df.select(F.col(flag).alias("f"), F.col(value).cast("double").alias("v"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"))

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 3, resamples))
        for frame in frames:
            for f, v, h in zip(frame["f"], frame["v"], frame["h"], strict=True):
                w = np.random.default_rng(int(h) & (1 << 63) - 1).poisson(1.0, resamples)
                total[int(f)] += np.stack([w, w * v, w * v * v])
        yield pd.DataFrame({"r": np.arange(resamples)} | {f"{n}{k}": total[k, i] for k in (0, 1) for i, n in enumerate("nsq")})

    sums = rows.mapInPandas(weigh, "r int, n0 double, s0 double, q0 double, n1 double, s1 double, q1 double").groupBy("r").agg(*(F.sum(f"{n}{k}").alias(f"{n}{k}") for k in (0, 1) for n in "nsq"))
    c = F.col
    moment = lambda k: (c(f"n{k}"), c(f"s{k}") / c(f"n{k}"), (c(f"q{k}") - c(f"s{k}") ** 2 / c(f"n{k}")) / (c(f"n{k}") - 1))
    drawn = sums.where("n0 > 1 and n1 > 1").select(_corrected(*moment(1), *moment(0)).alias("g"))
    point = effect(df.select(F.when(F.col(flag), F.col(value)).alias("a"), F.when(~F.col(flag), F.col(value)).alias("b")), "a", "b").select("g")
    return point.join(F.broadcast(drawn.agg(F.percentile("g", 0.025).alias("low"), F.percentile("g", 0.975).alias("high"))), F.lit(True))  # a thousand resamples
