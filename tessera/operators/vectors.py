"""Vector search, sparse tag similarity, standardisation and projection."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as x
from tessera.plans.materialize import checkpointed, sized

if TYPE_CHECKING:
    import pandas as pd


def top_k(pairs: DataFrame, query: str, score: str, ties: str, k: int) -> DataFrame:
    """The k best rows of each query by score, then ties; adds rank from 1."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), F.asc(ties)))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def blockwise(left: DataFrame, right: DataFrame, key: str, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int = 1024) -> DataFrame:
    """Every block of left rows beside every block of right rows: compare(q, c), columns named q_ and c_, either may be empty.

    Rows are dealt to blocks of about that many by the key's hash, and a task
    gets one pair of blocks.  Neither side passes through the driver, and a
    task's memory depends on the block only.
    """
    blocks = lambda df: max(1, -(-df.count() // block))
    n_left, n_right = blocks(left), blocks(right)
    dealt = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Both sides may come from one table: new names keep a cogroup's columns apart.
    named = lambda df, side: df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns))
    q = named(left.withColumn("i", dealt(n_left)).withColumn("j", every(n_right)), "q")
    c = named(right.withColumn("j", dealt(n_right)).withColumn("i", every(n_left)), "c")
    return q.groupBy("q_i", "q_j").cogroup(c.groupBy("c_i", "c_j")).applyInPandas(compare, schema)


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector", group_col: str | None = None, block: int = 4096) -> DataFrame:
    """Exact inner-product neighbours: (query, candidate, score, rank), by score and then id.

    Blocks of queries meet blocks of vectors as a matrix product, which keeps
    each query's k best, so the last shuffle carries k rows a query and block.
    A query skips itself and candidates of its own group.
    """
    columns = [F.col(id_col).alias("id"), F.col(vector_col).alias("vector")] + ([F.col(group_col).alias("group")] if group_col else [])
    kind = dict(vectors.dtypes)[id_col]

    def search(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        if not len(mine) or not len(others):
            return pd.DataFrame({"query": mine["q_id"][:0], "candidate": others["c_id"][:0], "score": np.zeros(0)})
        own, ids = others["c_id"].to_numpy(), mine["q_id"].to_numpy()
        order = np.argsort(own, kind="stable")  # so that equal scores come in order of id
        own = own[order]
        scores = np.stack(mine["q_vector"].to_numpy()).astype(np.float64) @ np.stack(others["c_vector"].to_numpy()).astype(np.float64)[order].T
        refused = ids[:, None] == own[None, :]
        if group_col:
            refused |= mine["q_group"].to_numpy()[:, None] == others["c_group"].to_numpy()[order][None, :]
        scores[refused] = -np.inf
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        score = np.take_along_axis(scores, best, axis=1)
        taken = score > -np.inf
        return pd.DataFrame({"query": np.repeat(ids, best.shape[1])[taken.ravel()], "candidate": own[best.ravel()][taken.ravel()], "score": score.ravel()[taken.ravel()]})

    found = blockwise(queries.select(*columns), vectors.select(*columns), "id", search, f"query {kind}, candidate {kind}, score double", block)
    return top_k(found, "query", "score", "candidate", k)


def above(vectors: DataFrame, threshold: float, id_col: str = "id", vector_col: str = "vector", block: int = 4096) -> DataFrame:
    """(query, candidate): pairs whose inner product reaches a threshold, by blocks."""
    kind = dict(vectors.dtypes)[id_col]

    def search(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        if not len(mine) or not len(others):
            return pd.DataFrame({"query": mine["q_id"][:0], "candidate": others["c_id"][:0]})
        ids, own = mine["q_id"].to_numpy(), others["c_id"].to_numpy()
        i, j = np.nonzero(np.stack(mine["q_vector"].to_numpy()).astype(np.float64) @ np.stack(others["c_vector"].to_numpy()).astype(np.float64).T >= threshold)
        return pd.DataFrame({"query": ids[i], "candidate": own[j]}).loc[ids[i] != own[j]]

    e = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    return blockwise(e, e, "id", search, f"query {kind}, candidate {kind}", block)


def tag_idf(owners: DataFrame) -> DataFrame:
    """(tag, idf, df) from distinct (artist_id, tag)."""
    n = owners.agg(F.countDistinct("artist_id").alias("n"))
    df = owners.groupBy("tag").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n), F.lit(True)).select("tag", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"), "df")


def tag_weights(owners: DataFrame) -> DataFrame:
    """(artist_id, tag, df, idf) from distinct (artist_id, tag)."""
    return owners.join(tag_idf(owners).select("tag", "df", "idf"), "tag")


def tag_cosine(weights: DataFrame, queries: DataFrame, most_owners: int | None = None, block: int = 1024) -> DataFrame:
    """(query, candidate, score): idf cosine between artists that share a tag.

    Blocks of queries meet blocks of artists as matrices over their tags, so a
    tag of very many owners costs no more rows than a rare one and no pair is
    summed in two tasks.  With most_owners, tags with more owners count in norms
    only.
    """
    import numpy as np
    import pandas as pd

    counted = F.lit(True) if most_owners is None else F.col("df") <= most_owners
    owned = weights.groupBy("artist_id").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"), F.collect_list(F.when(counted, F.struct("tag", "idf"))).alias("owned"))
    packed = checkpointed(owned.where(F.size("owned") > 0).select("artist_id", "norm", F.col("owned.tag").alias("tags"), F.col("owned.idf").alias("idfs")))
    asked = checkpointed(packed.join(queries.select("artist_id").distinct(), "artist_id", "left_semi"))

    kind = dict(weights.dtypes)["artist_id"]

    def compare(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(others):
            return pd.DataFrame({"query": mine["q_artist_id"][:0], "candidate": others["c_artist_id"][:0], "score": np.zeros(0)})
        tags, _ = pd.factorize(np.concatenate([*mine["q_tags"], *others["c_tags"]]))
        idf = np.concatenate([*mine["q_idfs"], *others["c_idfs"]])
        row = np.repeat(np.arange(len(mine) + len(others)), [len(t) for t in (*mine["q_tags"], *others["c_tags"])])
        common = np.zeros((len(mine), len(others)))
        for first in range(0, int(tags.max()) + 1, 4096):  # so many tags at a time
            at = np.flatnonzero((tags >= first) & (tags < first + 4096))
            part = np.zeros((len(mine) + len(others), 4096))
            part[row[at], tags[at] - first] = idf[at]
            common += part[: len(mine)] @ part[len(mine) :].T
        a, b = mine["q_artist_id"].to_numpy(), others["c_artist_id"].to_numpy()
        i, j = np.nonzero((common > 0) & (a[:, None] != b[None, :]))
        score = common[i, j] / (mine["q_norm"].to_numpy()[i] * others["c_norm"].to_numpy()[j])
        return pd.DataFrame({"query": a[i], "candidate": b[j], "score": score})

    return blockwise(asked, packed, "artist_id", compare, f"query {kind}, candidate {kind}, score double", block)


def tag_neighbors(owners: DataFrame, queries: DataFrame, k: int, places: int = 9, block: int = 4096, weights: DataFrame | None = None) -> DataFrame:
    """(query, candidate, score, rank): the k best idf cosines of artists that share a tag, by score at so many places, then candidate.

    owners: distinct (artist_id, tag), ids whole numbers; queries: artist_id;
    weights: a checkpoint of (tag, idf), by default counted from owners.
    Artists of equal tags have equal cosines and are compared as one kind.  A
    task holds a block of the queries' kinds and sees all kinds once, in order of
    their least id, a batch at a time, so that it keeps k + 1 rows each and no
    pairs are shuffled.  A kind travels as numbers of its tags, once for each
    block; of a kind only the k + 1 least ids can be among a query's best.
    """
    import numpy as np
    import pyarrow as pa

    from tessera.operators.nearest import Nearest
    from tessera.operators.ordering import row_numbers

    lists = checkpointed(owners.groupBy("artist_id").agg(F.collect_list("tag").alias("tags")))
    if weights is None:
        n = lists.where("artist_id is not null").count()
        df = lists.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("df"))
        weights = df.select("tag", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    tags = checkpointed(row_numbers(weights.select("tag", "idf"), ["tag"], "number").select("tag", F.col("number").cast("int").alias("number"), "idf"))
    owned = lists.where("artist_id is not null").select("artist_id", F.explode("tags").alias("tag")).join(sized(tags), "tag").groupBy("artist_id")
    owned = checkpointed(owned.agg(F.sort_array(F.collect_list(F.struct("number", "idf"))).alias("o")).select("artist_id", F.col("o.number").alias("tags"), F.col("o.idf").alias("idfs")))
    kinds = checkpointed(owned.groupBy("tags").agg(F.min("artist_id").alias("kind"), F.first("idfs").alias("idfs"), F.least(F.count("*"), F.lit(k + 1)).alias("size")))
    kinds = kinds.withColumn("norm", F.sqrt(F.aggregate("idfs", F.lit(0.0), lambda s, i: s + i * i)))
    place = F.row_number().over(Window.partitionBy("tags").orderBy("artist_id"))
    members = owned.select("artist_id", "tags").withColumn("place", place).where(F.col("place") <= k + 1).join(kinds.select("tags", "kind"), "tags").select("kind", F.col("artist_id").alias("candidate"))
    own = owned.join(queries.select("artist_id").distinct(), "artist_id", "left_semi").join(kinds.select("tags", "kind"), "tags")
    own = checkpointed(own.select(F.col("artist_id").alias("query"), F.col("kind").alias("of")))
    asked = kinds.join(own.select(F.col("of").alias("kind")).distinct(), "kind", "left_semi")
    blocks = max(1, -(-own.select("of").distinct().count() // block))
    columns = [F.col("kind").alias("artist_id"), "norm", "tags"]
    mine = asked.select(F.pmod(F.xxhash64("kind"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), *columns, "idfs")
    others = kinds.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), *columns, F.lit(None).cast("array<double>").alias("idfs"))
    dealt = mine.unionByName(others).repartitionById(blocks, F.col("block")).sortWithinPartitions("side", "artist_id")
    kind = dict(owners.dtypes)["artist_id"]
    names = ["query", "candidate", "score", "rank"]

    def search(batches):
        ids, norms, numbers, weights, best = [], [], [], [], None
        for batch in batches:
            side = batch.column("side").to_numpy()
            cut = int(np.searchsorted(side, 1))
            if cut:
                q = batch.slice(0, cut)
                ids.append(q.column("artist_id").to_numpy())
                norms.append(q.column("norm").to_numpy())
                numbers += [q.column("tags")]
                weights += [q.column("idfs")]
            if cut == len(side) or not ids:
                continue
            if best is None:
                best = Nearest(np.concatenate(ids), np.concatenate(norms), pa.chunked_array(numbers).combine_chunks(), pa.chunked_array(weights).combine_chunks(), k + 1, places)
            c = batch.slice(cut)
            best.see(c.column("artist_id").to_numpy(), c.column("norm").to_numpy(), c.column("tags"))
        if best is not None:
            found = best.best()
            for at in range(0, len(found[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(f[at : at + 100_000]) for f in found], names=names)

    found = dealt.mapInArrow(search, f"query {kind}, candidate {kind}, score double, rank long").withColumn("rounded", F.round("score", places))
    found = found.select(F.col("query").alias("of"), F.col("candidate").alias("kind"), "score", "rounded").join(kinds.select("kind", "size"), "kind")
    # Kinds behind others of k + 1 artists or more have no place.
    upto = F.coalesce(F.sum("size").over(Window.partitionBy("of").orderBy(F.desc("rounded"), "kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.withColumn("upto", upto).withColumn("before", F.min("upto").over(Window.partitionBy("of", "rounded"))).where(F.col("before") <= k)
    first = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("rounded"), "candidate"))
    best = found.join(members, "kind").withColumn("first", first).where(F.col("first") <= k + 1)
    pairs = own.join(best, "of").where("query <> candidate").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("first")))
    return pairs.where(F.col("rank") <= k).select("query", "candidate", "score", F.col("rank").cast("long").alias("rank"))


def tag_pair_cosine(weights: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (x, y) of artists with score: idf cosine, 1 for an artist with itself, 0 without a common tag, null where either has none."""
    from tessera.operators.pairwise import TagCosines, scored_pairs

    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm")
    owned = weights.where("artist_id is not null").groupBy(F.col("artist_id").alias("id")).agg(norm, F.collect_list(F.struct("tag", "idf")).alias("o"))
    lists = checkpointed(owned.select("id", "norm", F.col("o.tag").alias("tags"), F.col("o.idf").alias("idfs")))
    distinct = checkpointed(pairs.select("x", "y").distinct())
    asked = checkpointed(lists.join(distinct.select(F.col("x").alias("id")).distinct(), "id", "left_semi"))
    scored = scored_pairs(distinct, asked, lists, TagCosines)
    score = F.when(F.col("x") == F.col("y"), 1.0).otherwise(F.col("score"))
    return pairs.join(scored.select("x", "y", score.alias("score")), ["x", "y"], "left")


def standardized(df: DataFrame, columns: list[str], limit: float = 10.0) -> DataFrame:
    """Columns as z-scores of the whole table, missing values at the mean, clipped; constants become 0."""
    good = lambda c: F.when(x.finite(F.col(c)), F.col(c))
    stats = df.agg(*(F.avg(good(c)).alias(f"m_{c}") for c in columns), *(F.stddev_pop(good(c)).alias(f"s_{c}") for c in columns))
    joined = df.join(F.broadcast(stats), F.lit(True))  # one row
    scaled = lambda c: F.coalesce(x.clip(x.ratio(good(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), -limit, limit), F.lit(0.0))
    return joined.select(*[c for c in df.columns if c not in columns], *(scaled(c).alias(c) for c in columns))


def pca(df: DataFrame, k: int, vector_col: str = "vector", target: float | None = None):
    """A fitted projection; with a target, the fewest of k components that explain so much, an error if none do."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    prepared = df.withColumn("_v", array_to_vector(F.transform(vector_col, lambda e: e.cast("double"))))
    model = PCA(k=k, inputCol="_v", outputCol="projected").fit(prepared)
    if target is not None:
        total = 0.0
        for i, share in enumerate(model.explainedVariance):
            total += float(share)
            if total >= target:
                model = PCA(k=i + 1, inputCol="_v", outputCol="projected").fit(prepared)
                break
        else:
            raise ValueError(f"{k} components explain {total:.3f} of the variance; {target} is asked for")
    return model, model.transform(prepared).drop("_v")
