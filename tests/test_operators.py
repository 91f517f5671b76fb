"""Operators against hand-made cases."""

import math
import sqlite3
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import exprs as x
from tessera.operators import features, graph, models, ordering, ranking, vectors
from tessera.sources import readers, sinks

EDGES = [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "a"), ("e", "a"), ("b", "z")]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(i,) for i in "abcde"], "id string"), spark.createDataFrame(EDGES, "src string, dst string")


@pytest.mark.parametrize("search", [graph.bfs, graph.bfs_messages])
def test_bfs(small, search):
    got = {r["id"]: (r["distance"], r["parent"]) for r in search(*small, "a").collect()}
    assert got == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "b"), "z": (2, "b"), "e": (None, None)}


def test_bfs_errors(small):
    with pytest.raises(ValueError):
        graph.bfs(*small, "q")
    with pytest.raises(ValueError):
        graph.bfs(*small, "a", max_iter=1)


def test_verify(small, spark):
    good = graph.bfs(*small, "a")
    bad = good.where("id <> 'z'").withColumn("distance", F.when(F.col("id") == "d", 7).otherwise(F.col("distance")))
    row = graph.verify_distances(bad, good).first()
    assert (row["mismatches"], row["missing"], row["extra"], row["repeated"]) == (1, 1, 0, 0)


def test_adjacency(small):
    got = {r["id"]: (r["neighbors"], r["degree"]) for r in graph.adjacency(*small).collect()}
    assert got["a"] == (["b", "c"], 2) and got["e"] == (["a"], 1) and "z" not in got


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([("k", 1.0, 1.0, 0), ("k", 2.0, 1.0, 1), ("k", 3.0, 2.0, 2), ("one", 5.0, 1.0, 3)], "k string, v double, w double, i int")
    got = {r["k"]: (r["q10"], r["q50"], r["q90"]) for r in features.weighted_quantiles(df, "k", "v", "w", "i", {"q10": 0.1, "q50": 0.5, "q90": 0.9}).collect()}
    assert got["k"] == pytest.approx((1.0, 7 / 3, 3.0)) and got["one"] == (5.0, 5.0, 5.0)


def test_ranking_metrics(spark):
    df = spark.createDataFrame([("q", i + 1, label) for i, label in enumerate([0, 1, 0, 1])] + [("none", 1, 0)], "query string, rank int, label int")
    rows = ranking.metrics(df, (10,)).collect()
    assert len(rows) == 1 and rows[0]["mrr"] == 0.5 and rows[0]["recall10"] == 1.0
    assert rows[0]["ndcg10"] == pytest.approx((1 / np.log2(3) + 1 / np.log2(5)) / (1 + 1 / np.log2(3)))


def test_random_expectation(spark):
    rng = np.random.default_rng(1)
    n, p, k = 12, 3, 5
    expected = ranking.random_expectation(spark.createDataFrame([("q", n, p)], "query string, n int, positives int"), (k,)).first()
    ideal = sum(1 / np.log2(i + 2) for i in range(min(p, k)))
    found = np.zeros(3)
    for _ in range(20000):
        labels = rng.permutation([1] * p + [0] * (n - p))[:k]
        found += [labels.sum() / p, labels.any(), sum(v / np.log2(i + 2) for i, v in enumerate(labels)) / ideal]
    assert np.allclose(found / 20000, [expected["recall5"], expected["hit5"], expected["ndcg5"]], atol=0.015)


def test_interleave():
    got = ranking.interleaved(list("ABCD"), list("BDAC"), 10, 20)
    assert [(i, f) for _, i, f in got[:4]] == [("A", "learned"), ("B", "audio"), ("C", "learned"), ("D", "audio")]
    assert [i for _, i, _ in ranking.interleaved(list("ABCD"), list("BDAC"), 0, 3)] == list("ABC")
    assert [i for _, i, _ in ranking.interleaved(list("ABCD"), list("BDAC"), 3, 3)] == list("BDA")


def test_backfill(spark):
    union = spark.createDataFrame([("q", "a"), ("q", "b")], "query string, candidate string")
    extra = spark.createDataFrame([("q", "a", "tag", 1), ("q", "c", "tag", 2), ("q", "d", "bfs", 1), ("q", "e", "tag", 3)], "query string, candidate string, source string, rank int")
    got = [(r["candidate"], r["source"], r["is_new"]) for r in ranking.backfill(union, extra, 4).collect()]
    assert got == [("a", "tag", False), ("c", "tag", True), ("d", "bfs", True)]


def test_stack(spark):
    df = spark.createDataFrame([(2000.0, 1990.0, 1995.0), (1990.0, 1990.0, 1990.0)], "o double, l double, y double")
    assert models.stack_weight(df, "o", "l", "y").first()[0] == 0.5
    assert models.stack_weight(df.where("o = l"), "o", "l", "y").first()[0] == 0.5


def test_leave_one_out(spark):
    tags = spark.createDataFrame([(a, "t") for a in ("x", "y", "test")] + [("test", "unknown")], "artist_id string, tag string")
    targets = spark.createDataFrame([("x", 1990.0), ("y", 2000.0), ("g", 1950.0)], "artist_id string, target double")
    got = {r["artist_id"]: (r["mean"], r["n"]) for r in features.leave_one_out_prior(tags, targets, 1.0).collect()}
    assert got["x"] == pytest.approx(((2000 + 1980) / 2, 1)) and got["test"] == pytest.approx(((3990 + 1980) / 3, 1))


RIDGE = ([[1.0, -2.0, 0.5], [0.0, 1.5, -1.0], [2.0, 0.25, 1.25], [-1.5, 2.0, 0.0], [0.75, -0.5, 2.0]], [0.20, 0.75, 0.55, 0.35, 0.90])


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_ridge_gradient(spark, parts):
    df = spark.createDataFrame([(*f, y) for f, y in zip(*RIDGE)], "a double, b double, c double, y double").repartition(parts)
    loss, gradient, slope = models.ridge_gradient(df, ["a", "b", "c"], "y", np.array([0.12, -0.08, 0.05]), 0.1, 0.3)
    assert loss == pytest.approx(0.29008625, abs=1e-10)
    assert gradient == pytest.approx([0.203, -1.07875, -0.14075], abs=1e-10) and slope == pytest.approx(-0.777, abs=1e-10)


def test_ridge_descends(spark):
    df = spark.createDataFrame([(*f, y) for f, y in zip(*RIDGE)], "a double, b double, c double, y double")
    _, _, losses = models.ridge_descent(df, ["a", "b", "c"], "y", steps=10, rate=0.04)
    assert losses == sorted(losses, reverse=True)


def test_knn(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(e) for e in rng.normal(size=8)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>, grp int").repartition(3)
    got = {(r["query"], r["rank"]): r["candidate"] for r in vectors.knn(df, df, 5, group_col="grp", block=16).collect()}
    for i, q, g in rows:
        best = sorted((-float(np.dot(q, c)), j) for j, c, h in rows if j != i and h != g)[:5]
        assert [got[i, k + 1] for k in range(5)] == [j for _, j in best]


@pytest.mark.parametrize("cap", [None, 5000])
def test_tag_cosine_with_a_hot_tag(spark, cap):
    n = 5100
    tags = {i: {"hot", f"t{i % 700}", f"u{i % 41}"} for i in range(n)}
    rows = [(i, t) for i, mine in tags.items() for t in mine]
    owners = Counter(t for _, t in rows)
    idf = {t: math.log((n + 1) / (k + 1)) + 1 for t, k in owners.items()}
    norm = {i: math.sqrt(sum(idf[t] ** 2 for t in mine)) for i, mine in tags.items()}
    expected = {}
    for q in (0, 7, 5099):
        for c in tags:
            common = [t for t in tags[q] & tags[c] if cap is None or owners[t] <= cap]
            if c != q and common:
                expected[q, c] = sum(idf[t] ** 2 for t in common) / (norm[q] * norm[c])
    weights = vectors.tag_weights(spark.createDataFrame(rows, "artist_id long, tag string"))
    got = vectors.tag_cosine(weights, spark.createDataFrame([(0,), (7,), (5099,), (9999,)], "artist_id long"), cap).collect()
    assert len(got) == len(expected)
    assert all(abs(r["score"] - expected[r["query"], r["candidate"]]) < 1e-9 for r in got)


def test_walks_take_all_paths(spark):
    tracks = [(1, 10, 100), (2, 10, 101), (3, 11, 102), (4, 12, 103), (5, 13, 104), (6, 14, 104), (7, 15, 105)]
    by_artist, release = {t: a for t, a, _ in tracks}, {t: r for t, _, r in tracks}
    owners = [(11, "x"), (12, "x"), (12, "alone"), (15, "own"), (99, "own")]
    frame = spark.createDataFrame
    got = graph.walks(frame(tracks, "track_id long, artist_id long, release_id long"), frame([(10, 11), (13, 98)], "src long, dst long"), frame(owners, "artist_id long, tag string"), 20, 8).collect()
    assert len(got) == 140
    total = [sum(r["path_counts"][i] for r in got) for i in range(4)]
    assert all(total)
    for r in got:
        assert r["walk_seq"][0] == r["track_id"] and sum(r["path_counts"]) == len(r["walk_seq"]) - 1
        assert r["stop_reason"] == ("no_eligible_path" if r["track_id"] == 7 else "target_length")
        for a, b in zip(r["walk_seq"], r["walk_seq"][1:]):
            pair = by_artist[a], by_artist[b]
            assert a != b and (pair[0] == pair[1] or pair in {(10, 11), (11, 12), (12, 11)} or release[a] == release[b])


def test_pca_target(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), float(2 * a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(50, 2)))]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    model, projected = vectors.pca(df, 3, target=0.99)
    assert model.getK() == 2 and projected.count() == 50
    with pytest.raises(ValueError):
        vectors.pca(df, 1, target=0.9999)


def test_row_numbers(spark):
    df = spark.createDataFrame([(i * 37 % 1000,) for i in range(1000)], "k bigint").repartition(7)
    got = sorted((r["k"], r["n"]) for r in ordering.row_numbers(df, ["k"], "n").collect())
    assert got == [(i, i) for i in range(1000)]


def test_expressions(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),)], "v double")
    assert [r[0] for r in df.select(x.finite(F.col("v"))).collect()] == [True, False, False, False]
    assert spark.range(1).select(x.unit(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] is None
    assert spark.range(1).select(x.unit(F.array(F.lit(3.0), F.lit(4.0)))).first()[0] == pytest.approx([0.6, 0.8])


def test_boosted_trees(spark):
    df = spark.createDataFrame([(float(i % 10), float(i % 10 > 4)) for i in range(100)], "f double, y double")
    got = models.boosted_trees(df, ["f"], "y", maxIter=3).transform(df)
    assert got.agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.2


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE songs (id TEXT, year INTEGER, loud REAL)")
        con.executemany("INSERT INTO songs VALUES (?, ?, ?)", [(f"s{i}", i, i / 2) for i in range(25)])
        con.execute("CREATE TABLE none (id TEXT)")
    got = sorted(tuple(r) for r in readers.sqlite(spark, path, "songs", 3).collect())
    assert got == sorted((f"s{i}", i, i / 2) for i in range(25))
    assert readers.sqlite(spark, path, "none").count() == 0


def test_separated(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a<SEP>1<SEP>x<SEP>y\nb<SEP>bad\n")
    got = sorted(tuple(r) for r in readers.separated(spark, str(tmp_path), ["k", "n", "rest"], casts={"n": "int"}).collect())
    assert got == [("a", 1, "x<SEP>y"), ("b", None, None)]


def test_sinks(spark, tmp_path):
    df = spark.range(10)
    sinks.parquet_strict(df, str(tmp_path / "p"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.parquet_strict(df, str(tmp_path / "p"))
    sinks.csv_result(df, str(tmp_path / "r.csv"))
    with pytest.raises(ValueError):
        sinks.csv_result(df, str(tmp_path / "s.csv"), 5)
    sinks.json_atomic({"a": 1}, str(tmp_path / "j.json"))
    (tmp_path / "stage").mkdir()
    sinks.publish(str(tmp_path / "stage"), str(tmp_path / "out"), "me")
    (tmp_path / "stage").mkdir()
    with pytest.raises(FileExistsError):
        sinks.publish(str(tmp_path / "stage"), str(tmp_path / "out"), "you")


def test_bootstrap(spark):
    df = spark.createDataFrame([(i % 20, 1.0 + (i % 7) / 10) for i in range(400)], "c int, v double")
    row = ranking.bootstrap(df, "v", "c", 400).first()
    assert row["low"] < row["mean"] < row["high"] and row["high"] - row["low"] < 0.2


def test_moe_gradient():
    from tessera.operators import moe

    rng = np.random.default_rng(4)
    shape = moe.Shape(3, 1980, 1999)
    p, m, year = shape.start(1) + rng.normal(0, 0.05, shape.size), rng.normal(size=(6, 3)), rng.integers(1980, 2000, 6).astype(float)
    _, gradient = moe.loss_and_gradient(shape, p, m, year)
    for i in range(shape.size):
        step = np.zeros(shape.size)
        step[i] = 1e-6
        slope = (moe.loss_and_gradient(shape, p + step, m, year)[0] - moe.loss_and_gradient(shape, p - step, m, year)[0]) / 2e-6
        assert slope == pytest.approx(gradient[i], abs=1e-4)


def test_moe_learns(spark):
    from tessera.operators import moe

    rng = np.random.default_rng(5)
    rows = [(i, [float(e) for e in f], float(round(np.clip(1990 + 6 * f[0], 1980, 1999)))) for i, f in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "id bigint, x array<double>, year double")
    shape = moe.Shape(2, 1980, 1999)
    p, history = moe.train(df.where("id < 200"), shape, "id", "x", "year", held=df.where("id >= 200"), epochs=15, rate=0.2, fraction=0.7)
    assert [h["epoch"] for h in history] == list(range(1, len(history) + 1)) and history[0]["rate"] == pytest.approx(0.2)
    assert min(h["mae_blend"] for h in history) < 0.9 * history[0]["mae_blend"]
    held = moe.errors(df.where("id >= 200"), shape, p, "x", "year")
    assert held["blend"] == pytest.approx(min(h["mae_blend"] for h in history))
    heads = moe.forward(shape, p, np.array([r[1] for r in rows]))
    assert np.isfinite(heads["blend"]).all() and (np.diff(heads["above"], axis=1) <= 1e-12).all()
    assert np.allclose(heads["blend"], 0.2 * heads["ordinal"] + 0.8 * heads["mixture"])


def test_moments_are_all_steps(spark):
    """Descent on sums of products is the descent on rows, in full and on batches."""
    rng = np.random.default_rng(3)
    m, y = rng.normal(size=(200, 3)), rng.normal(size=200) + 1990
    df = spark.createDataFrame([(i, *map(float, f), float(t)) for i, (f, t) in enumerate(zip(m, y, strict=True))], "id long, a double, b double, c double, y double").repartition(3)
    weights, intercept, losses = models.ridge_descent(df, ["a", "b", "c"], "y", l2=0.1, steps=30)
    w, b = np.zeros(3), y.mean()
    for loss in losses:
        e = m @ w + b - y
        assert loss == pytest.approx((e * e).mean() + 0.1 * w @ w, rel=1e-9)
        w, b = w - 0.08 * (2 * m.T @ e / len(y) + 0.2 * w), b - 0.08 * 2 * e.mean()
    assert weights == pytest.approx(w) and intercept == pytest.approx(b)
    batches = models.moments(df, F.array("a", "b", "c"), "y", 0.0, 40, 0.25, 7, "id")
    sizes = [batches[k][3, 3] for k in range(40)]
    assert len(set(sizes)) > 5 and np.mean(sizes) == pytest.approx(50, rel=0.1)
    again = models.moments(df.repartition(5), F.array("a", "b", "c"), "y", 0.0, 40, 0.25, 7, "id")
    assert all(np.allclose(batches[k], again[k]) for k in range(40))
    assert models.ridge_descent(df.limit(0), ["a", "b", "c"], "y", steps=2)[2] == [0.0, 0.0]


def test_kernel_descent_stops(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(e) for e in f], float(f[0] + 0.1 * rng.normal())) for i, f in enumerate(rng.normal(size=(120, 4)))]
    df = spark.createDataFrame(rows, "id long, m array<double>, y double")
    for huber in (None, 0.5):
        weights, bias, history = models.kernel_descent(df.where("id < 80"), "m", "y", held=df.where("id >= 80"), huber=huber, steps=40 if huber else 300, rate=0.3, least=1e-4)
        assert len(history) < (41 if huber else 300) and history[-1][0] < history[0][0] and weights[0] > 0.7


def test_logistic_grid(spark):
    rng = np.random.default_rng(9)
    rows = [(float(a), float(b), 1.0, float(a + 0.5 * rng.normal() > 0), 1.0) for a, b in rng.normal(size=(300, 2))]
    df = spark.createDataFrame(rows, "a double, b double, one double, y double, w double")
    found = models.logistic(df, ["a", "b", "one"], "y", "w")
    assert list(found) == [0.1, 0.01, 0.001] and all(w[2] == 0 for _, w in found.values())
    assert found[0.1][1][0] < found[0.01][1][0] < found[0.001][1][0]
    with pytest.raises(ValueError, match="convergence"):
        models.logistic(df, ["a", "b"], "y", steps=2)


def test_quota_redistribution():
    from tessera.operators.ordering import shares

    assert shares({"a": 1, "b": 9, "c": 9}, 10) == {"a": 1, "b": 5, "c": 4}
    assert shares({"a": 2, "b": 0, "c": 3}, 50) == {"a": 2, "b": 0, "c": 3}
    assert shares({"a": 10, "b": 10, "c": 10}, 10) == {"a": 4, "b": 3, "c": 3}


@pytest.mark.parametrize("block", [3, 7, 100])
def test_searches_by_blocks(spark, block):
    """However many blocks the two sides have, results are those of one matrix."""
    rng = np.random.default_rng(11)
    m = rng.normal(size=(23, 4))
    m[5] = m[9]  # a tie
    df = spark.createDataFrame([(i, [float(e) for e in row], i % 3) for i, row in enumerate(m)], "id long, vector array<double>, g int")
    queries = df.where("id % 2 = 0")
    scores = m @ m.T

    def best(i, k, own):
        ok = [j for j in range(23) if j != i and not (own and j % 3 == i % 3)]
        return sorted(ok, key=lambda j: (-round(scores[i, j], 9), j))[:k]

    for group in (None, "g"):
        got = {}
        for r in vectors.knn(df, queries, 4, group_col=group, block=block).collect():
            got.setdefault(r["query"], {})[r["rank"]] = r["candidate"]
        assert {q: [c for _, c in sorted(x.items())] for q, x in got.items()} == {i: best(i, 4, group) for i in range(0, 23, 2)}
    pairs = {(r["query"], r["candidate"]) for r in vectors.above(df, 1.0, block=block).collect()}
    assert pairs == {(i, j) for i in range(23) for j in range(23) if i != j and scores[i, j] >= 1.0}
    assert vectors.knn(df.limit(0), queries, 3, block=block).count() == 0 and vectors.knn(df, queries.limit(0), 3, block=block).count() == 0

    owned = [(a, t) for a in range(14) for t in range(9) if (a * t + a) % 4 == 1]
    weights = vectors.tag_weights(spark.createDataFrame(owned, "artist_id long, tag int"))
    idf = {r["tag"]: r["idf"] for r in weights.collect()}
    length = lambda a: sum(idf[t] ** 2 for b, t in owned if b == a) ** 0.5
    expected = {}
    for a in {x for x, _ in owned}:
        for b in {x for x, _ in owned} - {a}:
            common = sum(idf[t] ** 2 for x, t in owned if x == a and (b, t) in owned)
            if common:
                expected[a, b] = common / length(a) / length(b)
    found = {(r["query"], r["candidate"]): r["score"] for r in vectors.tag_cosine(weights, weights.select("artist_id"), block=block).collect()}
    assert found == pytest.approx(expected)
    asked = spark.createDataFrame([(1, 3), (1, 1), (1, 0), (99, 1)], "x long, y long")
    by_pair = {(r["x"], r["y"]): r["score"] for r in vectors.tag_pair_cosine(weights, asked).collect()}
    known = {a for a, _ in owned}
    for (a, b), score in by_pair.items():
        assert score == (None if not {a, b} <= known else pytest.approx(1.0 if a == b else expected.get((a, b), 0.0)))


def test_numbers_in_order(spark):
    """Global numbers and numbers in groups, whatever the keys' types; exact quantiles between them."""
    from tessera.operators.ordering import group_numbers, quantiles, row_numbers

    rows = [(f"g{i * 7 % 4}", f"k{i * 13 % 50}", i) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, k string, i int").repartition(5)
    ordered = sorted(rows)
    assert {r["i"]: r["n"] for r in row_numbers(df, ["g", "k", "i"], "n").collect()} == {i: n for n, (_, _, i) in enumerate(ordered)}
    expected = {}
    for g in {r[0] for r in rows}:
        expected |= {i: n for n, (_, _, i) in enumerate(sorted(r for r in rows if r[0] == g))}
    assert {r["i"]: r["n"] for r in group_numbers(df, ["g"], ["k", "i"], "n").collect()} == expected
    values = [float(v) for v in np.random.default_rng(2).integers(0, 30, 77)]
    table = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    got = quantiles(table, "v", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}).first()
    assert list(got) == pytest.approx(list(np.quantile(values, [0, 0.37, 0.5, 1])))
    nearest = quantiles(table, "v", {"a": 0.0, "b": 0.37, "d": 1.0}, linear=False).first()
    assert list(nearest) == [sorted(values)[max(1, int(np.ceil(q * 77))) - 1] for q in (0.0, 0.37, 1.0)]
    assert quantiles(table.limit(0), "v", {"a": 0.5}).first()["a"] is None


def test_hubs_are_salted(spark):
    """Paths over a vertex of many edges, dealt over salts or not."""
    from tessera.operators import graph

    edges = [(i, 100) for i in range(30)] + [(100, 200 + i) for i in range(5)] + [(1, 2), (2, 3), (200, 1)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    expected = sorted((a, b, d) for a, b in edges for c, d in edges if b == c)
    for most in (2, 7, 1000):
        assert sorted(tuple(r) for r in graph.two_steps(df, most).collect()) == expected


def test_local_bfs(spark):
    from tessera.operators import graph

    edges = [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "a"), ("e", "a"), ("b", "z")]
    df = spark.createDataFrame(edges, "src string, dst string")
    ids = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    found = {r["id"]: (r["distance"], r["parent"]) for r in graph.bfs_local(ids, df, "a").collect()}
    assert found == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "b"), "z": (2, "b"), "e": (None, None)}
    assert found == {r["id"]: (r["distance"], r["parent"]) for r in graph.bfs(ids, df, "a").collect()}
    with pytest.raises(ValueError, match="more than"):
        graph.bfs_local(ids, df, "a", most=3)


def test_era(spark):
    from tessera.functions import exprs

    cases = {"the 1980s": 1980, "1980": 1980, "80s hits": 1980, "00s": 2000, "in 1985 and 90s": 1990, "20s": 1920, "10s": None, "80": None, "12345": None, "1910s": None, "2010s": 2010, "": None, "x90s 1970": 1970}
    df = spark.createDataFrame(list(cases.items()), "t string, e int")
    assert {r["t"]: r["got"] for r in df.select("t", exprs.era(F.col("t")).alias("got")).collect()} == cases


def test_policy_guards(spark):
    """A policy that breaks a guard never wins; without any that passes, all audio with the largest settings does."""
    from tessera.operators import recommend

    cells = [(f, g) for f in ("tune", "confirm") for g in ("audio", "relation", "mixed")]
    baseline = spark.createDataFrame([(f, g, 0.5) for f, g in cells], "fold string, grp string, score double")

    def table(policies):
        return spark.createDataFrame([(*p, f, g, s) for p, scores in policies.items() for (f, g), s in zip(cells, scores, strict=True)], "reg double, middle long, high long, low_t double, high_t double, fold string, grp string, score double")

    good, better, lossy, timid = (0.01, 18, 16, 0.2, 0.4), (0.001, 17, 16, 0.2, 0.4), (0.1, 16, 16, 0.2, 0.4), (0.1, 19, 19, 0.2, 0.4)
    all_audio, also = (0.1, 20, 20, 0.2, 0.4), (0.001, 20, 20, 0.2, 0.4)
    policies = {good: [0.46, 0.6, 0.5] * 2, better: [0.46, 0.65, 0.52] * 2, lossy: [0.44, 0.9, 0.9] * 2, timid: [0.5, 0.501, 0.5] * 2, all_audio: [0.5] * 6, also: [0.5] * 6}
    best = recommend.select_policy(table(policies), baseline).first()
    assert tuple(best)[1:6] == better and best["publishable"] and best["feasible"] == 2
    none = recommend.select_policy(table({k: policies[k] for k in (lossy, timid, all_audio, also)}), baseline).first()
    assert tuple(none)[1:6] == all_audio and not none["publishable"] and none["feasible"] == 0


def test_taken_in_turn(spark):
    """One of each source in turn, none twice, up to the limit."""
    import itertools

    from tessera.operators import recommend

    lists = {"a": [1, 2, 3], "b": [2, 1, 4, 5], "c": []}
    rows = [(7, c, s, k) for s, items in lists.items() for k, c in enumerate(items, 1)]
    got = recommend.taken_in_turn(spark.createDataFrame(rows, "query long, candidate long, source string, rank int"), ("a", "b", "c"), 4).orderBy("place").collect()
    assert [r["candidate"] for r in got] == [1, 2, 3, 4]
    drawn = spark.range(1).select(*(recommend.splitmix(F.lit(s), F.lit(a), F.lit(97)).alias(f"p{i}") for i, (s, a) in enumerate(itertools.product((0, -1, 2**62), (0, 5))))).first()
    for (s, a), found in zip(itertools.product((0, -1, 2**62), (0, 5)), drawn, strict=True):
        z = (s + a + 0x9E3779B97F4A7C15) % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        assert found == (z ^ z >> 31) % 97


def test_bfs_relaxed(small, spark, monkeypatch):
    """The oracle of g_bfs_verify takes nothing to the driver, so it has no largest graph."""
    from tessera.queries import QUERIES

    got = {r["id"]: (r["distance"], r["parent"]) for r in graph.bfs_relaxed(*small, "a").collect()}
    assert got == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "b"), "z": (2, "b"), "e": (None, None)}
    with pytest.raises(ValueError):
        graph.bfs_relaxed(*small, "q")
    with pytest.raises(ValueError):
        graph.bfs_relaxed(*small, "a", max_iter=1)
    monkeypatch.setattr(graph, "bfs_local", None)
    row = QUERIES["g_bfs_verify"](spark, "/root/testdata/sf0.001").first()
    assert row["reachable"] > 1 and row["mismatches"] == row["missing"] == row["extra"] == 0


def test_bfs_reference_keeps_off_the_driver(spark, monkeypatch):
    from tessera.queries import QUERIES

    monkeypatch.setattr(graph, "bfs_local", None)
    assert QUERIES["g_bfs_reference"](spark, "/root/testdata/sf0.001").where("distance is not null").count() > 1


def test_catalog_keeps_what_queries_ask_for(spark):
    """Edges and tags of the artists that can be asked for, the same as in the whole views; not those of all artists."""
    from tessera.plans import views
    from tessera.queries.recommend import Catalog

    small = "/root/testdata/sf0.01"
    c = Catalog(spark, small)
    own = {r["artist_id"] for r in c.cat.collect()}
    asked = {r["artist_id"] for r in c.asked.collect()}
    whole = {(r["artist_id"], r["similar_artist_id"]) for r in views.similar(spark, small).select("artist_id", "similar_artist_id").collect()}
    near = own | {dst for src, dst in whole if src in asked}
    assert sorted(tuple(r) for r in c.edges.select("src", "dst").collect()) == sorted(e for e in whole if e[0] in near)
    tags = {(r["artist_id"], r["tag"]) for r in views.tags(spark, small).where("source = 'mbtag'").collect()}
    kept = c.tags.select("artist_id", "tag").collect()
    assert sorted(tuple(r) for r in kept) == sorted(t for t in tags if t[0] in own) and len(kept) < len(tags)


def test_checkpoint_drops_its_shuffle_files(spark):
    import gc
    import time

    from tessera.plans.materialize import checkpointed

    held = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before = held()
    kept = [checkpointed(df.withColumn("i", F.lit(i))) for i in range(5)]
    until = time.time() + 10
    while held() > before + 2 and time.time() < until:
        time.sleep(0.2)
    assert held() <= before + 2 and all(k.count() == 7 for k in kept)


def test_checkpoint_drops_its_files_each_time(spark):
    """Each checkpoint by itself, without a later collection of garbage."""
    import time

    from tessera.plans.materialize import checkpointed

    held = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    checkpointed(spark.range(10))
    for k in range(3):
        before, df = held(), spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7 + k).alias("k")).count()
        kept = checkpointed(df)
        time.sleep(0.6)
        assert held() <= before
        assert kept.count() == 7


@pytest.mark.parametrize(("block", "k"), [(2, 3), (100, 3), (3, 50)])
def test_tag_neighbors_keep_the_best(spark, block, k):
    """The best of all cosines by score and id, with ties, and without a row a pair."""
    owned = [(a, f"t{t}") for a in range(40) for t in range(9) if ((a % 13) * t + a % 13) % 4 == 1]
    df = spark.createDataFrame(owned, "artist_id long, tag string").repartition(3)
    asked = df.select("artist_id").where("artist_id % 3 = 0")
    scored = vectors.tag_cosine(vectors.tag_weights(df), asked).collect()
    expected = {}
    for q in {r["query"] for r in scored}:
        mine = sorted((r for r in scored if r["query"] == q), key=lambda r: (-round(r["score"], 9), r["candidate"]))[:k]
        expected |= {(q, i): (r["candidate"], pytest.approx(r["score"])) for i, r in enumerate(mine, 1)}
    found = vectors.tag_neighbors(df, asked, k, block=block)
    assert {(r["query"], r["rank"]): (r["candidate"], r["score"]) for r in found.collect()} == expected
    assert vectors.tag_neighbors(df, asked.limit(0), k).count() == 0


def test_nearest_settles_often():
    """However often the kept rows are cut down, the best stay."""
    import pyarrow as pa

    from tessera.operators.nearest import Nearest

    rng = np.random.default_rng(5)
    lists = [sorted(rng.choice(12, 4, replace=False).tolist()) for _ in range(300)]
    norms = np.full(300, 2.0)
    as_lists = lambda x: pa.array(x, pa.list_(pa.int32()))
    q = list(range(0, 300, 30))
    n = Nearest(np.array(q), norms[q], as_lists([lists[i] for i in q]), pa.array([[1.0] * 4] * len(q)), 5, 9, tile=7, columns=5, most=60)
    for low in range(0, 300, 50):
        n.see(np.arange(low, low + 50), norms[low : low + 50], as_lists(lists[low : low + 50]))
    got = {}
    for a, b, _, r in zip(*n.best(), strict=True):
        got.setdefault(int(a), []).append((int(r), int(b)))
    for i in q:
        want = sorted(range(300), key=lambda j: (-len({*lists[i]} & {*lists[j]}), j))[:5]
        assert [b for _, b in sorted(got[i])] == want


def test_idf_counts_owners_in_bits(spark):
    """Over 64 tags, none at all, repeated orders, lines and parts, strangers; looked up or joined."""
    from tessera.operators import tagbits

    parts = [(p, f"t{p % 70}") for p in range(100)] + [(100, None), (None, "t0")]
    orders = [(o, o * 7 % 11) for o in range(40)] + [(40, None), (5, 2), (None, 1)]
    lines = [(i * 13 % 45, i * 29 % 103) for i in range(300)] + [(None, 1), (1, None)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    for more, most in (([], 4_000_000), ([], 10), ([(3, "t69")], 4_000_000)):
        named = parts + more
        owned = {(a, t) for o, p in lines for q, a in orders for r, t in named if o == q and p == r and o is not None and p is not None}
        frames = df(lines, "order long, part long"), df(orders, "order long, artist_id long"), df(named, "part long, tag string")
        got = {r["tag"]: (r["idf"], r["df"]) for r in tagbits.idf(*frames, most=most).collect()}
        expected = {r["tag"]: (r["idf"], r["df"]) for r in vectors.tag_idf(df(sorted(owned, key=repr), "artist_id long, tag string")).collect()}
        assert len(expected) > 64
        assert got.keys() == expected.keys()
        assert all(got[t][1] == expected[t][1] and got[t][0] == pytest.approx(expected[t][0]) for t in got)


@pytest.mark.parametrize("odd", [False, True])
def test_follows_of_some_look_at_the_next_orders_only(spark, tmp_path, odd):
    """Edges of some artists are those of all, with repeated orders and lines without one too; of a part only lines beside theirs are taken."""
    from tessera.plans import views

    orders = [(i, i * 7 % 12) for i in range(60)]
    lines = [(i * 31 % 60, i % 3, i * 17 % 4) for i in range(200)]
    if odd:
        orders = [o for o in orders if o[0] % 4 != 1] + [(7, 3), (8, 2), (10, None)]
        lines += [(None, 1, 2), (6, None, 3), (9, 1, None), (11, 2, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    for some in ([0, 3], [11], [99]):
        artists = ordering.checkpointed(spark.createDataFrame([(a,) for a in some], "artist_id long"))
        found = {tuple(r) for r in views.follows(spark, str(tmp_path), artists).collect()}
        assert found == {tuple(r) for r in views.follows(spark, str(tmp_path)).collect() if r["artist_id"] in some}
    if not odd:
        whole, all_orders = views.table(spark, str(tmp_path), "lineitem"), views.table(spark, str(tmp_path), "orders")
        taken, _ = views._beside(whole, all_orders, all_orders.where("o_custkey = 11"))
        assert 0 < taken.count() < len(lines) / 2


def test_round_robin_by_hops_compares_reached_artists_only(spark, monkeypatch):
    """Likeness is asked of the pairs that were reached, not of all that share a tag."""
    from tessera.queries import recommend

    def refuse(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(vectors, "tag_cosine", refuse)
    assert recommend.r_round_robin_bfs(spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("sizes", [(4_000_000, 1_000_000), (40, 30), (100, 5)])
def test_two_steps_in_blocks(spark, sizes):
    """Paths of two edges and direct edges, by blocks of sources and targets, with a hub; nothing but packed edges is shuffled."""
    from tessera.operators.twosteps import two_step_pairs

    edges = {(i, 100) for i in range(30)} | {(100, 200 + i) for i in range(5)} | {(i * 7 % 40, i * 11 % 37) for i in range(150)} | {(-5, 3)}
    edges = {(a, b) for a, b in edges if a != b}
    paths = Counter((a, d) for a, b in edges for c, d in edges if b == c and a != d)
    expected = {pair: (paths[pair], pair in edges) for pair in {*paths, *edges}}
    df = spark.createDataFrame(sorted(edges), "src long, dst long").repartition(3)
    lists = df.groupBy("src").agg(F.collect_set("dst").alias("to"))
    rows = two_step_pairs(lists, *sizes).collect()
    assert len(rows) == len(expected)
    assert {(r["src"], r["dst"]): (r["paths"], r["direct"]) for r in rows} == expected
    assert two_step_pairs(lists.limit(0)).count() == 0
    text = graph.apart_two(df.select(F.col("src").cast("string"), F.col("dst").cast("string"))).collect()
    assert {(int(r["src"]), int(r["dst"])): (r["paths"], r["direct"]) for r in text} == expected
    plan = graph.within_two(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("block", [2, 5, 100])
def test_pairs_are_scored_in_blocks(spark, block):
    from tessera.operators.pairwise import Dots, TagCosines, scored_pairs

    rng = np.random.default_rng(3)
    own = {i: sorted({int(t) for t in rng.integers(0, 9, 4)}) for i in range(12)}
    weight = {t: 1.0 + t / 7 for t in range(9)}
    norm = {i: math.sqrt(sum(weight[t] ** 2 for t in own[i])) for i in own}
    pairs = [(i, j) for i in range(14) for j in range(0, 14, 3)] + [(None, 1), (2, None)]
    asked = spark.createDataFrame(pairs, "x long, y long")
    rows = spark.createDataFrame([(i, norm[i], [f"t{t}" for t in own[i]], [weight[t] for t in own[i]]) for i in own], "id long, norm double, tags array<string>, idfs array<double>")
    got = {(r["x"], r["y"]): r["score"] for r in scored_pairs(asked, rows, rows, TagCosines, block).collect()}
    known = [(i, j) for i, j in pairs if i in own and j in own]
    assert sorted(got) == sorted(known)
    for i, j in known:
        assert got[i, j] == pytest.approx(sum(weight[t] ** 2 for t in set(own[i]) & set(own[j])) / norm[i] / norm[j])
    m = rng.normal(size=(12, 3))
    sounds = spark.createDataFrame([(i, [float(e) for e in row]) for i, row in enumerate(m)], "id long, vector array<double>")
    got = {(r["x"], r["y"]): r["score"] for r in scored_pairs(asked, sounds, sounds, Dots, block).collect()}
    assert got == {(i, j): pytest.approx(float(m[i] @ m[j])) for i, j in known}


def test_round_robin_joins_the_first_artists_only(spark, monkeypatch):
    """Of each level one artist more than the places is joined to tracks; places are those of all artists."""
    from tessera.operators import recommend

    joined = []
    monkeypatch.setattr(recommend, "sized", lambda df: joined.append(df.count()) or df)
    tracks = spark.createDataFrame([(100 + 2 * a + t, a) for a in range(30) for t in range(2)], "track_id long, artist_id long")
    reached = spark.createDataFrame([(100, a, 1 + a % 2, 0.5 if a < 20 else 0.9) for a in range(30)], "query long, artist_id long, level int, likeness double")
    found = [(r["candidate"], r["rank"]) for r in recommend.round_robin(reached, tracks, 8).orderBy("rank").collect()]
    assert joined == [30]
    order = sorted(((1 + a % 2, t, -(0.5 if a < 20 else 0.9), 100 + 2 * a, 100 + 2 * a + t) for a in range(30) for t in range(2) if 100 + 2 * a + t != 100))
    assert found == [(o[-1], k) for k, o in enumerate(order[:8], 1)]


def test_pool_compares_no_artists_by_all_their_tags(spark, monkeypatch):
    """The one search by all pairs that is left is of those that share a follower."""
    from tessera.queries import recommend

    searched, whole = [], vectors.tag_cosine
    monkeypatch.setattr(vectors, "tag_cosine", lambda weights, asked: searched.append(dict(weights.dtypes)["tag"]) or whole(weights, asked))
    assert recommend.r_quota(spark, "/root/testdata/sf0.001").count() > 0
    assert searched == ["bigint"]


def test_evaluation_ranks_pairs_once_for_all_scorers(spark, monkeypatch):
    """Every window of ranks is over a query's pairs, so that a pair is no row for each scorer before the groups are known."""
    from pyspark.sql import Window

    from tessera.queries import recommend

    names = ["query", "candidate", "query_artist", "candidate_artist", "cos_audio", "cos_graph", "bfs_score", "tag_tfidf_cosine", "year_gap", "same_release", "has_release", "has_graph", "has_bfs", "has_tags", "has_year"]
    rows = [(q, c, q, c % 3, c / 40, None, 0.5, (c % 7) / 7, float(c % 4), float(c % 2), 1.0, 0.0, 1.0, 1.0, 1.0) for q in (0, 20) for c in range(1, 31)]
    signals = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if i < 4 else 'double'}" for i, n in enumerate(names)))

    class Few:
        edges = spark.createDataFrame([(0, 1)], "src long, dst long")

    Few.signals = signals
    limits = spark.createDataFrame([(0.6, 0.7, 0.4)], "audio_p90 double, tag_p90 double, audio_p50 double")
    monkeypatch.setattr(recommend, "thresholds", lambda c: limits)
    asked = []
    whole = Window.partitionBy
    monkeypatch.setattr(recommend.Window, "partitionBy", staticmethod(lambda *c: asked.append(c) or whole(*c)))
    found = recommend.evaluated(Few())
    assert ("scorer", "query") not in asked
    got = {(r["scorer"], r["grp"], r["query"]): r["ndcg"] for r in found.collect()}
    groups = {}
    for r in recommend.validation_groups(Few(), signals, limits).collect():
        groups.setdefault((r["grp"], r["query"]), set()).add(r["candidate"])
    assert groups and {k[1:] for k in got} == set(groups)
    for (grp, q), members in groups.items():
        order = sorted(range(1, 31), key=lambda c: (-round(c / 40, 9), c))
        dcg = sum(1 / math.log2(k + 1) for k, c in enumerate(order, 1) if c in members and k <= 20)
        ideal = sum(1 / math.log2(k + 1) for k in range(1, min(len(members), 20) + 1))
        assert got["c1", grp, q] == pytest.approx(dcg / ideal)


def test_skipgram_tree():
    """The tree in runs of equal counts is as good as one built node by node, and no word is on another's path."""
    import heapq

    import numpy as np

    from tessera.operators import skipgram

    random = np.random.default_rng(1)
    for _ in range(50):
        counts = sorted(random.integers(1, int(random.integers(2, 30)), int(random.integers(1, 60))).tolist(), reverse=True)
        n = len(counts)
        nodes, codes = skipgram.paths(np.arange(n), skipgram.tree([(c, counts.count(c)) for c in set(counts)]), n)
        heap, best = list(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            best += both
            heapq.heappush(heap, both)
        assert sum(c * int((p >= 0).sum()) for c, p in zip(counts, nodes, strict=True)) == best
        assert len({tuple(zip(p[p >= 0], c[p >= 0], strict=True)) for p, c in zip(nodes, codes, strict=True)}) == n
        assert n == 1 or set(nodes[nodes >= 0]) == set(range(n, 2 * n - 1))


def test_skipgram_vectors(spark):
    """Words that meet come near each other, whether a task holds all of the model or some; a word that meets none keeps a vector; the result is repeatable."""
    import numpy as np

    from tessera.operators import skipgram

    random = np.random.default_rng(2)
    rows = [(t * 10 + w, [int(t // 20 * 20 + k) for k in random.integers(0, 20, 12)]) for t in range(40) for w in range(10)] + [(999, [77]), (1000, [])]
    tokens = spark.createDataFrame(rows, "key long, words array<long>")
    for most in (1000, 80):  # one round an iteration, and several
        got = skipgram.vectors(tokens, 16, 5, 3, 0.025, 4, 40, 42, most).collect()
        again = skipgram.vectors(tokens, 16, 5, 3, 0.025, 4, 40, 42, most).collect() if most == 1000 else got
        assert {r["word"]: r["vector"] for r in got} == {r["word"]: r["vector"] for r in again}
        assert sorted(r["word"] for r in got) == [*range(40), 77] and all(len(r["vector"]) == 16 for r in got)
        v = np.array([np.array(r["vector"]) / np.linalg.norm(r["vector"]) for r in sorted(got, key=lambda r: r["word"]) if r["word"] < 40])
        near, side = v @ v.T, np.arange(40) // 20
        alike = side[:, None] == side
        assert near[alike].mean() > 0.5 > near[~alike].mean() + 0.4


def test_word2vec_is_whole(spark, monkeypatch):
    """The query walks 10 times 40 tracks and trains 128 numbers in 5 iterations, a window of 5 and 20 partitions."""
    from tessera.operators import skipgram
    from tessera.queries import graph as queries

    seen = {}
    train = skipgram.vectors

    def walks(tracks, edges, owners, **shape):
        seen.update(shape)
        return spark.createDataFrame([(1, 0, [1, 2, 1]), (2, 0, [2, 1]), (3, 0, [3])], "track_id long, walk_id int, walk_seq array<long>")

    def vectors(tokens, size, window, iterations, step, partitions, longest, seed):
        seen.update(size=size, window=window, iterations=iterations, step=step, partitions=partitions, longest=longest)
        return train(tokens, size, window, 1, step, 2, longest, seed)

    monkeypatch.setattr(queries.graph, "walks", walks)
    monkeypatch.setattr(skipgram, "vectors", vectors)
    got = queries.g_word2vec(spark, "/root/testdata/sf0.001").collect()
    assert seen == {"per_track": 10, "steps": 40, "size": 128, "window": 5, "iterations": 5, "step": 0.025, "partitions": 20, "longest": 40}
    assert sorted(map(tuple, got)) == [(1, 128, True), (2, 128, True), (3, 128, True)]


def test_report_metrics(spark):
    """Chance's reciprocal rank against all orders, metrics by the positives there are, and draws with replacement of as many rows as there are."""
    from itertools import combinations

    for n, p in ((5, 1), (6, 3), (4, 4)):
        firsts = [min(places) + 1 for places in combinations(range(n), p)]
        assert spark.range(1).select(ranking.expected_mrr(F.lit(n), F.lit(p))).first()[0] == pytest.approx(sum(1 / f for f in firsts) / len(firsts))
    hits = spark.createDataFrame([(1, "a", 2, None), (1, "a", 15, 3)], "query int, grp string, s int, t int")
    got = {(r["scorer"], r["metric"]): r["value"] for r in ranking.ranked_metrics(hits, ["s", "t"], (10, 20)).collect()}
    best = 1 + 1 / np.log2(3)
    assert got["s", "mrr"] == 0.5 and got["t", "mrr"] == pytest.approx(1 / 3) and got["s", "recall@10"] == got["t", "recall@20"] == 0.5 and got["s", "recall@20"] == 1
    assert got["s", "ndcg@10"] == pytest.approx(1 / np.log2(3) / best) and got["t", "ndcg@20"] == pytest.approx(0.5 / best)
    rows = spark.createDataFrame([(i, "ab"[i % 3 == 0], float(i), 1.0) for i in range(90)], "query int, grp string, v double, one double")
    drawn = ranking.resampled(rows, "query", ["v", "one"], 300, stratum="grp", block=16).collect()
    assert {(r["stratum"], r["one"]) for r in drawn} == {("a", 60.0), ("b", 30.0)} and len(drawn) == 600
    assert np.std([r["v"] / 60 for r in drawn if r["stratum"] == "a"]) == pytest.approx(26 / 60**0.5, rel=0.25)
    for cluster in (None, "artist"):
        r = ranking.paired_intervals(rows.withColumn("artist", F.col("query") % 30), ["v"], 300, cluster=cluster).first()
        assert r["low"] < r["point"] < r["high"] and r["point"] == pytest.approx(44.25) and 0 < r["samples"] <= 300


def test_report_rankings(spark):
    """The learned lists begin with places in turn with audio, unknown scores come last, and the cold list leaves out what audio alone found."""
    from tessera.operators import recommend
    from tessera.queries import recommend as queries

    raw = [f for f in recommend.FEATURES if f not in ("audio_tag_interaction", "graph_bfs_interaction")]
    rows = []
    for i in range(30):
        known = {"cos_audio": i / 30, "cos_graph": 0.5 if i == 3 else 0.0, "has_graph": float(i == 3), "has_bfs": float(i in (4, 5)), "bfs_score": {4: 0.5, 5: 1.0}.get(i, 0.9), "tag_tfidf_cosine": 1 - i / 30}
        rows.append((0, i, ["audio"] if i >= 25 else ["audio", "tag"], *(known.get(f, 0.0) for f in raw)))
    whole = spark.createDataFrame(rows, "query int, candidate int, sources array<string>, " + ", ".join(f"{f} double" for f in raw))
    whole = whole.withColumn("audio_tag_interaction", F.col("cos_audio") * F.col("tag_tfidf_cosine")).withColumn("graph_bfs_interaction", F.col("cos_graph") * F.col("bfs_score"))
    got = {r["candidate"]: r for r in queries.rankings(whole, spark.createDataFrame([(0.5,)], "_cos_audio double")).collect()}
    order = lambda n: sorted((c for c in got if got[c][n] is not None), key=lambda c: got[c][n])
    assert order("c1_only") == list(range(29, -1, -1)) and order("c2_only")[0] == 3 and order("bfs")[:2] == [5, 4] and order("bfs")[2] == 0
    assert order("precomputed_acoustic_cold") and not set(order("precomputed_acoustic_cold")) & set(range(25, 30))
    assert sorted(order("full")) == list(range(30)) and sorted(got[c]["full"] for c in got) == list(range(1, 31))


def test_report_is_whole(spark):
    """All parts are there, each with every scorer, group, cutoff and baseline; and digests follow contents."""
    from tessera.queries import recommend as queries

    rows = queries.e_dev_report(spark, "/root/testdata/sf0.001").collect()
    got = {(r["part"], r["measure"]): r for r in rows}
    assert len(got) == len(rows)
    parts = {"queries", "group_eligibility", "candidate_counts", "candidates", "candidate_layer", "ranking", "query_bootstrap", "artist_cluster_bootstrap", "catalog", "coverage", "decade", "made_from"}
    assert {p for p, _ in got} == parts
    for scorer in (*queries.REPORTED, "random_expectation"):
        for group in ("audio", "relation", "mixed", "three_strata_macro"):
            for metric in ("mrr", *(f"{m}@{k}" for k in (10, 20, 50) for m in ("recall", "hit", "ndcg"))):
                assert 0 <= got["ranking", f"{scorer}/{group}/{metric}"]["value"] <= 1 + 1e-9
    for baseline in ("random", "c1_only", "c2_only", "handcrafted", "bfs", "no_hard_neg"):
        for part, draws in (("query_bootstrap", 2000), ("artist_cluster_bootstrap", 1000)):
            low, point, high = (got[part, f"{baseline}/{m}"]["value"] for m in ("ci95_low", "point_difference", "ci95_high"))
            assert low <= point <= high and 0 < got[part, f"{baseline}/samples"]["value"] <= draws
    a, b, c = (spark.createDataFrame(r, "x int, y string") for r in ([(1, None), (2, "b")], [(2, "b"), (1, None)], [(1, "b"), (2, None)]))
    digest = lambda df: queries.content_digest(df).first()["digest"]
    assert digest(a) == digest(b) != digest(c)
