"""Distributed regression: constants, ridge, kernels, trees, stacks and ensembles.

Gradients and normal equations are sums of fixed width: partials in the
executors, a few numbers on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs as x
from tessera.plans import shipping

shipping.by_value(__name__)


def ridge_gradient(df: DataFrame, columns: list[str], label: str, weights: np.ndarray, intercept: float, l2: float) -> tuple[float, np.ndarray, float]:
    """Loss, gradient and intercept gradient of mean squared error plus l2 times the squared weights."""
    guess = reduce(lambda a, b: a + b, (F.col(c) * float(w) for c, w in zip(columns, weights, strict=True)), F.lit(float(intercept)))
    e = guess - F.col(label)
    row = df.agg(F.count("*").alias("n"), F.sum(e * e).alias("ss"), F.sum(e).alias("s"), *(F.sum(e * F.col(c)).alias(f"g{i}") for i, c in enumerate(columns))).first()
    n = max(row["n"], 1)
    gradient = np.array([2 * (row[f"g{i}"] or 0.0) / n for i in range(len(columns))]) + 2 * l2 * weights
    return (row["ss"] or 0.0) / n + l2 * float(weights @ weights), gradient, 2 * (row["s"] or 0.0) / n


def _mixed(h: np.ndarray) -> np.ndarray:
    """A finisher of 64-bit counters."""
    u = np.uint64
    h = (h ^ (h >> u(31))) * u(0x7FB5D329728EA185)
    h = (h ^ (h >> u(27))) * u(0x81DADEF4BC2DD44D)
    return h ^ (h >> u(33))


def moments(df: DataFrame, matrix: Column, label: str, center: float, batches: int = 1, fraction: float | None = None, seed: int = 42, id_col: str | None = None) -> dict[int, np.ndarray]:
    """By batch, the sums of products of (features, 1, label - center) with each other, in one pass.

    matrix is an array column.  With a fraction, each batch holds the rows that a
    hash of id, seed and batch picks; else there is one batch of all rows.  A
    task sends one matrix for each batch, whose size does not depend on its rows.
    """
    columns = [matrix.alias("m"), (F.col(label).cast("double") - center).alias("y")] + ([F.xxhash64(F.lit(seed), F.col(id_col)).alias("h")] if fraction else [])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            if not len(frame):
                continue
            rows = np.column_stack([np.stack(frame["m"].to_numpy()).astype(np.float64), np.ones(len(frame)), frame["y"].to_numpy(np.float64)])
            for b in range(batches if fraction else 1):
                part = rows
                if fraction:
                    draw = _mixed(frame["h"].to_numpy(np.int64).view(np.uint64) + np.uint64((b + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                    part = rows[draw < np.uint64(int(fraction * float(1 << 64)))]
                total[b] = total.get(b, 0) + part.T @ part
        yield pd.DataFrame({"b": list(total), "sums": [v.tobytes() for v in total.values()]}, columns=["b", "sums"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": [frame["b"].iloc[0]], "sums": [np.sum([np.frombuffer(v) for v in frame["sums"]], axis=0).tobytes()]})

    found = df.select(*columns).mapInPandas(run, "b int, sums binary").groupBy("b").applyInPandas(add, "b int, sums binary").collect()  # one matrix a batch
    square = lambda v: v.reshape(int(round(len(v) ** 0.5)), -1)
    return {r["b"]: square(np.frombuffer(r["sums"])) for r in found}


def quadratic(sums: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean squared error of weights (last the intercept) on moments, and its gradient."""
    k = len(w)
    n = max(sums[k - 1, k - 1], 1.0)
    fit = sums[:k, :k] @ w
    return max(0.0, float(w @ fit - 2 * w @ sums[:k, k] + sums[k, k])) / n, 2 * (fit - sums[:k, k]) / n


def ridge_descent(df: DataFrame, columns: list[str], label: str, l2: float = 0.001, rate: float = 0.08, steps: int = 100, fraction: float | None = None, seed: int = 42, id_col: str | None = None) -> tuple[np.ndarray, float, list[float]]:
    """Weights, intercept and losses of gradient descent from zero weights and the mean label; mini-batches by a hash of the id.

    Loss and gradient are functions of sums of products, which are gathered once,
    for all steps: the table is read twice however many steps there are.
    """
    center = float(df.agg(F.avg(label)).first()[0] or 0.0)
    sums = moments(df, F.array(*(F.col(c).cast("double") for c in columns)), label, center, steps, fraction, seed, id_col)
    none = np.zeros((len(columns) + 2, len(columns) + 2))
    w, losses = np.zeros(len(columns) + 1), []
    decay = np.append(np.ones(len(columns)), 0.0)  # not of the intercept
    for step in range(steps):
        loss, gradient = quadratic(sums.get(step if fraction else 0, none), w)
        losses.append(loss + l2 * float((decay * w) @ w))
        w = w - rate * (gradient + 2 * l2 * decay * w)
    return w[:-1], float(w[-1]) + center, losses


def fourier_features(df: DataFrame, columns: list[str], dimension: int, gamma: float, seed: int, name: str = "rff") -> DataFrame:
    """df with random Fourier features sqrt(2 / D) cos(W x + b) as an array; W and b depend on the seed alone.  Arrow batches, one matrix product each."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (dimension, len(columns))), rng.uniform(0, 2 * np.pi, dimension)
    scale = float(np.sqrt(2 / dimension))

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(scale * np.cos(np.stack(x.to_numpy()).astype(np.float64) @ w.T + b)))

    return df.withColumn(name, project(F.array(*(F.col(c).cast("double") for c in columns))))


def kernel_descent(df: DataFrame, features: str, label: str, l2: float = 0.001, rate: float = 0.1, steps: int = 100, huber: float | None = None, held: DataFrame | None = None, patience: int = 5, least: float = 1e-6) -> tuple[np.ndarray, float, list[tuple[float, float]]]:
    """Best weights and intercept of descent on half squared (or Huber) loss over an array column, and the losses (train, held) by step.

    It stops when the held-out loss, without held the training loss, has not
    fallen by least for so many steps.  The squared loss needs one pass over each
    table, Huber's one a step.
    """
    center = float(df.agg(F.avg(label)).first()[0] or 0.0)
    tables = [df, held] if held is not None else [df]
    if huber is None:
        known = [moments(t, F.col(features), label, center) for t in tables]
        if 0 not in known[0]:
            raise ValueError("no training rows")
        size = len(known[0][0]) - 2

        def measure(k: int, w: np.ndarray) -> tuple[float, np.ndarray]:
            loss, gradient = quadratic(known[k].get(0, np.zeros((size + 2, size + 2))), w)
            return loss / 2, gradient / 2
    else:
        data = [t.select(F.col(features).alias("m"), (F.col(label).cast("double") - center).alias("y")).persist() for t in tables]
        first = data[0].select(F.size("m")).first()
        if first is None:
            raise ValueError("no training rows")
        size = first[0]

        def measure(k: int, w: np.ndarray) -> tuple[float, np.ndarray]:
            def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total = np.zeros(len(w) + 2)
                for frame in frames:
                    if len(frame):
                        m = np.column_stack([np.stack(frame["m"].to_numpy()), np.ones(len(frame))])
                        e = m @ w - frame["y"].to_numpy()
                        near = np.abs(e) <= huber
                        total += np.concatenate([m.T @ np.clip(e, -huber, huber), [np.where(near, 0.5 * e * e, huber * (np.abs(e) - 0.5 * huber)).sum(), len(e)]])
                yield pd.DataFrame({"i": np.arange(len(w) + 2), "v": total})

            total = np.zeros(len(w) + 2)
            for r in data[k].mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
                total[r["i"]] = r["v"]
            n = max(total[-1], 1.0)
            return total[-2] / n, total[:-2] / n

    w, best, history = np.zeros(size + 1), (np.inf, np.zeros(size + 1), 0), []
    decay = np.append(np.ones(size), 0.0)
    for step in range(steps):
        loss, gradient = measure(0, w)
        loss += 0.5 * l2 * float((decay * w) @ w)
        judged = measure(1, w)[0] if held is not None else loss
        history.append((loss, judged))
        if judged < best[0] - least:
            best = (judged, w.copy(), step)
        elif step - best[2] >= patience:
            break
        w = w - rate * (gradient + l2 * decay * w)
    if huber is not None:
        for t in data:
            t.unpersist()
    return best[1][:-1], float(best[1][-1]) + center, history


def stack_weight(df: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """One row: the weight of a against b that fits the label best, within [0, 1]; a half where they never differ."""
    d = F.col(a) - F.col(b)
    sums = df.agg(F.sum(d * (F.col(label) - F.col(b))).alias("n"), F.sum(d * d).alias("m"))
    return sums.select(F.when(F.coalesce("m", F.lit(0.0)) > 0, F.least(F.greatest(x.ratio(F.col("n"), F.col("m")), F.lit(0.0)), F.lit(1.0))).otherwise(0.5).alias("weight"))


def linear_ensemble(df: DataFrame, guesses: list[str], label: str) -> np.ndarray:
    """Ordinary least squares of the label on the guesses, intercept first, from the normal equations."""
    columns = [F.lit(1.0), *(F.col(g) for g in guesses)]
    k = len(columns)
    row = df.agg(*(F.sum(columns[i] * columns[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(columns[i] * F.col(label)).alias(f"b{i}") for i in range(k))).first()
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return np.linalg.lstsq(a, np.array([row[f"b{i}"] for i in range(k)]), rcond=None)[0]


def decade_weights(df: DataFrame, year: str, power: float = 0.5, most: float = 5.0) -> DataFrame:
    """(decade, weight): rarer decades weigh more, capped, with mean 1 over the rows."""
    counts = df.groupBy(x.decade(F.col(year)).alias("decade")).agg(F.count("*").alias("n"))
    largest = counts.agg(F.max("n").alias("top"))
    raw = counts.join(F.broadcast(largest), F.lit(True)).withColumn("w", F.least(F.pow(F.col("top") / F.col("n"), F.lit(power)), F.lit(most)))
    mean = raw.agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("mean"))
    return raw.join(F.broadcast(mean), F.lit(True)).select("decade", "n", (F.col("w") / F.col("mean")).alias("weight"))


def boosted_trees(train: DataFrame, columns: list[str], label: str, weight: str | None = None, validation: str | None = None, slots: int = 0, **options):
    """A fitted gradient-boosted tree model on the columns.

    weight: a column of row weights.  validation: a boolean column; its rows only
    tell when to stop.  slots: columns of at most so many values are categories.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler, VectorIndexer
    from pyspark.ml.regression import GBTRegressor

    raw = VectorAssembler(inputCols=columns, outputCol="assembled" if slots else "features")
    stages = [raw] + ([VectorIndexer(inputCol="assembled", outputCol="features", maxCategories=slots, handleInvalid="keep")] if slots else [])
    more = ({"weightCol": weight} if weight else {}) | ({"validationIndicatorCol": validation, "validationTol": 0.001} if validation else {})
    return Pipeline(stages=[*stages, GBTRegressor(featuresCol="features", labelCol=label, seed=42, **more, **options)]).fit(train)


#: Stages of the search in order, and the settings each tries; what fits best stays for the next.
TUNING = {
    "capacity": ({"maxDepth": 2}, {"maxDepth": 4}),
    "regularisation": ({"minInstancesPerNode": 1, "subsamplingRate": 1.0}, {"minInstancesPerNode": 20, "subsamplingRate": 0.85}),
    "learning_rate": ({"stepSize": 0.1}, {"stepSize": 0.3}),
    "loss": ({"lossType": "squared"}, {"lossType": "absolute"}),
}


def tuned(train: DataFrame, held: DataFrame, columns: list[str], label: str, stages: dict = TUNING, **fixed) -> tuple[dict, list[tuple[str, str, float, bool]]]:
    """The settings chosen stage by stage by the held-out mean absolute error; and rows (stage, settings, error, chosen)."""
    best, rows = dict(fixed), []
    for stage, settings in stages.items():
        tried = []
        for extra in settings:
            found = boosted_trees(train, columns, label, **(best | extra)).transform(held).agg(F.avg(F.abs(F.col("prediction") - F.col(label)))).first()[0]
            tried.append(float("inf") if found is None else float(found))
        k = int(np.argmin(tried))
        rows += [(stage, ", ".join(f"{a}={b}" for a, b in extra.items()), e, i == k) for i, (extra, e) in enumerate(zip(settings, tried, strict=True))]
        best |= settings[k]
    return best, rows


def logistic(train: DataFrame, columns: list[str], label: str, weight: str | None = None, penalties: tuple[float, ...] = (0.1, 0.01, 0.001), steps: int = 100, tol: float = 1e-6) -> dict[float, tuple[float, np.ndarray]]:
    """By penalty, intercept and coefficients of a weighted logistic ranker on standardised columns.

    The largest penalty comes first and each fit starts from the one before; a
    fit that does not converge is an error; constant columns get coefficient 0.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=columns, outputCol="features").transform(train).select("features", F.col(label).cast("double").alias("label"), *([weight] if weight else [])).persist()
    out, before = {}, None
    for penalty in sorted(penalties, reverse=True):
        ranker = LogisticRegression(regParam=penalty, maxIter=steps, tol=tol, **({"weightCol": weight} if weight else {}))
        if before is not None:
            ranker._java_obj.setInitialModel(before._java_obj)
        before = ranker.fit(ready)
        if before.summary.totalIterations >= steps:
            ready.unpersist()
            raise ValueError(f"no convergence within {steps} steps at penalty {penalty}")
        out[penalty] = float(before.intercept), before.coefficients.toArray()
    ready.unpersist()
    return out


def regression_metrics(df: DataFrame, guess: str, label: str, low: float, high: float, by: list[str] | None = None) -> DataFrame:
    """Counts and errors of guesses clipped to [low, high], and of the raw ones."""
    clipped = x.clip(F.col(guess), low, high)
    e, raw = clipped - F.col(label), F.col(guess) - F.col(label)
    within = lambda k: F.avg(F.when(F.abs(e) <= k, 1.0).otherwise(0.0))
    out = F.when((F.col(guess) < low) | (F.col(guess) > high), 1.0).otherwise(0.0)
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.percentile(F.abs(e), 0.5).alias("median_ae"), within(5).alias("within_5"), within(10).alias("within_10"),
        F.avg(e).alias("signed"), F.avg(F.abs(raw)).alias("raw_mae"), F.sqrt(F.avg(raw * raw)).alias("raw_rmse"), F.avg(out).alias("out_of_range"), F.min(guess).alias("least"), F.max(guess).alias("most"),
    )
