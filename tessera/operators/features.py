"""Interval, weighted and target features."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as x
from tessera.operators.ordering import quantiles


def weighted_quantiles(df: DataFrame, key: str, value: str, weight: str, order: str, qs: dict[str, float]) -> DataFrame:
    """By key, quantiles at midpoints of cumulative weight, linear between values and flat beyond the ends."""
    w = Window.partitionBy(key).orderBy(value, order)
    upto = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(weight).over(Window.partitionBy(key))
    placed = df.where(x.finite(F.col(value)) & (F.col(weight) > 0)).withColumn("_p", (upto - F.col(weight) / 2) / total)
    steps = placed.select(key, F.col(value).alias("_v"), "_p", F.lead("_p").over(w).alias("_np"), F.lead(value).over(w).alias("_nv"))
    out = []
    for name, q in qs.items():
        inside = (F.col("_p") <= q) & (F.col("_np") > q)
        between = F.max(F.when(inside, F.col("_v") + (q - F.col("_p")) / (F.col("_np") - F.col("_p")) * (F.col("_nv") - F.col("_v"))))
        out.append(F.coalesce(between, F.when(F.min("_p") > q, F.min("_v")).otherwise(F.max("_v"))).alias(name))
    return steps.groupBy(key).agg(*out)


def segment_lengths(df: DataFrame, key: str, start: str, order: str, last: float) -> DataFrame:
    """df with length to the key's next start (the last one has a given length) and whether the segment is valid."""
    length = F.coalesce(F.lead(start).over(Window.partitionBy(key).orderBy(start, order)) - F.col(start), F.lit(last))
    return df.withColumn("length", length).withColumn("valid", x.finite(F.col(start)) & (F.col(start) >= 0) & (F.col("length") > 0))


def pooled(df: DataFrame, key: str, start: str, length: str, value: str, windows: int) -> DataFrame:
    """By key and equal part of its whole span: the overlap-weighted mean and whether anything overlaps."""
    span = df.groupBy(key).agg(F.min(start).alias("_t0"), F.max(F.col(start) + F.col(length)).alias("_t1"))
    cut = span.select(key, "_t0", ((F.col("_t1") - F.col("_t0")) / windows).alias("_step"), F.explode(F.sequence(F.lit(0), F.lit(windows - 1))).alias("part"))
    low, high = F.col("_t0") + F.col("part") * F.col("_step"), F.col("_t0") + (F.col("part") + 1) * F.col("_step")
    end = F.col(start) + F.col(length)
    # The parts a segment touches are computed, not searched for.
    at = lambda t: F.least(F.greatest(F.floor(x.ratio(t - F.col("_t0"), F.col("_step"))), F.lit(0)), F.lit(windows - 1)).cast("int")
    touched = df.join(span.select(key, "_t0", ((F.col("_t1") - F.col("_t0")) / windows).alias("_step")), key).where("_step > 0").withColumn("part", F.explode(F.sequence(at(F.col(start)), at(end))))
    overlap = F.greatest(F.least(end, high) - F.greatest(F.col(start), low), F.lit(0.0))
    means = touched.withColumn("_o", overlap).groupBy(key, "part").agg(x.ratio(F.sum(F.col("_o") * F.col(value)), F.sum("_o")).alias("mean"))
    return cut.join(means, [key, "part"], "left").select(key, "part", "mean", F.col("mean").isNotNull().alias("available"))


def covariances(df: DataFrame, key: str, columns: list[str], least_rows: int = 3) -> DataFrame:
    """By key: means, then covariances by diagonal offset; null with fewer rows than are needed."""
    enough = F.count("*") >= least_rows
    out = [F.when(enough, F.avg(c)).alias(f"mean_{c}") for c in columns]
    for offset in range(len(columns)):
        for i in range(len(columns) - offset):
            a, b = columns[i], columns[i + offset]
            out.append(F.when(enough, F.covar_samp(a, b)).alias(f"cov_{a}_{b}"))
    good = F.lit(True)
    for c in columns:
        good = good & x.finite(F.col(c))
    return df.where(good).groupBy(key).agg(*out)


def rotated(values: Column, by: Column) -> Column:
    """An array turned left."""
    return F.concat(F.slice(values, by + 1, F.size(values)), F.slice(values, F.lit(1), by))


def entropy(values: Column) -> Column:
    """Entropy of a non-negative array's shares, as a part of the largest possible."""
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    part = lambda v: F.when(v > 0, -(v / total) * F.log(v / total)).otherwise(0.0)
    return F.when(total > 0, F.aggregate(values, F.lit(0.0), lambda s, v: s + part(v)) / F.log(F.size(values).cast("double")))


def filled_with_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values of the columns at the column's median."""
    good = lambda c: F.when(x.finite(F.col(c)), F.col(c))
    joined = df
    for c in columns:
        joined = joined.join(F.broadcast(quantiles(df, c, {f"_m_{c}": 0.5}, linear=False)), F.lit(True))  # one row
    return joined.select(*(F.coalesce(good(c), F.col(f"_m_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns))


def clipped_log(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """log1p of the columns, first clipped to quantiles of what is there."""
    joined = df
    for c in columns:
        joined = joined.join(F.broadcast(quantiles(df, c, {f"_lo_{c}": low, f"_hi_{c}": high}, linear=False)), F.lit(True))
    log = lambda c: F.log1p(F.greatest(F.least(F.greatest(F.col(c), F.col(f"_lo_{c}")), F.col(f"_hi_{c}")), F.lit(0.0)))
    return joined.select(*(F.when(F.col(c).isNotNull(), log(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def _contract(columns: list[str]) -> str:
    return hashlib.sha256("\0".join(columns).encode()).hexdigest()


def fitted(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> dict:
    """What preprocessing needs to know of the columns, as plain values: medians, bounds, and a digest of the columns' order."""
    out = {"contract": _contract(columns), "columns": {}}
    for c in columns:
        row = quantiles(df, c, {"median": 0.5, "low": low, "high": high}, linear=False).first()
        if row["median"] is None:
            raise ValueError(f"{c} has no finite value")
        out["columns"][c] = {k: float(row[k]) for k in ("median", "low", "high")}
    return out


def applied(df: DataFrame, columns: list[str], saved: dict) -> DataFrame:
    """Saved medians for missing values, saved bounds, and log1p; the columns must be those of the fit."""
    if saved["contract"] != _contract(columns):
        raise ValueError("saved for other columns")
    def value(c: str) -> Column:
        known = saved["columns"][c]
        whole = F.coalesce(F.when(x.finite(F.col(c)), F.col(c)), F.lit(known["median"]))
        return F.log1p(F.greatest(x.clip(whole, known["low"], known["high"]), F.lit(0.0)))

    return df.select(*(value(c).alias(c) if c in columns else F.col(c) for c in df.columns))


def varying(df: DataFrame, columns: list[str], least: float = 1e-12) -> list[str]:
    """The columns whose range is larger than least."""
    row = df.agg(*(F.max(c).alias(f"x_{c}") for c in columns), *(F.min(c).alias(f"n_{c}") for c in columns)).first()
    return [c for c in columns if row[f"x_{c}"] is not None and row[f"x_{c}"] - row[f"n_{c}"] > least]


def leave_one_out_prior(tags: DataFrame, targets: DataFrame, smoothing: float) -> DataFrame:
    """By artist, from distinct (artist_id, tag) and train targets (artist_id, target): statistics of its tags' smoothed means, its own target left out."""
    overall = targets.agg(F.avg("target").alias("_g"))
    known = tags.join(targets, "artist_id")
    sums = known.groupBy("tag").agg(F.sum("target").alias("_s"), F.count("*").alias("_n"))
    joined = tags.join(sums, "tag").join(targets, "artist_id", "left").join(F.broadcast(overall), F.lit(True))
    own, one = F.coalesce("target", F.lit(0.0)), F.col("target").isNotNull().cast("int")
    prior = x.ratio(F.col("_s") - own + smoothing * F.col("_g"), F.col("_n") - one + smoothing)
    return joined.select("artist_id", prior.alias("prior"), "_n").groupBy("artist_id").agg(
        F.count("prior").alias("n"), F.avg("prior").alias("mean"), F.stddev_pop("prior").alias("std"), F.min("prior").alias("least"), F.max("prior").alias("most"), F.avg("_n").alias("support")
    )
