"""An ordinal head, a gated mixture of decade experts and a direct head, trained together.

Executors turn their rows into a loss and a gradient of fixed width; the driver
adds these up and takes Adam's step, clipped, at a cosine rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs as x
from tessera.plans import shipping

shipping.by_value(__name__)

#: Shares of the five losses, Huber's bound and an expert's reach in years, and shares of the heads in the blend (fixed values).
LOSSES = {"ordinal": 0.35, "mixture": 0.45, "direct": 0.05, "decade": 0.12, "consistency": 0.03}
HUBER, REACH = 3.0, 8.0
BLEND = {"ordinal": 0.20, "mixture": 0.80, "direct": 0.0}
HEADS = ("ordinal", "mixture", "direct", "blend")


@dataclass(frozen=True)
class Shape:
    """Features, the years from first to last, and experts, one a decade."""

    features: int
    first: int = 1922
    last: int = 2011

    @property
    def thresholds(self) -> int:
        return self.last - self.first

    @property
    def experts(self) -> int:
        return self.last // 10 - self.first // 10 + 1

    @property
    def centres(self) -> np.ndarray:
        """The middle of each decade, within the years."""
        return np.clip((self.first // 10 + np.arange(self.experts)) * 10.0 + 5, self.first, self.last - 1)

    def split(self, p: np.ndarray) -> list[np.ndarray]:
        f, k, e = self.features, self.thresholds, self.experts
        sizes = [f, k, f * e, e, f * e, e, f, 1]
        parts = np.split(p, np.cumsum(sizes)[:-1])
        parts[2], parts[4] = parts[2].reshape(f, e), parts[4].reshape(f, e)
        return parts

    @property
    def size(self) -> int:
        return self.features * (2 + 2 * self.experts) + self.thresholds + 2 * self.experts + 1

    def start(self, seed: int, counts: dict[int, int] | None = None) -> np.ndarray:
        """Small random weights; thresholds at the logits of the years' shares, if these are known."""
        p = np.random.default_rng(seed).normal(0, 0.01, self.size)
        later = np.linspace(0.95, 0.05, self.thresholds)
        if counts:
            total = max(sum(counts.values()), 1)
            later = np.array([sum(n for y, n in counts.items() if y > self.first + k) / total for k in range(self.thresholds)])
        later = np.clip(later, 1e-4, 1 - 1e-4)
        self.split(p)[1][:] = np.log(1 - later) - np.log(later)
        self.split(p)[7][:] = 0.5
        return p


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def forward(shape: Shape, p: np.ndarray, m: np.ndarray) -> dict[str, np.ndarray]:
    """Heads' predictions in years."""
    w, theta, experts, bias, gate, shift, direct, offset = shape.split(p)
    above = _sigmoid((m @ w)[:, None] - np.sort(theta))  # sorted: monotone
    logits = m @ gate + shift
    share = np.exp(logits - logits.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    bend = np.tanh(m @ experts + bias)
    each = shape.centres + REACH * bend
    out = {"above": above, "share": share, "bend": bend, "each": each}
    out |= {"ordinal": shape.first + above.sum(axis=1), "mixture": (share * each).sum(axis=1), "direct": shape.first + shape.thresholds * (m @ direct + offset[0])}
    return out | {"blend": sum(BLEND[h] * out[h] for h in BLEND)}


def _huber(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and slope."""
    return np.where(np.abs(e) <= HUBER, 0.5 * e * e, HUBER * (np.abs(e) - 0.5 * HUBER)), np.clip(e, -HUBER, HUBER)


def loss_and_gradient(shape: Shape, p: np.ndarray, m: np.ndarray, year: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over rows of five parts: thresholds, mixture, direct, gate, and agreement of the first two heads."""
    _, theta, *_ = shape.split(p)
    order = np.argsort(theta)
    h = forward(shape, p, m)
    beyond = (year[:, None] > shape.first + np.arange(shape.thresholds)[None, :]).astype(float)
    decade = np.clip(year.astype(int) // 10 - shape.first // 10, 0, shape.experts - 1)
    known = np.zeros_like(h["share"])
    known[np.arange(len(year)), decade] = 1
    a, s = h["above"], h["share"]
    mixture, to_mixture = _huber(h["mixture"] - year)
    direct, to_direct = _huber(h["direct"] - year)
    agree, to_agree = _huber(h["ordinal"] - h["mixture"])
    crossed = -(beyond * np.log(a + 1e-12) + (1 - beyond) * np.log(1 - a + 1e-12)).mean(axis=1)
    c = LOSSES
    loss = c["ordinal"] * crossed + c["mixture"] * mixture + c["direct"] * direct - c["decade"] * np.log(s[np.arange(len(year)), decade] + 1e-12) + c["consistency"] * agree
    to_mixture = c["mixture"] * to_mixture - c["consistency"] * to_agree
    to_above = c["ordinal"] * (a - beyond) / shape.thresholds + c["consistency"] * to_agree[:, None] * a * (1 - a)
    to_each = to_mixture[:, None] * s * REACH * (1 - h["bend"] ** 2)
    to_gate = to_mixture[:, None] * s * (h["each"] - h["mixture"][:, None]) + c["decade"] * (s - known)
    to_direct = c["direct"] * to_direct * shape.thresholds
    to_theta = np.zeros(shape.thresholds)
    to_theta[order] = -to_above.sum(axis=0)
    parts = [m.T @ to_above.sum(axis=1), to_theta, (m.T @ to_each).ravel(), to_each.sum(axis=0), (m.T @ to_gate).ravel(), to_gate.sum(axis=0), m.T @ to_direct, [to_direct.sum()]]
    return float(loss.sum()), np.concatenate([np.asarray(g, dtype=float).ravel() for g in parts])


def _added(df: DataFrame, width: int, each, features: str, year: str) -> np.ndarray:
    """Sums over all rows of each(matrix, years), vectors of that width."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for frame in frames:
            if len(frame):
                total += each(np.stack(frame[features].to_numpy()).astype(float), frame[year].to_numpy().astype(float))
        yield pd.DataFrame({"i": np.arange(width), "v": total})

    total = np.zeros(width)
    for r in df.select(features, year).mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        total[r["i"]] = r["v"]
    return total


def errors(df: DataFrame, shape: Shape, p: np.ndarray, features: str, year: str) -> dict[str, float]:
    """Mean absolute error of each head."""

    def each(m: np.ndarray, y: np.ndarray) -> np.ndarray:
        h = forward(shape, p, m)
        return np.array([*(np.abs(h[head] - y).sum() for head in HEADS), len(y)])

    total = _added(df, len(HEADS) + 1, each, features, year)
    return dict(zip(HEADS, total[:-1] / max(total[-1], 1), strict=True))


def train(df: DataFrame, shape: Shape, id_col: str, features: str, year: str, held: DataFrame | None = None, epochs: int = 10, rate: float = 0.05, fraction: float = 0.5, patience: int = 3, seed: int = 42) -> tuple[np.ndarray, list[dict]]:
    """The parameters with the least held-out error of the blend, and a record of each epoch.

    An epoch steps on its own hashed sample, at a rate that falls as a half
    cosine; without held rows the training rows judge.
    """
    df = df.persist()
    judge = df if held is None else held.persist()
    counts = {int(r["y"]): r["n"] for r in df.groupBy(F.floor(year).alias("y")).agg(F.count("*").alias("n")).collect()}  # a few years
    p = shape.start(seed, counts)
    first, second, best, stale, history = np.zeros_like(p), np.zeros_like(p), (np.inf, p), 0, []

    def each(m: np.ndarray, y: np.ndarray, p: np.ndarray) -> np.ndarray:
        loss, gradient = loss_and_gradient(shape, p, m, y)
        return np.concatenate([gradient, [loss, len(y)]])

    for epoch in range(epochs):
        sample = df.where(x.unit_hash(seed + epoch, F.col(id_col)) < fraction) if fraction < 1 else df
        total = _added(sample, shape.size + 2, lambda m, y, p=p: each(m, y, p), features, year)
        n = max(total[-1], 1.0)
        gradient = total[:-2] / n
        norm = float(np.linalg.norm(gradient))
        gradient *= min(1.0, 5.0 / (norm + 1e-12))
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        step = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        p = p - step * (first / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(second / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        found = errors(judge, shape, p, features, year)
        better = found["blend"] < best[0] - 1e-6
        history.append({"epoch": epoch + 1, "rate": float(step), "rows": int(total[-1]), "loss": float(total[-2] / n), "norm": norm, "improved": bool(better)} | {f"mae_{h}": float(e) for h, e in found.items()})
        stale = 0 if better else stale + 1
        if better:
            best = (found["blend"], p)
        elif stale >= patience:
            break
    df.unpersist()
    if held is not None:
        judge.unpersist()
    return best[1], history


def predict(df: DataFrame, shape: Shape, p: np.ndarray, id_col: str, features: str) -> DataFrame:
    """(id, ordinal, mixture, direct, blend) in years."""
    kind = dict(df.dtypes)[id_col]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                h = forward(shape, p, np.stack(frame[features].to_numpy()).astype(float))
                yield pd.DataFrame({id_col: frame[id_col].to_numpy()} | {n: h[n] for n in HEADS})

    return df.select(id_col, features).mapInPandas(run, f"{id_col} {kind}, " + ", ".join(f"{n} double" for n in HEADS))
