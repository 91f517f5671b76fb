"""Toxicity by a weighted finite-state pattern grammar (operator 1).

Words become symbols: insult, threat, target, negation, reported speech, other.
Three transducers read a clause's symbols one after another and are composed
into a single one: negation rewrites insults and threats in its scope, reported
speech those of a clause that quotes, and scoring weighs what is left, more
where a target stands near, a threat only with a target.  A clause scores the
sum of its arcs' weights times its words' weights; a text's score is a logistic
function of its clauses' sum, so isolated words count by the pattern they are in.

Weights of words and beginnings of words are learned from labelled texts, a
sample of at most ``max_rows`` of them (the rows with the least hashes of their
ids), beside a small built-in lexicon.  Scoring sees nothing but the text.

Defined results: a null or empty text scores as one without any pattern;
repeated rows score alike and there are no ties; null ids are kept but never
matched with a label; without labels, or for empty tables, only the built-in
lexicon is used; a text of any length is scored whole; columns other than those
named are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytekit as bk
from tessera.llm.runtime import ship

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, DENIED, QUOTED = range(8)

#: Built-in words (fixed values).
WORDS = {
    INSULT: ("idiot", "moron", "stupid", "imbecile", "scumbag", "worthless", "pathetic", "loser"),
    THREAT: ("kill", "hurt", "stab", "shoot", "strangle", "murder"),
    TARGET: ("you", "your", "yours", "youre", "he", "she", "they", "them", "him", "her"),
    NEGATION: ("not", "never", "neither", "nor", "isn", "aren", "wasn", "don", "doesn", "didn"),
    REPORT: ("said", "says", "wrote", "claimed", "quoted", "allegedly", "according", "reportedly"),
}
_SHORTEST, _LONGEST = 4, 8  # bytes of beginnings of words that are learned
_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[list(b".!?;\n")] = True


class Transducer:
    """States by number from 0; an arc for each state and symbol: next state, symbol written, weight."""

    def __init__(self, states: int, arcs: dict[tuple[int, int], tuple[int, int, float]]):
        self.states = states
        #: Without an arc a symbol is copied, with weight 1, and the state stays.
        self.arcs = {(q, s): arcs.get((q, s), (q, s, 1.0)) for q in range(states) for s in range(8)}

    def then(self, after: Transducer) -> Transducer:
        """The composition: after reads what this writes."""
        arcs = {}
        for (q, s), (q_next, written, weight) in self.arcs.items():
            for p in range(after.states):
                p_next, out, more = after.arcs[p, written]
                arcs[q * after.states + p, s] = (q_next * after.states + p_next, out, weight * more)
        return Transducer(self.states * after.states, arcs)

    def run(self, symbols: list[int]) -> list[float]:
        """Weights of the arcs taken from state 0."""
        state, out = 0, []
        for s in symbols:
            state, _, weight = self.arcs[state, s]
            out.append(weight)
        return out


def negation(scope: int = 3) -> Transducer:
    """After a negation, insults and threats among the next words are denied."""
    arcs = {}
    for left in range(scope + 1):
        for s in range(8):
            arcs[left, s] = (max(left - 1, 0), DENIED if left and s in (INSULT, THREAT) else s, 1.0)
        arcs[left, NEGATION] = (scope, NEGATION, 1.0)
    return Transducer(scope + 1, arcs)


def reported() -> Transducer:
    """After a verb of saying, insults and threats of the clause are quoted."""
    return Transducer(2, {(0, REPORT): (1, REPORT, 1.0), (1, INSULT): (1, QUOTED, 1.0), (1, THREAT): (1, QUOTED, 1.0)})


def scoring(reach: int = 3) -> Transducer:
    """Weights: an insult by its clause, most with a target among the words before, more after another insult than alone; a threat only with a target; denied and quoted ones little."""
    arcs = {}
    for left in range(reach + 1):
        for seen in (0, 1):  # whether an insult came before
            here, down = 2 * left + seen, 2 * max(left - 1, 0)
            for s in range(8):
                arcs[here, s] = (down + seen, s, 0.0)
            arcs[here, TARGET] = (2 * reach + seen, TARGET, 0.0)
            arcs[here, INSULT] = (down + 1, INSULT, 1.3 if left else 1.0 if seen else 0.7)
            arcs[here, THREAT] = (down + 1, THREAT, 1.0 if left else 0.0)
            arcs[here, DENIED] = (down + seen, DENIED, 0.15)
            arcs[here, QUOTED] = (down + seen, QUOTED, 0.4)
    return Transducer(2 * (reach + 1), arcs)


GRAMMAR = negation().then(reported()).then(scoring())


def _hash(text: str) -> int:
    chunk = bk.Chunk(pa.RecordBatch.from_arrays([pa.array([text], pa.string())], names=["text"]), "text")
    return int(chunk.span_hash(np.array([0]), np.array([len(chunk.data)]), folded=True)[0])


@dataclass
class Model:
    """Weights by hash of whole words (length 0) or of beginnings of so many bytes, and the logistic function."""

    units: dict[int, dict[int, float]] = field(default_factory=dict)
    bias: float = -4.0
    slope: float = 2.5

    def tables(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        out = []
        for length, weights in sorted(self.units.items()):
            keys = np.array(sorted(weights), dtype=np.uint64)
            out.append((length, keys, np.array([weights[int(k)] for k in keys])))
        return out


def _words(chunk: bk.Chunk) -> tuple[np.ndarray, ...]:
    starts, ends, first = chunk.runs(bk.ALNUM_WORD)
    return starts, ends, first, chunk.span_hash(starts, ends, folded=True)


def _look(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in keys, and whether the value is there."""
    if not len(keys):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return place, keys[place] == values


def pattern_sums(chunk: bk.Chunk, model: Model, tables: list, symbols: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """By row, the sum of clause scores and how many clauses match."""
    starts, ends, first, words = _words(chunk)
    row = bk.row_of(first)
    weight = np.zeros(len(words))
    for length, keys, weights in tables:
        at = np.arange(len(words)) if length == 0 else np.flatnonzero(ends - starts >= length)
        values = words if length == 0 else chunk.span_hash(starts[at], starts[at] + length, folded=True)
        place, there = _look(keys, values)
        weight[at[there]] = np.maximum(weight[at[there]], weights[place[there]])
    place, there = _look(symbols[0], words)
    symbol = np.where(there, symbols[1][place], OTHER) if len(words) else np.zeros(0, np.int64)
    symbol[(weight > 0) & (symbol == OTHER)] = INSULT  # a learned word that the grammar knows keeps its part in it
    weight[(symbol == THREAT)] = 2.0
    sums, matched = np.zeros(chunk.rows), np.zeros(chunk.rows, dtype=np.int64)
    hits = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
    if not len(hits):
        return sums, matched
    breaks = np.concatenate([[0], np.cumsum(_BREAKS[chunk.data])])
    clause_head = np.ones(len(words), dtype=bool)
    clause_head[1:] = (row[1:] != row[:-1]) | (breaks[starts[1:]] != breaks[starts[:-1]])
    clause = np.cumsum(clause_head) - 1
    begin = np.append(np.flatnonzero(clause_head), len(words))
    for c in np.unique(clause[hits]).tolist():
        a, b = begin[c], begin[c + 1]
        score = float(np.dot(GRAMMAR.run(symbol[a:b].tolist()), weight[a:b]))
        if score > 0:
            sums[row[a]] += score
            matched[row[a]] += 1
    return sums, matched


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted((_hash(w), s) for s, words in WORDS.items() if s != INSULT for w in words)
    return np.array([p[0] for p in pairs], dtype=np.uint64), np.array([p[1] for p in pairs], dtype=np.int64)


def _units(chunk: bk.Chunk) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Length, rows and hashes of the distinct whole words and beginnings of words in each row, and one of 63 bits for the next word of each."""
    starts, ends, first, words = _words(chunk)
    row = bk.row_of(first)
    following = np.int64(1) << (bk.mix(np.append(words[1:], np.zeros(min(1, len(words)), np.uint64))) % np.uint64(63)).astype(np.int64)
    for length in (0, *range(_SHORTEST, _LONGEST + 1)):
        at = np.arange(len(words)) if length == 0 else np.flatnonzero(ends - starts >= length)
        values = words[at] if length == 0 else chunk.span_hash(starts[at], starts[at] + length, folded=True)
        order = np.lexsort((values, row[at]))
        v, r = values[order], row[at][order]
        new = np.ones(len(v), dtype=bool)
        new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
        heads = np.flatnonzero(new)
        yield length, r[heads], v[heads], np.bitwise_or.reduceat(following[at][order], heads) if len(heads) else following[:0]


_COUNTED = T.StructType([T.StructField("length", T.IntegerType()), T.StructField("unit", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("next", T.LongType())])


def _counts(sample: DataFrame, only: dict[int, np.ndarray] | None) -> DataFrame:
    """Texts of the sample that hold a unit, by unit and label; only the given units, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in bk.chunks(batches, "text"):
            label = chunk.batch.column(1).to_numpy(zero_copy_only=False)
            for length, row, unit, following in _units(chunk):
                if only is not None:
                    _, there = _look(only.get(length, np.zeros(0, np.uint64)), unit)
                    row, unit, following = row[there], unit[there], following[there]
                for toxic in (0, 1):
                    mine = np.flatnonzero(label[row] == toxic)
                    if len(mine):
                        mine = mine[np.argsort(unit[mine])]
                        found, heads, n = np.unique(unit[mine], return_index=True, return_counts=True)
                        k = len(found)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, length), pa.int32()), pa.array(found.view(np.int64)), pa.array(np.full(k, toxic), pa.int32()), pa.array(n, pa.int64()), pa.array(np.bitwise_or.reduceat(following[mine], heads), pa.int64())], names=_COUNTED.names)

    return sample.mapInArrow(run, _COUNTED).groupBy("length", "unit", "toxic").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("next")).alias("contexts"))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, least_texts: int = 6, least_contexts: int = 6) -> Model:
    """Learn units and the logistic function from at most max_rows labelled texts.

    A unit must stand before several different words: copies of one toxic text
    would otherwise make all its words look toxic.
    """
    ship(df.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    # The sample's size is bounded by max_rows, 16 bytes each.
    part = F.pmod(F.xxhash64("id"), F.lit(3))
    sample = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "label", part.alias("part")).persist()
    # The logistic function is fitted on a third that the units of this first model have not seen.
    model = _learned(sample.where("part <> 0"), least_texts, least_contexts)
    _calibrate(sample.where("part = 0"), model)
    model.units = _learned(sample, least_texts, least_contexts).units
    sample.unpersist()
    return model


def _learned(sample: DataFrame, least_texts: int, least_contexts: int) -> Model:
    """A model with the built-in insults and the sample's units."""
    model = Model(units={0: {_hash(w): 2.0 for w in WORDS[INSULT]}})
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if toxic and clean:
        often = _counts(sample.where("label = 1"), None).where((F.col("n") >= least_texts) & (F.col("contexts") >= least_contexts)).collect()  # of a sample of bounded size
        only: dict[int, list[int]] = {}
        for r in often:
            only.setdefault(r["length"], []).append(r["unit"] & (1 << 64) - 1)
        arrays = {k: np.array(sorted(v), dtype=np.uint64) for k, v in only.items()}
        against = {(r["length"], r["unit"]): r["n"] for r in _counts(sample.where("label = 0"), arrays).collect()}
        for r in often:
            n, m = r["n"], against.get((r["length"], r["unit"]), 0)
            odds = np.log((n + 0.5) / (toxic + 1)) - np.log((m + 0.5) / (clean + 1))
            if odds >= 3.0 and m <= 0.03 * n:
                model.units.setdefault(r["length"], {})[r["unit"] & (1 << 64) - 1] = float(min(odds, 6.0) / 3.0)
    return model


def _calibrate(sample: DataFrame, model: Model, bins: int = 200) -> None:
    """Fit the logistic function on a histogram of pattern sums by label."""
    schema = T.StructType([T.StructField("bin", T.IntegerType()), T.StructField("label", T.IntegerType()), T.StructField("n", T.LongType())])
    tables, symbols = model.tables(), _symbols()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in bk.chunks(batches, "text"):
            sums, _ = pattern_sums(chunk, model, tables, symbols)
            at = np.minimum(np.log1p(sums) * 40, bins - 1).astype(np.int64) * 2 + chunk.batch.column(1).to_numpy(zero_copy_only=False)
            found, n = np.unique(at, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found // 2, pa.int32()), pa.array(found % 2, pa.int32()), pa.array(n, pa.int64())], names=schema.names)

    rows = sample.mapInArrow(run, schema).groupBy("bin", "label").agg(F.sum("n").alias("n")).collect()
    if {r["label"] for r in rows} != {0, 1}:
        return
    x = np.array([(r["bin"] + 0.5) / 40 if r["bin"] else 0.0 for r in rows])
    y, n = np.array([r["label"] for r in rows], dtype=float), np.array([r["n"] for r in rows], dtype=float)
    weights = np.array([model.bias, model.slope])
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):  # Newton's method, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (n * (y - p)) - 0.5 * weights
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 0.5 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        weights += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    if weights[1] > 0:
        model.bias, model.slope = float(weights[0]), float(weights[1])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """A row for each row of df: id, score, predicted, matched clauses."""
    ship(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_clauses", T.LongType())])
    tables, symbols = model.tables(), _symbols()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in bk.chunks(batches, "text"):
            sums, matched = pattern_sums(chunk, model, tables, symbols)
            value = 1 / (1 + np.exp(-np.clip(model.bias + model.slope * np.log1p(sums), -30, 30)))
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), pa.array(value, pa.float64()), pa.array(value >= threshold, pa.bool_()).cast(pa.int32()), pa.array(matched, pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
