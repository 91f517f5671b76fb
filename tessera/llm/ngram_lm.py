"""Language-model scores by deleted interpolation (operator 6).

A token's probability is a mixture of maximum-likelihood estimates: of the
bigram, c(uv)/c(u); of the word, c(v)/N; and of a uniform word, 1/(V + 1).  The
weights depend on a bucket of the context's frequency and are learned by
expectation-maximisation: a tenth of the training texts is deleted from the
counts, and its tokens are the held-out ones.

Nothing that grows with the corpus is broadcast or collected.  Texts belong to
blocks by a hash of id and text, so that no id makes a block of its own.  Tasks send each distinct n-gram of a block with its
training count to its hash bucket; buckets add up the counts and answer each
block with the totals of just its n-grams, in order of hash, so that answers
need no n-gram in them; a block's texts meet its answers and are scored.  The
held-out tenth has blocks of its own and is met first, for a histogram of
bounded size (bins of both estimates by bucket) on which the driver learns.

Every text ends with an end token, which is also the context of its first word.
N-grams are told apart by 51 bits of a hash.

Defined results: a null or empty text is one end token; repeated rows count and
score each time; null ids are kept; there are no ties; an empty table gives an
empty one; a text longer than a block's share is scored whole in its block;
columns other than id and text are read only by the two conditions; without
training texts every estimate is the uniform one and the base score that of an
empty corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytekit as bk
from tessera.llm.runtime import checkpointed, ship, width

_U = np.uint64
_BITS = 51
_END = _U(0x1F3D5B79A2C4E)
#: Context-frequency buckets, bins per doubling of an estimate, and the least estimate told apart (as a power of two).
BUCKETS, _FINE, _DEEP = 24, 8, 40
_BLOCK_BYTES, _FLUSH = 16 << 20, 2_000_000
_WORDS, _PAIRS, _TOTALS = 0, 1, 2


@dataclass
class Mixture:
    """Weights (bigram, word, uniform) by bucket, training tokens and distinct training tokens."""

    weights: np.ndarray
    tokens: int
    distinct: int

    def log10(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 of each token's probability from its counts."""
        w = self.weights[bucket_of(context)]
        estimate = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(self.tokens, 1) + w[:, 2] / (self.distinct + 1)
        return np.log10(estimate)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one bucket for each doubling."""
    return np.minimum(np.where(context > 0, np.frexp(np.maximum(context, 1).astype(np.float64))[1], 0), BUCKETS - 1)


def streams(chunk: bk.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens and of the bigrams that end in them, and first indexes by row; each row ends with its end token."""
    starts, ends, first = chunk.runs(bk.SPACED_WORD)
    words = chunk.span_hash(starts, ends, folded=True) >> _U(64 - _BITS)
    begin = first + np.arange(len(first))
    tokens = np.full(begin[-1], _END, dtype=_U)
    tokens[np.arange(len(words)) + bk.row_of(first)] = words
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[begin[:-1]] = _END
    pairs = bk.mix(bk.mix(before + _U(0x632BE59BD9B4E019)) + tokens) >> _U(64 - _BITS)
    return tokens, pairs, begin


def _requests(source: DataFrame, bits: int) -> DataFrame:
    """By hash bucket and kind, packed: blocks with how many n-grams of each, the n-grams' lower bits, their training counts."""
    names = ["bucket", "kind", "blocks", "runs", "low", "high", "n"]
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in names[2:])])
    rest = _BITS - bits

    def packed(kind: int, value: np.ndarray, block: np.ndarray, train: np.ndarray) -> Iterator[pa.RecordBatch]:
        every, local = np.unique(block, return_inverse=True)
        for low_block in range(0, len(every), 1 << 13):  # 13 bits for the block beside 51 of the hash
            here = (local >= low_block) & (local < low_block + (1 << 13))
            v, b = value[here], (local[here] - low_block).astype(_U)
            key = v >> _U(rest) << _U(rest + 13) | b << _U(rest) | v & _U((1 << rest) - 1)
            order = np.argsort(key)
            key = key[order]
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.add.reduceat(train[here][order].astype(np.uint32), heads, dtype=np.uint32)
            key = key[heads]
            place, owner = (key >> _U(rest + 13)).astype(np.int64), (key >> _U(rest)).astype(np.int64)
            tail = key & _U((1 << rest) - 1)
            low, high = (tail & _U(0xFFFFFFFF)).astype(np.uint32), (tail >> _U(32)).astype(np.uint32)
            cuts = np.searchsorted(place, np.arange((1 << bits) + 1))
            full = np.flatnonzero(np.diff(cuts))
            columns: list[list[bytes]] = [[] for _ in range(5)]
            for p in full.tolist():
                part = slice(cuts[p], cuts[p + 1])
                change = np.flatnonzero(np.concatenate([[True], owner[part][1:] != owner[part][:-1]]))
                columns[0].append(every[low_block + (owner[part][change] & ((1 << 13) - 1))].astype(np.int64).tobytes())
                columns[1].append(np.diff(np.append(change, cuts[p + 1] - cuts[p])).astype(np.int32).tobytes())
                columns[2].append(low[part].tobytes())
                columns[3].append(high[part].astype(np.uint16 if rest <= 48 else np.uint32).tobytes())
                columns[4].append(n[part].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), kind), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            tokens, pairs, block, train = (np.concatenate([h[i] for h in held]) for i in range(4))
            yield from packed(_WORDS, tokens, block, train)
            yield from packed(_PAIRS, pairs, block, train)

        for chunk in bk.chunks(batches, "text"):
            tokens, pairs, begin = streams(chunk)
            sizes = np.diff(begin)
            block, train = chunk.batch.column(1).to_numpy(), np.asarray(chunk.batch.column(2))
            held.append((tokens, pairs, np.repeat(block, sizes), np.repeat(train.astype(bool), sizes)))
            count += len(tokens)
            if count >= _FLUSH:
                yield from flush()
                held, count = [], 0
        if count:
            yield from flush()

    return source.mapInArrow(run, schema)


def _answers(requests: DataFrame, parts: int, bits: int, deleted: int) -> DataFrame:
    """By block, kind and bucket: training counts of its n-grams in order of hash, and for blocks below deleted the counts without theirs; and totals."""
    names = ["block", "kind", "bucket", "all", "rest", "tokens", "distinct", "held"]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("all", T.BinaryType()), T.StructField("rest", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in names[5:])])
    high_type = np.uint16 if _BITS - bits <= 48 else np.uint32

    def work(bucket: int, kind: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        block = np.concatenate([np.repeat(h[0], h[1]) for h in held])
        tail = np.concatenate([h[2].astype(_U) | h[3].astype(_U) << _U(32) for h in held])
        n = np.concatenate([h[4] for h in held]).astype(np.int64)
        order = np.lexsort((block, tail)) if len(held) > 1 else np.argsort(tail, kind="stable")
        block, tail, n = block[order], tail[order], n[order]
        head = np.concatenate([[True], tail[1:] != tail[:-1]])
        which, heads = np.cumsum(head) - 1, np.flatnonzero(head)
        total = np.add.reduceat(n, heads)
        without = total - np.add.reduceat(np.where(block < deleted, n, 0), heads)
        once = head | np.concatenate([[True], block[1:] != block[:-1]])
        block, which = block[once], which[once]
        order = np.argsort(block, kind="stable")
        block, which = block[order], which[order]
        edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        rows = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            counts = pa.compress(total[which[a:b]].astype(np.uint32).tobytes(), "zstd", asbytes=True)
            rest = pa.compress(without[which[a:b]].astype(np.uint32).tobytes(), "zstd", asbytes=True) if block[a] < deleted else None
            rows.append((int(block[a]), kind, bucket, counts, rest, None, None, None))
        rows.append((None, kind + _TOTALS, bucket, None, None, int(total.sum()), int((total > 0).sum()), int((total - without).sum())))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        current = None
        for batch in batches:
            keys = list(zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), strict=True))
            for i, key in enumerate(keys):
                if key != current and held:
                    yield work(*current, held)
                    held = []
                current = key
                held.append(tuple(np.frombuffer(batch.column(c)[i].as_buffer(), dtype=t) for c, t in (("blocks", np.int64), ("runs", np.int32), ("low", np.uint32), ("high", high_type), ("n", np.uint32))))
        if held:
            yield work(*current, held)

    return requests.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, schema)


def _met(source: DataFrame, answers: DataFrame, parts: int, schema: T.StructType, each, column: str) -> DataFrame:
    """Bring each block's texts and answers together: each(ids, texts' streams by chunk, counts of words, counts of pairs)."""
    texts = source.select("block", F.lit(-1).alias("kind"), F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("counts"), "id", "text")
    id_type = source.schema["id"].dataType
    told = answers.select("block", "kind", "bucket", F.col(column).alias("counts"), F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("string").alias("text"))
    both = told.unionByName(texts).repartition(parts, "block").sortWithinPartitions("block", "kind", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        counts: dict[int, list[np.ndarray]] = {_WORDS: [], _PAIRS: []}
        current = None

        def finish() -> pa.RecordBatch:
            tokens, pairs = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            sizes = np.concatenate([np.diff(h[2]) for h in held])
            found = []
            for values, kind in ((tokens, _WORDS), (pairs, _PAIRS)):
                every, which = np.unique(values, return_inverse=True)
                answer = np.concatenate(counts[kind])
                if len(answer) != len(every):
                    raise ValueError("a block's answers do not fit its n-grams")
                found.append(answer[which].astype(np.int64))
                if kind == _WORDS:
                    end = int(answer[np.searchsorted(every, _END)])
            return each(pa.concat_arrays(ids), np.concatenate([[0], np.cumsum(sizes)]), found[0], found[1], end)

        for batch in batches:
            kind, block = batch.column("kind").to_numpy(), batch.column("block").to_numpy()
            for a, b in _stretches(block, kind):
                if block[a] != current:
                    if held:
                        yield finish()
                    ids, held, counts, current = [], [], {_WORDS: [], _PAIRS: []}, block[a]
                part = batch.slice(a, b - a)
                if kind[a] >= 0:
                    for packed in part.column("counts"):
                        raw = packed.as_buffer()
                        counts[int(kind[a])].append(np.frombuffer(pa.decompress(raw, _size(raw), "zstd"), dtype=np.uint32))
                else:
                    for chunk in bk.chunks(iter([part]), "text"):
                        held.append(streams(chunk))
                        ids.append(chunk.batch.column("id"))
        if held:
            yield finish()

    return both.mapInArrow(run, schema)


def _stretches(block: np.ndarray, kind: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (kind[1:] != kind[:-1]), [True]]))
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _size(raw: pa.Buffer) -> int:
    """Length of the content of a zstd frame with its size in the header."""
    head = raw.to_pybytes()[:18]
    flags = head[4]
    single, size_flag, dictionary = flags >> 5 & 1, flags >> 6, flags & 3
    at = 5 + (0 if single else 1) + (0, 1, 2, 4)[dictionary]
    width_ = (1 if single else 0, 2, 4, 8)[size_flag]
    value = int.from_bytes(head[at : at + width_], "little")
    return value + 256 if size_flag == 1 else value


def learn(cells: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights by bucket from cells (bucket, bigram estimate, word estimate, uniform estimate, tokens) by expectation-maximisation."""
    weights = np.tile(np.array([0.4, 0.5, 0.1]), (BUCKETS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    if not len(cells):
        return weights
    bucket, parts, n = cells[:, 0].astype(np.int64), cells[:, 1:4], cells[:, 4]
    for _ in range(rounds):
        share = weights[bucket] * parts
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
        gathered = np.zeros((BUCKETS, 3))
        np.add.at(gathered, bucket, share * n[:, None])
        # A few tokens' worth of the start, so that no weight of a rare bucket becomes nothing.
        gathered += 2.0 * np.array([0.3, 0.4, 0.3]) * (np.arange(BUCKETS) > 0)[:, None] + 2.0 * np.array([0.0, 0.6, 0.4]) * (np.arange(BUCKETS) == 0)[:, None]
        weights = gathered / gathered.sum(axis=1, keepdims=True)
    return weights


def score(df: DataFrame, held_out, deleted, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """A row for each row of df: id, n_tokens, n_known, train_tokens, base_score, score.

    held_out and deleted are conditions on df's rows: what is not learned from
    at all, and the training texts that the weights are learned on.
    """
    spark = df.sparkSession
    ship(spark)
    parts = width(spark)
    bits = max(2, min(_BITS - 32, (4 * parts - 1).bit_length()))
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = df.agg(F.sum(F.when(deleted & ~held_out, F.octet_length(text) + 8)).alias("d"), F.sum(F.octet_length(text) + 8).alias("all")).first()
    n_deleted = max(1, -(-int(sizes["d"] or 0) // block_bytes))
    n_other = max(1, -(-(int(sizes["all"] or 0) - int(sizes["d"] or 0)) // block_bytes))
    spot = F.xxhash64(F.col(id_col).cast("string"), text)  # many rows may share an id, or have none
    block = F.when(deleted & ~held_out, F.pmod(spot, F.lit(n_deleted))).otherwise(F.pmod(spot, F.lit(n_other)) + n_deleted)
    source = df.select(text.alias("text"), block.cast("long").alias("block"), (~held_out).alias("train"), F.col(id_col).alias("id"))
    requests = _requests(source.select("text", "block", "train"), bits)
    answers = checkpointed(_answers(requests, parts, bits, n_deleted))
    totals = answers.where(F.col("kind") == _WORDS + _TOTALS).agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v"), F.sum("held").alias("h")).first()
    tokens, distinct, held = (int(totals[c] or 0) for c in ("n", "v", "h"))
    told = answers.where(F.col("kind") < _TOTALS)

    # The held-out tokens by bucket and bins of their estimates, counted without the deleted texts.
    cell_schema = T.StructType([T.StructField("cell", T.LongType()), T.StructField("n", T.LongType())])
    wide = _DEEP * _FINE + 2

    def bins(estimate: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            deep = np.floor(-np.log2(estimate) * _FINE)
        return np.where(estimate > 0, np.minimum(deep, wide - 2) + 1, 0).astype(np.int64)

    def tally(ids: pa.Array, begin: np.ndarray, word: np.ndarray, pair: np.ndarray, end: int) -> pa.RecordBatch:
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[begin[:-1]] = end
        cell = (bucket_of(context) * wide + bins(pair / np.maximum(context, 1))) * wide + bins(word / max(tokens - held, 1))
        found, n = np.unique(cell, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    tenth = _met(source.where(F.col("block") < n_deleted), told.where(F.col("block") < n_deleted), parts, cell_schema, tally, "rest")
    rows = tenth.groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most buckets x bins x bins cells
    middle = lambda b: np.where(b > 0, 2.0 ** (-(b - 0.5) / _FINE), 0.0)
    cell, n = np.array([r["cell"] for r in rows], dtype=np.int64), np.array([r["n"] for r in rows], dtype=np.float64)
    cells = np.stack([cell // wide // wide, middle(cell // wide % wide), middle(cell % wide), np.full(len(cell), 1.0 / (distinct + 1)), n], axis=1) if len(cell) else np.zeros((0, 5))
    mixture = Mixture(learn(cells), tokens, distinct)

    out = T.StructType([T.StructField("id", source.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def scored(ids: pa.Array, begin: np.ndarray, word: np.ndarray, pair: np.ndarray, end: int) -> pa.RecordBatch:
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[begin[:-1]] = end
        base = np.log10((word + 0.1) / (tokens + 0.1 * (distinct + 1)))
        known = bk.sum_by(begin, word > 0)
        sums = lambda x: np.add.reduceat(x, begin[:-1])  # noqa: E731  every row has its end token
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(begin), pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(known), tokens), pa.int64()), pa.array(sums(base)), pa.array(sums(mixture.log10(pair, context, word)))], names=out.names)

    every = _met(source, told, max(parts, min(n_deleted + n_other, 4 * parts)), out, scored, "all")
    return every.withColumnRenamed("id", id_col)
