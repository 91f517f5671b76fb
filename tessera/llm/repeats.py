"""Removal of repeated byte strings by suffix sorting (operator 9).

A byte is removed if a string of ``length`` bytes that covers it also starts
anywhere else in the corpus.  The suffixes are sorted by the difference-cover
algorithm and neighbours in that order compared on their first ``length`` bytes.

One order of all suffixes of a corpus would take many times the corpus on disk,
and only suffixes that agree in ``length`` bytes matter to each other.  So the
suffixes are dealt out first: a window of ``length`` bytes belongs to its
minimizer, the least hash among its shorter byte grams.  Equal windows have
equal minimizers, so each bucket is sorted by itself and no match is lost.
Consecutive windows with one minimizer travel as one piece:

1. pieces are dealt by minimizer as hashes, without text; equal pieces are
   repeated as wholes; minimizers of one piece only are done;
2. of the other minimizers, one text of each different piece is fetched, and
   each bucket's texts are suffix-sorted together, marking windows that agree
   with a neighbour;
3. marks meet their texts again, and covered bytes are cut out.

A task sends on only one of equal pieces, so a passage that very many documents
share is no hot spot; a minimizer with too many different pieces is dealt out
again by whole windows.  Hashes are of 64 bits; neighbours in suffix order are
compared by their bytes.

With ``least_words``, only maximal repeated runs that hold so many whole words
count, so that a length short enough for any passage of that many words leaves
shorter repeats alone.

Defined results: a null text is an empty one; texts shorter than ``length`` and
windows across documents never match; every copy of a repeated string goes, the
first included; repeated rows are copies of each other; null ids are kept, ties
do not occur; an empty table gives an empty one; a text of any length is judged
whole, alone in its chunk if it is long; columns other than id and text pass
through whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytekit as bk
from tessera.llm.runtime import checkpointed, ship, width
from tessera.llm.suffix import suffix_array

_U = np.uint64
_BUCKETS, _FLUSH = 4, 200_000
#: Different pieces of a minimizer that are sorted together; more are dealt out by window.
_MOST_PIECES = 3000
_SORTED_BYTES = 800_000
#: Bytes and whole words that make a run a passage: 51 words of prose take some 250 bytes or more.
PASSAGE = (200, 51)
_FILTER_BITS = 1 << 26


def _key(text: bytes) -> tuple[bytes, int]:
    digest = hashlib.sha256(text).digest()
    return digest, int.from_bytes(digest[:8], "big", signed=True)


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return (bk.mix(values.view(_U)) >> _U(33)).astype(np.int64) % buckets


def pieces(chunk: bk.Chunk, rows: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the given rows: minimizer, hash, row, first place in the row and windows of each piece."""
    n, span = len(chunk.data), length - gram + 1
    count = n - length + 1
    if count <= 0 or not rows.any():
        return tuple(np.zeros(0, t) for t in (_U, _U, np.int64, np.int64, np.int64))
    grams = chunk.rolling_hash(gram)
    # The leftmost least gram of each window: minima of blocks from their left and right ends.
    key = (grams & ~_U((1 << 31) - 1)) | np.arange(len(grams), dtype=_U)
    blocks = np.concatenate([key, np.full(-len(key) % span, ~_U(0))]).reshape(-1, span)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(right[:count], left[span - 1 : span - 1 + count]) & _U((1 << 31) - 1)).astype(np.int64)
    row = np.repeat(np.arange(chunk.rows), chunk.sizes)[:count]
    valid = (np.arange(count) + length <= chunk.offsets[1:][row]) & rows[row]
    heads = np.ones(count, dtype=bool)
    heads[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | (valid[1:] != valid[:-1])
    start = np.flatnonzero(heads)
    windows = np.diff(np.append(start, count))
    keep = valid[start]
    start, windows = start[keep], windows[keep]
    end = start + windows - 1 + length
    hashed = bk.mix(chunk.span_hash(start, end) + (at[start] - start).astype(_U) * _U(0xC2B2AE3D27D4EB4F) + windows.astype(_U))
    return grams[at[start]], hashed, row[start], start - chunk.offsets[row[start]], windows


def _packed(kind: int, bucket: np.ndarray, buckets: int, columns: list[np.ndarray], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    """One row for each bucket met: bucket, kind and the columns' values as bytes; other columns null."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(edges))
    out = [pa.array(full, pa.int32()), pa.array(np.full(len(full), kind), pa.int32())]
    for column in columns:
        values = column[order]
        out.append(pa.array([values[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()))
    out += [pa.nulls(len(full), t) for t in types[len(out) :]]
    return pa.RecordBatch.from_arrays(out, names=names)


_BYTES = ("a", "b", "c", "d", "e")
_PIECES, _MARKS, _WANTED, _DOCUMENT, _TEXTS, _WINDOWS = range(6)


def _schema(id_type: T.DataType) -> T.StructType:
    """Rows of all kinds: packed values a to e, or a document's id, digest, size, words and text."""
    packed = [T.StructField(n, T.BinaryType()) for n in _BYTES]
    return T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), *packed, T.StructField("id", id_type), T.StructField("digest", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("text", T.StringType())])


def _types(id_type: pa.DataType) -> list[pa.DataType]:
    return [pa.int32(), pa.int32(), *[pa.binary()] * 5, id_type, pa.binary(), pa.int64(), pa.int64(), pa.string()]


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _dealt(source: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """Documents without texts, packed pieces by minimizer, and marks of pieces a task holds twice."""
    schema, names = _schema(source.schema["id"].dataType), _schema(T.NullType()).names
    kinds = _types(_arrow_type(source.schema["id"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, seen, told = [], 0, set(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            mini, hashed, key, place, windows = (np.concatenate([h[i] for h in held]) for i in range(5))
            order = np.lexsort((place, key, hashed, mini))
            mini, hashed, key, place, windows = (x[order] for x in (mini, hashed, key, place, windows))
            head = np.ones(len(mini), dtype=bool)
            head[1:] = (mini[1:] != mini[:-1]) | (hashed[1:] != hashed[:-1])
            group = np.cumsum(head) - 1
            twice = (np.bincount(group) > 1)[group]
            if twice.any():
                yield _packed(_MARKS, _bucket(key[twice], buckets), buckets, [key[twice], place[twice], windows[twice].astype(np.int32)], kinds, names)
            known = twice.astype(np.int32)
            yield _packed(_PIECES, _bucket(mini[head], buckets), buckets, [mini[head], hashed[head], key[head], place[head], windows[head].astype(np.int32) * 2 + known[head]], kinds, names)

        for chunk in bk.chunks(batches, "text"):
            digests, keys = zip(*(_key(chunk.text(r)) for r in range(chunk.rows)), strict=True)
            fresh = np.zeros(chunk.rows, dtype=bool)
            for r, k in enumerate(keys):
                if k not in seen:  # copies of a text in one task are dealt once
                    seen.add(k)
                    fresh[r] = True
            keys = np.array(keys, dtype=np.int64)
            mini, hashed, row, place, windows = pieces(chunk, fresh, length, gram)
            held.append((mini, hashed, keys[row], place, windows))
            count += len(mini)
            n, words = chunk.rows, np.diff(chunk.runs(bk.SPACED_WORD)[2])
            spread = (told + np.arange(n)) % buckets  # documents only pass through: copies need not meet
            told += n
            yield pa.RecordBatch.from_arrays([pa.array(spread, pa.int32()), pa.array(np.full(n, _DOCUMENT), pa.int32()), *[pa.nulls(n, pa.binary())] * 5, chunk.batch.column(0), pa.array(digests, pa.binary()), pa.array(chunk.sizes, pa.int64()), pa.array(words, pa.int64()), pa.nulls(n, pa.string())], names=names)
            if count >= _FLUSH:
                yield from flush()
                held, count, seen = [], 0, set()
        if count:
            yield from flush()

    return source.mapInArrow(run, schema)


def _by_bucket(df: DataFrame, parts: int, work: Callable[[dict[int, list[list[np.ndarray]]]], Iterator[pa.RecordBatch]], dtypes: dict[int, list[str]], passed: tuple[int, ...] = ()) -> DataFrame:
    """Gather packed rows bucket by bucket and hand each to work; rows of passed kinds go through."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        current = None
        for batch in batches:
            kinds, buckets = batch.column("kind").to_numpy(), batch.column("bucket").to_numpy()
            through = np.isin(kinds, passed)
            if through.any():
                yield batch.filter(pa.array(through))
            for i in np.flatnonzero(~through).tolist():
                if buckets[i] != current and held:
                    yield from work(held)
                    held = {}
                current = buckets[i]
                values = [np.frombuffer(batch.column(n)[i].as_buffer(), dtype=t) for n, t in zip(_BYTES, dtypes[int(kinds[i])], strict=False)]
                held.setdefault(int(kinds[i]), []).append(values)
        if held:
            yield from work(held)

    return df.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _compared(dealt: DataFrame, parts: int, buckets: int) -> DataFrame:
    """Step 1: documents and marks as they are, marks of equal pieces, and wanted texts by document."""
    names, kinds = dealt.schema.names, _types(_arrow_type(dealt.schema["id"].dataType))

    def work(held: dict[int, list[list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        mini, hashed, key, place, windows = (np.concatenate(x) for x in zip(*held[_PIECES], strict=True))
        known, windows = windows & 1, windows >> 1
        order = np.lexsort((place, key, hashed, mini))
        mini, hashed, key, place, windows, known = (x[order] for x in (mini, hashed, key, place, windows, known))
        # The same piece of the same text, from copies in two tasks, is one.
        other = np.ones(len(mini), dtype=bool)
        other[1:] = (mini[1:] != mini[:-1]) | (hashed[1:] != hashed[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1])
        first = np.flatnonzero(other)
        known = np.maximum.reduceat(known, first)
        mini, hashed, key, place, windows = (x[first] for x in (mini, hashed, key, place, windows))
        head = np.ones(len(mini), dtype=bool)
        head[1:] = (mini[1:] != mini[:-1]) | (hashed[1:] != hashed[:-1])
        heads = np.flatnonzero(head)
        piece = np.cumsum(head) - 1
        repeated = (np.bincount(piece) > 1) | (np.maximum.reduceat(known, heads) > 0)
        tell = repeated[piece] & (known == 0)
        if tell.any():
            yield _packed(_MARKS, _bucket(key[tell], buckets), buckets, [key[tell], place[tell], windows[tell].astype(np.int32)], kinds, names)
        group = np.cumsum(np.concatenate([[True], mini[heads][1:] != mini[heads][:-1]])) - 1
        different = np.bincount(group)[group]
        want = (different > 1) & ((np.bincount(group, weights=~repeated) > 0)[group])
        if want.any():
            at = heads[want]
            flags = (~repeated[want]).astype(np.int32) + 2 * (different[want] > _MOST_PIECES)
            yield _packed(_WANTED, _bucket(key[at], buckets), buckets, [key[at], place[at], windows[at].astype(np.int32), mini[at], flags.astype(np.int32)], kinds, names)

    return _by_bucket(dealt, parts, work, {_PIECES: ["u8", "u8", "i8", "i8", "i4"]}, (_DOCUMENT, _MARKS))


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A bit table of fixed size for the int64 values in the only column, packed or plain; a set bit may mean no key, a clear one never does."""
    schema = T.StructType([T.StructField("word", T.IntegerType()), T.StructField("mask", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            values = [column.to_numpy()] if pa.types.is_int64(column.type) else [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in column]
            place = np.unique(np.concatenate([_bucket(x, _FILTER_BITS) for x in values] or [np.zeros(0, np.int64)]))
            if len(place):
                word = place >> 5
                heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(word[heads], pa.int32()), pa.array(np.bitwise_or.reduceat(np.int64(1) << (place & 31), heads), pa.int64())], names=["word", "mask"])

    table = np.zeros(_FILTER_BITS >> 5, dtype=np.uint32)
    words = keys.mapInArrow(run, schema).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    for row in words.toLocalIterator():
        table[row["word"]] = row["mask"]
    return table


def _told(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the table."""
    place = _bucket(keys, _FILTER_BITS)
    return ((table[place >> 5] >> (place & 31).astype(np.uint32)) & 1).astype(bool)


def _among(source: DataFrame, table: np.ndarray) -> DataFrame:
    """The rows of source whose text's key may be in the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in bk.chunks(batches, "text"):
            keys = np.array([_key(chunk.text(r))[1] for r in range(chunk.rows)], dtype=np.int64)
            yield chunk.batch.filter(pa.array(_told(table, keys)))

    return source.mapInArrow(run, source.schema)


def _texts(source: DataFrame, table: np.ndarray, buckets: int) -> DataFrame:
    """One row a task for each text whose key may be in the table, to its bucket."""
    schema, names = _schema(source.schema["id"].dataType), _schema(T.NullType()).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for chunk in bk.chunks(batches, "text"):
            keys = np.array([_key(chunk.text(r))[1] for r in range(chunk.rows)], dtype=np.int64)
            rows = [r for r in np.flatnonzero(_told(table, keys)).tolist() if keys[r] not in seen and not seen.add(keys[r])]
            if rows:
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(_bucket(keys[rows], buckets), pa.int32()), pa.array(np.full(n, _DOCUMENT), pa.int32()), pa.array([keys[r].tobytes() for r in rows], pa.binary()), *[pa.nulls(n, pa.binary())] * 4, chunk.batch.column(0).take(pa.array(rows)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), chunk.batch.column(1).take(pa.array(rows)).cast(pa.string())], names=names)

    return source.mapInArrow(run, schema)


def _beside(notes: DataFrame, texts: DataFrame, parts: int, dtypes: list[str], each: Callable[[bytes, int, list[np.ndarray]], None], flush: Callable[[bool], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """Bring notes, packed by key in column a, beside their texts: each(text, key, notes) for each text once, then flush."""
    kind = F.when(F.col("text").isNull(), 0).otherwise(1)
    both = notes.unionByName(texts).repartition(parts, "bucket").withColumn("later", kind).sortWithinPartitions("bucket", "later").drop("later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        known: list[np.ndarray] | None = None
        done: set[int] = set()
        current = None
        for batch in batches:
            buckets, text = batch.column("bucket").to_numpy(), batch.column("text")
            for i in range(batch.num_rows):
                if buckets[i] != current:
                    held, known, done, current = [], None, set(), buckets[i]
                if not text[i].is_valid:
                    held.append([np.frombuffer(batch.column(n)[i].as_buffer(), dtype=t) for n, t in zip(_BYTES, dtypes, strict=False)])
                    continue
                if known is None:
                    known = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, t) for t in dtypes]
                    order = np.argsort(known[0], kind="stable")
                    known = [x[order] for x in known]
                    held = []
                key = int(np.frombuffer(batch.column("a")[i].as_buffer(), dtype=np.int64)[0])
                low, high = np.searchsorted(known[0], [key, key + 1]) if key < 2**63 - 1 else (np.searchsorted(known[0], key), len(known[0]))
                if high > low and key not in done:
                    done.add(key)
                    each(text[i].as_buffer().to_pybytes(), key, [x[low:high] for x in known[1:]])
                    yield from flush(False)
        yield from flush(True)

    return both.mapInArrow(run, schema)


def _fetched(wanted: DataFrame, texts: DataFrame, parts: int, buckets: int, length: int) -> DataFrame:
    """The wanted pieces' texts by minimizer; of minimizers with too many pieces, windows by hash."""
    schema, names = texts.schema, texts.schema.names
    kinds = _types(_arrow_type(schema["id"].dataType))
    held: list[tuple[int, int, int, int, bytes]] = []
    wide: list[tuple[np.ndarray, int, int, int]] = []
    size = [0]

    def each(text: bytes, key: int, notes: list[np.ndarray]) -> None:
        for place, windows, mini, flag in zip(*(x.tolist() for x in notes), strict=True):
            part = text[place : place + windows - 1 + length]
            if flag & 2:
                batch = pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], names=["text"])
                chunk = bk.Chunk(batch, "text")
                wide.append((chunk.rolling_hash(length), key, place, flag & 1))
            else:
                held.append((mini, key, place, flag & 1, part))
            size[0] += len(part) * (9 if flag & 2 else 1)

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        if not last and size[0] < 8 << 20:
            return
        if held:
            mini = np.array([h[0] for h in held], dtype=_U)
            spot = _bucket(mini, buckets)
            order = np.argsort(spot, kind="stable")
            edges = np.searchsorted(spot[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(edges))
            rows = [[held[i] for i in order[edges[b] : edges[b + 1]]] for b in full]
            info = [np.array([[r[1], r[2], r[3], len(r[4])] for r in group], dtype=np.int64) for group in rows]
            columns = [pa.array([mini[order[edges[b] : edges[b + 1]]].tobytes() for b in full], pa.binary()), pa.array([x.tobytes() for x in info], pa.binary()), pa.array([b"".join(r[4] for r in group) for group in rows], pa.binary())]
            n = len(full)
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(n, _TEXTS), pa.int32()), *columns, *(pa.nulls(n, t) for t in kinds[5:])], names=names)
        if wide:
            hashes = np.concatenate([w[0] for w in wide])
            counts = [len(w[0]) for w in wide]
            key = np.repeat(np.array([w[1] for w in wide], dtype=np.int64), counts)
            place = np.concatenate([w[2] + np.arange(c) for w, c in zip(wide, counts, strict=True)])
            need = np.repeat(np.array([w[3] for w in wide], dtype=np.int32), counts)
            yield _packed(_WINDOWS, _bucket(hashes, buckets), buckets, [hashes, key, place, need], kinds, names)
        held.clear()
        wide.clear()
        size[0] = 0

    return _beside(wanted, texts, parts, ["i8", "i8", "i4", "u8", "i4"], each, flush, schema)


def _ends(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each followed by a zero, and where each starts, with the end."""
    data = np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


def _window_hashes(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of the joined texts, and which lie within one text."""
    whole = bk.Chunk(pa.RecordBatch.from_arrays([pa.array([b"\0".join([*texts, b""])], pa.binary())], names=["text"]), "text")
    grams = whole.rolling_hash(length)
    starts = _ends(texts)[1]
    edge = np.zeros(len(grams) + 1, dtype=np.int64)
    windows = np.array([len(t) - length + 1 for t in texts])
    some = windows > 0
    edge[starts[:-1][some]] += 1
    edge[(starts[:-1] + windows)[some]] -= 1
    return grams, np.cumsum(edge)[:-1] > 0


def agreeing(texts: list[bytes], length: int) -> list[np.ndarray]:
    """By text, the places whose first length bytes agree with those of another place in these texts.

    Hashes of the windows show which stretches can hold such places; only these
    are suffix-sorted, and neighbours compared by their bytes.
    """
    found = [np.zeros(0, np.int64) for _ in texts]
    grams, valid = _window_hashes(texts, length)
    at = np.flatnonzero(valid)
    ordered = np.sort(grams[at])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return found
    place = np.minimum(np.searchsorted(twice, grams[at]), len(twice) - 1)
    at = at[twice[place] == grams[at]]
    starts = _ends(texts)[1]
    owner = np.searchsorted(starts, at, side="right") - 1
    heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    chosen, first, last = owner[heads], at[heads] - starts[owner[heads]], at[np.append(heads[1:] - 1, len(at) - 1)] - starts[owner[heads]]
    parts = [texts[t][a : b + length] for t, a, b in zip(chosen.tolist(), first.tolist(), last.tolist(), strict=True)]
    for t, a, places in zip(chosen.tolist(), first.tolist(), _sorted_alike(parts, length), strict=True):
        found[t] = places + a
    return found


def _sorted_alike(texts: list[bytes], length: int) -> list[np.ndarray]:
    """By text, the places that agree with a neighbour in suffix order in their first length bytes."""
    data, starts = _ends(texts)
    joined = data.astype(np.int64) + 1
    joined[starts[1:] - 1] = 0
    order = suffix_array(joined)
    grams, valid = _window_hashes(texts, length)
    n = len(joined)
    order = order[order < len(grams)]
    order = order[valid[order]]
    head = grams[order]
    near = np.flatnonzero(head[1:] == head[:-1])
    one, other = order[near], order[near + 1]
    # Pairs that follow each other in both texts share most of their bytes: such a run is compared at once.
    along = np.lexsort((one, other - one))
    one, other = one[along], other[along]
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(one) != 1) | (np.diff(other) != 1)])) if len(one) else one
    marked = np.zeros(n, dtype=bool)
    for a, b, m in zip(one[heads].tolist(), other[heads].tolist(), np.diff(np.append(heads, len(one))).tolist(), strict=True):
        apart = data[a : a + m + length - 1] != data[b : b + m + length - 1]
        if not apart.any():
            marked[a : a + m] = marked[b : b + m] = True
        else:
            before = np.concatenate([[0], np.cumsum(apart)])
            same = np.flatnonzero(before[length:] == before[:-length])
            marked[a + same] = marked[b + same] = True
    return [np.flatnonzero(marked[s : e - 1]) for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def _sorted(fetched: DataFrame, parts: int, buckets: int, length: int) -> DataFrame:
    """Step 2: marks of windows that agree with a neighbour in their bucket's suffix order."""
    names, kinds = fetched.schema.names, _types(_arrow_type(fetched.schema["id"].dataType))

    def marks(key: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        """Runs of places of a text as one mark each."""
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1] + 1)]))
        runs = np.diff(np.append(heads, len(key))).astype(np.int32)
        return _packed(_MARKS, _bucket(key[heads], buckets), buckets, [key[heads], place[heads], runs], kinds, names)

    def work(held: dict[int, list[list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        if _TEXTS in held:
            mini = np.concatenate([h[0] for h in held[_TEXTS]])
            info = np.concatenate([h[1].reshape(-1, 4) for h in held[_TEXTS]])
            text = np.concatenate([h[2] for h in held[_TEXTS]])
            ends = np.cumsum(info[:, 3])
            order = np.argsort(mini, kind="stable")
            found_key, found_place = [], []
            batch: list[int] = []
            size = 0

            def finish() -> None:
                parts_ = [text[ends[i] - info[i, 3] : ends[i]].tobytes() for i in batch]
                for i, places in zip(batch, agreeing(parts_, length), strict=True):
                    if info[i, 2] and len(places):
                        found_key.append(np.full(len(places), info[i, 0]))
                        found_place.append(info[i, 1] + places)

            heads = np.flatnonzero(np.concatenate([[True], mini[order][1:] != mini[order][:-1]]))
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
                if b - a < 2:
                    continue
                grown = int(info[order[a:b], 3].sum()) + b - a
                if batch and size + grown > _SORTED_BYTES:
                    finish()
                    batch, size = [], 0
                batch += order[a:b].tolist()
                size += grown
            if batch:
                finish()
            if found_key:
                yield marks(np.concatenate(found_key), np.concatenate(found_place))
        if _WINDOWS in held:
            hashes, key, place, need = (np.concatenate(x) for x in zip(*held[_WINDOWS], strict=True))
            _, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
            chosen = (count[which] > 1) & (need > 0)
            if chosen.any():
                yield marks(key[chosen], place[chosen])

    return _by_bucket(fetched, parts, work, {_TEXTS: ["u8", "i8", "u1"], _WINDOWS: ["u8", "i8", "i8", "i4"]})


def _whole_words(text: bytes, first: int, beyond: int) -> int:
    """Words of a span that do not go on outside it."""
    part = text[first:beyond]
    words = part.split()
    begun = first > 0 and not text[first - 1 : first].isspace() and not part[:1].isspace()
    goes_on = beyond < len(text) and not text[beyond : beyond + 1].isspace() and not part[-1:].isspace()
    return max(0, len(words) - begun - goes_on) if len(words) > 1 else int(not begun and not goes_on and bool(words))


def _cut(marks: DataFrame, texts: DataFrame, parts: int, length: int, least_words: int) -> DataFrame:
    """Step 3: by text with marks: key, removed spans, digest of what is left, and the longest run, removed or not."""
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("beyond", T.LongType())])
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept_sha256", T.StringType()), T.StructField("longest", T.LongType())])
    arrow_span = pa.list_(pa.struct([("first", pa.int64()), ("beyond", pa.int64())]))
    held: list[tuple] = []

    def each(text: bytes, key: int, notes: list[np.ndarray]) -> None:
        place, windows = notes[0], notes[1].astype(np.int64)
        order = np.argsort(place, kind="stable")
        first, beyond = place[order], (place + windows - 1 + length)[order]
        reach = np.maximum.accumulate(beyond)
        heads = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]]))
        a, b = first[heads], reach[np.append(heads[1:] - 1, len(first) - 1)]
        longest = int((b - a).max())
        if least_words:
            enough = np.array([_whole_words(text, x, y) >= least_words for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype=bool)
            a, b = a[enough], b[enough]
        kept, at = hashlib.sha256(), 0
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            kept.update(text[at:x])
            at = y
        kept.update(text[at:])
        held.append((key, int((b - a).sum()), [{"first": int(x), "beyond": int(y)} for x, y in zip(a, b, strict=True)], kept.hexdigest(), longest))

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        if held and (last or len(held) >= 2000):
            columns = list(zip(*held, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], arrow_span), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.int64())], names=schema.names)
            held.clear()

    return _beside(marks, texts, parts, ["i8", "i8", "i4"], each, flush, schema)


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _find(source: DataFrame, length: int, gram: int, least_words: int) -> tuple[DataFrame, DataFrame]:
    """Documents (id, key, digest, n_bytes, n_words), and by key of a text with repeats: n_removed, spans, kept_sha256, longest."""
    parts = width(source.sparkSession)
    buckets = parts * _BUCKETS
    compared = checkpointed(_compared(_dealt(source, length, gram, buckets), parts, buckets))
    wanted = compared.where(F.col("kind") == _WANTED)
    marks = compared.where(F.col("kind") == _MARKS)
    if not wanted.isEmpty():
        fetched = _fetched(wanted, _texts(source, _filter_of(wanted.select("a")), buckets), parts, buckets, length)
        marks = checkpointed(marks.unionByName(_sorted(fetched, parts, buckets, length)))
    key = F.conv(F.substring(F.hex("digest"), 1, 16), 16, -10).cast("long")
    docs = compared.where(F.col("kind") == _DOCUMENT).select("id", key.alias("key"), "digest", "n_bytes", "n_words")
    return docs, _cut(marks, _texts(source, _filter_of(marks.select("a")), buckets), parts, length, least_words)


def _lost(docs: DataFrame, cut: DataFrame, length: int, least_words: int) -> DataFrame:
    """By key of a text that loses something: whole (it has copies), n_removed, spans, kept_sha256."""
    copied = (F.col("n") > 1) & (F.col("n_bytes") >= length) & (F.col("n_words") >= least_words)
    copies = docs.groupBy("key").agg(F.count("*").alias("n"), F.first("n_bytes").alias("n_bytes"), F.first("n_words").alias("n_words")).where(copied).select("key", F.lit(True).alias("whole"))
    both = cut.where(F.col("n_removed") > 0).join(copies, "key", "full_outer")
    return both.select("key", F.coalesce("whole", F.lit(False)).alias("whole"), "n_removed", "spans", "kept_sha256")


_SALTS = 8


def _salted(df: DataFrame, salt: str, *by: str) -> DataFrame:
    """df with a salt by row, from the given columns: a text with very many copies is one key, whose rows are dealt over salts."""
    return df.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(_SALTS)).cast("int"))


def _spread(lost: DataFrame, salt: str) -> DataFrame:
    return lost.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int | None = None, passage: tuple[int, int] | None = None) -> DataFrame:
    """A row for each row of df: id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    With passage, (bytes, words), also n_passage: the text's bytes in repeated
    runs of at least so many bytes and whole words; it must not be longer than
    length.  Texts whose longest such run is shorter than length are then left
    out of the search for strings of length.
    """
    source = _source(df, id_col, text_col)
    if passage:
        short, words = passage
        if short > length:
            raise ValueError("a passage must not be longer than a string")
        docs, runs = _find(source, short, max(1, short // 2), words)
        runs = checkpointed(runs)
        passages = _lost(docs, runs, short, words).select("key", F.col("whole").alias("whole_passage"), F.col("n_removed").alias("n_passage"))
        cut = _find(_among(source, _filter_of(runs.where(F.col("longest") >= length).select("key"))), length, gram or max(1, length // 2), 0)[1]
        lost = _lost(docs, cut, length, 0).join(passages, "key", "full_outer")
    else:
        docs, cut = _find(source, length, gram or max(1, length // 2), 0)
        lost = _lost(docs, cut, length, 0)
    joined = _salted(docs, "salt", "id").join(_spread(lost, "salt"), ["key", "salt"], "left")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("beyond")))
    spans = F.when(F.col("whole"), all_of_it).otherwise(F.col("spans"))
    counted = [F.when(F.col("whole_passage"), F.col("n_bytes")).otherwise(F.coalesce("n_passage", F.lit(0))).cast("long").alias("n_passage")] if passage else []
    return joined.select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.coalesce(F.size(spans), F.lit(0)).cast("long").alias("n_spans"),
        F.when(F.col("whole"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        spans.alias("spans"), *counted,
    )


def remove(df: DataFrame, text_col: str = "text", length: int = 400, gram: int | None = None, least_words: int = 0) -> DataFrame:
    """df with repeated strings cut out of its texts, all columns; a character cut in two goes as a whole."""
    docs, cut = _find(_source(df.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), "id", "text"), length, gram or max(1, length // 2), least_words)
    lost = checkpointed(_lost(docs, cut, length, least_words))
    key_name, note, salt = "key", "lost", "salt"
    while {key_name, note, salt} & set(df.columns):
        key_name, note, salt = key_name + "_", note + "_", salt + "_"
    keyed = df.withColumn(key_name, F.conv(F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256), 1, 16), 16, -10).cast("long"))
    told = _spread(lost.select(F.col("key").alias(key_name), F.struct("whole", "spans").alias(note)), salt)
    joined = _salted(keyed, salt, *(n for n, t in df.dtypes if "map<" not in t and t != "variant")).join(told, [key_name, salt], "left")
    same = joined.where(F.col(note).isNull()).select(*df.columns)
    changed = joined.where(F.col(note).isNotNull()).select(*df.columns, note)
    names, position = df.columns, df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, gone in zip(batch.column(position).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                raw, at, left = (text or "").encode("utf-8"), 0, []
                if not gone["whole"]:
                    for s in gone["spans"]:
                        left.append(raw[at : s["first"]].decode("utf-8", "ignore"))
                        at = s["beyond"]
                    left.append(raw[at:].decode("utf-8", "ignore"))
                texts.append("".join(left))
            columns = batch.columns[:-1]
            columns[position] = pa.array(texts, batch.schema.field(position).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return same.unionByName(changed.mapInArrow(run, df.schema))
