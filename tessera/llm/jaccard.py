"""N-gram Jaccard join by PartEnum signatures (operator 10).

A document's set is its distinct word shingles; equal sets are one node.  Sets
of sizes a and b that are similar enough differ in few shingles: with s the
similarity, in (a + b)(1 - s)/(1 + s) at most.  Sizes are cut into bands, a
band's domain is divided by hash into partitions, and a set signs each of its
first d + 1 partitions that hold something of it, d being the most shingles it
can differ in from a set of the band.  Two such sets agree in one signature at
least, since each shingle they differ in spoils one partition.  (This is the
enumeration with second-level subsets of size one; of all exact forms it has
the fewest signatures.  In bands of small sets there are 2**40 partitions,
one for each shingle.  Should a set ever fill too few partitions, its band is done again
that way, so that no case is lost.)

Signatures travel as packed arrays, by hash bucket.  Sets that meet in a
signature are compared by parity bitmaps, a lower bound of their difference,
inside their group; what passes is verified by the sets themselves.  A group
offers a spanning tree and nearest neighbours, never all its pairs; where
verification refuses an offer, the group offers others in the next round, until
none is left.  So components are exact, though copies are not expanded into all
pairs.  Groups of very many nodes are dealt over blocks, pairs of which are
compared in separate tasks.

Defined results: a text of fewer words than a shingle has one shingle, all its
words; a null text or one without words has none, links with nothing and is its
own component; repeated rows share a node; a null id takes part but is never a
component's name unless all its ids are null; ties go to the least id; an empty
table gives an empty one; a text of any length has all its shingles; columns
other than id and text are never read, and pass through ``keep_one`` whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytekit as bk
from tessera.llm.components import components
from tessera.llm.runtime import checkpointed, ship, width

_U = np.uint64
#: Bands below this one, sets of fewer than 32 shingles, have a partition for each shingle.
_FINE_BELOW = 5
#: Signatures a task gathers before it sends them on; buckets per shuffle partition; nodes of a block.
_FLUSH, _BUCKETS, BLOCK = 1_000_000, 4, 2048


class ShingleSets:
    """The sets of a chunk's rows: values of 52 bits grouped by row, ascending in each."""

    def __init__(self, chunk: bk.Chunk, shingle: int):
        starts, ends, first = chunk.runs(bk.SPACED_WORD)
        words = chunk.span_hash(starts, ends, folded=True)
        count, row = np.diff(first), bk.row_of(first)
        grams = bk.ngram_hash(words, shingle)
        at = np.flatnonzero(row[: len(grams)] == row[shingle - 1 :]) if len(grams) else np.zeros(0, np.int64)
        values, rows = [grams[at]], [row[at]]
        for n in range(1, shingle):
            short = np.flatnonzero(count == n)
            if len(short):
                joined = np.zeros(len(short), dtype=_U)
                for j in range(n):
                    joined = joined * _U(0xD6E8FEB86659FD93) + words[first[short] + j]
                values.append(bk.mix(joined + _U(n)))
                rows.append(short)
        # Sorted as one number, the row above 52 bits of the hash.
        both = np.concatenate(values) >> _U(12) | np.concatenate(rows).astype(_U) << _U(52)
        both.sort()
        new = np.ones(len(both), dtype=bool)
        new[1:] = both[1:] != both[:-1]
        both = both[new]
        self.value, self.row = both & _U((1 << 52) - 1), (both >> _U(52)).astype(np.int64)
        self.first = np.searchsorted(self.row, np.arange(chunk.rows + 1))
        self.size = np.diff(self.first)
        total = np.concatenate([np.zeros(1, _U), np.cumsum(bk.mix(self.value ^ _U(0x5851F42D4C957F2D)))])
        self.key = bk.mix(total[self.first[1:]] - total[self.first[:-1]] + self.size.astype(_U)).view(np.int64)


def octave(size: np.ndarray) -> np.ndarray:
    """The band of a size: sizes 2**i to 2**(i+1) - 1."""
    return np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1


def _differ(total: np.ndarray, percent: int) -> np.ndarray:
    """The most elements that sets of so many elements in all can differ in: (a + b)(100 - p)/(100 + p)."""
    return total * (100 - percent) // (100 + percent)


def signatures(sets: ShingleSets, rows: np.ndarray, percent: int, fine: frozenset[int]) -> tuple[np.ndarray, np.ndarray, set[int]]:
    """Signatures of the given rows with their rows, and bands in which a row fills too few partitions."""
    out, owner, short = [], [], set()
    chosen = np.zeros(len(sets.size), dtype=bool)
    chosen[rows] = sets.size[rows] > 0
    live = chosen[sets.row]
    value, row = sets.value[live], sets.row[live]
    own = octave(sets.size)
    for up in (0, 1):
        band = own + up
        top = (2 << band.astype(np.int64)) - 1
        reach = sets.size * 100 // percent  # the largest set that can be similar
        takes = chosen if up == 0 else chosen & (reach > (2 << own.astype(np.int64)) - 1)
        need = _differ(sets.size + np.minimum(reach, top), percent) + 1
        most = _differ(2 * top, percent) + 1
        parts = (most * 112 + 99) // 100 + 6
        here = takes[row]
        v, r = value[here], row[here]
        if not len(v):
            continue
        single = np.isin(band, list(fine)) | (band < _FINE_BELOW)
        spot = bk.mix(v ^ _U(0x2545F4914F6CDD1D) + band[r].astype(_U))
        part = np.where(single[r], spot >> _U(24), spot % parts[r].astype(_U)).astype(np.int64)
        order = np.argsort(r << 40 | part)
        v, r, part = v[order], r[order], part[order]
        heads = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (part[1:] != part[:-1])]))
        held = np.add.reduceat(bk.mix(v ^ _U(0x9FB21C651E98DF25)), heads)
        r, part = r[heads], part[heads]
        begin = np.searchsorted(r, np.arange(len(sets.size) + 1))
        rank = np.arange(len(r)) - begin[r]
        keep = rank < need[r]
        lacking = takes & (np.diff(begin) < need) & ~single
        short |= set(band[lacking].tolist())
        out.append(bk.mix(held + bk.mix(part.astype(_U) * _U(64) + band[r].astype(_U)))[keep])
        owner.append(r[keep])
    if not out:
        return np.zeros(0, _U), np.zeros(0, np.int64), short
    return np.concatenate(out), np.concatenate(owner), short


def bitmaps(sets: ShingleSets) -> list[bytes | None]:
    """By row: for each of 4 << band bits (at least 64), whether it is hit an odd number of times."""
    out: list[bytes | None] = []
    bits = np.maximum(64, 4 << octave(sets.size).astype(np.int64))
    spot = bk.mix(sets.value ^ _U(0xD1B54A32D192ED03))
    for r in range(len(sets.size)):
        if sets.size[r] == 0:
            out.append(None)
            continue
        hits = np.bincount((spot[sets.first[r] : sets.first[r + 1]] & _U(bits[r] - 1)).astype(np.int64), minlength=bits[r])
        out.append(np.packbits((hits & 1).astype(np.uint8), bitorder="little").tobytes())
    return out


def _nodes_and_signatures(df: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, buckets: int, fine: frozenset[int]) -> DataFrame:
    """Rows of two kinds: a document's (id, key, size, bitmap), and a bucket's packed signatures with their keys."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType(
        [T.StructField("bucket", T.IntegerType()), T.StructField("id", source.schema["id"].dataType), T.StructField("key", T.LongType()), T.StructField("size", T.LongType())]
        + [T.StructField(n, T.BinaryType()) for n in ("bitmap", "sigs", "keys")] + [T.StructField("short", T.ArrayType(T.IntegerType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, seen, told = [], 0, set(), 0

        def flush() -> pa.RecordBatch:
            sig, key = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            bucket = (sig >> _U(33)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            sig, key, edges = sig[order], key[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(edges))
            cut = lambda x: pa.array([x[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary())
            n = len(full)
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), cut(sig), cut(key), pa.nulls(n, pa.list_(pa.int32()))], names=schema.names)

        id_type = None
        for chunk in bk.chunks(batches, "text"):
            id_type = chunk.batch.schema.field(0).type
            sets = ShingleSets(chunk, shingle)
            fresh = []
            for r, k in enumerate(sets.key.tolist()):
                if sets.size[r] and k not in seen:  # copies in one task sign once
                    seen.add(k)
                    fresh.append(r)
            sig, owner, short = signatures(sets, np.array(fresh, dtype=np.int64), percent, fine)
            held.append((sig, sets.key[owner]))
            count += len(sig)
            none = sets.size == 0
            n = chunk.rows
            spread = (told + np.arange(n)) % buckets  # documents only pass through: copies need not meet
            told += n
            yield pa.RecordBatch.from_arrays([pa.array(spread, pa.int32()), chunk.batch.column(0), pa.array(sets.key, pa.int64(), mask=none), pa.array(sets.size, pa.int64()), pa.array(bitmaps(sets), pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array([sorted(short)] + [None] * (n - 1), pa.list_(pa.int32()))], names=schema.names)
            if count >= _FLUSH:
                yield flush()
                held, count, seen = [], 0, set()
        if count:
            yield flush()

    return source.mapInArrow(run, schema)


def _met(signed: DataFrame, parts: int) -> DataFrame:
    """Documents' rows as they are, and for signatures of two nodes or more, rows (group, node)."""
    schema = T.StructType([T.StructField("group", T.LongType()), *(f for f in signed.schema if f.name in ("id", "key", "size", "bitmap", "short"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        current, id_type = None, None

        def groups() -> Iterator[pa.RecordBatch]:
            sig, key = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            order = np.lexsort((key, sig))
            sig, key = sig[order], key[order]
            new = np.ones(len(sig), dtype=bool)
            new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
            sig, key = sig[new], key[new]
            heads = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            members = np.diff(np.append(heads, len(sig)))
            # Groups with the same nodes are one.
            name = bk.mix(np.add.reduceat(bk.mix(key.view(_U)), heads) + members.astype(_U))
            _, once = np.unique(name, return_index=True)
            chosen = np.zeros(len(heads), dtype=bool)
            chosen[once] = True
            rows = np.repeat(chosen & (members > 1), members)
            n = int(rows.sum())
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, members)[rows].view(np.int64)), pa.nulls(n, id_type), pa.array(key[rows]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int32()))], names=schema.names)

        for batch in batches:
            id_type = batch.schema.field("id").type
            packed = batch.column("sigs")
            plain = batch.filter(packed.is_null())
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays([pa.nulls(plain.num_rows, pa.int64()), *(plain.column(n) for n in schema.names[1:])], names=schema.names)
            for i in np.flatnonzero(~np.asarray(packed.is_null())):
                bucket = batch.column("bucket")[int(i)].as_py()
                if bucket != current and held:
                    yield from groups()
                    held = []
                current = bucket
                held.append((np.frombuffer(packed[int(i)].as_buffer(), dtype=_U), np.frombuffer(batch.column("keys")[int(i)].as_buffer(), dtype=np.int64)))
        if held:
            yield from groups()

    return signed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps brought to the shortest length; folding keeps the parities."""
    shortest = min(map(len, maps))
    out = np.zeros((len(maps), shortest), dtype=np.uint8)
    for i, m in enumerate(maps):
        wide = np.frombuffer(m, dtype=np.uint8)
        out[i] = np.bitwise_xor.reduce(wide.reshape(-1, shortest), axis=0)
    return out.view(_U)


def _apart(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps, brought to one length, are apart."""
    if len(x) != len(y):
        short, long = sorted((x, y), key=len)
        x, y = short, np.bitwise_xor.reduce(np.frombuffer(long, np.uint8).reshape(-1, len(short)), axis=0).tobytes()
    return (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()


def offers(keys: np.ndarray, sizes: np.ndarray, maps: list[bytes], yes: list[set[int]], no: list[set[int]], percent: int, nearest: int = 1) -> tuple[list[tuple[int, int]], list[int]]:
    """Pairs of a group worth verifying, and the nodes that are in any pair that may link.

    The pairs are a spanning forest of what may link and is not linked yet, and
    for each node in it some nearest ones.  yes and no hold, by node, the keys
    already verified.  No pair means that what may link is linked already.
    """
    n = len(keys)
    if n == 2:
        total = int(sizes.sum())
        low, high = sorted(sizes.tolist())
        may = low * 100 >= percent * high and _apart(*maps) <= _differ(total, percent) and int(keys[1]) not in yes[0] | no[0]
        return ([(int(keys.min()), int(keys.max()))], keys.tolist()) if may else ([], [])
    bits = _folded(maps)
    may = np.zeros((n, n), dtype=bool)
    close = np.zeros((n, n), dtype=np.float32)
    for i in range(n - 1):
        apart = np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(axis=1, dtype=np.int64)
        total = sizes[i + 1 :] + sizes[i]
        may[i, i + 1 :] = (apart <= _differ(total, percent)) & (np.minimum(sizes[i + 1 :], sizes[i]) * 100 >= percent * np.maximum(sizes[i + 1 :], sizes[i]))
        close[i, i + 1 :] = apart / total
    may |= may.T
    active = np.flatnonzero(may.any(axis=1))
    if not len(active):
        return [], []
    # Only nodes that may link at all go on.
    keys, n = keys[active], len(active)
    yes, no = [yes[i] for i in active], [no[i] for i in active]
    may, close = may[np.ix_(active, active)], close[np.ix_(active, active)]
    close += close.T
    label = np.arange(n)
    if any(yes) or any(no):
        place = {int(k): i for i, k in enumerate(keys)}
        known = np.zeros((n, n), dtype=bool)
        for i in range(n):
            known[i, [place[k] for k in yes[i] if k in place]] = True
            may[i, [place[k] for k in no[i] if k in place]] = False
        known |= known.T
        for i in range(n):
            if label[i] == i and known[i].any():
                reached, frontier = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
                frontier[i] = True
                while frontier.any():
                    reached |= frontier
                    frontier = known[frontier].any(axis=0) & ~reached
                label[reached] = i
        may &= label[:, None] != label[None, :]
    found: set[tuple[int, int]] = set()
    free = np.ones(n, dtype=bool)
    for start in np.argsort(-may.sum(axis=1), kind="stable"):
        if not free[start]:
            continue
        level = np.flatnonzero(label == label[start])
        free[level] = False
        while len(level):
            hit = np.flatnonzero(may[level].any(axis=0) & free)
            grown = []
            for child in hit.tolist():
                if free[child]:
                    above = level[may[level, child]]
                    found.add((int(above[np.argmin(close[above, child])]), child))
                    same = np.flatnonzero(label == label[child])
                    free[same] = False
                    grown.append(same)
            level = np.concatenate(grown) if grown else np.zeros(0, np.int64)
    if n > 2:
        for i in np.flatnonzero(may.any(axis=1)).tolist():
            near = np.flatnonzero(may[i])
            found |= {(i, int(j)) for j in near[np.argsort(close[i, near], kind="stable")[:nearest]]}
    return [(int(min(keys[i], keys[j])), int(max(keys[i], keys[j]))) for i, j in found], keys.tolist()


def _offered(members: DataFrame, percent: int, parts: int, nearest: int) -> DataFrame:
    """Distinct offers (a, b) of all groups, and rows (a, null) of nodes that may link; members: group, key, size, bitmap, yes, no."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        seen: set[tuple[int, int]] = set()
        active: set[int] = set()

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            group = table["group"].to_numpy()
            keys, sizes = table["key"].to_numpy(), table["size"].to_numpy()
            maps, yes, no = (table[n].to_pylist() for n in ("bitmap", "yes", "no"))
            heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            pairs, nodes = [], []
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(group)], strict=True):
                if b - a < 2:
                    continue
                told = [set(yes[i] or ()) for i in range(a, b)], [set(no[i] or ()) for i in range(a, b)]
                new, linkable = offers(keys[a:b], sizes[a:b], maps[a:b], *told, percent, nearest)
                pairs += [p for p in new if p not in seen and not seen.add(p)]
                nodes += [k for k in linkable if k not in active and not active.add(k)]
            if len(seen) + len(active) > _FLUSH:
                seen.clear()
                active.clear()
            if nodes or pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs] + nodes, pa.int64()), pa.array([p[1] for p in pairs] + [None] * len(nodes), pa.int64())], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            group = table["group"].to_numpy()
            last = int(np.searchsorted(group, group[-1]))  # sorted: the last group may go on
            if last:
                yield from work(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None and rest.num_rows:
            yield from work(rest)

    return members.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(run, schema).distinct()


def _sets_of(df: DataFrame, text_col: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """The shingles, packed, of the wanted keys.  A bit table of the keys, of a fixed size, spares most texts' rows."""
    bits = 1 << 24
    places = wanted.select(F.pmod(F.shiftright("key", 20), F.lit(bits)).cast("int").alias("place"))
    words = places.groupBy(F.shiftright("place", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1, place & 31)")).alias("mask"))
    table = np.zeros(bits >> 5, dtype=np.uint32)
    for row in words.toLocalIterator():
        table[row["word"]] = row["mask"] & 0xFFFFFFFF
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for chunk in bk.chunks(batches, "text"):
            sets = ShingleSets(chunk, shingle)
            place = (sets.key >> 20) % bits
            may = (table[place >> 5] >> (place & 31).astype(np.uint32)) & 1
            rows = [r for r in np.flatnonzero((may == 1) & (sets.size > 0)).tolist() if sets.key[r] not in seen and not seen.add(sets.key[r])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(sets.key[rows], pa.int64()), pa.array([sets.value[sets.first[r] : sets.first[r + 1]].tobytes() for r in rows], pa.binary())], names=schema.names)

    found = df.select(F.col(text_col).alias("text")).mapInArrow(run, schema)
    return found.join(wanted, "key", "left_semi").dropDuplicates(["key"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs with linked, by the sets themselves."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("linked", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=_U) for c in ("x", "y"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=schema.names)

    x, y = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, schema)


def _blocked(groups: DataFrame) -> DataFrame:
    """Groups beyond a block's nodes, as pairs of blocks; the others as they are."""
    counted = groups.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    marked = groups.join(counted, "group", "left")
    small = marked.where("n is null").select("group", "key")
    blocks = F.ceil(F.col("n") / (BLOCK // 2)).cast("int")
    large = marked.where("n is not null").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return small.union(dealt.select(F.xxhash64("group", F.least("mine", "other"), F.greatest("mine", "other")).alias("group"), "key"))


def links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Documents (id, key, size) and verified links (a, b) between keys, enough of them to join all that are connected."""
    spark = df.sparkSession
    ship(spark)
    parts = width(spark)
    fine: frozenset[int] = frozenset()
    while True:
        met = checkpointed(_met(_nodes_and_signatures(df, id_col, text_col, shingle, percent, parts * _BUCKETS, fine), parts))
        lacking = {r["band"] for r in met.where("short is not null").select(F.explode("short").alias("band")).distinct().collect()} - set(fine)
        if not lacking:
            break
        fine |= lacking
    docs = met.where("group is null").select("id", "key", "size", "bitmap")
    groups = checkpointed(_blocked(met.where("group is not null").select("group", "key").distinct()))
    met_keys = groups.select("key").distinct()
    nodes = checkpointed(docs.join(met_keys, "key", "left_semi").groupBy("key").agg(F.first("size").alias("size"), F.first("bitmap").alias("bitmap")))
    none = F.lit(None).cast("array<bigint>")
    first = checkpointed(_offered(groups.join(nodes, "key").withColumn("yes", none).withColumn("no", none), percent, parts, 1))
    pairs = first.where("b is not null")
    sets = checkpointed(_sets_of(df, text_col, shingle, first.where("b is null").select(F.col("a").alias("key"))))
    checked = checkpointed(_verified(pairs, sets, percent))
    tested, nearest = checked, 1
    while not (refused := checked.where("not linked")).isEmpty():
        # Only groups that hold a refused pair have something left to offer; they offer more each time.
        nearest = min(64, nearest * 4)
        at_a = refused.join(groups.select("group", F.col("key").alias("a")), "a")
        again = at_a.select("group", F.col("b").alias("key")).join(groups, ["group", "key"]).select("group").distinct()
        open_groups = groups.join(again, "group", "left_semi")
        told = tested.select(F.col("a").alias("key"), F.col("b").alias("with"), "linked").union(tested.select(F.col("b").alias("key"), F.col("a").alias("with"), "linked"))
        by_node = told.groupBy("key").agg(F.collect_list(F.when(F.col("linked"), F.col("with"))).alias("yes"), F.collect_list(F.when(~F.col("linked"), F.col("with"))).alias("no"))
        now = open_groups.join(nodes.join(by_node, "key", "left"), "key")
        pairs = checkpointed(_offered(now.select("group", "key", "size", "bitmap", "yes", "no"), percent, parts, nearest)).where("b is not null")
        if pairs.isEmpty():
            break
        checked = checkpointed(_verified(pairs, sets, percent))
        tested = checkpointed(tested.union(checked))
    return docs.select("id", "key", "size"), tested.where("linked").select("a", "b")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of df: id, n_shingles, component_id (the least id that links reach)."""
    docs, found = links(df, id_col, text_col, shingle, percent)
    least = docs.where("key is not null").groupBy("key").agg(F.min("id").alias("least"))
    joined = components(found).select(F.col("node").alias("key"), "component") if not found.isEmpty() else None
    if joined is None:
        by_key = least
    else:
        placed = least.join(joined, "key", "left").withColumn("component", F.coalesce("component", "key"))
        named = placed.groupBy("component").agg(F.min("least").alias("least"))
        by_key = placed.drop("least").join(named, "component").select("key", "least")
    out = docs.join(by_key, "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of df of each component, that with the least id; all columns.

    Null ids come after all others; ties of one id are settled by digests of the
    text and of the row, so a repeated row stays once.  Rows without shingles
    link with nothing and all stay.
    """
    mark, size, place = "mark", "n_shingles", "place"
    while {mark, size, place} & set(df.columns):
        mark, size, place = mark + "_", size + "_", place + "_"
    text = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    marked = df.withColumn(mark, F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), text.alias("digest")))
    found = join(marked.select(mark, text_col), mark, text_col, shingle, percent)
    first = found.where(F.col(mark) == F.col("component_id")).groupBy(mark).agg(F.first("n_shingles").alias(size))
    rest = F.xxhash64(*(c for c in df.columns if not dict(df.dtypes)[c].startswith("map")))
    ranked = marked.join(first, mark).withColumn(place, F.row_number().over(Window.partitionBy(mark).orderBy(rest)))
    return ranked.where((F.col(place) == 1) | (F.col(size) == 0)).select(*df.columns)
