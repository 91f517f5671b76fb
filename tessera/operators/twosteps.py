"""Pairs of vertices two edges apart, counted in the tasks; sent there as code."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import shipping

shipping.by_value(__name__)


def dealt(ids: np.ndarray, blocks: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks


def packed(src: np.ndarray, dst: np.ndarray) -> bytes:
    """Edges in their order, as differences by planes of bytes."""
    order = np.lexsort((dst, src))
    both = np.stack([np.diff(src[order], prepend=0), np.diff(dst[order], prepend=0)])
    return zlib.compress(np.ascontiguousarray(both.reshape(-1).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    """(src, dst) as two rows."""
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).reshape(2, -1), axis=1)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of count[0] numbers, then the same of the next."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


def pairs_of(left: np.ndarray, right: np.ndarray, most: int):
    """(src, dst, paths, direct) as arrays, a batch of sources at a time: left has all edges of some sources, right all edges to some targets.

    A batch has at most about so many paths; a source of more is counted over all targets, some of its edges at a time.
    """
    src, via = left[:, np.argsort(left[0], kind="stable")]  # runs in order are merged
    del left  # a task's memory is tight
    right = right[:, np.argsort(right[0], kind="stable")]
    targets, to = np.unique(right[1], return_inverse=True)
    hubs, first = np.unique(right[0], return_index=True)
    degree = np.diff(np.append(first, right.shape[1]))
    to, right = to.astype(np.int32), None

    def row(ids):  # where the edges of vertices begin, and how many they are
        at = np.minimum(np.searchsorted(hubs, ids), len(hubs) - 1)
        return first[at], np.where(hubs[at] == ids, degree[at], 0)

    if not len(hubs) or not len(src):
        return
    begin, count = row(via)
    sources, at = np.unique(src, return_index=True)
    at = np.append(at, len(src))
    own_begin, own_count = row(sources)
    upto = np.concatenate([[0], np.cumsum(count)])[at]  # paths before each source
    low = 0
    while low < len(sources):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + most, "right")) - 1)
        mine = slice(at[low], at[high])
        if high == low + 1 and upto[high] - upto[low] > most:
            total = np.zeros(len(targets), np.int64)
            pieces = np.append(np.flatnonzero(np.diff(np.cumsum(count[mine]) // most, prepend=-1)), at[high] - at[low])
            for a, b in zip(pieces[:-1], pieces[1:], strict=True):
                total += np.bincount(to[_spread(begin[mine][a:b], count[mine][a:b])], minlength=len(targets))
            keys = np.flatnonzero(total)
            paths = total[keys]
        else:
            local = np.repeat(np.arange(high - low), np.diff(at[low : high + 1]))
            keys = np.repeat(local * len(targets), count[mine]) + to[_spread(begin[mine], count[mine])]
            keys.sort()
            ends = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) if len(keys) else np.zeros(0, np.int64)
            keys, paths = keys[ends], np.diff(ends, prepend=-1)
        near = np.unique(np.repeat(np.arange(high - low) * len(targets), own_count[low:high]) + to[_spread(own_begin[low:high], own_count[low:high])])
        where = np.searchsorted(keys, near)
        there = np.zeros(len(near), bool)
        inside = where < len(keys)
        there[inside] = keys[where[inside]] == near[inside]
        direct = np.zeros(len(keys), bool)
        direct[where[there]] = True
        keys = np.concatenate([keys, near[~there]])
        paths, direct = np.concatenate([paths, np.zeros(len(keys) - len(paths), np.int64)]), np.concatenate([direct, np.ones(len(keys) - len(direct), bool)])
        a, b = sources[low + keys // len(targets)], targets[keys % len(targets)]
        apart = a != b
        yield a[apart], b[apart], paths[apart], direct[apart]
        low = high


def two_step_pairs(lists: DataFrame, edges: int = 4_000_000, paths: int = 1_000_000) -> DataFrame:
    """(src, dst, paths, direct) of different vertices one or two edges apart: the number of paths of two edges, and whether an edge joins them.

    lists: a checkpoint of (src, to) with each vertex's neighbours, ids whole
    numbers.  A task has the edges of a block of sources and all edges to a block
    of targets, so that no path is shuffled: only packed edges are, once for each
    block of the other side.  A side's block holds about so many edges.
    """
    import pyarrow as pa

    total = lists.agg(F.sum(F.size("to"))).first()[0] or 0
    kind = dict(lists.dtypes)["src"]
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_to = max(1, -(-total // edges))
    n_from = max(1, -(-total // edges), -(-min(parts, 12) // n_to))

    def pack(batches):
        held, size = [], 0

        def rows():
            src, dst = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            out = []
            for side, key, blocks in ((0, src, n_from), (1, dst, n_to)):
                block = dealt(key, blocks)
                for i in np.unique(block):
                    here = block == i
                    data = packed(src[here], dst[here])
                    others = range(n_to) if side == 0 else range(n_from)
                    out += [(int(i * n_to + o if side == 0 else o * n_to + i), side, data) for o in others]
            return [pa.RecordBatch.from_arrays([pa.array([r[0]], pa.int32()), pa.array([r[1]], pa.int32()), pa.array([r[2]], pa.binary())], names=["task", "side", "data"]) for r in out]

        for batch in batches:
            to = batch.column(1)
            held.append((np.repeat(batch.column(0).to_numpy().astype(np.int64), to.value_lengths().to_numpy()), to.flatten().to_numpy().astype(np.int64)))
            size += len(held[-1][0])
            if size >= 1_000_000:
                yield from rows()
                held, size = [], 0
        if size:
            yield from rows()

    def count(batches):
        sides: tuple[list, list] = ([], [])
        for batch in batches:
            for side, data in zip(batch.column("side").to_pylist(), batch.column("data").to_pylist(), strict=True):
                sides[side].append(unpacked(data))
        if not sides[0] or not sides[1]:
            return
        left, right = (np.concatenate(s, axis=1) for s in sides)
        sides[0].clear()
        sides[1].clear()
        whole = pa.int64() if kind == "bigint" else pa.int32()
        pairs = pairs_of(left, right, paths)
        del left, right
        for found in pairs:
            for at in range(0, len(found[0]), 100_000):
                a, b, n, direct = (f[at : at + 100_000] for f in found)
                yield pa.RecordBatch.from_arrays([pa.array(a).cast(whole), pa.array(b).cast(whole), pa.array(n), pa.array(direct)], names=["src", "dst", "paths", "direct"])

    rows = lists.mapInArrow(pack, "task int, side int, data binary")
    return rows.repartitionById(n_from * n_to, F.col("task")).mapInArrow(count, f"src {kind}, dst {kind}, paths long, direct boolean")
