"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Texts are read straight from Arrow's buffers, a few megabytes at a time, so no
Python string is made for a word, line or n-gram. Hashes of words, lines and
pieces are 64-bit chains of a mixer over blocks of eight bytes, as a tree where
a span is longer than 64 bytes; words of one length up to eight bytes never
share one. Rolling hashes of all grams of one length are a polynomial over
random byte values modulo 2**64, good enough to choose and to deal by: it has
structured collisions between long strings, so nothing is taken for equal
by it that could be a thousand bytes long.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 4096

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
_BLOCK, _SEGMENT = 8, 64
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(_BLOCK + 1)], dtype=_U)
#: A-Z as a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None


#: Value of each byte in rolling hashes.
_VALUES = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A boolean table of 256 entries, true in the given closed ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words [^\x20\x09-\x0D]+, and words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased.
SPACED_WORD = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM_WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first n powers and the inverses of them, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = (n + (1 << 18) - 1) >> 18 << 18
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            out = np.ones(size, dtype=_U)
            done = 1
            while done < size:
                more = min(done, size - done)
                np.multiply(out[:more], _U(pow(base, done, 1 << 64)), out=out[done : done + more])
                done += more
            _powers[name] = out
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish hashes so that all bits depend on all bits."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start to its end; equal bytes have equal hashes wherever they stand."""
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, dtype=_U)
    padded = np.concatenate([data, np.zeros(_BLOCK, np.uint8)])
    blocks = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    long = np.flatnonzero(sizes > _SEGMENT)
    out = _chained(blocks, starts, np.minimum(sizes, _SEGMENT))
    if len(long):
        count = -(-sizes[long] // _SEGMENT)
        first = np.concatenate([[0], np.cumsum(count)])
        owner = np.repeat(long, count)
        at = starts[owner] + _SEGMENT * (np.arange(first[-1]) - np.repeat(first[:-1], count))
        segments = _chained(blocks, at, np.minimum(ends[owner] - at, _SEGMENT))
        nested = hash_spans(segments.astype("<u8").view(np.uint8), _BLOCK * first[:-1], _BLOCK * first[1:])
        out[long] = mix(nested ^ (sizes[long].astype(_U) * _U(0x9E6C63D0876A9A47)))
    return out


def _chained(blocks: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of spans of at most a segment, block after block."""
    out = sizes.astype(_U) * _U(0xA0761D6478BD642F) + _U(0xE7037ED1A0B428DB)
    done = 0
    live = np.arange(len(sizes))
    while len(live):
        value = blocks[starts[live] + done] & _LOWEST[np.minimum(sizes[live] - done, _BLOCK)]
        out[live] = mix(out[live] ^ (value * _U(0x8EBC6AF09C88C6E3)))
        done += _BLOCK
        live = live[sizes[live] > done]
    return out


class Chunk:
    """Some rows of a batch: the bytes of their texts, end to end."""

    def __init__(self, batch: pa.RecordBatch, column: str):
        self.batch = batch
        array = batch.column(batch.schema.get_field_index(column))
        wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
        n = len(array)
        _, offsets, values = array.buffers()
        self.rows = n
        if n == 0 or offsets is None:
            raw = np.zeros(n + 1, dtype=np.int64)
        else:
            kind = np.int64 if wide else np.int32
            raw = np.frombuffer(offsets, dtype=kind, count=array.offset + n + 1)[array.offset :].astype(np.int64)
        data = np.zeros(0, np.uint8) if values is None else np.frombuffer(values, dtype=np.uint8)
        self.null = np.zeros(n, dtype=bool) if array.null_count == 0 else np.asarray(array.is_null(), dtype=bool)
        self.data = data[raw[0] : raw[-1]]
        self.offsets = raw - raw[0]
        if self.null.any() and (np.diff(self.offsets)[self.null] > 0).any():  # bytes under a null
            return self._compact()

    def _compact(self) -> None:
        lengths = np.diff(self.offsets)
        keep = np.repeat(~self.null, lengths)
        self.data = self.data[keep]
        self.offsets = np.concatenate([[0], np.cumsum(np.where(self.null, 0, lengths))])

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()

    def rolling_hash(self, gram: int) -> np.ndarray:
        """Hashes of the gram bytes from each place; shorter by gram - 1 than the bytes."""
        n = len(self.data)
        total = np.zeros(n + 1, dtype=_U)
        np.cumsum(_VALUES[self.data] * powers(n)[0], out=total[1:])
        return mix((total[gram:] - total[:-gram]) * powers(n + 1)[1][: max(0, n - gram + 1)])

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and, by row, first indexes of maximal runs of bytes in a class; runs stay within a row."""
        n = len(self.data)
        first = np.zeros(self.rows + 1, dtype=np.int64)
        if n == 0:
            return first[:0], first[:0], first
        is_in = inside[self.data]
        before = np.empty(n, dtype=bool)
        before[0] = False
        before[1:] = is_in[:-1]
        heads = self.offsets[:-1]
        before[heads[heads < n]] = False
        starts = np.flatnonzero(is_in & ~before)
        after = np.empty(n, dtype=bool)
        after[-1] = False
        after[:-1] = is_in[1:]
        tails = self.offsets[1:]
        after[tails[tails > 0] - 1] = False
        ends = np.flatnonzero(is_in & ~after) + 1
        first = np.searchsorted(starts, self.offsets)
        return starts, ends, first

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, folded: bool = False) -> np.ndarray:
        """Hashes of spans of the bytes; folded, A-Z count as a-z."""
        return hash_spans(LOWER[self.data] if folded else self.data, starts, ends)


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive values from each place; shorter by n - 1 than words."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, dtype=_U)
    for j in range(n):
        out = out * _U(0xD6E8FEB86659FD93) + words[j : j + count]
    return mix(out + _U(n))


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each run, from the first indexes by row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sum_by(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values by row, given the first indexes by row."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES, most_rows: int = CHUNK_ROWS) -> Iterator[Chunk]:
    """Cut batches into chunks of at most so many rows and bytes of text, at least one row each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = Chunk(batch, column).offsets[1:]
        row = 0
        while row < batch.num_rows:
            base = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, base + limit, side="right")))
            stop = min(stop, row + most_rows)
            yield Chunk(batch.slice(row, stop - row), column)
            row = stop
    trim()


def trim() -> None:
    """Give memory that is free back to the system: a worker lives on for other tasks."""
    if _LIBC is not None:
        _LIBC.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def duplicates(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (row, value) pairs in order of place: which occur twice or more in their row, and which occurred before."""
    n = len(value)
    twice, again = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if n:
        key = mix(value ^ (row.astype(_U) * _U(0xA24BAED4963EE407)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again[order[1:][same]] = True
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    return twice, again
