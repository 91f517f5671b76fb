"""Suffix arrays by the difference cover of three, on whole NumPy arrays."""

from __future__ import annotations

import numpy as np

#: Longest string: three names of 21 bits make one 63-bit key.
LONGEST = (1 << 21) - 8


def _rank(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks from 1, and how many."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    rise = np.ones(len(keys), dtype=np.int64)
    rise[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.cumsum(rise)
    return rank, int(rise.sum())


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Places of the suffixes of values, non-negative integers below 2**21 - 1, in order.

    Suffixes at places 1 and 2 modulo 3 are sorted by their first three values;
    if some agree, their names, first those of places 1 and then of places 2,
    are sorted as a shorter string.  The others follow from a value and the
    rank behind it, and the two sorted lists are merged.
    """
    n = len(values)
    if n > LONGEST:
        raise ValueError(f"{n} values; {LONGEST} at most")
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: values[i:].tolist()), dtype=np.int64)
    s = np.zeros(n + 4, dtype=np.int64)
    s[:n] = values
    s[:n] += 1  # zeros stand behind the end
    ones = np.arange(1, n + (n % 3 == 1), 3)  # with a place behind the end where n % 3 is 1, so that its triple ends the first half
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    names, distinct = _rank((s[sample] << 42) | (s[sample + 1] << 21) | s[sample + 2])
    if distinct < len(sample):
        order = suffix_array(names - 1)
        names[order] = np.arange(1, len(sample) + 1)
    else:
        order = np.argsort(names, kind="stable")
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample] = names
    sampled = sample[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    key = (s[rest] << 21) | rank[rest + 1]
    by_key = np.argsort(key, kind="stable")
    rest, key = rest[by_key], key[by_key]
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted((s[first] << 21) | rank[first + 1], key)
    triple = (s[rest] << 42) | (s[rest + 1] << 21) | rank[rest + 2]
    before += np.searchsorted((s[second] << 42) | (s[second + 1] << 21) | rank[second + 2], triple)
    out = np.empty(n, dtype=np.int64)
    place = np.arange(len(rest)) + before
    taken = np.zeros(n, dtype=bool)
    taken[place] = True
    out[place] = rest
    out[~taken] = sampled
    return out
