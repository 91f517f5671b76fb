"""The nearest sparse rows of a block of queries, of candidates that pass by; sent to tasks as code."""

from __future__ import annotations

import numpy as np

from tessera.plans import shipping

shipping.by_value(__name__)


class Nearest:
    """The k best candidates of each query by weighted cosine, then id; candidates must come in order of id.

    A query's numbers have weights; candidates have numbers only, since the
    weight is the number's.  Kept are the k best and those that came after the
    last settling, in a bounded number of rows.
    """

    def __init__(self, ids, norms, numbers, weights, k: int, places: int, tile: int = 1024, columns: int = 1024, most: int = 3_000_000):
        self.ids, self.k, self.places, self.tile, self.most = ids, k, places, tile, most
        values = np.asarray(numbers.flatten())
        self.known, at = np.unique(values, return_inverse=True)
        row = np.repeat(np.arange(len(ids)), np.asarray(numbers.value_lengths()))
        share = np.asarray(weights.flatten()) ** 2 / norms[row]
        self.parts = []  # by so many of the queries' numbers, a matrix
        for first in range(0, len(self.known), columns):
            here = (at >= first) & (at < first + columns)
            part = np.zeros((len(ids), min(columns, len(self.known) - first)))
            part[row[here], at[here] - first] = share[here]
            self.parts.append((first, part))
        self.cut = np.zeros(len(ids))  # what a new candidate must exceed, a little less than the k-th score
        self.found = [(np.zeros(0, np.int64), np.zeros(0, ids.dtype), np.zeros(0))]
        self.held = 0

    def see(self, ids, norms, numbers) -> None:
        values, lengths = np.asarray(numbers.flatten()), np.asarray(numbers.value_lengths())
        row = np.repeat(np.arange(len(ids)), lengths)
        at = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
        asked = self.known[at] == values
        row, at = row[asked], at[asked]
        for low in range(0, len(ids), self.tile):
            high = min(low + self.tile, len(ids))
            mine = slice(*np.searchsorted(row, [low, high]))
            score = np.zeros((len(self.ids), high - low))
            for first, part in self.parts:
                here = (at[mine] >= first) & (at[mine] < first + part.shape[1])
                other = np.zeros((part.shape[1], high - low))
                other[at[mine][here] - first, row[mine][here] - low] = 1.0 / norms[row[mine][here]]
                score += part @ other
            q, c = np.nonzero(score > self.cut[:, None])
            score, c = score[q, c], ids[low + c]
            self.found.append((q, c, score))
            self.held += len(q)
            if self.held > self.most:
                self.settle()
                self.most = max(self.most, 2 * self.held)

    def settle(self) -> None:
        q, c, score = (np.concatenate([f[i] for f in self.found]) for i in range(3))
        rounded = np.round(score, self.places)
        order = np.lexsort((c, -rounded, q))
        begin = np.searchsorted(q[order], np.arange(len(self.ids) + 1))
        rank = np.arange(len(order)) - np.repeat(begin[:-1], np.diff(begin))
        kept = order[rank < self.k]
        full = np.flatnonzero(np.diff(begin) >= self.k)
        # Later candidates have larger ids: only a larger rounded score gets them in.
        self.cut[full] = rounded[order[begin[full] + self.k - 1]] + 0.4 * 10.0**-self.places
        self.found, self.held = [(q[kept], c[kept], score[kept])], len(kept)

    def best(self):
        """(query, candidate, score, rank) as arrays."""
        self.settle()
        q, c, score = self.found[0]
        begin = np.searchsorted(q, np.arange(len(self.ids) + 1))
        rank = np.arange(len(q)) - np.repeat(begin[:-1], np.diff(begin)) + 1
        return self.ids[q], c, score, rank.astype(np.int64)
