"""Benchmark decontamination by suffix arrays over the training texts (operator 3).

The documents' partitions are the shards.  A shard, a few megabytes at a time,
names its words by the benchmark's vocabulary, sorts the suffixes that begin a
long enough run of such words, and has every test suffix binary-searched in
them: what matches gives verbatim matches and their places.  Words outside the
vocabulary can be in no match, so suffixes that meet one too early are left out
of the sort; no match is lost by it.  No shuffle.

The benchmark goes to the tasks in blocks of a bounded size; a larger one takes
more passes over the documents, with a checkpoint after each, so that the driver
and the tasks hold one block and the next at most.

Defined results: a null or empty text has no words, no hits and is clean; an
item without words matches nothing; items that repeat an id count once; a null
item id counts as an empty string; an empty benchmark leaves all documents
clean; null and repeated document ids are kept row by row; there are no ties;
an empty documents table gives an empty one; a text of any length is searched
whole; columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytekit as bk
from tessera.llm.runtime import checkpointed, ship

WINDOW = 10
#: Bytes of benchmark text that go to the tasks at once.
BLOCK_BYTES = 16 << 20


class TestSuffixes:
    """The windows of some benchmark items: a full window from each word on, or a short item as a whole."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
        chunk = bk.Chunk(batch, "text")
        starts, ends, first = chunk.runs(bk.ALNUM_WORD)
        hashes = chunk.span_hash(starts, ends, folded=True)
        self.window, self.ids = window, ids
        self.vocabulary, names = np.unique(hashes, return_inverse=True)
        names = names.astype(np.int64) + 1
        counts = np.diff(first)
        length = np.minimum(counts, window)  # of each item's windows
        item = np.repeat(np.arange(len(ids)), counts)
        inside = np.arange(len(names)) - first[:-1][item] <= (counts - length)[item]
        at = np.flatnonzero(inside)
        width = length[item[at]]
        keys = suffix_keys(names, at, width, window)
        self.keys, which = np.unique(keys, return_inverse=True)
        self.length = np.zeros(len(self.keys), dtype=np.int64)
        self.length[which] = width
        owners = np.unique(np.stack([which, item[at]], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        self.items = owners[:, 1]
        self.items_first = np.searchsorted(owners[:, 0], np.arange(len(self.keys) + 1))
        follows = (np.diff(at) == 1) & (item[at][1:] == item[at][:-1])
        self.follows = np.unique(which[:-1][follows] * len(self.keys) + which[1:][follows])
        self.upper = np.array([k.ljust(4 * n, b"\0").ljust(4 * window, b"\xff") for k, n in zip(self.keys.tolist(), self.length.tolist(), strict=True)], dtype=f"S{4 * window}")
        self.shortest = int(self.length.min()) if len(self.keys) else 0


def suffix_keys(names: np.ndarray, at: np.ndarray, width: np.ndarray, window: int) -> np.ndarray:
    """From each place, window names (none beyond its width) as bytes that sort like the names."""
    table = np.zeros((len(at), window), dtype=">u4")
    for j in range(window):
        live = width > j
        table[live, j] = names[at[live] + j]
    return table.view(f"S{4 * window}").ravel() if len(at) else np.zeros(0, dtype=f"S{4 * window}")


def _merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint (first, beyond) pairs."""
    if len(spans) == 0:
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[head, 0], reach[np.concatenate([np.flatnonzero(head)[1:] - 1, [len(spans) - 1]])]], axis=1)


def search(chunk: bk.Chunk, tests: TestSuffixes) -> tuple[np.ndarray, dict[int, np.ndarray], dict[int, set[str]], np.ndarray]:
    """Words by row; by row with matches, the hit word spans and item ids; by row, the longest match in words."""
    starts, ends, first = chunk.runs(bk.ALNUM_WORD)
    n_words, longest = np.diff(first), np.zeros(chunk.rows, dtype=np.int64)
    if not len(starts) or not len(tests.keys):
        return n_words, {}, {}, longest
    hashes = chunk.span_hash(starts, ends, folded=True)
    place = np.minimum(np.searchsorted(tests.vocabulary, hashes), len(tests.vocabulary) - 1)
    names = np.where(tests.vocabulary[place] == hashes, place + 1, 0)
    row = bk.row_of(first)
    # Words from each place to the next word outside the vocabulary, or the text's end.
    stop = np.where(names == 0, np.arange(len(names)), len(names))
    stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], first[1:][row])
    width = np.minimum(stop - np.arange(len(names)), tests.window)
    at = np.flatnonzero(width >= tests.shortest)
    keys = suffix_keys(names, at, width[at], tests.window)
    order = np.argsort(keys, kind="stable")
    array, keys = at[order], keys[order]
    low, high = np.searchsorted(keys, tests.keys, "left"), np.searchsorted(keys, tests.upper, "right")
    met = np.flatnonzero(high > low)
    if not len(met):
        return n_words, {}, {}, longest
    count = (high - low)[met]
    test = np.repeat(met, count)
    hit = array[np.repeat(low[met], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    order = np.lexsort((test, hit))
    hit, test = hit[order], test[order]
    # The longest match: windows that follow each other in the text and in an item.
    length = tests.length[test]
    full = np.flatnonzero(length == tests.window)
    runs = np.zeros(len(full), dtype=np.int64)
    if len(full):
        chained = np.zeros(len(full), dtype=bool)
        chained[1:] = (np.diff(hit[full]) == 1) & (row[hit[full]][1:] == row[hit[full]][:-1]) & np.isin(test[full][:-1] * len(tests.keys) + test[full][1:], tests.follows)
        index = np.arange(len(full))
        runs = index - np.maximum.accumulate(np.where(chained, 0, index))
    np.maximum.at(longest, row[hit], length)
    np.maximum.at(longest, row[hit[full]], runs + tests.window)
    spans, items = {}, {}
    edges = np.searchsorted(row[hit], np.arange(chunk.rows + 1))
    for r in np.flatnonzero(np.diff(edges)):
        part = slice(edges[r], edges[r + 1])
        base = hit[part] - first[r]
        spans[r] = _merged(np.stack([base, base + length[part]], axis=1))
        owners = {int(i) for t in np.unique(test[part]) for i in tests.items[tests.items_first[t] : tests.items_first[t + 1]]}
        items[r] = {tests.ids[i] for i in owners}
    return n_words, spans, items, longest


def test_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> Iterator[TestSuffixes]:
    """The benchmark, block by block, each of a bounded size."""
    ids, texts, held = [], [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for row in rows.toLocalIterator():
        size = len(row["text"].encode("utf-8"))
        if ids and held + size > block_bytes:
            yield TestSuffixes(ids, texts, window)
            ids, texts, held = [], [], 0
        ids.append(row["id"])
        texts.append(row["text"])
        held += size
    yield TestSuffixes(ids, texts, window)


def matches(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> tuple[DataFrame, str]:
    """df with one more column, a struct (n_words, spans, items, longest) of the verbatim matches; and that column's name."""
    ship(df.sparkSession)
    name = "matches"
    while name in df.columns:
        name += "_"
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("beyond", T.LongType())])
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType())])
    arrow_kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("beyond", pa.int64())]))), ("items", pa.list_(pa.string())), ("longest", pa.int64())])
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    out = df
    for number, tests in enumerate(test_blocks(benchmark, item_col, text_col, block_bytes, window)):

        def run(batches: Iterator[pa.RecordBatch], tests: TestSuffixes = tests, again: bool = number > 0) -> Iterator[pa.RecordBatch]:
            for chunk in bk.chunks(batches, text_col):
                n_words, spans, items, longest = search(chunk, tests)
                before = chunk.batch.column(chunk.batch.num_columns - 1).to_pylist() if again else [None] * chunk.rows
                found = []
                for r in range(chunk.rows):
                    old = before[r] or {"spans": [], "items": [], "longest": 0}
                    pairs = _merged(np.array([(s["first"], s["beyond"]) for s in old["spans"]] + spans[r].tolist(), dtype=np.int64).reshape(-1, 2)) if r in spans else None
                    found.append({"n_words": int(n_words[r]), "spans": old["spans"] if pairs is None else [{"first": a, "beyond": b} for a, b in pairs.tolist()], "items": sorted(set(old["items"]) | items.get(r, set())), "longest": max(old["longest"], int(longest[r]))})
                columns = chunk.batch.columns[: len(schema) - 1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, arrow_kind)], names=schema.names)

        if number:
            out = checkpointed(out)  # so that the block before is no longer held
        out = out.mapInArrow(run, schema)
    return out, name


def report(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each row of df: id, n_words, n_hit, n_items, items_sha256, contaminated, longest and the hit spans."""
    found, m = matches(df.select(F.col(id_col), F.col(text_col)), benchmark, text_col, **options)
    n_hit = F.aggregate(f"{m}.spans", F.lit(0).cast("long"), lambda total, s: total + s["beyond"] - s["first"])
    return found.select(
        id_col,
        F.col(f"{m}.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(f"{m}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(f"{m}.items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.col(f"{m}.longest").alias("longest"),
        F.col(f"{m}.spans").alias("spans"),
    )


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of df without any match, all columns."""
    found, m = matches(df, benchmark, text_col, **options)
    return found.where(F.size(f"{m}.spans") == 0).select(*df.columns)
