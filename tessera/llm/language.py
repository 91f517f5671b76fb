"""Language identification by rank-order profiles (operator 8).

A language's profile is the ranking of its most frequent character n-grams (one
to three letters, words bounded by blanks).  A text's own ranking is compared
with each profile by the out-of-place distance: the sum, over the text's
n-grams, of how far their ranks are apart, or a fixed penalty where a profile
lacks one.

Letters are lower-cased code points of 21 bits, so an n-gram of up to three is an
exact number of 63 bits, in any script.  A chunk numbers just the letters it
holds, which keeps its n-grams short enough to be sorted beside their rows.
Profiles are fitted on all rows with a language; the driver gets the ranked
n-grams of each language and nothing else.

Defined results: a null or empty text, or one without a letter, is ``und`` with
score 0; without any labelled row, or for an empty table of them, every text is
``und``; ties go to the language that sorts first, and n-grams of one frequency
are ranked in order of their letters; rows with a null language teach nothing;
repeated rows count each time; null ids are kept; a text of any length is
counted whole; columns other than those named are never read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytekit as bk
from tessera.llm.runtime import ship

#: N-grams of a text and of a profile that are ranked.
RANKED = 300
_POINT = 21
_BLANK = 32


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """By code point: 0 for no letter, else the first code point of its lower case."""
    out = np.zeros(0x110000, dtype=np.int64)
    for point in range(0x110000):
        char = chr(point)
        if unicodedata.category(char)[0] == "L":
            out[point] = ord(char.lower()[0])
    return out


def counted(chunk: bk.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, n-grams and their counts, by row and n-gram; and letters by row.

    An n-gram is its code points, 21 bits each from the highest down, with a
    blank for a word's bound and zeros behind its end.
    """
    text = chunk.data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    heads = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
    first = heads[chunk.offsets] if len(points) == heads[-1] else np.zeros(chunk.rows + 1, np.int64)
    letter = letters()[points]
    total = np.concatenate([[0], np.cumsum(letter > 0)])
    n_letters = total[first[1:]] - total[first[:-1]]
    row = np.repeat(np.arange(chunk.rows), np.diff(first))
    n = len(row)
    if n == 0 or not n_letters.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, n_letters
    letter = letter[:n]
    # Numbers of the chunk's letters, in order: 0 for nothing, 1 for a blank, then letters.
    there = np.zeros(0x110000, dtype=bool)
    there[letter] = True
    there[0] = False
    known = np.concatenate([[0, _BLANK], np.flatnonzero(there)])
    number = np.zeros(0x110000, dtype=np.int64)
    number[known[2:]] = np.arange(2, len(known))
    number[0] = 1
    kind = number[letter]
    bits = max(1, int(len(known) - 1).bit_length())
    # A neighbour in another row is a blank.
    left, right = np.ones(n, np.int64), np.ones(n, np.int64)
    left[1:] = np.where(row[1:] == row[:-1], kind[:-1], 1)
    right[:-1] = np.where(row[1:] == row[:-1], kind[1:], 1)
    here = np.flatnonzero(kind > 1)
    k, a, b, r = kind[here], left[here], right[here], row[here] << (3 * bits)
    start = a == 1  # the blank before a word, and its first letter
    codes = np.concatenate([r | k << 2 * bits, r | k << 2 * bits | b << bits, r | a << 2 * bits | k << bits | b, r[start] | 1 << 2 * bits | k[start] << bits])
    codes.sort()
    head = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    some = codes[head]
    part = lambda shift: known[some >> shift & ((1 << bits) - 1)]
    gram = part(2 * bits) << 2 * _POINT | part(bits) << _POINT | part(0)
    return some >> 3 * bits, gram, np.diff(np.append(head, len(codes))), n_letters


def _ranked(row: np.ndarray, gram: np.ndarray, count: np.ndarray, ranked: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent n-grams of each row with their ranks; ties in order of the n-gram, as they come."""
    order = np.argsort(row << 44 | ((1 << 44) - 1 - count), kind="stable")
    row, gram = row[order], gram[order]
    first = np.searchsorted(row, np.arange(row[-1] + 2 if len(row) else 1))
    rank = np.arange(len(row)) - first[row]
    keep = rank < ranked
    return row[keep], gram[keep], rank[keep]


#: Distinct n-grams a task gathers before it sends their counts on.
_FLUSH = 1_000_000


def fit(df: DataFrame, lang_col: str = "lang", text_col: str = "text", ranked: int = RANKED) -> dict[str, np.ndarray]:
    """By language, the n-grams of its profile from the most frequent on."""
    ship(df.sparkSession)
    source = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, (grams, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], names=schema.names)
            held.clear()

        for chunk in bk.chunks(batches, "text"):
            row, gram, count, _ = counted(chunk)
            langs = chunk.batch.column(0).to_pylist()
            names = sorted(set(langs))
            which = np.array([names.index(x) for x in langs])[row]
            for i, name in enumerate(names):
                mine = which == i
                before = held.get(name, (gram[:0], count[:0]))
                grams, place = np.unique(np.concatenate([before[0], gram[mine]]), return_inverse=True)
                held[name] = grams, np.bincount(place, weights=np.concatenate([before[1], count[mine]]), minlength=len(grams)).astype(np.int64)
            if sum(len(x[0]) for x in held.values()) > _FLUSH:
                yield from flush()
        yield from flush()

    summed = source.mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The row number's limit keeps the first of each task, so that a language's n-grams never meet in one.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = summed.withColumn("rank", place).where(F.col("rank") <= ranked)
    profiles: dict[str, list[tuple[int, int]]] = {}
    for r in top.collect():  # so many n-grams a language
        profiles.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {lang: np.array([gram for _, gram in sorted(rows)], dtype=np.int64) for lang, rows in sorted(profiles.items())}


def predict(df: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", ranked: int = RANKED) -> DataFrame:
    """A row for each row of df: id, lang_pred, score."""
    ship(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = [*profiles]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By language and n-gram of any profile, its rank there; in the last column, and where there is none, the penalty.
        every = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
        table = np.full((max(1, len(names)), len(every) + 1), ranked, dtype=np.int64)
        for i, name in enumerate(names):
            table[i, np.searchsorted(every, profiles[name])] = np.arange(len(profiles[name]))
        for chunk in bk.chunks(batches, "text"):
            row, gram, count, n_letters = counted(chunk)
            row, gram, rank = _ranked(row, gram, count, ranked)
            place = np.searchsorted(every, gram)
            place = np.where(every[np.minimum(place, len(every) - 1)] == gram, place, len(every)) if len(every) else np.zeros(len(gram), np.int64)
            first = np.searchsorted(row, np.arange(chunk.rows + 1))
            apart = np.stack([bk.sum_by(first, np.where(t[place] == ranked, ranked, np.abs(t[place] - rank))) for t in table], axis=1)
            best = np.argmin(apart, axis=1)
            near = apart[np.arange(chunk.rows), best]
            score = 1 - near / np.maximum(np.diff(first) * ranked, 1)
            none = (n_letters == 0) | (len(names) == 0)
            found = ["und" if none[i] else names[b] for i, b in enumerate(best.tolist())]
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), pa.array(found, pa.string()), pa.array(np.where(none, 0.0, np.clip(score, 0, 1)), pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text (a null one as an empty text), modulo folds."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
