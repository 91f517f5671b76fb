"""Line-first quality rules (operator 5).

Each line is judged alone by punctuation, navigation and boilerplate rules;
failing lines are removed, and a document that loses too much of its text, or
fails a document rule, is rejected.  One pass over the texts, no shuffle.  Words
and lines are compared by 64-bit hashes.

Defined results: a null or empty text has no lines, no words and is rejected
(fewer than ``min_words``); null ids and repeated rows pass through row by row,
and there are no ties; an empty table gives an empty one; a text of any length
is judged whole.  Columns other than the id and the text never matter, whatever
their names.
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
from tessera.llm.runtime import ship

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_DIVIDERS = np.zeros(256, dtype=bool)
_DIVIDERS[list(b"|<>")] = True
_MARKS = bk.byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_LETTERS = bk.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_STOPS = np.zeros(256, dtype=bool)
_STOPS[list(b".!?")] = True
_STOPS[0x80:] = True  # marks of other scripts

#: Phrases that make a short line boilerplate (fixed values).
BOILERPLATE = (
    b"all rights reserved",
    b"cookie policy",
    b"privacy policy",
    b"terms of service",
    b"terms of use",
    b"click here",
    b"subscribe to our newsletter",
    b"sign up now",
    b"log in",
    b"javascript",
    b"share this",
    b"lorem ipsum",
)


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules; shares are parts of one."""

    min_words: int = 20
    max_repeat_share: float = 0.30
    repeat_window: int = 8
    max_mark_share: float = 0.25  # marks per non-blank byte of a line
    min_marks: int = 3  # a line of one short word and its stop is none of marks
    max_bang_share: float = 0.50  # words of a line that end in two marks alike
    max_divider_share: float = 0.20  # | < > per word of a line: navigation
    min_dividers: int = 3
    max_stutter_share: float = 0.35  # words of a line equal to the word before
    unstopped_words: int = 60  # a longer line without any sentence mark fails
    boilerplate_words: int = 12
    max_lost_share: float = 0.35  # bytes of words a document may lose


def _lines(chunk: bk.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of lines split at \\n, and first indexes by row; an empty text has one empty line."""
    breaks = np.flatnonzero(chunk.data == 10)
    starts = np.concatenate([chunk.offsets[:-1], breaks + 1])
    row = np.concatenate([np.arange(chunk.rows), np.searchsorted(chunk.offsets, breaks, side="right") - 1])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = np.empty_like(starts)
    last = np.flatnonzero(np.diff(row, append=-1) != 0)
    ends[:-1] = starts[1:] - 1
    ends[last] = chunk.offsets[1:]
    return starts, ends, np.searchsorted(row, np.arange(chunk.rows + 1))


def measure(chunk: bk.Chunk, rules: QualityRules) -> dict[str, np.ndarray]:
    """Counts and verdicts by row, and the lines with their verdicts."""
    data = chunk.data
    starts, ends, first = chunk.runs(bk.SPACED_WORD)
    n_words = np.diff(first)

    points = np.concatenate([[0], np.cumsum(bk.SPACED_WORD[data] & ((data & 0xC0) != 0x80), dtype=np.int64)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[data], dtype=np.int64)])
    by_row = lambda total: total[chunk.offsets[1:]] - total[chunk.offsets[:-1]]

    # Words in windows that the row holds twice.
    words, row = chunk.span_hash(starts, ends), bk.row_of(first)
    size = rules.repeat_window
    windows = bk.ngram_hash(words, size)
    inside = row[: len(windows)] == row[size - 1 :] if len(windows) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    twice, _ = bk.duplicates(row[at], windows[at])
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + size, -1)
    n_repeat = bk.sum_by(first, np.cumsum(cover)[:-1] > 0)

    # Lines.
    l_start, l_end, l_first = _lines(chunk)
    l_row = bk.row_of(l_first)
    by_line = lambda total: total[l_end] - total[l_start]
    w_first, w_stop = np.searchsorted(starts, l_start), np.searchsorted(starts, l_end)
    l_words = w_stop - w_first
    filled = np.flatnonzero(l_words > 0)
    hashed = chunk.span_hash(l_start[filled], l_end[filled])
    _, again = bk.duplicates(l_row[filled], hashed)
    n_dup = np.bincount(l_row[filled][again], minlength=chunk.rows)

    cum = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    solid = by_line(cum(bk.SPACED_WORD[data]))
    marks = by_line(cum(_MARKS[data]))
    dividers = by_line(cum(_DIVIDERS[data]))
    doubled = np.zeros(len(starts), dtype=bool)
    long = np.flatnonzero(ends - starts >= 2)
    tail, before = data[ends[long] - 1], data[ends[long] - 2]
    doubled[long] = (tail == before) & _MARKS[tail]
    bangs = cum(doubled)
    l_bangs = bangs[w_stop] - bangs[w_first]
    stopped = by_line(cum(_STOPS[data])) > 0
    stutter = np.zeros(len(words), dtype=bool)
    stutter[1:] = words[1:] == words[:-1]
    stutter[w_first[filled]] = False  # a line's first word has none before it
    stutters = cum(stutter)
    l_stutters = stutters[w_stop] - stutters[w_first]
    filled_words = np.maximum(l_words, 1)

    bad_marks = (
        ((marks >= rules.min_marks) & (marks > rules.max_mark_share * np.maximum(solid, 1))) | (l_bangs > rules.max_bang_share * filled_words) | (l_stutters > rules.max_stutter_share * filled_words) | (~stopped & (l_words > rules.unstopped_words))
    )
    navigation = (dividers >= rules.min_dividers) & (dividers > rules.max_divider_share * filled_words)
    boiler = np.zeros(len(l_start), dtype=bool)
    lowered = data.tobytes().lower()
    for phrase in BOILERPLATE:
        place = lowered.find(phrase)
        while place >= 0:
            line = int(np.searchsorted(l_start, place, side="right")) - 1  # the last line that starts at or before the place: texts abut, so its end may be another's start
            boiler[line] |= place + len(phrase) <= l_end[line] and l_words[line] <= rules.boilerplate_words
            place = lowered.find(phrase, place + 1)
    failed = (l_words > 0) & (bad_marks | navigation | boiler)
    lost = np.bincount(l_row[failed], weights=solid[failed], minlength=chunk.rows)
    whole = np.bincount(l_row, weights=solid, minlength=chunk.rows)
    lost_share = lost / np.maximum(whole, 1)

    base_failed = (n_words < rules.min_words) | (n_repeat > rules.max_repeat_share * n_words + 1e-9)
    return {
        "n_words": n_words,
        "word_chars": by_row(points),
        "n_symbols": by_row(symbols),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "n_lines": np.bincount(l_row[filled], minlength=chunk.rows),
        "n_failed_lines": np.bincount(l_row[failed], minlength=chunk.rows),
        "lost_share": lost_share,
        "kept": ~base_failed & (lost_share <= rules.max_lost_share),
        "_failed": failed,
        "_lines": (l_start, l_end, l_first),
    }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ARROW = {name: pa.int64() for name in (*_COUNTS, "n_lines", "n_failed_lines")} | {"base_failed": pa.bool_(), "kept": pa.bool_(), "lost_share": pa.float64()}


def assess(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: QualityRules | None = None) -> DataFrame:
    """A row for each row of df: its id, counts, line verdicts in sum, and kept."""
    ship(df.sparkSession)
    limits = rules or QualityRules()
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = [*_COUNTS, "base_failed", "kept", "n_lines", "n_failed_lines", "lost_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in bk.chunks(batches, "text"):
            found = measure(chunk, limits)
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), *(pa.array(found[n], _ARROW[n]) for n in names)], names=["id", *names])

    kinds = {pa.int64(): T.LongType(), pa.bool_(): T.BooleanType(), pa.float64(): T.DoubleType()}
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), *(T.StructField(n, kinds[_ARROW[n]]) for n in names)])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def clean(df: DataFrame, text_col: str = "text", rules: QualityRules | None = None, drop_lines: bool = False) -> DataFrame:
    """The rows of df that are kept, all columns; with drop_lines, their texts without failing lines."""
    ship(df.sparkSession)
    limits = rules or QualityRules()
    position = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in bk.chunks(batches, text_col):
            found = measure(chunk, limits)
            keep = np.flatnonzero(found["kept"])
            out = chunk.batch.take(pa.array(keep))
            if drop_lines and len(keep):
                l_start, l_end, l_first = found["_lines"]
                texts = [b"\n".join(chunk.data[l_start[i] : l_end[i]].tobytes() for i in range(l_first[r], l_first[r + 1]) if not found["_failed"][i]).decode("utf-8") for r in keep]
                columns = out.columns
                columns[position] = pa.array(texts, out.schema.field(position).type)
                out = pa.RecordBatch.from_arrays(columns, schema=out.schema)
            if out.num_rows:
                yield out

    return df.mapInArrow(run, df.schema)
