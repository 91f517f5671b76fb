"""Byte-level BPE by prefix dynamic programming (operator 7).

Every prefix of a byte string has exactly one token that can end its encoding:
a token t that ends at i is that one if the prefix before it is empty, or if
the last token stored for that prefix may stand before t.  Two tokens may stand
side by side if merging their joined bytes gives just these two.  The table of
last tokens makes appending exact (earlier entries never change) and lets an
edit be re-encoded from the first changed byte.

A piece that is itself a token is that token, as public encoders have it.

Defined results: a null or empty text encodes to no ids; texts of any length are
encoded whole; repeated rows repeat their results, null ids are kept and there
are no ties; an empty table gives an empty one; special tokens are ordinary
text; columns other than id and text are never read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytekit as bk
from tessera.llm.runtime import ship

#: Pieces whose encodings a worker remembers; beyond it the memory starts anew.
REMEMBERED = 500_000
#: Bytes of text whose new pieces are encoded together.
_TEXT_BYTES = 2 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PrefixEncoder:
    """Encodes and decodes under one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        #: By rank: bytes of the token, and the rank as text.
        top = max(self.tokens, default=-1) + 1
        self.sizes = [len(self.tokens.get(i, b"")) for i in range(top)]
        self.names = [str(i) for i in range(top)]
        lengths: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                lengths.setdefault(token[-3:], set()).add(len(token))
        #: By the last three bytes: lengths of tokens with that ending, longest first, then two bytes and one.
        self.lengths = {end: (*sorted(found, reverse=True), 2, 1) for end, found in lengths.items()}
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first: only for the few bytes of one or two tokens."""
        rank, none = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        joins = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while joins:
            least = min(joins)
            if least == none:
                break
            i = joins.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joins[i]
            if i:
                joins[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(joins):
                joins[i] = rank(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def stands_alone(self, token: int) -> bool:
        if token not in self.alone:
            self.alone[token] = self.merged(self.tokens[token]) == [token]
        return self.alone[token]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if key not in self.pairs:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            self.pairs[key] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return self.pairs[key]

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Continue the table of last tokens of data's first len(last) bytes to all of data."""
        rank, pairs, lengths, short = self.ranks.get, self.pairs, self.lengths.get, (2, 1)
        for end in range(len(last) + 1, len(data) + 1):
            for size in lengths(data[end - 3 : end], short) if end > 2 else short:
                start = end - size
                if start < 0:
                    continue
                token = rank(data[start:end])
                if token is None:
                    continue
                if start == 0:
                    if self.stands_alone(token):
                        break
                else:
                    fits = pairs.get(last[start - 1] << 32 | token)
                    if self.compatible(last[start - 1], token) if fits is None else fits:
                        break
            else:
                raise ValueError("a byte is not in the vocabulary")
            last.append(token)
        return last

    def ids(self, data: bytes, last: list[int]) -> list[int]:
        """Follow the table back from the end."""
        out, end, sizes = [], len(data), self.sizes
        while end:
            token = last[end - 1]
            out.append(token)
            end -= sizes[token]
        out.reverse()
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.ids(data, self.extend(data, []))

    def reencode(self, old: bytes, last: list[int], new: bytes) -> tuple[list[int], list[int]]:
        """The ids and the table of new, reusing the table of old up to the first changed byte."""
        limit = min(len(old), len(new))
        same = next((i for i in range(limit) if old[i] != new[i]), limit)
        table = self.extend(new, last[:same])
        return self.ids(new, table), table

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class TextEncoder:
    """Cuts texts into pieces by a pattern and encodes each; frequent pieces are remembered."""

    def __init__(self, encoder: PrefixEncoder, pattern: str):
        import regex

        self.encoder, self.find = encoder, regex.compile(pattern).findall
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def learn(self, unknown: Iterable[str]) -> dict[str, tuple[str, int, bytes]]:
        """Encode pieces in order of their bytes: each table continues that of the piece before from where they part."""
        encoder, out = self.encoder, {}
        whole, tokens, extend, follow, name = encoder.ranks.get, encoder.tokens, encoder.extend, encoder.ids, encoder.names.__getitem__
        before, table = b"", []
        for data, piece in sorted((p.encode("utf-8"), p) for p in unknown):
            token = whole(data)
            if token is not None:
                out[piece] = (name(token), 1, tokens[token])
                continue
            same = 0
            if data.startswith(before):
                same = len(before)
            else:
                for x, y in zip(before, data):
                    if x != y:
                        break
                    same += 1
            del table[same:]
            ids = follow(data, extend(data, table))
            before = data
            out[piece] = (",".join(map(name, ids)), len(ids), b"".join(map(tokens.__getitem__, ids)))
        return out

    def pieces_of(self, texts: list[str]) -> list[list[tuple[str, int, bytes]]]:
        """By text, its pieces' ids as text, how many, and the bytes they decode to."""
        found = [self.find(text) for text in texts]
        unknown = set().union(*found).difference(self.known)
        if unknown:
            if len(self.known) + len(unknown) > REMEMBERED:
                # The half that was learned last stays, and what this call needs.
                needed = set().union(*found)
                recent = list(self.known.items())[len(self.known) // 2 :]
                self.known = {p: v for p, v in self.known.items() if p in needed} | dict(recent)
                unknown = needed.difference(self.known)
            self.known |= self.learn(unknown)
        known = self.known.__getitem__
        return [list(map(known, pieces)) for pieces in found]

    def pieces(self, text: str) -> list[tuple[str, int, bytes]]:
        return self.pieces_of([text])[0]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.pieces(text) for i in ids.split(",")]


@lru_cache(maxsize=4)
def text_encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder for each vocabulary and worker."""
    return TextEncoder(PrefixEncoder(load_ranks(path)), pattern)


def encode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """A row for each row of df: its id, n_tokens, digests of the ids and of the decoded bytes, and, if asked for, the ids."""
    ship(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(vocabulary, pattern)
        for chunk in bk.chunks(batches, "text", _TEXT_BYTES):
            counts, coded, decoded, lists = [], [], [], []
            gc.disable()  # nothing made here is in a cycle, and there is much to look through
            try:
                pieces = encoder.pieces_of([text or "" for text in chunk.batch.column(1).to_pylist()])
            finally:
                gc.enable()
            for parts in pieces:
                joined = ",".join([p[0] for p in parts])
                counts.append(sum([p[1] for p in parts]))
                coded.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest())
                if with_ids:
                    lists.append(np.array(joined.split(","), dtype=np.int32) if joined else [])
            columns = [chunk.batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(lists, pa.list_(pa.int32()))] if with_ids else []), names=schema.names)

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
