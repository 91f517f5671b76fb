"""Suffix sorting and repeated strings against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import repeats
from tessera.llm.suffix import suffix_array


def test_suffix_array():
    random.seed(4)
    for _ in range(300):
        values = np.array([random.randint(0, random.choice([1, 3, 200])) for _ in range(random.randint(0, 60))], dtype=np.int64)
        assert suffix_array(values).tolist() == sorted(range(len(values)), key=lambda i: values[i:].tolist())
    for text in (b"a" * 500, b"ab" * 300, b"abcabcabcd" * 60):
        values = np.frombuffer(text, dtype=np.uint8).astype(np.int64)
        assert suffix_array(values).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def expected(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    often = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if often[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~gone[:-1]])
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if t else 0
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def runs(texts, length, words):
    """By text, the maximal repeated runs of at least so many whole words."""
    often = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, dtype=bool)
        for i in range(len(t) - length + 1):
            if often[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        edges = np.flatnonzero(np.diff(gone.astype(int)))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        whole = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        out.append([(a, b) for a, b in spans if sum(a <= x and y <= b for x, y in whole) >= words])
    return out


@pytest.mark.parametrize("table,short,words,length", [("awkward", 40, 6, 60), ("awkward", 30, 0, 30), ("documents", 200, 51, 400)])
def test_passages_of_words(table, short, words, length, request):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    spans = runs([(t or "").encode() for _, t in rows], short, words)
    reported = repeats.report(df, length=length, passage=(short, words)).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in reported) == expected(rows, length)
    assert Counter((r["doc_id"], r["n_passage"]) for r in reported) == Counter((d, sum(b - a for a, b in s)) for (d, _), s in zip(rows, spans, strict=True))
    out = []
    for (d, t), s in zip(rows, spans, strict=True):
        raw, at, left = (t or "").encode(), 0, ""
        for a, b in s:
            left += raw[at:a].decode("utf-8", "ignore")
            at = b
        out.append((d, left + raw[at:].decode("utf-8", "ignore") if s else t))
    assert Counter((r["doc_id"], r["text"]) for r in repeats.remove(df, length=short, least_words=words).collect()) == Counter(out)


def got(df, length):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.report(df, length=length).collect())


@pytest.mark.parametrize("table,length", [("awkward", 400), ("awkward", 40), ("nothing", 400), ("documents", 400)])
def test_report(table, length, request):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert got(df, length) == expected(rows, length)
    out = repeats.remove(df, length=length)
    assert out.schema == df.schema
    lengths = Counter(d for d, *_ in expected(rows, length).elements())
    assert Counter(r["doc_id"] for r in out.collect()) == lengths


def passages(seed, n, alphabet="abcdef é"):
    random.seed(seed)
    common = ["".join(random.choice(alphabet) for _ in range(random.randint(20, 90))) for _ in range(12)]
    out = []
    for i in range(n):
        parts = [random.choice(common) if random.random() < 0.5 else "".join(random.choice(alphabet) for _ in range(random.randint(1, 40))) for _ in range(random.randint(0, 8))]
        out.append((i, "".join(parts)))
    out += [(n, "ab" * 60), (n + 1, "a" * 90), (n + 2, common[0] * 3)]
    return out


@pytest.mark.parametrize("seed,length", [(1, 40), (2, 30), (3, 12)])
def test_passages(spark, seed, length):
    rows = passages(seed, 150)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length) == expected(rows, length)


def test_crowded_minimizers(spark, monkeypatch):
    """Minimizers with too many pieces are dealt out by whole windows; batches of suffixes are small."""
    monkeypatch.setattr(repeats, "_MOST_PIECES", 2)
    monkeypatch.setattr(repeats, "_SORTED_BYTES", 300)
    rows = passages(9, 150)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 30) == expected(rows, 30)


def test_removed_text(spark):
    shared = "".join(chr(97 + i * i % 23) for i in range(60))
    rows = [(1, "é" * 3 + "start " + shared + " end"), (2, shared), (3, "nothing shared here at all, not a bit of it")]
    out = {r["doc_id"]: r["text"] for r in repeats.remove(spark.createDataFrame(rows, "doc_id long, text string"), length=50).collect()}
    assert out == {1: "ééé" + "start " + " end", 2: "", 3: rows[2][1]}
