"""The interpolated model against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language, ngram_lm

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}
END = object()


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10


def run(df, **options):
    f = language.fold("doc_id", 10)
    return ngram_lm.score(df, f == 0, f == 9, **options).collect()


def base(rows):
    tokens = [(i, [*SPACED.findall((t or "").translate(FOLD)), END]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if fold(i) != 0 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(i, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in tokens]


@pytest.mark.parametrize("block", [24 << 20, 20_000])
@pytest.mark.parametrize("table", ["awkward", "nothing", "documents"])
def test_base(table, block, request):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = run(df, block_bytes=block)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == Counter(base(rows))
    assert all(r["score"] < 0 for r in got)


def test_score_is_the_mixture(spark, documents, monkeypatch):
    kept = []
    first = ngram_lm.learn
    monkeypatch.setattr(ngram_lm, "learn", lambda cells: kept.append(first(cells)) or kept[-1])
    got = {r["doc_id"]: r["score"] for r in run(documents)}
    rows = [(r["doc_id"], [*SPACED.findall((r["text"] or "").translate(FOLD)), END]) for r in documents.collect()]
    words, pairs = Counter(), Counter()
    for i, ws in rows:
        if fold(i) != 0:
            words.update(ws)
            pairs.update(zip([END, *ws], ws))
    n, v, weights = sum(words.values()), len(words), kept[0]
    for i, ws in rows[:40]:
        total = 0.0
        for u, w in zip([END, *ws], ws):
            l2, l1, l0 = weights[ngram_lm.bucket_of(np.array([words[u]]))[0]]
            total += math.log10(l2 * pairs[u, w] / max(words[u], 1) + l1 * words[w] / n + l0 / (v + 1))
        assert got[i] == pytest.approx(total, rel=1e-9)


def test_better_than_base_on_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    f = language.fold("doc_id", 10)
    held = ngram_lm.score(df, f == 0, f == 9).where(f == 0).agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_learning_recovers_weights():
    rng = np.random.default_rng(0)
    parts = 2.0 ** -rng.uniform(0, 12, (400, 3))
    truth = np.array([0.6, 0.3, 0.1])
    cells = np.column_stack([np.full(400, 5), parts, 1e5 * (parts @ truth)])
    found = ngram_lm.learn(cells, 400)
    assert np.allclose(found.sum(axis=1), 1) and (found >= 0).all()
    log = lambda w: (cells[:, 4] * np.log(parts @ w)).sum()
    assert log(found[5]) >= log(truth) - 1e-3 * abs(log(truth))
