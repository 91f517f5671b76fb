"""The pipeline against a brute-force version of its stages."""

import base64
import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import quality
from tests.llm.test_jaccard import shingles
from tests.llm.test_repeats import runs
from tests.llm.test_single_pass import hits

SMALL = "/root/testdata/sf0.001"


def near_duplicates(rows):
    sets = [shingles(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r["doc_id"], least.get(find(i), r["doc_id"]))
    return [r for i, r in enumerate(rows) if not sets[i] or r["doc_id"] == least[find(i)]]


def repeated_passages(rows, length=200, words=51):
    out = {}
    texts = [(r["text"] or "").encode() for r in rows]
    for r, t, spans in zip(rows, texts, runs(texts, length, words), strict=True):
        left, at = "", 0
        for a, b in spans:
            left += t[at:a].decode("utf-8", "ignore")
            at = b
        left += t[at:].decode("utf-8", "ignore")
        if left.strip():
            out[r["doc_id"]] = left
    return out


def public_tokens(texts):
    """Number of ids and their digest by the public encoder."""
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    public = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [public.encode_ordinary(t) for t in texts]
    return [(len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for x, t in zip(ids, texts, strict=True)]


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["quality_rules"](spark, docs, SMALL)
    assert kept.columns == docs.columns
    judged = {r["doc_id"]: r["kept"] for r in quality.assess(docs).collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in kept.collect():  # lines go, and nothing else
        lines = iter(before[r["doc_id"]].split("\n"))
        assert all(line in lines for line in r["text"].split("\n")) and r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in kept.collect()} == {d for d, good in judged.items() if good}
    rows = sorted((r.asDict() for r in kept.collect()), key=lambda r: r["doc_id"])

    single = steps["near_duplicates"](spark, kept, SMALL)
    expected = near_duplicates(rows)
    assert single.columns == docs.columns
    assert sorted(r["doc_id"] for r in single.collect()) == [r["doc_id"] for r in expected]

    cut = steps["repeated_passages"](spark, single, SMALL)
    left = repeated_passages(expected)
    assert cut.schema == docs.schema
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()} == {d: (t, len(t)) for d, t in left.items()}

    clean = steps["benchmark_passages"](spark, cut, SMALL)
    dirty = {r[0] for r in hits(list(left.items()), benchmark) if r[-1]}
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == set(left) - dirty

    last = sorted(set(left) - dirty)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == dict(zip(last, public_tokens([left[d] for d in last]), strict=True))


def test_awkward(spark, awkward):
    """Nulls, empty and long texts, repeated rows and clashing names go through every stage."""
    docs = awkward
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SMALL)
        if name != "tokens":
            assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), after.schema)
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()}
    assert docs.count() >= 1
    assert all((texts[d] or "").strip() for d in (r["doc_id"] for r in docs.collect()))


def test_copies_stay_once(spark):
    """Repeated rows and copies with null ids: one of each stays, whole."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [" ".join(f"{x}{i} is followed by {x}{i * 7 % 1000}." for i in range(n)) for x, n in (("word", 80), ("item", 80), ("term", 8))]
    rows = [(1, texts[0]), (1, texts[0]), (None, texts[1]), (None, texts[1]), (2, texts[2]), (2, texts[2]), (None, texts[2])]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], docs.schema)
    steps = dict(corpus_pipeline.STAGES)
    left = steps["repeated_passages"](spark, steps["near_duplicates"](spark, df, SMALL), SMALL)
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == {(1, texts[0]): 1, (None, texts[1]): 1, (2, texts[2]): 1}


def test_empty(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
