"""Operators that look at each text alone, against brute force: 2 sharding, 3, 4, 5 and 7."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from tessera.llm import bpe, decontaminate, licenses, quality, sharding

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def both(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(rows, expected):
    assert Counter(rows) == Counter(expected)


# 5: quality rules


def quality_counts(text):
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


@pytest.mark.parametrize("table", ["awkward", "nothing", "documents"])
def test_quality(table, request):
    df = request.getfixturevalue(table)
    got = quality.assess(df).collect()
    same([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got], [(i, *quality_counts(t)) for i, t in both(df)])
    assert not any(r["kept"] and r["base_failed"] for r in got)
    kept = quality.clean(df)
    assert kept.schema == df.schema
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["kept"])


def test_quality_follows_labels(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = quality.assess(documents).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in got) >= 0.97 * len(got)


def test_quality_lines(spark):
    good = [f"Sentence {i} tells of thing{i} and of place{i}, and ends with person{i}." for i in range(9)]
    text = "\n".join([*good, "home | about | help | more", "All rights reserved."])
    out = quality.clean(spark.createDataFrame([(1, text)], "doc_id long, text string"), drop_lines=True).collect()
    assert len(out) == 1
    assert "|" not in out[0]["text"] and "rights" not in out[0]["text"] and out[0]["text"] == "\n".join(good)


def test_quality_boilerplate_at_the_start(spark):
    """A text's first line is judged alike wherever the text is in its chunk."""
    good = [f"Sentence {i} tells of thing{i} and of place{i}, and ends with person{i}." for i in range(9)]
    heads = ["Log in", "Cookie policy", "All rights reserved", "\nLog in", "An honest line, which stays."]
    rows = [(i, "\n".join([head, *good]) + tail) for i, (head, tail) in enumerate((h, t) for t in ("", "\n") for h in heads)]
    rows = [*rows[:3], (-1, ""), *rows[3:]]
    got = quality.assess(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).where("doc_id >= 0").collect()
    assert {r["doc_id"]: r["n_failed_lines"] for r in got} == {i: int(i % 5 < 4) for i in range(10)}


# 2: sharding


def least_capacity(sizes, shards):
    best = None
    for cut in combinations(range(1, len(sizes)), min(shards, len(sizes)) - 1):
        edges = [0, *cut, len(sizes)]
        largest = max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:], strict=False))
        best = largest if best is None else min(best, largest)
    return best


def test_capacity_is_the_least():
    random.seed(3)
    for _ in range(60):
        sizes = [random.randint(1, 30) for _ in range(random.randint(1, 9))]
        shards = random.randint(1, 4)
        capacity = sharding.smallest_capacity(sizes, shards)
        assert capacity == least_capacity(sizes, shards)
        assert sharding.greedy(sizes, shards, capacity - 1) is None


@pytest.mark.parametrize("table", ["awkward", "nothing", "documents"])
def test_shards(table, request):
    df = request.getfixturevalue(table)
    got = sharding.shard(df, 16).collect()
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in got], [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in both(df)])
    by_text = {}
    for r in got:
        by_text.setdefault(r["digest"], set()).add(r["shard"])
    assert all(len(x) == 1 for x in by_text.values())
    for k in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    assert all(0 <= r["shard"] < 16 and r["law"] == "bytes" and r["grown_shard"] is None for r in got)


def test_shards_are_exact(spark, documents):
    """The cells' cuts are those of all groups in order."""
    for shards in (2, 5, 16):
        got = sharding.shard(documents, shards).collect()
        totals = Counter()
        for r in got:
            totals[r["digest"]] += r["size"]
        giants = {d for d in totals if totals[d] > sum(totals.values()) / shards}
        if not giants:
            sizes = [totals[d] for d in sorted(totals)]
            held = Counter()
            for r in got:
                held[r["shard"]] += r["size"]
            assert max(held.values()) == sharding.smallest_capacity(sizes, shards)


def test_giant_group(spark):
    df = spark.createDataFrame([(i, "same " * 100 if i % 3 else f"text {i} " * 20) for i in range(900)], "doc_id long, text string")
    got = sharding.shard(df, 4).collect()
    held = Counter()
    for r in got:
        held[r["shard"]] += r["size"]
    assert held[0] == 600 * 501
    assert max(held[k] for k in (1, 2, 3)) - min(held[k] for k in (1, 2, 3)) < 1000


# 7: BPE

RANKS = {bytes([i]): i for i in range(256)} | {t: 256 + i for i, t in enumerate([b"th", b"he", b"the", b"in", b"ing", b" t", b" the", b"ab", b"bc", b"abc", b"aa", b"aaaa"])}
PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def test_encoder_merges():
    encoder = bpe.PrefixEncoder(RANKS)
    random.seed(1)
    for _ in range(3000):
        data = bytes(random.choice(b"abcthing ") for _ in range(random.randint(0, 14)))
        expected = encoder.merged(data) if data not in RANKS else [RANKS[data]]
        assert encoder.encode_piece(data) == expected
        assert encoder.decode(expected) == data


def test_appends_and_edits():
    encoder = bpe.PrefixEncoder(RANKS)
    random.seed(2)
    for _ in range(300):
        data = bytes(random.choice(b"abcthing ") for _ in range(30))
        table = encoder.extend(data, [])
        for end in range(31):  # the table of a prefix is a prefix of the table
            assert encoder.extend(data[:end], []) == table[:end]
        edited = data[:17] + bytes([random.choice(b"abcth")]) + data[18:] + b"the"
        ids, after = encoder.reencode(data, table, edited)
        assert ids == encoder.merged(edited) and after == encoder.extend(edited, [])


@pytest.mark.parametrize("table", ["awkward", "nothing", "documents"])
def test_bpe(table, request):
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    df, path = request.getfixturevalue(table), tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    public = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(df, path, tokenizers.PATTERN).collect()
    expected = []
    for i, t in both(df):
        ids = public.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids)))
    same([(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in got], expected)


# 3: decontamination


def alnum(text):
    return ALNUM.findall((text or "").translate(FOLD))


def hits(texts, items):
    windows = {}
    for i, t in items:
        words = alnum(t)
        for k in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[k : k + 10]), set()).add("" if i is None else str(i))
    lengths = {len(w) for w in windows}
    out = []
    for i, t in texts:
        words, hit, found = alnum(t), set(), set()
        for n in lengths:
            for k in range(len(words) - n + 1):
                if (w := tuple(words[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[w]
        out.append((i, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 300])
@pytest.mark.parametrize("table", ["awkward", "nothing", "documents"])
def test_decontamination(spark, table, block, request):
    df = request.getfixturevalue(table)
    if table == "documents":
        items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    else:
        items = [(1, "one two"), (2, "quick BROWN fox jumps over the lazy dog while seven wizards quietly"), (3, None), (4, ""), (5, "..."), (2, "one two"), (None, "another number 7 word2 is followed by another number 14"), (7, "number")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    if block == 300 and table == "documents":
        block = 4000
    got = decontaminate.report(df, benchmark, block_bytes=block).collect()
    expected = hits(both(df), items)
    same([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got], expected)
    left = decontaminate.clean(df, benchmark, block_bytes=block)
    assert left.schema == df.schema
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(e[0] for e in expected if not e[-1])


def test_longest_match(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x y " + " ".join(f"w{i}" for i in range(5, 30)) + " z " + " ".join(f"w{i}" for i in range(9)))], "doc_id long, text string")
    got = decontaminate.report(docs, items).first()
    assert got["longest"] == 25 and [tuple(s) for s in got["spans"]] == [(2, 27)]


def test_empty_benchmark(spark, awkward):
    got = decontaminate.report(awkward, spark.createDataFrame([], "item_id long, text string"))
    assert got.where("contaminated").count() == 0 and got.count() == awkward.count()


# 4: licenses

PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def license_base(text):
    words, places, labels = alnum(text), [], set()
    for phrase, label in PHRASES.items():
        at = [k for k in range(len(words) - len(phrase) + 1) if tuple(words[k : k + len(phrase)]) == phrase]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("table", ["awkward", "nothing", "documents"])
def test_licenses(table, request):
    df = request.getfixturevalue(table)
    got = licenses.detect(df).collect()
    same([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got], [(i, *license_base(t)) for i, t in both(df)])
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and r["labels"] == ",".join(sorted(set(r["labels"].split(","))))


def test_license_spans(spark):
    notice = dict((label, text) for label, text in licenses.TEMPLATES)
    bsd = notice["bsd"].split()
    edited = bsd[:6] + ["certainly"] + bsd[6:]  # an insertion: two neighbouring diagonals
    texts = ["words before " + notice["mpl"] + " and after", " ".join(edited), " ".join(bsd[:6]), "nothing of the kind", (notice["isc"] + " ") * 50]
    got = {r["doc_id"]: r["labels"] for r in licenses.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "mpl", 1: "bsd", 2: "", 3: "", 4: "isc"}


@pytest.mark.parametrize("template", range(len(licenses.TEMPLATES)))
def test_notices_one_after_another(spark, template):
    """However often a notice stands, and whatever stands between, its label is found."""
    label, text = licenses.TEMPLATES[template]
    rows = [(n, (text + between) * n) for n in (1, 2, 4, 9) for between in (". ",)] + [(100 + n, (text + " and " * n) * 4) for n in range(1, 6)]
    got = licenses.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(label in r["labels"].split(",") and r["score"] == 1.0 for r in got)
