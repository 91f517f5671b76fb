"""The n-gram Jaccard join against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import jaccard

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def shingles(text, n=5):
    words = SPACED.findall((text or "").translate(FOLD))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    inverted = {}
    for i, s in enumerate(sets):
        for x in s:
            inverted.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in inverted[x] if j < i)
        for j, both in common.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def got(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect())


@pytest.mark.parametrize("table", ["awkward", "nothing", "documents"])
def test_join(table, request):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert got(df) == expected(rows)
    kept = jaccard.keep_one(df)
    assert kept.schema == df.schema


def test_keep_one_of_repeated_rows_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a, 1), (3, a, 1), (3, a, 2), (4, a, 1), (None, a, 1), (None, b, 1), (None, b, 1), (None, b + " end", 2), (3, c, 1), (5, c, 1), (6, None, 1), (None, "", 1), (None, "", 1)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, place int").repartition(3)).collect()
    assert Counter((r["doc_id"], (r["text"] or "-")[0]) for r in kept if r["text"]) == {(3, "a"): 1, (None, "b"): 1, (3, "c"): 1}
    assert Counter((r["doc_id"], r["text"]) for r in kept if not r["text"]) == {(6, None): 1, (None, ""): 2}


def near_copies(seed, bases, copies, words):
    random.seed(seed)
    out = []
    for b in range(bases):
        base = [f"w{random.randint(0, 4000)}" for _ in range(random.randint(*words))]
        out.append(" ".join(base))
        for _ in range(copies):
            copy = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 25))):
                at = random.randrange(len(copy))
                copy[at : at + random.choice([0, 1])] = [f"x{random.randint(0, 9999)}"] * random.choice([0, 1, 2])
            out.append(" ".join(copy))
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("words", [(3, 14), (15, 60), (100, 400)])
def test_near_copies(spark, words):
    rows = near_copies(words[0], 12, 30, words)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df) == expected(rows)


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rows = near_copies(7, 2, 120, (60, 90))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_fine_bands(spark, monkeypatch):
    """A band with too few partitions filled is done again, shingle by shingle."""
    first = jaccard.signatures

    def starved(sets, rows, percent, fine):
        sig, owner, short = first(sets, rows, percent, fine)
        return sig, owner, short | ({6} - set(fine))

    monkeypatch.setattr(jaccard, "signatures", starved)
    rows = near_copies(8, 6, 10, (60, 120))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(5)

    class Sets:
        pass

    for _ in range(50):
        a = np.unique(rng.integers(0, 2**60, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 2**60, 30, dtype=np.uint64)]))
        sets = Sets()
        sets.value, sets.first = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        sets.size = np.diff(sets.first)
        bits = jaccard._folded(jaccard.bitmaps(sets))
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(a, b))


def test_words_that_rolling_hashes_confuse(spark):
    """Two words that are one under any polynomial modulo a power of two."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper())]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_keep_one_goes_by_row(spark):
    """An id that stands for two texts loses only the one that has a smaller copy."""
    rows = [(3, "one text of six short words"), (5, "one text of six short words"), (5, "another text with quite different words")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == [rows[0], rows[2]]
