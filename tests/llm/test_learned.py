"""Operators that learn: 1 toxicity and 8 language."""

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import bytekit as bk
from tessera.llm import language, toxicity
from tests.llm import conftest as cases

LABELS = "doc_id long, quality int, toxic int"


# 8: language


def test_languages_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language.fold("doc_id", 4) == 2
    profiles = language.fit(df.where(~held))
    got = language.predict(df.where(held), profiles).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("table", ["awkward", "nothing"])
def test_language_cases(table, request, documents):
    df = request.getfixturevalue(table)
    for profiles in (language.fit(documents), language.fit(df), {}):
        got = language.predict(df, profiles).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in df.collect())
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        for r in got:
            if not any(c.isalpha() for c in texts[r["doc_id"]] or "") or not profiles:
                assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            else:
                assert r["lang_pred"] in profiles


def grams(text):
    """Counts of the n-grams of one to three letters, and of letters beside a blank, of a text's words."""
    low = "".join((c.lower()[0] if unicodedata.category(c)[0] == "L" else " ") for c in text or "")
    out = Counter()
    for word in low.split():
        padded = f" {word} "
        out.update(word)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def ranking(counts, ranked):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:ranked]]


def number(gram):
    return sum(ord(c) << 21 * (2 - i) for i, c in enumerate(gram))


def nearest(text, profiles, ranked):
    own = ranking(grams(text), ranked)
    apart = {lang: sum(abs(p.index(g) - i) if g in p else ranked for i, g in enumerate(own)) for lang, p in profiles.items()}
    if not own or not profiles:
        return "und", 0.0
    best = min(apart, key=lambda lang: (apart[lang], lang))
    return best, 1 - apart[best] / (len(own) * ranked)


@pytest.mark.parametrize("table,ranked", [("awkward", 300), ("awkward", 7), ("documents", 300)])
def test_languages_by_brute_force(table, ranked, request, spark):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in df.collect()]
    totals = {}
    for _, text, lang in rows:
        if lang is not None:
            totals.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: ranking(n, ranked) for lang, n in totals.items()}
    got = language.fit(df, ranked=ranked)
    assert {lang: p.tolist() for lang, p in got.items()} == {lang: [number(g) for g in p] for lang, p in profiles.items()}
    found = Counter((r["doc_id"], r["lang_pred"], round(r["score"], 12)) for r in language.predict(df, got, ranked=ranked).collect())
    assert found == Counter((i, lang, round(score, 12)) for i, lang, score in ((i, *nearest(t, profiles, ranked)) for i, t, _ in rows))


def test_languages_of_other_scripts(spark):
    """Letters of any script stand for themselves."""
    texts = {"ru": "съешь же ещё этих мягких французских булок да выпей чаю", "uk": "чуєш їх доцю га кумедна ж ти прощайся без ґольфів", "el": "ξεσκεπάζω την ψυχοφθόρα βδελυγμία", "ja": "いろはにほへと ちりぬるを わかよたれそ"}
    df = spark.createDataFrame([(lang, t) for lang, t in texts.items()], "lang string, text string")
    queries = spark.createDataFrame([(1, "этих французских булок"), (2, "доцю кумедна їх"), (3, "την ψυχοφθόρα"), (4, "ちりぬるを")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.predict(queries, language.fit(df)).collect()} == {1: "ru", 2: "uk", 3: "el", 4: "ja"}


# 1: toxicity


def test_composition_is_one_after_another():
    import random

    first, second = toxicity.negation(), toxicity.reported()
    both = first.then(second)
    random.seed(6)
    for _ in range(200):
        symbols = [random.randrange(6) for _ in range(12)]
        q = p = c = 0
        for s in symbols:
            q, written, w = first.arcs[q, s]
            p, out, v = second.arcs[p, written]
            c, composed, weight = both.arcs[c, s]
            assert (composed, weight) == (out, w * v) and c == q * second.states + p


def test_grammar(spark):
    texts = {"plain": "He is an idiot.", "denied": "He is not an idiot.", "quoted": "She said that he was an idiot.", "none": "He is a teacher.", "threat": "I will kill you", "target": "you will, i hurt", "parting": "Kill the lights, please."}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, toxicity.Model(units={0: {toxicity._hash("idiot"): 2.0}})).collect()}
    assert got["plain"] > got["quoted"] > got["denied"] > got["none"]
    assert got["target"] > got["none"] == got["parting"]


ALNUM = re.compile(rb"[0-9a-z\x80-\xff]+")
SYMBOL = {w.encode(): kind for kind, words in toxicity.WORDS.items() if kind != toxicity.INSULT for w in words}


def unit(part):
    chunk = bk.Chunk(pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], names=["text"]), "text")
    return int(chunk.span_hash(np.array([0]), np.array([len(part)]))[0])


def clauses(text):
    """Words of each clause: a new one begins behind a mark of its end."""
    low, out, end = (text or "").encode().lower(), [], 0
    for m in ALNUM.finditer(low):
        if not out or re.search(rb"[.!?;\n]", low[end : m.start()]):
            out.append([])
        out[-1].append(m.group())
        end = m.end()
    return out


def units_of(words):
    return {(0, unit(w)) for w in words} | {(n, unit(w[:n])) for w in words for n in range(4, 9) if len(w) >= n}


def brute_score(text, model):
    """Word by word through the three transducers, one after another."""
    machines, total, matched = (toxicity.negation(), toxicity.reported(), toxicity.scoring()), 0.0, 0
    for words in clauses(text):
        state, clause = [0, 0, 0], 0.0
        for w in words:
            weight = max([model.units.get(0, {}).get(unit(w), 0.0)] + [model.units.get(n, {}).get(unit(w[:n]), 0.0) for n in range(4, 9) if len(w) >= n])
            symbol = SYMBOL.get(w, toxicity.INSULT if weight > 0 else toxicity.OTHER)
            weight = 2.0 if symbol == toxicity.THREAT else weight
            for k, machine in enumerate(machines):
                state[k], symbol, factor = machine.arcs[state[k], symbol]
            clause += factor * weight  # only the last one weighs
        total, matched = total + clause, matched + (clause > 0)
    return 1 / (1 + math.exp(-max(-30, min(30, model.bias + model.slope * math.log1p(total))))), matched


@pytest.mark.parametrize("table", ["awkward", "documents"])
def test_toxicity_by_brute_force(spark, table, request):
    """Scores of every text, and which words are learned, against plain loops."""
    df, labels = request.getfixturevalue(table), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.fit(df, labels, least_texts=2, least_contexts=1)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = Counter((r["doc_id"], round(r["score"], 9), r["n_clauses"], r["predicted"]) for r in toxicity.score(df, model).collect())
    expected = [(i, *brute_score(t, model)) for i, t in rows]
    assert got == Counter((i, round(s, 9), n, int(s >= 0.7)) for i, s, n in expected)

    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    texts = [(t, known[i]) for i, t in rows if i is not None and known.get(i) is not None]
    toxic, clean = sum(y for _, y in texts), sum(1 - y for _, y in texts)
    n, m = Counter(), Counter()
    for t, y in texts:
        (n if y else m).update(units_of([w for c in clauses(t) for w in c]))
    learned = {(0, unit(w.encode())) for w in toxicity.WORDS[toxicity.INSULT]}
    for u, often in n.items():
        odds = math.log((often + 0.5) / (toxic + 1)) - math.log((m[u] + 0.5) / (clean + 1))
        if often >= 2 and odds >= 3.0 and m[u] <= 0.03 * often:
            learned.add(u)
            assert model.units[u[0]][u[1]] == pytest.approx(min(odds, 6.0) / 3.0)
    if toxic and clean:
        assert {(length, h) for length, hashes in model.units.items() for h in hashes} == learned


def test_isolated_words_weigh_less(spark):
    """The same insult counts by its clause: alone, behind another, behind a target."""
    model = toxicity.Model(units={0: {toxicity._hash("idiot"): 2.0}})
    texts = ["an idiot", "an idiot and idiot", "you idiot", "idiot. an", "never an idiot"]
    got = [r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert got[0] == got[3] < got[2] < got[1] and got[4] < got[0] < 0.7


def test_toxic_held_out(spark):
    folder = "/root/testdata/sf0.1"
    df, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = language.fold("doc_id", 3) == 1
    model = toxicity.fit(df, labels.where(~held))
    got = toxicity.score(df.where(held), model).join(labels, "doc_id").collect()
    toxic, clean = [r for r in got if r["toxic"]], [r for r in got if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) > 0.7 * len(toxic)  # a tenth of the labels has no toxic word
    assert sum(r["predicted"] for r in clean) < 0.01 * len(clean)


@pytest.mark.parametrize("table", ["awkward", "nothing"])
def test_toxic_cases(spark, table, request):
    df = request.getfixturevalue(table)
    labels = spark.createDataFrame([(1, 1, 0), (5, None, 1), (6, 1, 1), (7, 0, None), (None, 1, 1), (5, 1, 1), (99, 1, 0)], LABELS)
    for known in (labels, labels.limit(0)):
        model = toxicity.fit(df, known, least_texts=1, least_contexts=1)
        got = toxicity.score(df, model).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in df.collect())
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_cases_are_awkward():
    assert None in cases.TEXTS and "" in cases.TEXTS
