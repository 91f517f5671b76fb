"""The registered queries of the text operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, jaccard, language, licenses, ngram_lm, quality, repeats, sharding, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels.where(language.fold("doc_id", 3) != 1))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", (language.fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "n_clauses")


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 16).drop("digest")


def op3_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("longest", "spans")


def op4_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.detect(_table(spark, sf_dir, "documents"))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents"))


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = language.fold("doc_id", 10)
    scored = ngram_lm.score(_table(spark, sf_dir, "documents"), held_out=fold == 0, deleted=fold == 9)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_ids=False)


def op8_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    fold = language.fold("doc_id", 4)
    profiles = language.fit(documents.where(fold != 2))
    return language.predict(documents, profiles).select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(_table(spark, sf_dir, "documents"), passage=repeats.PASSAGE).drop("spans")


def op10_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxic_grammar": op1_toxic_grammar,
    "op2_minimax_shards": op2_minimax_shards,
    "op3_suffix_decontamination": op3_suffix_decontamination,
    "op4_license_diagonals": op4_license_diagonals,
    "op5_line_quality": op5_line_quality,
    "op6_deleted_interpolation": op6_deleted_interpolation,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_rank_order_language": op8_rank_order_language,
    "op9_suffix_repeats": op9_suffix_repeats,
    "op10_partenum_join": op10_partenum_join,
}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"""regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
_SPACED = f"""regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+')"""

#: A byte b's step of CRC-32 from c, bit by bit.
_CRC_STEP = "xor(c, b)"
for _ in range(8):
    _CRC_STEP = f"list_transform([{_CRC_STEP}], lambda z: CASE WHEN z % 2 = 1 THEN xor(z // 2, 3988292384) ELSE z // 2 END)[1]"
_MARK = r"[!-/:-@\[-`{-~]"
_BOILER = " OR ".join(f"contains(low, '{p.decode()}')" for p in quality.BOILERPLATE)


def _template_rows() -> str:
    """The license templates as rows (t, label, words)."""
    return ", ".join(f"({t}, '{label}', '{text}')" for t, (label, text) in enumerate(licenses.TEMPLATES))


ORACLE_SQL: dict[str, str] = {
    "op2_minimax_shards": """
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda b: {table}) AS tab),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) + 1 AS size, md5(coalesce(text, '')) AS digest FROM documents),
crc AS (SELECT DISTINCT digest, xor(list_reduce(list_transform(range(1, CAST(size AS BIGINT)), lambda i: CAST('0x' || hex(b[i : i]) AS BIGINT)), lambda c, x: xor(tab[xor(c, x) % 256 + 1], c // 256), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM (SELECT DISTINCT digest, b, size FROM d), tab),
g AS (SELECT digest, sum(size)::BIGINT AS total FROM d GROUP BY 1), t AS (SELECT sum(total)::BIGINT AS t FROM g),
giant(l, n, more) AS (SELECT []::VARCHAR[], 16, TRUE UNION ALL SELECT list_concat(l, new), n - len(new), len(new) > 0 FROM (SELECT l, n, coalesce((SELECT list(digest ORDER BY total DESC, digest) FROM g, t WHERE total > (t.t - (SELECT coalesce(sum(total), 0) FROM g h WHERE list_contains(l, h.digest))) / n::DOUBLE AND NOT list_contains(l, digest)), [])[1 : n - 1] AS new FROM giant WHERE more AND n > 1)),
gl AS (SELECT l, n FROM giant ORDER BY n, more LIMIT 1),
rest AS (SELECT digest, total, sum(total) OVER (ORDER BY digest)::BIGINT AS upto FROM g, gl WHERE NOT list_contains(l, digest)), cum AS (SELECT list(upto ORDER BY upto) AS c, max(upto) AS tot, max(total) AS most, any_value(n) AS n FROM rest, gl),
search(low, high, k, pos) AS (SELECT greatest(-(-tot // n), most), tot, 0, 0::BIGINT FROM cum UNION ALL
  SELECT CASE WHEN reach < tot AND k + 1 = n THEN middle + 1 ELSE low END, CASE WHEN reach = tot THEN middle ELSE high END, CASE WHEN reach = tot OR k + 1 = n THEN 0 ELSE k + 1 END, CASE WHEN reach = tot OR k + 1 = n THEN 0 ELSE reach END
  FROM (SELECT *, (low + high) // 2 AS middle, list_max(list_filter(c, lambda u: u <= pos + (low + high) // 2)) AS reach FROM search, cum WHERE low < high)),
cap AS (SELECT max(low) AS cap FROM search WHERE low = high),
cut(k, pos) AS (SELECT 0, 0::BIGINT UNION ALL SELECT k + 1, list_max(list_filter(c, lambda u: u <= pos + cap)) FROM cut, cum, cap WHERE pos < tot),
placed AS (SELECT digest, len(l) + (SELECT count(*) FROM cut WHERE k > 0 AND pos <= upto - total) AS shard FROM rest, gl UNION ALL SELECT unnest(l), unnest(range(CAST(len(l) AS BIGINT))) FROM gl)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id || '/' || digest), doc_id, digest) - 1 AS slot, NULL::INT AS grown_shard FROM d JOIN crc USING (digest) JOIN placed USING (digest)""".format(table=_CRC_STEP.replace("xor(c, b)", "b")),
    "op4_license_diagonals": f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT doc_id, w, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS i FROM d WHERE len(w) > 0),
hit AS (SELECT doc_id, i, CASE WHEN w[i] = 'mit' AND w[i + 1] = 'license' THEN 'mit' WHEN w[i] = 'apache' AND w[i + 1] = 'license' THEN 'apache' WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' END AS label FROM b),
base AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS z, list(DISTINCT label) AS labels FROM hit WHERE label IS NOT NULL GROUP BY 1),
tw AS (SELECT t, label, {_ALNUM} AS w FROM (VALUES {_template_rows()}) v(t, label, text)), tg AS (SELECT t, label, len(w) - 2 AS places, unnest(range(1, CAST(len(w) - 1 AS BIGINT))) AS tp, unnest(list_transform(range(1, CAST(len(w) - 1 AS BIGINT)), lambda i: w[i : i + 2])) AS g FROM tw),
vote AS (SELECT doc_id, t, label, places, i - tp AS diagonal, tp, i FROM b JOIN tg ON g = w[i : i + 2]),
diag AS (SELECT doc_id, t, label, places, diagonal, list(DISTINCT tp) AS covered, min(i) AS first, max(i) AS last FROM vote GROUP BY 1, 2, 3, 4, 5),
alone AS (SELECT *, len(covered) >= 0.6::DOUBLE * places AS whole FROM diag),
head AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= least(4, places // 2) AND NOT whole AND NOT lag(whole) OVER o THEN 0 ELSE 1 END AS h FROM alone WINDOW o AS (PARTITION BY doc_id, t ORDER BY diagonal)),
band AS (SELECT *, sum(h) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS k FROM head), span AS (SELECT doc_id, t, label, places, len(list_distinct(flatten(list(covered)))) AS n, min(first) AS first, max(last) + 3 AS beyond FROM band GROUP BY doc_id, t, label, places, k),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(n / places::DOUBLE) AS coverage FROM span WHERE n >= 0.6::DOUBLE * places AND beyond - first <= 1.5::DOUBLE * (places + 2) + 4 GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels, greatest(coalesce(coverage, 0), CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END) AS score
FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id""",
    "op5_line_quality": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, CAST(len(w) - 6 AS BIGINT))) AS i, unnest(list_transform(range(1, CAST(len(w) - 6 AS BIGINT)), lambda i: array_to_string(w[i : i + 7], ' '))) AS g FROM d WHERE len(w) >= 8),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1), rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1),
l0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, unnest(range(CAST(len(string_split(t, chr(10))) AS BIGINT))) AS k FROM d),
l1 AS (SELECT doc_id, k, l, {_FOLD.format("l")} AS low, regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+') AS w FROM l0),
l2 AS (SELECT *, len(w) AS n, list_sum(list_transform(w, lambda x: strlen(x))) AS solid, len(regexp_extract_all(l, '{_MARK}')) AS marks, len(regexp_extract_all(l, '[|<>]')) AS dividers,
  len(list_filter(w, lambda x: len(x) > 1 AND x[-1] = x[-2] AND regexp_matches(x[-1], '{_MARK}'))) AS bangs, len(list_filter(range(2, CAST(len(w) + 1 AS BIGINT)), lambda i: w[i] = w[i - 1])) AS stutters, regexp_matches(l, '[.!?]|[^\\x00-\\x7F]') AS stopped FROM l1 WHERE len(w) > 0),
l3 AS (SELECT *, (marks >= 3 AND marks > 0.25::DOUBLE * solid) OR bangs > 0.5::DOUBLE * n OR stutters > 0.35::DOUBLE * n OR (NOT stopped AND n > 60) OR (dividers >= 3 AND dividers > 0.2::DOUBLE * n) OR (n <= 12 AND ({_BOILER})) AS failed,
  row_number() OVER (PARTITION BY doc_id, l ORDER BY k) > 1 AS again FROM l2),
m AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (failed) AS n_failed, count(*) FILTER (again) AS n_dup, coalesce(sum(solid) FILTER (failed), 0) / sum(solid)::DOUBLE AS lost FROM l3 GROUP BY 1),
c AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_failed, 0) AS n_failed_lines, coalesce(lost, 0)::DOUBLE AS lost_share FROM d LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_share <= 0.35::DOUBLE AS kept FROM c""",
    "op8_rank_order_language": """
WITH crc AS (SELECT doc_id, list_reduce(list_transform(range(len(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[CAST(i + 1 AS BIGINT)]) AS BIGINT)), lambda c, b: {step}, 4294967295::BIGINT) AS c FROM documents),
d AS (SELECT doc_id, lang, xor(c, 4294967295) % 4 AS fold, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') AS w FROM documents JOIN crc USING (doc_id)),
s AS (SELECT doc_id, lang, fold, string_split(' ' || array_to_string(w, ' ') || ' ', '') AS s FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, lang, fold, s[i - 1] AS a, s[i] AS k, s[i + 1] AS b FROM (SELECT *, unnest(range(2, CAST(len(s) AS BIGINT))) AS i FROM s)),
g AS (SELECT doc_id, lang, fold, k AS g FROM p WHERE k <> ' ' UNION ALL SELECT doc_id, lang, fold, k || b FROM p WHERE k <> ' ' UNION ALL SELECT doc_id, lang, fold, a || k FROM p WHERE k <> ' ' AND a = ' ' UNION ALL SELECT doc_id, lang, fold, a || k || b FROM p WHERE k <> ' '),
n AS (SELECT doc_id, lang, fold, g, count(*) AS n FROM g GROUP BY ALL), own AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) AS r FROM n QUALIFY r <= 300),
pr AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) AS r FROM n WHERE lang IS NOT NULL AND fold <> 2 GROUP BY lang, g QUALIFY r <= 300),
apart AS (SELECT o.doc_id, l.lang, sum(CASE WHEN pr.r IS NULL THEN 300 ELSE abs(pr.r - o.r) END) AS x, count(*) AS m FROM own o CROSS JOIN (SELECT DISTINCT lang FROM pr) l LEFT JOIN pr ON pr.lang = l.lang AND pr.g = o.g GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY x, lang) AS k FROM apart)
SELECT d.doc_id, fold = 2 AS held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(1 - x::DOUBLE / (m * 300), 0.0)::DOUBLE AS score FROM d LEFT JOIN best ON best.doc_id = d.doc_id AND k = 1""".format(step=_CRC_STEP),
    "op3_suffix_decontamination": f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark),
t AS (SELECT item, least(10, len(w)) AS n, unnest(list_transform(range(1, CAST(len(w) - least(10, len(w)) + 2 AS BIGINT)), lambda i: array_to_string(w[i : i + least(10, len(w)) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM t),
g AS (SELECT doc_id, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i, unnest(list_transform(range(1, CAST(len(w) - n + 2 AS BIGINT)), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS g FROM d, lengths WHERE len(w) >= n),
m AS (SELECT g.doc_id, g.i, g.n, t.item FROM g JOIN t ON t.g = g.g AND t.n = g.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, CAST(i + n AS BIGINT))) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY 1),
k AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op9_suffix_repeats": r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, b, unnest(range(1, CAST(n - 398 AS BIGINT))) AS i FROM d WHERE n >= 400), g AS (SELECT doc_id, i, md5(b[i : i + 399]) AS g FROM p),
m AS (SELECT doc_id, i FROM g WHERE g IN (SELECT g FROM g GROUP BY 1 HAVING count(*) > 1)),
h AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS h FROM m),
k AS (SELECT doc_id, i, sum(h) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM h), s AS (SELECT doc_id, min(i) AS a, max(i) + 399 AS z FROM k GROUP BY doc_id, k),
c AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS f, a - 1 AS t FROM s UNION ALL SELECT doc_id, max(z) + 1, NULL FROM s GROUP BY 1),
x AS (SELECT doc_id, sha256(unhex(string_agg(CASE WHEN coalesce(t, n) >= f THEN hex(b[f : coalesce(t, n)]) ELSE '' END, '' ORDER BY f))) AS kept FROM c JOIN d USING (doc_id) GROUP BY 1),
r AS (SELECT doc_id, CAST(sum(z - a + 1) AS BIGINT) AS removed, count(*) AS spans FROM s GROUP BY 1),
pp AS (SELECT doc_id, b, unnest(range(1, CAST(n - 198 AS BIGINT))) AS i FROM d WHERE n >= 200), pg AS (SELECT doc_id, i, md5(b[i : i + 199]) AS g FROM pp),
pm AS (SELECT doc_id, i FROM pg WHERE g IN (SELECT g FROM pg GROUP BY 1 HAVING count(*) > 1)),
ph AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS h FROM pm),
pk AS (SELECT doc_id, i, sum(h) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM ph), ps AS (SELECT doc_id, min(i) AS a, max(i) + 199 AS z FROM pk GROUP BY doc_id, k),
y AS (SELECT doc_id, i, b[i : i] NOT IN ('\x20'::BLOB, '\x09'::BLOB, '\x0A'::BLOB, '\x0B'::BLOB, '\x0C'::BLOB, '\x0D'::BLOB) AS w FROM (SELECT doc_id, b, unnest(range(1, CAST(n + 1 AS BIGINT))) AS i FROM d WHERE doc_id IN (SELECT doc_id FROM ps))),
e AS (SELECT doc_id, i, w AND NOT coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS f, w AND NOT coalesce(lead(w) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS t FROM y),
wf AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e WHERE f), wt AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e WHERE t),
q AS (SELECT ps.doc_id, a, z FROM ps JOIN wf ON wf.doc_id = ps.doc_id AND wf.i >= a JOIN wt ON wt.doc_id = wf.doc_id AND wt.k = wf.k AND wt.i <= z GROUP BY 1, 2, 3 HAVING count(*) >= 51),
qs AS (SELECT doc_id, CAST(sum(z - a + 1) AS BIGINT) AS passage FROM q GROUP BY 1)
SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, coalesce(kept, sha256(b)) AS kept_sha256, coalesce(passage, 0) AS n_passage
FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN qs ON qs.doc_id = d.doc_id""",
    "op10_partenum_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, CAST(greatest(len(w) - 3, 2) AS BIGINT)), lambda i: array_to_string(w[i : i + 4], ' ') || '#' || least(len(w), 5))) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id FROM d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
}
