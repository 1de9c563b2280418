"""Named queries of the corpus operators: thin callers with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrail.llm import (backoff, bagminhash, bitpack, hard_negatives, html_region, importance, lattice, licenses, mixing, packing,
                            rules, suffix, viterbi)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_lattice(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.near_vectors(_table(spark, folder, "embeddings"))


def op2_viterbi(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return viterbi.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_suffix_arrays(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), keep=["doc_id"])


def op5_bitpack(spark: SparkSession, folder: str) -> DataFrame:
    return bitpack.round_trip(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 50257)


def op6_backoff(spark: SparkSession, folder: str) -> DataFrame:
    return backoff.backoff_scores(_table(spark, folder, "documents"))


def op7_rule_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    ensemble = rules.learn(docs, _table(spark, folder, "labels"))
    return rules.classify(docs.select("doc_id", "text"), ensemble).select(
        "doc_id", rules.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_bagminhash(spark: SparkSession, folder: str) -> DataFrame:
    return bagminhash.near_duplicates(_table(spark, folder, "documents")).select("doc_id", "component_id", "kept")


def op9_html_region(spark: SparkSession, folder: str) -> DataFrame:
    return html_region.extract_main_text(_table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(_table(spark, folder, "documents"), wrapped=True)


def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").withColumn("label", F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op13_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_sizes(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice": op1_lattice, "op2_viterbi": op2_viterbi, "op3_packing": op3_packing, "op4_suffix_arrays": op4_suffix_arrays, "op5_bitpack": op5_bitpack,
    "op6_backoff": op6_backoff, "op7_rule_ensemble": op7_rule_ensemble, "op8_bagminhash": op8_bagminhash,
    "op9_html_region": op9_html_region, "op10_license_scan": op10_license_scan, "op11_importance": op11_importance,
    "op12_hard_negatives": op12_hard_negatives, "op13_mixing": op13_mixing,
}

WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op1_lattice": """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
valid AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
classes AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM classes LEFT JOIN degree USING (vec_id)""",
    "op4_suffix_arrays": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS.format("text")} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, w[i:i + least(13, len(w)) - 1] AS win
            FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, i, n, w[i:i + n - 1] AS win FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS t(i)),
found AS (SELECT r, i, n, item_id FROM places JOIN windows USING (n, win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS t(p) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
          FROM found GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""",
    "op6_backoff": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({WORDS.format("text")}, []) AS w FROM documents),
tokens AS (SELECT r, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
total AS (SELECT count(*) AS n FROM tokens),
singles AS (SELECT word, count(*) AS c FROM tokens GROUP BY word),
coded AS (SELECT r, i, word, c FROM tokens JOIN singles USING (word)),
pairs AS (SELECT r, i, word, c, lag(word) OVER (PARTITION BY r ORDER BY i) AS v, lag(c) OVER (PARTITION BY r ORDER BY i) AS cv FROM coded),
counted AS (SELECT v, word, count(*) AS n FROM pairs WHERE v IS NOT NULL GROUP BY ALL HAVING count(*) >= {backoff.LEAST}),
scored AS (SELECT r, n IS NOT NULL AS found, CASE WHEN pairs.v IS NULL THEN log10(c) - log10((SELECT n FROM total))
           WHEN n IS NOT NULL THEN log10(n) - log10(cv) ELSE log10({backoff.BACKOFF}) + log10(c) - log10((SELECT n FROM total)) END AS s
           FROM pairs LEFT JOIN counted USING (v, word)),
sums AS (SELECT r, sum(s) / count(*) AS score, count(*) FILTER (found) AS n_found FROM scored GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_found, 0) AS n_found, round(score, 6) AS score FROM d LEFT JOIN sums USING (r)""",
    "op8_bagminhash": f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS.format("text")} AS w FROM documents),
shingles AS (SELECT r, w[i:i + least(5, len(w)) - 1] AS s, count(*) AS n FROM d, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS t(i)
             WHERE len(w) > 0 GROUP BY ALL),
sizes AS (SELECT r, sum(n) AS size FROM shingles GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, sum(least(a.n, b.n)) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE common >= 0.8 * (x.size + y.size - common)),
reach(r, other) AS (SELECT r, r FROM d UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.other),
classes AS (SELECT reach.r, min(e.doc_id) AS component_id FROM reach JOIN d e ON e.r = reach.other GROUP BY reach.r)
SELECT doc_id, component_id, doc_id = component_id AS kept FROM d JOIN classes USING (r)""",
    "op10_license_scan": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, coalesce({WORDS.format("text")}, []) AS w FROM documents),
phrases(p, label) AS (VALUES {", ".join(f"({p.split()}, '{v}')" for p, v in licenses.PHRASES.items())}),
places AS (SELECT r, i - 1 AS i, label FROM d, phrases, unnest(range(1, len(w) - len(p) + 2)) AS t(i) WHERE w[i:i + len(p) - 1] = p),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY r),
templates(label, t) AS (VALUES {", ".join(f"('{v}', {sorted(set(t.split()))})" for v, t in licenses.TEMPLATES)}),
blocks AS (SELECT r, {WORDS.format("block")} AS b FROM d, unnest(string_split(text, chr(10))) AS u(block)),
met AS (SELECT r, label, len(list_intersect(t, b)) / len(t) AS c FROM blocks, templates WHERE len(list_intersect(t, b)) >= ceil({licenses.THRESHOLD} * len(t) - 1e-9)),
own AS (SELECT r, list(DISTINCT label) AS labels, max(c) AS c FROM met GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN own USING (r)""",
    "op11_importance": f"""
WITH RECURSIVE table_(t) AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))),
texts AS (SELECT row_number() OVER () AS r, 's' AS side, doc_id, text FROM documents
          UNION ALL SELECT row_number() OVER (), 't', NULL, text FROM benchmark),
d AS (SELECT side, r, doc_id, coalesce({WORDS.format("text")}, []) AS w FROM texts),
runs AS (SELECT side, r, array_to_string(w[i:i + n - 1], ' ') AS f FROM d, unnest([1, 2, 3]) AS u(n), unnest(range(1, len(w) - n + 2)) AS t(i)),
features AS (SELECT f, hex(encode(f)) AS h FROM runs GROUP BY f),
bytes AS (SELECT f, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM features),
codes AS (SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
          FROM bytes, table_),
counted AS (SELECT side, r, bucket, count(*) AS n FROM runs JOIN codes USING (f) GROUP BY ALL),
buckets AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM counted GROUP BY bucket),
totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM buckets),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000)))) AS BIGINT) AS g FROM buckets, totals),
sums AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight FROM counted JOIN gain USING (bucket) WHERE side = 's' GROUP BY r),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
           (CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
           FROM d LEFT JOIN sums USING (r) WHERE side = 's'),
ranked AS (SELECT *, row_number() OVER (ORDER BY n_words >= 20 DESC, score DESC, doc_id NULLS FIRST, n_features, weight) AS k,
           5 * count(*) FILTER (n_words >= 20) OVER () // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= drawn THEN k END AS rank FROM ranked""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, row_number() OVER () AS r,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.r AS a, b.r AS b, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS s
          FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
positives AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, vec_id, b) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.vec_id, n.b) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM positives p JOIN pairs n ON n.a = p.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s QUALIFY rank <= 3""",
    "op13_mixing": """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3 * source_size AS cap FROM sources),
levels AS (SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / (sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
filled AS (SELECT coalesce(max(level) FILTER (w * level <= cap), 'inf'::DOUBLE) AS level FROM levels),
plan AS (SELECT source, source_size, least(w * filled.level, cap::DOUBLE) AS target FROM weighed, filled),
budget AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM plan),
places AS (SELECT d.*, source_size, target, copies, CAST(floor(target) AS BIGINT) - copies * source_size AS rest,
           sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(size) OVER (PARTITION BY d.source, h) AS before,
           count(*) OVER (PARTITION BY d.source, h) AS ties FROM d JOIN budget ON d.source IS NOT DISTINCT FROM budget.source)
SELECT doc_id, size, source_size, target, CAST(copies * size + greatest(0, least(size, floor((rest - before) / ties))) AS BIGINT) AS taken FROM places""",
}
