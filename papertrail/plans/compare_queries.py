"""Queries over exhibit-reference comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail.functions import scalars as S
from papertrail.operators import compare as P
from papertrail.operators import regions as R
from papertrail.operators import words as W
from papertrail.plans import bindings as B
from papertrail.plans import word_queries  # noqa: F401 (its CTEs)
from papertrail import constants as C
from papertrail.plans.registry import cte, query, similarity_cte


def evidence_fields(t):
    text = F.concat(F.lit("R-"), F.col("o_custkey").cast("string"), F.lit("-"), F.col("o_orderpriority"))
    return _order_fields(t, 0, text, F.lit(0.0))


def reference_fields(t):
    """Same field types shifted by one; texts equal, cut short, close or unrelated by customer."""
    key, kind = F.col("o_custkey"), F.col("o_custkey") % 4
    whole = F.concat(F.lit("R-"), key.cast("string"), F.lit("-"), F.col("o_orderpriority"))
    text = (F.when(kind == 0, F.upper(whole)).when(kind == 1, F.concat(F.lit("R-"), key.cast("string")))
            .when(kind == 2, F.concat(F.lit("R-"), (key + 1).cast("string"), F.lit("-"), F.col("o_orderpriority")))
            .otherwise(F.concat(F.lit("ISSUED "), F.col("o_orderstatus"))))
    return _order_fields(t, 1, text, (F.col("o_orderkey") % 3) * 0.05)


def _order_fields(t, shift, text, dx):
    rows = t.orders.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return rows.select(
        F.col("o_orderkey").alias("case_id"), F.col("i").alias("ord"),
        B._field_type(F.col("o_orderkey") + F.col("i") + shift).alias("field_type"), text.alias("raw_text"),
        S.normalize_text(text).alias("normalized_text"), F.lit(0.8).alias("confidence"),
        F.struct(((F.col("o_custkey") % 60) / 100 + dx).alias("x"), ((F.col("o_orderkey") % 60) / 100).alias("y"),
                 F.lit(0.2).alias("width"), F.lit(0.1).alias("height")).alias("bbox"))


def joined(t):
    return P.join_fields(evidence_fields(t), reference_fields(t))


_ev = "'R-' || o_custkey || '-' || o_orderpriority"
cte("order_fields", f"""
  SELECT coalesce(a.case_id, b.case_id) AS case_id, coalesce(a.field_type, b.field_type) AS field_type,
         a.raw AS ev_text, b.raw AS ref_text, a.x AS ax, b.x AS bx,
         CASE WHEN b.raw IS NULL THEN 'OCR_FIELD_ADDED' WHEN a.raw IS NULL THEN 'OCR_FIELD_REMOVED' ELSE 'BOTH' END AS change
  FROM (SELECT o_orderkey AS case_id, ({B._field_types})[(o_orderkey + i) % 11 + 1] AS field_type, {_ev} AS raw,
               (o_custkey % 60) / 100::DOUBLE AS x FROM orders CROSS JOIN (SELECT unnest([0, 1, 2]) AS i)) a
  FULL JOIN (SELECT o_orderkey AS case_id, ({B._field_types})[(o_orderkey + i + 1) % 11 + 1] AS field_type,
               CASE o_custkey % 4 WHEN 0 THEN upper({_ev}) WHEN 1 THEN 'R-' || o_custkey
                 WHEN 2 THEN 'R-' || (o_custkey + 1) || '-' || o_orderpriority ELSE 'ISSUED ' || o_orderstatus END AS raw,
               (o_custkey % 60) / 100::DOUBLE + (o_orderkey % 3) * 0.05::DOUBLE AS x
             FROM orders CROSS JOIN (SELECT unnest([0, 1, 2]) AS i)) b
    ON a.case_id = b.case_id AND a.field_type = b.field_type""")


@query("field_full_outer", """
  SELECT case_id, field_type, change, ev_text, ref_text, CASE WHEN change <> 'BOTH' THEN 0.82::DOUBLE END AS confidence
  FROM order_fields""", ("order_fields",))
def _(t):
    return joined(t).select("case_id", "field_type", "change", "ev_text", "ref_text",
                            F.when(F.col("change") != "BOTH", 0.82).alias("confidence"))


cte("order_pairs", f"""
  SELECT *, {B.NORM_SQL.format(t='ev_text')} AS ev, {B.NORM_SQL.format(t='ref_text')} AS ref FROM order_fields WHERE change = 'BOTH'""",
    "order_fields")
similarity_cte("field_ratio", "SELECT ref AS a, ev AS b FROM order_pairs WHERE ref <> ev", "order_pairs")
_identifiers = ", ".join(f"'{x}'" for x in C.IDENTIFIER_FIELDS)
cte("order_states", f"""
  SELECT *, CASE WHEN same THEN 'MATCH' WHEN tail_only THEN 'UNRELIABLE_OCR' WHEN ratio >= 0.86::DOUBLE THEN 'LIKELY_MATCH'
                 WHEN ratio >= 0.55::DOUBLE THEN 'LIKELY_MISMATCH' ELSE 'MISMATCH' END AS state,
         CASE WHEN same THEN 0.98::DOUBLE WHEN tail_only THEN 0.48 WHEN ratio >= 0.86::DOUBLE THEN CASE WHEN identifier THEN 0.62 ELSE 0.68 END
              WHEN ratio >= 0.55::DOUBLE THEN 0.68 WHEN field_type = 'name' THEN 0.90 ELSE 0.82 END AS confidence
  FROM (SELECT *, ev = ref AS same, identifier AND len(e) - len(r) BETWEEN 1 AND 2 AND e[1:len(r)] = r
               AND len(list_filter(e[len(r) + 1:], lambda x: len(x) > 8)) = 0 AS tail_only
        FROM (SELECT *, string_split(ev, ' ') AS e, string_split(ref, ' ') AS r, field_type IN ({_identifiers}) AS identifier FROM order_pairs)
        LEFT JOIN field_ratio ON a = ref AND b = ev)""", "order_pairs", "field_ratio")


@query("field_states", """
  SELECT case_id, field_type, state, confidence, CASE WHEN NOT (same OR tail_only) THEN fix(ratio, 4) END AS similarity
  FROM order_states""", ("order_states",))
def _(t):
    return P.field_states(joined(t)).select("case_id", "field_type", "state", "confidence",
                                            S.fix("similarity", 4).alias("similarity"))


@query("field_position_change", """
  SELECT case_id, field_type, 'OCR_FIELD_POSITION_CHANGE' AS type, fix(abs(bx - ax), 4) AS displacement, 0.72::DOUBLE AS confidence
  FROM order_states WHERE state IN ('MATCH', 'LIKELY_MATCH') AND abs(bx - ax) > 0.08::DOUBLE""", ("order_states",))
def _(t):
    same = P.field_states(joined(t)).filter(F.col("state").isin("MATCH", "LIKELY_MATCH"))
    return P.position_change(same).withColumn("displacement", S.fix("displacement", 4))


def field_findings(t):
    """What the comparison of all fields of both sides finds."""
    return P.field_findings(joined(t))


def mismatches(t):
    return P.state_findings(P.field_states(joined(t))).filter("type = 'OCR_FIELD_MISMATCH'")


cte("field_findings", """
  SELECT case_id, field_type, CASE WHEN state = 'UNRELIABLE_OCR' THEN 'OCR_FIELD_UNRELIABLE' ELSE 'OCR_FIELD_MISMATCH' END AS type, confidence
  FROM order_states WHERE state NOT IN ('MATCH', 'LIKELY_MATCH')
  UNION ALL SELECT case_id, field_type, 'OCR_FIELD_POSITION_CHANGE', 0.72 FROM order_states
    WHERE state IN ('MATCH', 'LIKELY_MATCH') AND abs(bx - ax) > 0.08::DOUBLE
  UNION ALL SELECT case_id, field_type, change, 0.82 FROM order_fields WHERE change <> 'BOTH'""", "order_states", "order_fields")


def visual(t):
    """Label values that differ between both sides."""
    def side(rows):
        return rows.select("case_id", F.col("field_type").alias("field"), F.col("raw_text").alias("value"))
    return P.field_differences(side(evidence_fields(t)), side(reference_fields(t)))


VISUAL = """
  SELECT case_id, field_type AS field FROM order_fields WHERE change = 'BOTH' AND lower(ev_text) <> lower(ref_text)"""
MISMATCH = "SELECT case_id, field_type, confidence FROM field_findings WHERE type = 'OCR_FIELD_MISMATCH'"


@query("field_corroboration", f"""
  SELECT m.case_id, m.field_type, v.field IS NOT NULL AS corroborated,
         CASE WHEN v.field IS NOT NULL THEN fix(least(0.98::DOUBLE, confidence + 0.06::DOUBLE), 3) ELSE confidence END AS confidence
  FROM ({MISMATCH}) m LEFT JOIN ({VISUAL}) v ON v.case_id = m.case_id AND v.field = m.field_type""", ("order_fields", "field_findings"))
def _(t):
    return P.corroborate(mismatches(t), visual(t)).select("case_id", "field_type", "corroborated", "confidence")


def host():
    return F.regexp_extract("url", "^https?://([^/:?#]+)", 1)


def codes(t):
    """Two pages make a case; pages with a query in their address carry no code, and
    every seventh host differs on the reference side."""
    pages = t.pages.select(F.floor(F.col("page_id") / 2).alias("case_id"), "page_id", "url", host().alias("payload"))
    coded = pages.filter(~F.col("url").contains("?"))
    other = coded.withColumn("payload", F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("x"), "payload"))
                             .otherwise(F.col("payload")))
    return pages, coded.select("case_id", "payload"), other.select("case_id", "payload")


PAYLOADS = """
  WITH coded AS (SELECT page_id // 2 AS case_id, page_id, url, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS payload FROM pages),
  sides AS (SELECT case_id, list_sort(list(payload)) AS a,
                   list_sort(list(CASE WHEN page_id % 7 = 0 THEN 'x' || payload ELSE payload END)) AS b, count(*) AS n
            FROM coded WHERE NOT contains(url, '?') GROUP BY case_id),
  compared AS (SELECT c.case_id, coalesce(n, 0) AS exhibit_codes, coalesce(n, 0) AS reference_codes,
                      CASE WHEN n IS NULL THEN 'not-detected' ELSE 'decoded' END AS status, a = b AS match
               FROM (SELECT DISTINCT case_id FROM coded) c LEFT JOIN sides USING (case_id))"""


@query("payload_compare", PAYLOADS + " SELECT * FROM compared")
def _(t):
    return P.compare_payloads(*codes(t))


PAYLOAD_CHECKS = """
  SELECT page_id AS case_id, payload, len(p) >= 4 AND NOT contains(t, p) AS mismatch FROM (
    SELECT page_id, payload, regexp_replace(lower(payload), '[^\\p{L}\\p{N}]', '', 'g') AS p,
           regexp_replace(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), '[^\\p{L}\\p{N}]', '', 'g') AS t
    FROM (SELECT page_id, html, regexp_extract(url, '//([^./]+)', 1) AS payload FROM pages))"""


def payload_checks(t):
    read = t.pages.select(F.col("page_id").alias("case_id"), F.regexp_extract("url", "//([^./]+)", 1).alias("payload"),
                          F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return P.payload_text_check(read.select("case_id", "payload"), read.select("case_id", "text"))


@query("payload_text_mismatch", PAYLOAD_CHECKS)
def _(t):
    return payload_checks(t)


@query("payload_layer", f"""
  SELECT case_id, CASE WHEN bool_or(mismatch) THEN 0.7::DOUBLE ELSE 0 END AS score, CASE WHEN bool_or(mismatch) THEN 'QR_OCR_MISMATCH' END AS code
  FROM ({PAYLOAD_CHECKS}) GROUP BY case_id""")
def _(t):
    return P.payload_layer(payload_checks(t))


def pairs(t):
    key = F.col("o_orderkey")
    return t.orders.select(key.alias("case_id"), (key % 5 != 0).alias("aligned"),
                           ((60 + key % 40) / 100).alias("alignment_confidence"),
                           ((F.col("o_custkey") % 100) / 100).alias("structural_difference"))


cte("ref_pairs", """
  SELECT o_orderkey AS case_id, o_orderkey % 5 <> 0 AS aligned, (60 + o_orderkey % 40) / 100::DOUBLE AS alignment,
         (o_custkey % 100) / 100::DOUBLE AS structural FROM orders""")


@query("reference_layer", f"""
  SELECT case_id, tier, fix(score, 4) AS score, fix(conf, 3) AS confidence, {B.STATUS_SQL.format(s='fix(score, 4)')} AS status,
         CASE WHEN has_direct THEN 'high' ELSE 'medium' END AS severity, regions, stable, direct AS disagreements FROM (
  SELECT *, CASE WHEN aligned THEN least(1, evidence * alignment) ELSE 0 END AS score,
         least(0.98::DOUBLE, alignment * (0.72::DOUBLE + CASE WHEN has_direct THEN 0.12 ELSE 0 END)) AS conf FROM (
  SELECT *, CASE WHEN has_direct THEN 'direct-comparative' WHEN stable > 0 THEN 'localized-supporting' ELSE 'global-supporting' END
           AS tier, CASE WHEN has_direct THEN greatest(structural, top, 0.86) WHEN stable > 0 THEN greatest(structural, top)
                         ELSE least(structural, 0.28) END AS evidence FROM (
  SELECT p.*, coalesce(r.n, 0) AS regions, coalesce(r.stable, 0) AS stable, coalesce(r.top, 0) AS top,
         coalesce(d.n, 0) AS direct, coalesce(d.n, 0) > 0 AS has_direct FROM ref_pairs p
  LEFT JOIN (SELECT case_id, count(*) AS n, count(*) FILTER (ord % 2 = 0) AS stable, max(score) AS top FROM regions GROUP BY 1) r
    USING (case_id) LEFT JOIN (SELECT case_id, count(*) AS n FROM field_findings
      WHERE type IN ('OCR_FIELD_MISMATCH', 'OCR_FIELD_ADDED', 'OCR_FIELD_REMOVED') GROUP BY 1) d USING (case_id))))""",
       ("ref_pairs", "regions", "field_findings"))
def _(t):
    changed = B.regions(t).withColumn("stable", F.col("ord") % 2 == 0)
    layer = P.reference_layer(pairs(t), changed, field_findings(t))
    return layer.withColumns({"score": S.fix("score", 4), "confidence": S.fix("confidence", 3)})


@query("layout_uplift", """
  SELECT case_id, differences, fix(raised, 6) AS score, CASE WHEN differences > 0 THEN greatest(confidence, 0.8) ELSE confidence END
           AS confidence, CASE WHEN differences > 0 THEN CASE WHEN raised >= 0.5::DOUBLE THEN 'alert' ELSE 'review' END
                               ELSE status END AS status
  FROM (SELECT l.*, coalesce(d.n, 0) AS differences, CASE WHEN d.n > 0 THEN greatest(score, least(0.85::DOUBLE, 0.45::DOUBLE + d.n * 0.1::DOUBLE))
                                                        ELSE score END AS raised
        FROM layers l LEFT JOIN (SELECT case_id, count(*) AS n FROM findings WHERE code = 'REF-FIELD' GROUP BY 1) d USING (case_id)
        WHERE layer = 'layout')""", ("layers", "findings"))
def _(t):
    differences = B.findings(t).filter(F.col("code") == "REF-FIELD")
    return P.uplift_layout(B.layers(t), differences).withColumn("score", S.fix("score", 6))


def text_differences(t):
    """Words whose nearest reference word reads differently, with their boxes."""
    box = ["left", "top", "width", "height", "page_width", "page_height"]
    return W.word_differences(B.words(t), B.reference_words(t), keep=box).withColumn("bbox", W.unit_box())


@query("change_lists", """
  SELECT case_id, kind, change_type, subject, fix(x, 4) AS x, fix(y, 4) AS y, fix(width, 4) AS width, fix(height, 4) AS height, exhibit, reference,
         fix(score, 3) AS score, confidence FROM (
    SELECT case_id, 'image' AS kind, CASE WHEN x + width / 2 < 0.30::DOUBLE AND y + height / 2 > 0.25::DOUBLE
                             AND y + height / 2 < 0.78::DOUBLE THEN 'portrait-region-difference'
                            WHEN y + height / 2 > 0.78::DOUBLE THEN 'barcode-or-signature-region-difference'
                            ELSE 'local-aligned-difference' END AS change_type, ord AS subject, x, y, width, height,
           NULL::VARCHAR AS exhibit, NULL::VARCHAR AS reference, score,
           fix(least(0.95::DOUBLE, 0.55::DOUBLE + score * 0.35::DOUBLE), 3) AS confidence FROM regions
    UNION ALL SELECT case_id, 'image', 'structural-or-texture', NULL, 0, 0, 1, 1, NULL, NULL, structural,
      fix(least(0.9::DOUBLE, 0.5::DOUBLE + structural), 3) FROM ref_pairs WHERE structural > 0.08::DOUBLE
    UNION ALL SELECT case_id, 'unchanged', 'whole-page', NULL, 0, 0, 1, 1, NULL, NULL, 1 - structural, NULL FROM ref_pairs
      WHERE 1 - structural >= 0.85::DOUBLE
    UNION ALL SELECT case_id, 'text', 'ocr-text-change', idx, greatest(0, "left") / page_width::DOUBLE, greatest(0, top) / page_height::DOUBLE,
      least(1::DOUBLE, width / page_width::DOUBLE), least(1::DOUBLE, height / page_height::DOUBLE), text, rtext, 0.9, 0.82
      FROM word_changes JOIN words USING (case_id, idx, text))
  WHERE change_type <> 'local-aligned-difference'""", ("regions", "ref_pairs", "words", "word_changes"))
def _(t):
    lists = P.change_lists(pairs(t), R.region_position(B.regions(t)), text_differences(t))
    return lists.select("case_id", "kind", "change_type", "subject", *[S.fix(f"bbox.{c}", 4).alias(c) for c in ("x", "y", "width", "height")],
                        "exhibit", "reference", S.fix("score", 3).alias("score"), "confidence")


@query("comparison_findings", PAYLOADS + f"""
  SELECT case_id, type AS code, field_type AS subject, CASE WHEN type = 'OCR_FIELD_MISMATCH' THEN 'high' ELSE 'medium' END AS severity, confidence
    FROM field_findings WHERE type <> 'OCR_FIELD_UNRELIABLE'
  UNION ALL SELECT case_id, 'REF-FIELD', field, 'high', 0.9 FROM ({VISUAL})
  UNION ALL SELECT case_id, 'REF-TEXT', CAST(idx AS VARCHAR), 'high', 0.82 FROM word_changes
  UNION ALL SELECT case_id, 'REF-QR', 'payload', 'critical', 0.95 FROM compared WHERE status = 'decoded' AND NOT match""",
       ("order_fields", "field_findings", "word_changes"))
def _(t):
    changed = W.word_differences(B.words(t), B.reference_words(t))
    return P.comparison_findings(field_findings(t), visual(t), changed, P.compare_payloads(*codes(t)))


@query("set_union_intersect", """
  SELECT case_id, field_type, count(*) = 2 AS in_both FROM (
    SELECT DISTINCT o_orderkey AS case_id, side, f AS field_type FROM (
      SELECT o_orderkey, 'a' AS side, """ + f"({B._field_types})[(o_orderkey + i) % 11 + 1] AS f" + """
      FROM orders CROSS JOIN (SELECT unnest([0, 1, 2]) AS i)
      UNION ALL SELECT o_orderkey, 'b', """ + f"({B._field_types})[(o_orderkey + i + 1) % 11 + 1]" + """
      FROM orders CROSS JOIN (SELECT unnest([0, 1, 2]) AS i))) GROUP BY 1, 2""")
def _(t):
    a = evidence_fields(t).select("case_id", "field_type")
    b = reference_fields(t).select("case_id", "field_type")
    shared = a.intersect(b).withColumn("in_both", F.lit(True))
    return a.union(b).distinct().join(shared, ["case_id", "field_type"], "left").fillna(False, ["in_both"])
