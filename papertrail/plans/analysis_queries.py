"""The whole job over order pages: observation tables in, fused and registered cases out."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail.operators import analysis as A
from papertrail.plans import bindings as B
from papertrail.plans.ledger_queries import INVOICE_SQL, invoice_words
from papertrail.plans.registry import CTES, cte, query
from papertrail.plans.word_queries import LAYOUT_WITH

_ODD = "(case_id * 7 + idx * 3) % 23 = 0"
_WEAK = "(case_id * 5 + idx // 10) % 13 = 0"
# Pages of orders; some words are far too large, some lines hardly readable.
cte("job_words", f"""
  SELECT case_id, idx, text, CASE WHEN {_WEAK} THEN 25 ELSE conf END AS conf, "left", top, width, CASE WHEN {_ODD} THEN 30 ELSE height END AS height
  FROM invoice_words""", "invoice_words")
cte("job_layout", f"""{LAYOUT_WITH.replace('WITH sized', 'WITH words AS (SELECT * FROM job_words), sized', 1)}
  SELECT *, CASE WHEN live THEN least(1, deviants / words::DOUBLE) ELSE 0 END AS score, CASE WHEN live THEN least(rx0, cx0) END AS x0,
         CASE WHEN live THEN least(ry0, cy0) END AS y0, CASE WHEN live THEN greatest(rx1, cx1) END AS x1, CASE WHEN live THEN greatest(ry1, cy1) END AS y1
  FROM (SELECT *, weak_words + odd_words + baseline_sets + column_sets AS deviants, words >= 20 AND weak_words + odd_words + baseline_sets + column_sets >= 2 AS live
        FROM (SELECT case_id, max(n) AS words, CAST(sum(weak_words) AS BIGINT) AS weak_words, CAST(sum(odd_words) AS BIGINT) AS odd_words,
                     max(CAST(drift_words >= 2 AS INT)) AS baseline_sets, least(min(x0), min(dx0) FILTER (drift_words >= 2)) AS rx0,
                     least(min(y0), min(dy0) FILTER (drift_words >= 2)) AS ry0, greatest(max(x1), max(dx1) FILTER (drift_words >= 2)) AS rx1,
                     greatest(max(y1), max(dy1) FILTER (drift_words >= 2)) AS ry1 FROM rows_out GROUP BY case_id)
        JOIN (SELECT case_id, max(CAST(off_words >= 3 AS INT)) AS column_sets, min(cx0) FILTER (off_words >= 3) AS cx0, min(cy0) FILTER (off_words >= 3) AS cy0,
                     max(cx1) FILTER (off_words >= 3) AS cx1, max(cy1) FILTER (off_words >= 3) AS cy1 FROM columns_out GROUP BY case_id) USING (case_id))""", "job_words")
cte("job_checks", f"{INVOICE_SQL.replace('WITH RECURSIVE', 'WITH RECURSIVE invoice_words AS (SELECT * FROM job_words),', 1)} SELECT * FROM all_checks", "job_words")
cte("job_breaches", """
  SELECT *, fix(least(0.97::DOUBLE, base * (0.65::DOUBLE + 0.35::DOUBLE * min_conf / 100) + CASE WHEN several THEN 0.06::DOUBLE ELSE 0 END), 3) AS confidence
  FROM (SELECT *, count(*) OVER (PARTITION BY case_id) > 1 AS several FROM job_checks WHERE NOT ok AND strong) WHERE min_conf IS NOT NULL""", "job_checks")
cte("job_scores", """
  SELECT o_orderkey AS case_id, coalesce(s.score, 0) AS semantic, coalesce(s.confidence, 0) AS semantic_c, coalesce(l.score, 0) AS layout,
         CASE WHEN l.live THEN least(0.95::DOUBLE, greatest(0.35::DOUBLE, 0.35::DOUBLE + 0.55::DOUBLE * l.score)) ELSE 0 END AS layout_c, l.live, l.deviants,
         l.x0, l.y0, l.x1, l.y1, issues, issues / 3::DOUBLE AS metadata, CASE WHEN issues > 0 THEN 0.4::DOUBLE + 0.4::DOUBLE * issues / 3 ELSE 0 END AS metadata_c,
         quality, CASE WHEN quality < 72 THEN least(1, greatest(0.05::DOUBLE, (72 - quality) / 22)) ELSE 0 END AS compression
  FROM (SELECT *, CAST(o_custkey % 3 = 0 AS INT) + CAST(o_orderpriority = '1-URGENT' AS INT) AS issues, CAST(40 + o_custkey % 60 AS DOUBLE) AS quality FROM orders) o
  LEFT JOIN (SELECT case_id, least(0.95::DOUBLE, coalesce(top, 0)) AS score, CASE WHEN breaches > 0 THEN greatest(0.5::DOUBLE, coalesce(top, 0)) ELSE 0 END AS confidence
             FROM (SELECT case_id, count(*) FILTER (NOT ok AND strong) AS breaches FROM job_checks GROUP BY 1)
             LEFT JOIN (SELECT case_id, max(confidence) AS top FROM job_breaches GROUP BY 1) USING (case_id)) s ON s.case_id = o_orderkey
  LEFT JOIN job_layout l ON l.case_id = o_orderkey""", "job_checks", "job_breaches", "job_layout")
cte("job_residual", """
  SELECT *, least(0.65::DOUBLE, greatest(0, (0.4::DOUBLE * p95 + 0.3::DOUBLE * stability + 0.3::DOUBLE * l) * l)) AS score
  FROM (SELECT *, least(1, greatest(0, 1 - greatest(0, area - 0.04::DOUBLE) / 0.18::DOUBLE)) AS l
        FROM (SELECT l_orderkey AS case_id, avg(CAST(l_discount > 0.08::DOUBLE AS INT)) AS area, max(l_tax) * 10 AS p95, avg(l_discount) AS stability
              FROM lineitem GROUP BY 1))""")
cte("job_layers", f"""
  SELECT case_id, layer, fix(score, 4) AS score, fix(confidence, 3) AS confidence, {B.STATUS_SQL.format(s='fix(score, 4)')} AS status, family FROM (
    SELECT case_id, unnest(['semantic', 'layout', 'metadata', 'compression']) AS layer, unnest([semantic, layout, metadata, compression]) AS score,
           unnest([semantic_c, layout_c, metadata_c, CASE WHEN quality < 72 THEN least(0.92::DOUBLE, 0.5::DOUBLE + 0.4::DOUBLE * compression) ELSE 0 END]) AS confidence
    FROM job_scores
    UNION ALL SELECT o_orderkey, 'deep-tamper-srm', coalesce(score, 0), CASE WHEN stability IS NULL THEN 0 ELSE least(0.86::DOUBLE, 0.45::DOUBLE + 0.35::DOUBLE * stability) END
    FROM orders LEFT JOIN job_residual ON case_id = o_orderkey) JOIN registry USING (layer)""", "job_scores", "job_residual", "registry")
_BAND = "CASE WHEN {0} >= 0.82::DOUBLE THEN 'critical' WHEN {0} >= 0.66::DOUBLE THEN 'high' WHEN {0} >= 0.45::DOUBLE THEN 'medium' " \
        "WHEN {0} >= 0.26::DOUBLE THEN 'low' WHEN {0} >= 0.14::DOUBLE THEN 'info' ELSE 'benign' END"
cte("job_findings", f"""
  SELECT case_id, 'semantic' AS layer, CAST(ord AS BIGINT) AS ord, 'SEM-ARITH' AS code, {_BAND.format('confidence')} AS severity, confidence, fix(diff, 2) AS metric FROM job_breaches
  UNION ALL SELECT case_id, 'layout', NULL, 'LXT-DEV', {_BAND.format('layout')}, fix(layout_c, 3), deviants FROM job_scores WHERE live
  UNION ALL SELECT case_id, 'metadata', NULL, 'META-CONS', {_BAND.format('metadata')}, fix(metadata_c, 3), issues FROM job_scores WHERE issues > 0
  UNION ALL SELECT case_id, 'compression', NULL, 'CMP-RESAVE', {_BAND.format('compression')}, fix(least(0.92::DOUBLE, 0.5::DOUBLE + 0.4::DOUBLE * compression), 3), quality
  FROM job_scores WHERE quality < 72
  UNION ALL SELECT r.case_id, 'deep-tamper-srm', NULL, 'SRM-LOCAL', CASE WHEN s.case_id IS NOT NULL THEN 'high' ELSE 'medium' END,
         fix(least(0.88::DOUBLE, 0.55::DOUBLE + 0.3::DOUBLE * stability), 3), fix(p95, 4)
  FROM job_residual r JOIN orders ON o_orderkey = r.case_id LEFT JOIN (SELECT DISTINCT case_id FROM job_layers WHERE score >= 0.55::DOUBLE AND layer <> 'deep-tamper-srm') s USING (case_id)
  WHERE r.score > 0""", "job_breaches", "job_scores", "job_residual", "job_layers")
cte("job_regions", """
  SELECT case_id, 'semantic' AS layer, CAST(ord AS BIGINT) AS ord, 'Arithmetic violation' AS label, fix(least(1::DOUBLE, diff / greatest(1, actual)), 4) AS score, confidence, x0, y0, x1, y1
  FROM job_breaches
  UNION ALL SELECT case_id, 'layout', NULL, 'Layout deviation', fix(layout, 4), fix(layout_c, 3), x0, y0, x1, y1 FROM job_scores WHERE live""", "job_breaches", "job_scores")
# Fusion as elsewhere, over the job's own layers and findings.
_FUSION = ", ".join(f"{n} AS ({CTES[n][0]})" for n in ("finding_family", "family_scores", "alerts", "fused"))
cte("job_fused", f"WITH layers AS (SELECT * FROM job_layers), findings AS (SELECT * FROM job_findings), {_FUSION} SELECT * FROM fused",
    "job_layers", "job_findings", "families")


def job(t) -> A.Analysis:
    """All standard detectors over the pages of the orders."""
    case, idx = F.col("case_id"), F.col("idx")
    pages = invoice_words(t).withColumns({
        "conf": F.when((case * 5 + F.floor(idx / 10)) % 13 == 0, 25.0).otherwise(F.col("conf")),
        "height": F.when((case * 7 + idx * 3) % 23 == 0, 30).otherwise(F.col("height")).cast("long")})
    orders = t.orders.select(F.col("o_orderkey").alias("case_id"), "o_custkey", "o_orderdate", "o_orderpriority")
    written = "yyyy:MM:dd HH:mm:ss"
    saved = F.col("o_orderdate").cast("timestamp")
    changed = F.when(F.col("o_custkey") % 3 == 0, saved - F.expr("INTERVAL 1 DAY")).otherwise(saved + F.expr("INTERVAL 1 DAY"))
    metadata = orders.select("case_id", F.when(F.col("o_orderpriority") == "1-URGENT", "Microsoft Word").alias("software"),
                             F.date_format(saved, written).alias("created"), F.date_format(changed, written).alias("modified"))
    quality = orders.select("case_id", (40 + F.col("o_custkey") % 60).cast("double").alias("quantization_quality"))
    residual = t.lineitem.groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.avg((F.col("l_discount") > 0.08).cast("double")).alias("area"), (F.max("l_tax") * 10).alias("p95"), F.avg("l_discount").alias("stability"))
    return A.analyze_cases(orders.select("case_id"), {"words": pages, "metadata": metadata, "facts": quality, "residual_stats": residual}, A.STANDARD)


@query("analyze_cases", """
  SELECT f.case_id, risk, verdict, confidence, agreement, alerts, coalesce(n.findings, 0) AS findings, coalesce(r.regions, 0) AS regions, scores.*
  FROM job_fused f LEFT JOIN (SELECT case_id, count(*) AS findings FROM job_findings GROUP BY 1) n ON n.case_id = f.case_id
  LEFT JOIN (SELECT case_id, count(*) AS regions FROM job_regions GROUP BY 1) r ON r.case_id = f.case_id
  JOIN (SELECT case_id AS c, max(score) FILTER (layer = 'semantic') AS semantic, max(score) FILTER (layer = 'layout') AS layout,
               max(score) FILTER (layer = 'deep-tamper-srm') AS residual FROM job_layers GROUP BY 1) scores ON c = f.case_id""".replace("scores.*", "semantic, layout, residual"),
       ("job_fused", "job_findings", "job_regions", "job_layers"))
def _(t):
    return job(t).cases.select("case_id", "risk", "verdict", "confidence", "agreement", "alerts", "findings", "regions",
                               *[F.col("layer_scores")[layer].alias(n) for layer, n in (("semantic", "semantic"), ("layout", "layout"), ("deep-tamper-srm", "residual"))])


@query("analysis_layers", "SELECT case_id, layer, score, confidence, status FROM job_layers", ("job_layers",))
def _(t):
    return job(t).layers.select("case_id", "layer", "score", "confidence", "status")


@query("analysis_findings", "SELECT case_id, layer, ord, code, severity, confidence, metric FROM job_findings", ("job_findings",))
def _(t):
    return job(t).findings


@query("analysis_regions", "SELECT case_id, layer, ord, label, score, confidence, x0, y0, x1, y1 FROM job_regions", ("job_regions",))
def _(t):
    return job(t).regions
