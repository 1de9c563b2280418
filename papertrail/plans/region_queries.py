"""Queries over detector regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail.functions import scalars as S
from papertrail.operators import regions as R
from papertrail.operators.skew import top_k
from papertrail.plans import bindings as B
from papertrail.plans.registry import query

IOU = B.IOU_SQL.format(a="a.", b="b.")

COMPONENTS = """
  WITH RECURSIVE both_ways AS (SELECT case_id, u, v FROM merge_edges UNION ALL SELECT case_id, v, u FROM merge_edges),
  reach(case_id, node, seen) AS (
    SELECT case_id, u, u FROM both_ways UNION
    SELECT r.case_id, r.node, e.v FROM reach r JOIN both_ways e ON e.case_id = r.case_id AND e.u = r.seen),
  components AS (
    SELECT r.*, coalesce(c.component, r.ord) AS component FROM typed r
    LEFT JOIN (SELECT case_id, node, min(seen) AS component FROM reach GROUP BY case_id, node) c
      ON c.case_id = r.case_id AND c.node = r.ord)"""


def typed_members(t):
    return R.region_types(R.merge_regions(B.regions(t)), B.region_fields(t))


@query("region_cross_check", f"""
  SELECT a.case_id, a.ord AS ord_a, b.ord AS ord_b, 'XC-CORR' AS code,
         CASE WHEN a.score >= b.score THEN a.layer ELSE b.layer END AS owner,
         CASE WHEN a.score >= b.score THEN b.layer ELSE a.layer END AS other,
         CASE WHEN {IOU} > 0.4::DOUBLE THEN 'critical' ELSE 'high' END AS severity, fix({IOU}, 6) AS iou,
         fix(least(0.98::DOUBLE, (a.confidence + b.confidence) / 2 + {IOU} * 0.3::DOUBLE), 3) AS confidence
  FROM regions a JOIN regions b ON b.case_id = a.case_id AND a.ord < b.ord AND a.layer <> b.layer
  WHERE a.score > 0.45::DOUBLE AND b.score > 0.45::DOUBLE AND {IOU} > 0.12::DOUBLE""", ("regions",))
def _(t):
    return R.cross_check(B.regions(t)).withColumn("iou", S.fix("iou", 6))


@query("region_components", COMPONENTS + """
  SELECT case_id, ord, component FROM components""", ("merge_edges", "typed"))
def _(t):
    return R.merge_regions(B.regions(t)).select("case_id", "ord", "component")


@query("region_summary", COMPONENTS + """,
  kinds AS (SELECT case_id, component, arg_max(region_type, [CAST(region_type <> 'unknown' AS INT), n, -first]) AS kind
            FROM (SELECT case_id, component, region_type, count(*) AS n, min(ord) AS first FROM components GROUP BY ALL)
            GROUP BY ALL),
  found AS (SELECT case_id, component, count(*) AS n, string_agg(layer, ',' ORDER BY first) AS detectors,
                   fix(sum(top), 3) AS score_sum
            FROM (SELECT case_id, component, layer, min(ord) AS first, fix(max(score), 3) AS top FROM components
                  GROUP BY ALL) GROUP BY ALL)
  SELECT c.case_id, c.component, fix(min(x), 4) AS x, fix(min(y), 4) AS y,
         fix(max(x + width) - min(x), 4) AS width, fix(max(y + height) - min(y), 4) AS height,
         any_value(kind) AS region_type, count(*) AS members, any_value(detectors) AS detectors,
         any_value(score_sum) AS score_sum,
         fix(least(0.98::DOUBLE, max(confidence) + least(0.18::DOUBLE, 0.06::DOUBLE * (any_value(found.n) - 1))), 3)
           AS confidence
  FROM components c JOIN kinds USING (case_id, component) JOIN found USING (case_id, component)
  GROUP BY c.case_id, c.component""", ("merge_edges", "typed"))
def _(t):
    total = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, v: a + v)
    return R.region_summary(typed_members(t)).select(
        "case_id", "component", "x", "y", "width", "height", "region_type", "members",
        F.array_join("detectors", ",").alias("detectors"), S.fix(total, 3).alias("score_sum"), "confidence")


@query("region_evidence", COMPONENTS + """
  SELECT case_id, component, ord, format('{}: {} (score {:.2f}); {}', layer, label, score, notes) AS evidence
  FROM components""", ("merge_edges", "typed"))
def _(t):
    return R.region_evidence(R.merge_regions(B.regions(t)))


@query("region_types", "SELECT case_id, ord, region_type FROM typed", ("typed",))
def _(t):
    return R.region_types(B.regions(t), B.region_fields(t)).select("case_id", "ord", "region_type")


@query("region_ids", """
  SELECT case_id, ord, printf('R-%02d', ord) AS region_id FROM regions""", ("regions",))
def _(t):
    return R.numbered(B.regions(t), "ord", "R").select("case_id", "ord", "region_id")


@query("regions_ordered", """
  SELECT case_id, printf('R-%02d', ord) AS region_id, layer, score FROM regions ORDER BY case_id, score DESC, ord""",
       ("regions",))
def _(t):
    listed = R.numbered(B.regions(t), "ord", "R")
    kept = listed.repartition("case_id").sortWithinPartitions("case_id", F.desc("score"), "ord")
    return kept.select("case_id", "region_id", "layer", "score")


@query("regions_topk", """
  SELECT case_id, ord, score, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, ord) AS rank FROM regions)
  WHERE rank <= 8""", ("regions",))
def _(t):
    return top_k(B.regions(t), ["case_id"], [F.desc("score"), F.col("ord")], 8).select("case_id", "ord", "score", "rank")


@query("regions_visible", """
  SELECT case_id, ord, layer FROM regions WHERE layer IN ('pixel', 'layout')""", ("regions",))
def _(t):
    return R.visible_regions(B.regions(t), ["pixel", "layout"]).select("case_id", "ord", "layer")


@query("region_position", """
  SELECT case_id, ord, CASE WHEN x + width / 2 < 0.30::DOUBLE AND y + height / 2 > 0.25::DOUBLE
                             AND y + height / 2 < 0.78::DOUBLE THEN 'portrait-region-difference'
                            WHEN y + height / 2 > 0.78::DOUBLE THEN 'barcode-or-signature-region-difference'
                            ELSE 'local-aligned-difference' END AS change_type,
         fix(least(0.95::DOUBLE, 0.55::DOUBLE + score * 0.35::DOUBLE), 3) AS trust FROM regions""", ("regions",))
def _(t):
    return R.region_position(B.regions(t)).select("case_id", "ord", "change_type", "trust")


@query("box_iou", f"""
  SELECT a.case_id, a.ord, fix(max({IOU}), 6) AS best_iou FROM regions a
  JOIN (SELECT case_id, fx AS x, fy AS y, fw AS width, fh AS height FROM region_fields) b ON b.case_id = a.case_id
  GROUP BY a.case_id, a.ord""", ("regions", "region_fields"))
def _(t):
    best = F.array_max(F.transform("fields", R.field_iou))
    return R.with_fields(B.regions(t), B.region_fields(t)).select("case_id", "ord", S.fix(best, 6).alias("best_iou"))


FIRST_FINDINGS = f"""
  SELECT case_id, ({B._field_types})[CAST(regexp_extract(notes, '[0-9]+') AS BIGINT) % 11 + 1] AS field_type,
         arg_min(confidence, ord) AS confidence, arg_min('differs from ' || notes, ord) AS evidence
  FROM regions GROUP BY 1, 2"""
CANDIDATES = f"""
  SELECT f.case_id, f.ord, 'Identity field: ' || f.field_type AS label, coalesce(x.confidence, 0) AS score,
         coalesce(x.confidence, f.confidence) AS confidence, coalesce(x.evidence, 'OCR field: ' || f.raw_text) AS notes
  FROM region_fields f LEFT JOIN ({FIRST_FINDINGS}) x ON x.case_id = f.case_id AND x.field_type = f.field_type"""


@query("field_candidates", f"""
  SELECT case_id, ord, label, fix(score, 4) AS score, fix(confidence, 4) AS confidence, notes FROM ({CANDIDATES})""",
       ("regions", "region_fields"))
def _(t):
    return R.field_candidates(B.region_fields(t), B.region_field_findings(t)).select(
        "case_id", "ord", "label", S.fix("score", 4).alias("score"), S.fix("confidence", 4).alias("confidence"), "notes")


@query("region_union", f"""
  SELECT layer, count(*) AS regions, fix(avg(score), 4) AS mean_score FROM (
    SELECT layer, score FROM regions UNION ALL SELECT 'identity-ocr', score FROM ({CANDIDATES})) GROUP BY layer""",
       ("regions", "region_fields"))
def _(t):
    fields = R.field_candidates(B.region_fields(t), B.region_field_findings(t))
    together = B.regions(t).unionByName(fields, allowMissingColumns=True)
    return together.groupBy("layer").agg(F.count(F.lit(1)).alias("regions"), S.fix(F.avg("score"), 4).alias("mean_score"))


@query("mask_overlap", """
  WITH pixels AS (
    SELECT case_id, side, unnest(generate_series(greatest(0, x0), least(99, x1))) AS px, y0, y1 FROM (
      SELECT case_id, 'p' AS side, CAST(floor(x * 100) AS INT) AS x0, CAST(floor((x + width) * 100) AS INT) AS x1,
             CAST(floor(y * 80) AS INT) AS y0, CAST(floor((y + height) * 80) AS INT) AS y1 FROM regions
      UNION ALL SELECT case_id, 't', CAST(floor(fx * 100) AS INT), CAST(floor((fx + fw) * 100) AS INT),
             CAST(floor(fy * 80) AS INT), CAST(floor((fy + fh) * 80) AS INT) FROM region_fields)
    WHERE x1 > x0 AND y1 > y0),
  cells AS (SELECT case_id, px, py, max(CAST(side = 'p' AS INT)) AS p, max(CAST(side = 't' AS INT)) AS t
            FROM (SELECT case_id, side, px, unnest(generate_series(greatest(0, y0), least(79, y1))) AS py FROM pixels)
            GROUP BY case_id, px, py),
  areas AS (SELECT case_id, sum(p) AS p, sum(t) AS t, sum(p * t) AS s, count(*) AS u FROM cells GROUP BY case_id)
  SELECT o.o_orderkey AS case_id, CAST(coalesce(p, 0) AS BIGINT) AS predicted_area,
         CAST(coalesce(t, 0) AS BIGINT) AS truth_area, CAST(coalesce(s, 0) AS BIGINT) AS shared_area,
         fix(CASE WHEN u > 0 THEN s / u::DOUBLE ELSE 1 END, 4) AS iou,
         fix(CASE WHEN u > 0 THEN 2 * s / (p + t)::DOUBLE ELSE 1 END, 4) AS dice
  FROM orders o LEFT JOIN areas ON areas.case_id = o.o_orderkey""", ("regions", "region_fields"))
def _(t):
    cases = t.orders.select(F.col("o_orderkey").alias("case_id"))
    truth = B.region_fields(t).select("case_id", "bbox.*")
    return R.mask_overlap(cases, B.regions(t), truth, 100, 80).withColumns(
        {"iou": S.fix("iou", 4), "dice": S.fix("dice", 4)})
