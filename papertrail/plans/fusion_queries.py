"""Queries over layer results and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail import constants as C
from papertrail.functions import scalars as S
from papertrail.operators import fusion
from papertrail.operators import words as W
from papertrail.plans import bindings as B
from papertrail.plans.registry import Tables, query


def fused(t: Tables):
    return fusion.fuse_cases(B.layers(t), B.findings(t))


@query("fuse_cases", """
  SELECT case_id, fix(mass, 6) AS mass, risk, verdict, agreement, fix(confidence, 3) AS confidence,
         CAST(active AS INT) AS active_families, alerts FROM fused""", ("fused",))
def _(t):
    return fused(t).select("case_id", S.fix(F.col("mass"), 6).alias("mass"), "risk", "verdict", "agreement",
                           S.fix(F.col("confidence"), 3).alias("confidence"), "active_families", "alerts")


@query("fusion_agreement", """
  SELECT agreement, count(*) AS cases FROM fused GROUP BY agreement""", ("fused",))
def _(t):
    return fused(t).groupBy("agreement").agg(F.count(F.lit(1)).alias("cases"))


@query("fusion_confidence", """
  SELECT verdict, count(*) AS cases, fix(min(confidence), 3) AS lowest, fix(avg(confidence), 6) AS mean,
         fix(max(confidence), 3) AS highest FROM fused GROUP BY verdict""", ("fused",))
def _(t):
    return fused(t).groupBy("verdict").agg(
        F.count(F.lit(1)).alias("cases"), S.fix(F.min("confidence"), 3).alias("lowest"),
        S.fix(F.avg("confidence"), 6).alias("mean"), S.fix(F.max("confidence"), 3).alias("highest"))


CONTRIBUTIONS_SQL = """
  SELECT l.case_id, l.layer, l.name, l.status,
         CASE WHEN l.status = 'skipped' THEN 0::DOUBLE
              ELSE s.fweight * l.score / CASE WHEN s.total = 0 THEN 1 ELSE s.total END END AS weight,
         CASE WHEN l.status = 'skipped' THEN 0::DOUBLE
              ELSE s.fweight * s.score * l.score / CASE WHEN s.total = 0 THEN 1 ELSE s.total END END AS contribution
  FROM layers l JOIN family_scores s ON s.case_id = l.case_id AND s.family = l.family"""


@query("fusion_contributions", f"""
  SELECT case_id, layer, status, fix(weight, 6) AS weight, fix(contribution, 6) AS contribution
  FROM ({CONTRIBUTIONS_SQL})""", ("family_scores", "layers"))
def _(t):
    return fusion.contributions(fused(t)).select(
        "case_id", "layer", "status", S.fix(F.col("weight"), 6).alias("weight"),
        S.fix(F.col("contribution"), 6).alias("contribution"))


@query("top_contributors", f"""
  SELECT case_id, CAST(rank AS INT) AS rank, layer, name, contribution FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY contribution DESC, layer) AS rank
    FROM (SELECT case_id, layer, name, fix(contribution, 6) AS contribution FROM ({CONTRIBUTIONS_SQL})))
  WHERE rank <= 3""", ("family_scores", "layers"))
def _(t):
    return fusion.top_contributors(fused(t))


@query("family_evidence", """
  SELECT case_id, family, fweight AS weight, fix(score, 6) AS score, fix(fweight * score, 6) AS contribution,
         coalesce(members, '') AS members, found AS finding_count FROM family_scores""", ("family_scores",))
def _(t):
    return fusion.family_evidence(fused(t)).select(
        "case_id", "family", "weight", S.fix(F.col("score"), 6).alias("score"),
        S.fix(F.col("contribution"), 6).alias("contribution"), "members", "finding_count")


POOL = f"""
  SELECT p.case_id, mass, {B.RISK_SQL.format(m="mass")} AS risk,
         fix(greatest(0::DOUBLE, 1 - sigma / 0.32::DOUBLE), 3) AS agreement, entropy, executed, mean_conf, n_layers,
         coalesce(a.alerts, 0) AS alerts, coalesce(a.links, 0) AS links, coalesce(a.criticals, 0) AS criticals
  FROM (SELECT case_id, coalesce(sum(raw * score) FILTER (live) / sum(raw) FILTER (live), 0) AS mass,
               coalesce(stddev_pop(score) FILTER (live), 0) AS sigma, count(*) FILTER (live) AS executed,
               coalesce(avg(confidence) FILTER (live), 0) AS mean_conf, count(*) AS n_layers,
               fix(coalesce(-sum(0.06::DOUBLE * log2(greatest(1e-6, 1 - abs(score - 0.5::DOUBLE) * 2)))
                     FILTER (live), 0), 3) AS entropy
        FROM (SELECT *, weight * (0.55::DOUBLE + 0.45::DOUBLE * confidence) AS raw, status <> 'skipped' AS live
              FROM layers) GROUP BY case_id) p LEFT JOIN alerts a ON a.case_id = p.case_id"""


@query("fuse_pool", f"""
  SELECT case_id, fix(mass, 6) AS mass, risk, {B.VERDICT_SQL.format(r="risk")} AS verdict, agreement,
         fix(least(0.98::DOUBLE, 0.42::DOUBLE + mean_conf * 0.34::DOUBLE + agreement * 0.16::DOUBLE
               + executed / n_layers * 0.12::DOUBLE + criticals * 0.04::DOUBLE), 3) AS confidence,
         executed, alerts, links FROM ({POOL})""", ("layers", "alerts"))
def _(t):
    return fusion.fuse_pool(B.layers(t), B.findings(t)).select(
        "case_id", S.fix(F.col("mass"), 6).alias("mass"), "risk", "verdict", "agreement",
        S.fix(F.col("confidence"), 3).alias("confidence"), "executed", "alerts", "links")


@query("fusion_entropy", f"SELECT case_id, entropy FROM ({POOL})", ("layers", "alerts"))
def _(t):
    return fusion.fuse_pool(B.layers(t), B.findings(t)).select("case_id", "entropy")


@query("alert_counts", "SELECT case_id, alerts, criticals, links FROM alerts", ("alerts",))
def _(t):
    return fusion.finding_counts(B.findings(t)).select("case_id", "alerts", "criticals", "links")


@query("calibrate", f"""
  SELECT case_id, fix(1 / (1 + exp(-5.2::DOUBLE * (mass - 0.45::DOUBLE))), 6) AS probability, risk
  FROM fused""", ("fused",))
def _(t):
    return fused(t).select("case_id", S.fix(S.calibrate(F.col("mass")), 6).alias("probability"), "risk")


@query("rationale", f"""
  SELECT f.case_id,
    format('Evidence mass {{:.3f}} across {{}} active families, risk {{}}/100.', fix(mass, 3), active, risk) AS mass_line,
    'Dominant contributors: ' || tops || '.' AS driver_line,
    format('Family agreement {{:.3f}}: {{}}.', agreement,
           CASE WHEN agreement > 0.72::DOUBLE THEN 'layers are mutually consistent'
                WHEN agreement > 0.45::DOUBLE THEN 'partial disagreement, interpret with care'
                ELSE 'layers disagree sharply, which itself warrants manual review' END) AS agreement_line,
    format('{{}} high-or-critical finding(s) and {{}} corroboration link(s) recorded.', alerts, links) AS alert_line
  FROM fused f JOIN (
    SELECT case_id, string_agg(format('{{}} ({{:.1f}}%)', name, fix(contribution * 100, 1)), '; ' ORDER BY rank) AS tops
    FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY contribution DESC, layer) AS rank
          FROM (SELECT case_id, layer, name, fix(contribution, 6) AS contribution FROM ({CONTRIBUTIONS_SQL})))
    WHERE rank <= 3 GROUP BY case_id) c ON c.case_id = f.case_id""", ("fused", "family_scores", "layers"))
def _(t):
    return fusion.rationale(fused(t))


@query("ablation", f"""
  WITH variant AS (
    SELECT o.case_id, o.layer AS left_out, l.family, l.score,
           row_number() OVER (PARTITION BY o.case_id, o.layer, l.family ORDER BY l.score DESC, l.layer) AS rk
    FROM layers o LEFT JOIN layers l ON l.case_id = o.case_id AND l.layer <> o.layer AND l.status <> 'skipped'
    WHERE o.status <> 'skipped'),
  strength AS (
    SELECT case_id, left_out, family,
           sum(score * CASE WHEN rk = 1 THEN 1::DOUBLE ELSE 0.12::DOUBLE / rk END) AS s
    FROM variant GROUP BY ALL),
  masses AS (
    SELECT s.case_id, s.left_out, coalesce(sum(f.fweight * least(1::DOUBLE, least(1::DOUBLE, s.s)
             + least(0.08::DOUBLE, coalesce(fs.found, 0) * 0.01::DOUBLE))), 0) AS mass
    FROM strength s LEFT JOIN families f ON f.family = s.family
    LEFT JOIN family_scores fs ON fs.case_id = s.case_id AND fs.family = s.family GROUP BY ALL)
  SELECT m.case_id, left_out, f.risk AS full_risk, {B.RISK_SQL.format(m="m.mass")} AS risk_without,
         f.risk - {B.RISK_SQL.format(m="m.mass")} AS delta
  FROM masses m JOIN fused f ON f.case_id = m.case_id""", ("layers", "families", "family_scores", "fused"))
def _(t):
    return fusion.ablate(fused(t))


@query("family_map", """
  SELECT kind, name, family, rows FROM (
    SELECT 'layer' AS kind, layer AS name, family, count(*) AS rows FROM layers GROUP BY layer, family
    UNION ALL SELECT 'finding', code, coalesce(family, 'none'), count(*) FROM finding_family GROUP BY code, family)""",
       ("layers", "finding_family"))
def _(t):
    by_layer = B.layers(t).select(F.lit("layer").alias("kind"), F.col("layer").alias("name"),
                                  S.layer_family(F.col("layer")).alias("family"))
    by_code = B.findings(t).select(F.lit("finding").alias("kind"), F.col("code").alias("name"),
                                   F.coalesce(S.finding_family(F.col("code")), F.lit("none")).alias("family"))
    return by_layer.unionByName(by_code).groupBy("kind", "name", "family").agg(F.count(F.lit(1)).alias("rows"))


@query("severity_bands", f"""
  SELECT {B.SEVERITY_SQL.format(s="score")} AS band, count(*) AS rows, fix(min(score), 6) AS lowest FROM layers
  GROUP BY 1""", ("layers",))
def _(t):
    return B.layers(t).groupBy(S.severity_band(F.col("score")).alias("band")).agg(
        F.count(F.lit(1)).alias("rows"), S.fix(F.min("score"), 6).alias("lowest"))


@query("layer_status", f"""
  SELECT case_id, layer, status, {B.STATUS_SQL.format(s="score")} AS derived,
         fix(0.6::DOUBLE + 0.3::DOUBLE * score, 6) AS default_confidence FROM layers""", ("layers",))
def _(t):
    return B.layers(t).select("case_id", "layer", "status", S.layer_status(F.col("score")).alias("derived"),
                              S.fix(S.default_confidence(F.col("score"), F.lit(None)), 6).alias("default_confidence"))


_recommendation = (f"CASE WHEN risk >= 68 THEN $${C.WORKER_RECOMMENDATIONS[0][1]}$$ "
                   f"WHEN risk >= 45 THEN $${C.WORKER_RECOMMENDATIONS[1][1]}$$ "
                   f"WHEN risk >= 24 THEN $${C.WORKER_RECOMMENDATIONS[2][1]}$$ "
                   f"ELSE $${C.WORKER_RECOMMENDATIONS[3][1]}$$ END")
_label = "CASE verdict " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.VERDICT_LABELS.items()) + " END"


_advice = "CASE verdict " + " ".join(f"WHEN '{k}' THEN $${v}$$" for k, v in C.VERDICT_ADVICE.items()) + " END"
_place = "CASE layer " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(C.LAYERS)) + " END"


@query("examiner_advice", f"""
  SELECT f.case_id, verdict, {_advice} || CASE WHEN verdict <> 'authentic' AND w.score > 0.45::DOUBLE
         THEN ' Primary driver: ' || lower(w.name) || ' — status ' || status || ' of ' || held || ' layer(s).' ELSE '' END AS advice
  FROM fused f JOIN (SELECT *, count(*) OVER (PARTITION BY case_id) AS held, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, {_place}, layer) AS rk
                     FROM layers) w ON w.case_id = f.case_id AND w.rk = 1""", ("fused", "layers"))
def _(t):
    found = B.layers(t)
    n = found.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    told = found.join(n, "case_id").withColumn("summary", F.concat(F.lit("Status "), "status", F.lit(" of "), "n", F.lit(" layer(s).")))
    return fusion.examiner_advice(fused(t), told)


@query("recommendations", f"""
  SELECT f.case_id, risk, verdict, {_recommendation} AS recommendation, {_label} AS label,
         CASE WHEN verdict <> 'authentic' AND w.score > 0.45::DOUBLE THEN lower(w.name) END AS primary_driver
  FROM fused f JOIN (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, layer) AS rk FROM layers) w
    ON w.case_id = f.case_id AND w.rk = 1""", ("fused", "layers"))
def _(t):
    return fusion.report_recommendation(fused(t))


@query("risk_band_counts", """
  SELECT CASE WHEN risk >= 86 THEN 'Forged' WHEN risk >= 68 THEN 'Likely forged' WHEN risk >= 45 THEN 'Suspicious'
              WHEN risk >= 24 THEN 'Low risk' ELSE 'Authentic' END AS band, count(*) AS cases, min(risk) AS lowest,
         max(risk) AS highest FROM fused GROUP BY 1""", ("fused",))
def _(t):
    return fused(t).groupBy(S.risk_band(F.col("risk")).alias("band")).agg(
        F.count(F.lit(1)).alias("cases"), F.min("risk").alias("lowest"), F.max("risk").alias("highest"))


@query("joint_failure", """
  SELECT p.case_id, 'XC-JOINT' AS code, 'critical' AS severity,
         fix(least(0.98::DOUBLE, (p.confidence + s.confidence) / 2 + 0.12::DOUBLE), 3) AS confidence,
         fix(p.score * s.score, 3) AS joint
  FROM layers p JOIN layers s ON s.case_id = p.case_id AND s.layer = 'semantic' AND s.score > 0.5::DOUBLE
  WHERE p.layer = 'pixel' AND p.score > 0.5::DOUBLE""", ("layers",))
def _(t):
    return fusion.joint_failure(B.layers(t))


@query("corroborated", """
  SELECT case_id, layer, fix(score, 6) AS score, EXISTS (SELECT 1 FROM layers o WHERE o.case_id = l.case_id
           AND o.layer <> l.layer AND o.score >= 0.55::DOUBLE) AS corroborated FROM layers l""", ("layers",))
def _(t):
    return fusion.corroborated(B.layers(t)).withColumn("score", S.fix(F.col("score"), 6))


@query("layers_top6", """
  SELECT case_id, layer, fix(score, 6) AS score, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, layer) AS rank FROM layers)
  WHERE rank <= 6""", ("layers",))
def _(t):
    return fusion.top_layers(B.layers(t)).select("case_id", "layer", S.fix(F.col("score"), 6).alias("score"), "rank")


@query("feature_vector", """
  SELECT case_id, fix(coalesce(any_value(conf), 0), 6) AS ocr_confidence, fix(coalesce(max(score) FILTER (layer = 'pixel'), 0), 6) AS ela_score,
         fix(coalesce(max(score) FILTER (layer = 'copy-move'), 0), 6) AS copy_move_score,
         coalesce(max(CASE WHEN n > 1 THEN fix(top / 500, 3) END) FILTER (layer = 'pixel'), 0) AS noise_anomaly,
         fix(coalesce(max(score) FILTER (layer = 'layout'), 0), 6) AS text_inconsistency
  FROM layers LEFT JOIN (SELECT case_id, avg(conf) FILTER (conf >= 0) AS conf FROM words GROUP BY case_id) USING (case_id)
  GROUP BY case_id""", ("layers", "words"))
def _(t):
    vector = fusion.feature_vector(B.layers(t), W.ocr_rollup(B.words(t)))
    return vector.select("case_id", S.fix("ocr_confidence", 6).alias("ocr_confidence"), S.fix(F.col("ela_score"), 6).alias("ela_score"),
                         S.fix(F.col("copy_move_score"), 6).alias("copy_move_score"), "noise_anomaly",
                         S.fix(F.col("text_inconsistency"), 6).alias("text_inconsistency"))


@query("findings_ordered", """
  SELECT case_id, ord, code, severity, CAST(list_position(['benign','info','low','medium','high','critical'], severity) - 1
           AS BIGINT) AS severity_rank FROM findings ORDER BY case_id, severity_rank DESC, ord""", ("findings",))
def _(t):
    ranked = B.findings(t).select("case_id", "ord", "code", "severity",
                                  S.severity_rank(F.col("severity")).alias("severity_rank"))
    # The order matters within a case only: cases are dealt by hash and sorted where they lie.
    return ranked.repartition("case_id").sortWithinPartitions("case_id", F.desc("severity_rank"), "ord")


@query("step_latency", """
  SELECT event_type AS key, count(*) AS steps, fix(quantile_cont(value, 0.5), 6) AS p50,
         fix(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type""")
def _(t):
    from papertrail.operators.skew import exact_quantiles
    steps = t.events.select(F.col("event_type").alias("key"), "value")
    spread = exact_quantiles(steps, ["key"], "value", {"p50": 0.5, "p95": 0.95}, width=0.5)
    return steps.groupBy("key").agg(F.count(F.lit(1)).alias("steps")).join(spread, "key").select(
        "key", "steps", S.fix("p50", 6).alias("p50"), S.fix("p95", 6).alias("p95"))
