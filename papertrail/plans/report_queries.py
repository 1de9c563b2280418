"""Queries over nested reports (one per document, built row by row)."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail.functions import scalars as S
from papertrail.operators import fusion
from papertrail.plans import bindings as B
from papertrail.plans.fusion_queries import fused
from papertrail.plans.registry import cte, query
from papertrail.session import materialise, run_folder
from papertrail.sources import reports as R

LAYERS = ["pixel", "metadata", "layout", "semantic", "aigc"]


def _array(values):
    return F.array(*[F.lit(v) for v in values])


def _empty(kind):
    return F.lit(None).cast(kind)


def reports(t):
    doc, n = F.col("doc_id"), F.col("n_chars")
    base = t.spread("documents", "doc_id").withColumn("tokens", F.split("text", B.BLANKS))
    # Only long words are looked at: they are picked once, and found again by their places.
    sizes = F.transform("tokens", lambda w: F.length(w))
    places = F.filter(F.transform("sizes", lambda n, i: F.when(n >= 8, i)), lambda i: i.isNotNull())
    base = base.withColumn("sizes", sizes).withColumn("long", F.transform(places, lambda i: F.struct(
        F.get("tokens", i).alias("w"), i.alias("i"), F.get("sizes", i).alias("size"))))
    none = F.struct(*[F.lit(None).cast("double").alias(c) for c in ("x", "y", "width", "height")])

    def finding(k):
        return F.struct(
            F.concat(F.lit("F-"), k["i"].cast("string")).alias("id"), F.element_at(_array(LAYERS), k["i"] % 5 + 1).alias("layer"),
            F.element_at(_array(B.CODES), k["size"] % 8 + 1).alias("code"), k["w"].alias("title"),
            S.severity_band((k["size"] * 7 % 100) / 100).alias("severity"), ((k["size"] % 20) / 20).alias("confidence"),
            F.lit("long word").alias("description"), F.array().cast(R.PAIR).alias("evidence"), none.alias("region"))
    findings = F.transform("long", finding)
    regions = F.transform(F.filter("long", lambda k: k["size"] >= 12), lambda k: F.struct(
        F.lit("").alias("id"), k["w"].alias("label"), F.element_at(_array(LAYERS), k["i"] % 5 + 1).alias("layer"),
        ((k["i"] % 100) / 100).alias("score"), (0.5 + (k["i"] % 50) / 100).alias("confidence"), ((k["i"] % 10) / 10).alias("x"),
        ((k["i"] % 17) / 20).alias("y"), F.lit(0.1).alias("width"), F.lit(0.05).alias("height"),
        F.lit("word length").alias("technique"), F.lit("").alias("notes")))
    found = base.withColumns({"findings": findings, "regions": regions})

    def layer(i):
        score = ((doc * (i + 3) + n) % 101) / 100
        return F.struct(
            F.lit(LAYERS[i]).alias("layer"), F.lit(LAYERS[i].title()).alias("name"), score.alias("score"),
            (0.5 + ((n + i * 13) % 50) / 100).alias("confidence"),
            S.layer_status(score, F.when((doc + i) % 11 == 0, "skipped")).alias("status"),
            F.when((doc % 3 == 0) & F.lit(i == 4), "modelled").otherwise("live").alias("mode"), F.array().cast(R.PAIR).alias("metrics"),
            F.filter("findings", lambda f: f["layer"] == LAYERS[i]).alias("findings"))
    risk = F.when(doc % 13 != 0, n % 101).cast("int")
    box = F.struct(F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), F.lit(0.3).alias("width"), F.lit(0.1).alias("height"))
    listed = F.sequence(F.lit(1), (n % 4).cast("int"))
    some = F.when(n % 4 > 0, listed).otherwise(F.array().cast("array<int>"))
    return found.select(
        doc.alias("case_id"), S.case_code(F.sha2("text", 256), 2026).alias("caseCode"),
        F.struct(F.lit("papertrail").alias("name"), F.lit("1.0").alias("version")).alias("engine"),
        F.struct(F.concat("source", F.lit(".png")).alias("name"), F.lit("image/png").alias("mimeType"), n.alias("sizeBytes")).alias("file"),
        F.struct(F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.sha1("text").alias("sha1")).alias("hashes"),
        F.struct(S.verdict(risk).alias("label"), risk.alias("riskScore"), ((n % 97) / 96).alias("confidence"),
                 S.worker_recommendation(risk).alias("recommendation")).alias("verdict"),
        F.when(doc % 17 != 0, F.array(*[layer(i) for i in range(5)])).alias("layers"), "findings", "regions",
        F.transform(F.when(n % 3 == 0, some).otherwise(F.array().cast("array<int>")), lambda i: F.struct(
            box.alias("bbox"), F.lit("name").alias("regionType"), (i / 10).alias("confidence"))).alias("unifiedRegions"),
        F.transform(some, lambda i: F.struct(F.lit("name").alias("fieldType"), F.when(i % 2 == 0, "OCR_FIELD_MISMATCH").otherwise(
            "OCR_FIELD_POSITION_CHANGE").alias("type"), F.lit(0.8).alias("confidence"), box.alias("bbox"))).alias("identityFindings"),
        F.struct((doc % 5 != 0).alias("aligned"), F.lit(0.9).alias("alignmentConfidence"), ((n % 100) / 100).alias("structuralDifference"),
                 F.transform(F.when(n % 2 == 0, some).otherwise(F.array().cast("array<int>")), lambda i: F.struct(
                     box.alias("bbox"), (i / 10).alias("score"), (i % 2 == 0).alias("stable"))).alias("changedRegions"),
                 F.transform(F.filter(some, lambda i: i > 2), lambda i: F.struct(
                     F.lit("name").alias("field"), F.lit("a").alias("primary"), F.lit("b").alias("reference"))).alias("fieldDifferences"))
        .alias("referenceComparison"), F.struct(F.lit("reference-based").alias("mode")).alias("reference"),
        F.struct(((n % 50) / 50).alias("agreement"), F.array(F.struct(F.lit("semantic").alias("family"), ((n % 30) / 30).alias("score")))
                 .alias("familyEvidence")).alias("fusion"), (n * 3).alias("durationMs"),
        F.timestamp_seconds(F.lit(1700000000) + doc).alias("createdAt"))


def valid(t):
    return reports(t).filter(R.accepted())


cte("report_docs", """
  SELECT *, CASE WHEN doc_id % 13 <> 0 THEN CAST(n_chars % 101 AS INT) END AS risk, doc_id % 13 <> 0 AND doc_id % 17 <> 0 AS accepted
  FROM documents""")
cte("report_findings", f"""
  SELECT doc_id AS case_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ord, pos, tok AS title,
         (['pixel','metadata','layout','semantic','aigc'])[pos % 5 + 1] AS layer, ({B._codes})[length(tok) % 8 + 1] AS code,
         {B.SEVERITY_SQL.format(s='(length(tok) * 7 % 100) / 100::DOUBLE')} AS severity, (length(tok) % 20) / 20::DOUBLE AS confidence
  FROM tokens WHERE length(tok) >= 8""", "tokens")


@query("report_envelope", "SELECT doc_id AS case_id, accepted FROM report_docs", ("report_docs",))
def _(t):
    return reports(t).select("case_id", F.coalesce(R.accepted(), F.lit(False)).alias("accepted"))


@query("case_rows", f"""
  SELECT doc_id AS case_id, 'SF-2026-' || (CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) % 900000 + 100000) AS case_code,
         source || '.png' AS filename, {B.VERDICT_SQL.format(r='risk')} AS verdict, risk AS risk_score,
         CAST(floor((n_chars % 97) / 96::DOUBLE * 100 + 0.5 + 1e-9) AS INT) AS confidence,
         fix(((doc_id * 3 + n_chars) % 101 + (doc_id * 4 + n_chars) % 101 + (doc_id * 5 + n_chars) % 101 + (doc_id * 6 + n_chars) % 101
              + (doc_id * 7 + n_chars) % 101) / 100::DOUBLE, 2) AS score_sum, 'papertrail v1.0' AS engine,
         CASE WHEN doc_id % 3 = 0 THEN 'modelled' ELSE 'live' END AS execution_mode FROM report_docs WHERE accepted""", ("report_docs",))
def _(t):
    total = F.aggregate(F.map_values("layer_scores"), F.lit(0.0), lambda a, v: a + v)
    return R.to_cases(valid(t)).select("case_id", "case_code", "filename", "verdict", "risk_score", "confidence",
                                       S.fix(total, 2).alias("score_sum"), "engine", "execution_mode")


@query("finding_rows", """
  SELECT f.case_id, ord, layer, code, title, severity, confidence FROM report_findings f
  JOIN report_docs d ON d.doc_id = f.case_id AND accepted""", ("report_docs", "report_findings"))
def _(t):
    return R.to_findings(valid(t)).select("case_id", "ord", "layer", "code", "title", "severity", "confidence")


@query("region_rows", """
  SELECT t.doc_id AS case_id, tok AS label, (['pixel','metadata','layout','semantic','aigc'])[pos % 5 + 1] AS layer,
         fix((pos % 100) / 100::DOUBLE, 4) AS score, fix(0.5::DOUBLE + (pos % 50) / 100::DOUBLE, 4) AS confidence,
         fix((pos % 10) / 10::DOUBLE, 4) AS x, fix((pos % 17) / 20::DOUBLE, 4) AS y
  FROM tokens t JOIN report_docs d ON d.doc_id = t.doc_id AND accepted WHERE length(tok) >= 12""", ("report_docs", "tokens"))
def _(t):
    return R.to_regions(valid(t)).select("case_id", "label", "layer", *[S.fix(c, 4).alias(c) for c in ("score", "confidence", "x", "y")])


@query("flatten_findings", """
  SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY pos % 5, pos) - 1 AS ord, layer, code, severity
  FROM report_findings f JOIN report_docs d ON d.doc_id = f.case_id AND accepted""", ("report_docs", "report_findings"))
def _(t):
    return R.flatten_findings(valid(t))


@query("report_defaults", """
  SELECT doc_id AS case_id, coalesce(risk, 0) AS risk, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE 5 END AS layer_count,
         CASE WHEN n_chars % 3 = 0 THEN n_chars % 4 ELSE 0 END AS region_count, doc_id % 5 <> 0 AS aligned FROM report_docs""", ("report_docs",))
def _(t):
    return R.with_defaults(reports(t))


@query("json_roundtrip", """
  SELECT doc_id AS case_id, risk, CAST(coalesce(n, 0) AS INT) AS findings, true AS unchanged FROM report_docs
  LEFT JOIN (SELECT case_id, count(*) AS n FROM report_findings GROUP BY 1) ON case_id = doc_id""", ("report_docs", "report_findings"))
def _(t):
    written = R.report_to_json(reports(t)).withColumn("r", F.from_json("report", R.REPORT_SCHEMA))
    return written.select("case_id", F.col("r.verdict.riskScore").alias("risk"), F.size("r.findings").alias("findings"),
                          (F.to_json("r") == F.col("report")).alias("unchanged"))


@query("diagnostics", """
  SELECT doc_id AS case_id, fix((n_chars % 50) / 50::DOUBLE, 4) AS agreement, fix((n_chars % 100) / 100::DOUBLE, 4) AS reference_score,
         CASE WHEN n_chars % 2 = 0 THEN n_chars % 4 ELSE 0 END AS changed_regions,
         CASE WHEN n_chars % 4 = 2 THEN 1 ELSE 0 END AS stable_regions, CASE WHEN n_chars % 4 = 3 THEN 1 ELSE 0 END AS field_mismatches,
         ((doc_id * 3 + n_chars) % 101) / 100::DOUBLE AS pixel_score, fix((n_chars % 30) / 30::DOUBLE, 4) AS semantic_score,
         coalesce(tops, '') AS top_findings, n_chars % 4 >= 2 AS direct_mismatch
  FROM report_docs LEFT JOIN (
    SELECT case_id, string_agg(code, ',' ORDER BY rk) AS tops FROM (
      SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY confidence DESC, pos) AS rk FROM report_findings) WHERE rk <= 5
    GROUP BY 1) ON case_id = doc_id WHERE accepted""", ("report_docs", "report_findings"))
def _(t):
    out = R.diagnostics(valid(t)).withColumn("top_findings", F.array_join("top_findings", ","))
    return out.withColumns({c: S.fix(c, 4) for c in ("agreement", "reference_score", "semantic_score")})


@query("localization_sources", """
  WITH counted AS (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN n_chars % 4 ELSE 0 END AS changed,
      CASE WHEN n_chars % 3 = 0 THEN n_chars % 4 ELSE 0 END AS unified, n_chars % 4 // 2 AS fields, coalesce(n, 0) AS raw
    FROM report_docs LEFT JOIN (SELECT doc_id AS d, count(*) AS n FROM tokens WHERE length(tok) >= 12 GROUP BY 1) ON d = doc_id
    WHERE accepted)
  SELECT doc_id AS case_id, s.source, s.boxes FROM (
    SELECT doc_id, unnest([{'source': 'changed', 'boxes': changed}, {'source': 'unified', 'boxes': CASE WHEN changed = 0 THEN unified ELSE 0 END},
      {'source': 'raw', 'boxes': CASE WHEN changed = 0 AND unified = 0 THEN raw ELSE 0 END}, {'source': 'identity', 'boxes': fields}]) AS s
    FROM counted) WHERE s.boxes > 0""", ("report_docs", "tokens"))
def _(t):
    return R.localization_regions(valid(t), reference=True).groupBy("case_id", "source").agg(F.count(F.lit(1)).alias("boxes"))


KINDS = ["jpeg", "png", "pdf", "raster", "unknown"]


@query("layer_applicability", f"""
  SELECT case_id, layer, fix(CASE WHEN barred THEN 0 ELSE score END, 6) AS score, CASE WHEN barred THEN 'skipped' ELSE status END AS status
  FROM (SELECT *, layer IN ('copy-move', 'aigc') AND case_id % 5 IN (2, 4) AS barred FROM layers)""", ("layers",))
def _(t):
    layers = B.layers(t)
    kinds = layers.select("case_id").distinct().withColumn("kind", F.element_at(_array(KINDS), (F.col("case_id") % 5 + 1).cast("int")))
    return fusion.apply_kinds(layers, kinds).select("case_id", "layer", S.fix("score", 6).alias("score"), "status")


@query("pipeline_trace", """
  WITH per AS (SELECT f.*, c.executed, c.alerting FROM fused f JOIN (
    SELECT case_id, count(*) FILTER (status <> 'skipped') AS executed, count(*) FILTER (status = 'alert') AS alerting
    FROM layers GROUP BY case_id) c USING (case_id))
  SELECT case_id, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS step,
         unnest(['upload', 'validate', 'extract', 'analyze', 'crosscheck', 'fuse', 'risk', 'explain']) AS key,
         unnest(['ok', CASE WHEN case_id % 5 = 2 THEN 'warn' ELSE 'ok' END, 'ok', CASE WHEN alerting > 0 THEN 'alert' ELSE 'ok' END,
           CASE WHEN links > 0 THEN 'warn' ELSE 'ok' END, 'ok',
           CASE WHEN risk >= 68 THEN 'alert' WHEN risk >= 45 THEN 'warn' ELSE 'ok' END, 'ok']) AS status,
         unnest([case_id || ' bytes received', 'container resolved as ' || CASE WHEN case_id % 5 = 2 THEN 'pdf (MIME mismatch)' ELSE 'png' END,
           case_id % 100 || ' word(s) recovered', executed || ' detector(s) executed, ' || alerting || ' returned an alert',
           links || ' corroboration link(s)', 'family fusion', 'Risk ' || risk || '/100', alerts || ' alert finding(s) rendered']) AS detail
  FROM per""", ("fused", "layers"))
def _(t):
    case = F.col("case_id")
    known = fused(t).withColumns({
        "type_mismatch": case % 5 == 2, "kind": F.when(case % 5 == 2, "pdf").otherwise("png"), "size_bytes": case, "word_count": case % 100})
    return fusion.pipeline_trace(known)


@query("stream_intake", f"""
  SELECT DISTINCT sha256(text) AS sha256, 'SF-2026-' || (CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) % 900000 + 100000) AS case_code,
         {B.VERDICT_SQL.format(r='risk')} AS verdict, risk AS risk_score, CAST(floor((n_chars % 97) / 96::DOUBLE * 100 + 0.5 + 1e-9) AS INT) AS confidence
  FROM report_docs WHERE accepted""", ("report_docs",))
def _(t):
    """Reports as files, read by the stream until it has all of them; what its commits show. One of equal files is kept."""
    from papertrail.streaming import intake
    folder = run_folder(t.spark, "stream")
    R.report_to_json(reports(t)).select(F.col("report").alias("value")).write.text(f"{folder}/in", compression="gzip")
    split, conf = "spark.sql.files.maxPartitionBytes", t.spark.conf
    kept = conf.get(split)
    conf.set(split, "16m")  # packed files become fifteen times as many bytes; the stream takes the settings with it when it starts
    try:
        stream = intake.stream_reports(t.spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", available_now=True)
    finally:
        conf.set(split, kept)
    stream.awaitTermination()
    return intake.committed(t.spark, f"{folder}/out", "cases").select("sha256", "case_code", "verdict", "risk_score", "confidence")


def _trained(t):
    """Split rows. The features are written first: every reader of the split would else go through the texts again."""
    from papertrail.operators import learn
    from papertrail.plans.evaluation_queries import written_features
    from papertrail.sources.tables import clean_features
    return learn, materialise(learn.group_split(clean_features(written_features(t))[0], 0.8))


def _held_out(t):
    """Predictions of the stored models, genuine or forged and the kind of forgery, for the part they were not trained on."""
    learn, rows = _trained(t)
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    folder = run_folder(t.spark, "models")
    kinds = train.filter("label = 'forged'").withColumn("label", F.col("forgery_type"))
    learn.save_models(learn.calibrate_forest(train), learn.train_forest(kinds), folder)
    binary, types = learn.load_models(folder)
    judged = learn.predict(test.select("doc_id", "sample_id", "forgery_type", "label", *learn.C.FEATURES), binary, types)
    return learn, materialise(judged.join(test.select("doc_id", F.col("label").alias("truth")), "doc_id")), binary


@query("ml_forgery_type")
def _(t):
    """Kind of forgery of every held-out row that is predicted forged."""
    _, judged, _ = _held_out(t)
    return judged.select("doc_id", "predicted", "forgery_type_predicted", S.fix("confidence", 6).alias("confidence"))


@query("ml_metrics")
def _(t):
    """Held-out metrics per class of both models."""
    from papertrail.operators.evaluate import multiclass_metrics
    _, judged, _ = _held_out(t)
    label = multiclass_metrics(judged.select("truth", "predicted")).withColumn("model", F.lit("label"))
    kind = multiclass_metrics(judged.filter("truth = 'forged' AND forgery_type_predicted IS NOT NULL").select(
        F.col("forgery_type").alias("truth"), F.col("forgery_type_predicted").alias("predicted"))).withColumn("model", F.lit("type"))
    return label.unionByName(kind).select("model", "class", "support", "predicted", S.fix("precision", 6).alias("precision"), S.fix("recall", 6).alias("recall"))


@query("ml_importances")
def _(t):
    """Importance of every feature, averaged over the forests of the folds (they sum to one)."""
    learn, rows = _trained(t)
    return learn.importance_rows(t.spark, learn.calibrate_forest(rows.filter("part = 'train'")))


@query("ml_predict")
def _(t):
    """Forest trained on the training part, calibrated by group, applied to the test part."""
    learn, rows = _trained(t)
    models = learn.calibrate_forest(rows.filter("part = 'train'"))
    judged = learn.predict(rows.filter("part = 'test'").select("doc_id", "sample_id", "label", *learn.C.FEATURES), models)
    return judged.select("doc_id", "predicted", S.fix("confidence", 6).alias("confidence"))
