"""Queries over the case register, evaluation labels and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail import constants as C
from papertrail.functions import scalars as S
from papertrail.operators import evaluate as E
from papertrail.operators import register as G
from papertrail.plans import bindings as B
from papertrail.plans.compare_queries import MISMATCH, VISUAL, mismatches, visual
from papertrail.plans.registry import cte, query
from papertrail.session import materialise, run_folder


def cases(t):
    digest = F.md5(F.col("o_orderkey").cast("string"))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    risk = (F.col("o_orderkey") % 101).cast("int")
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        uuid.alias("id"), F.col("o_orderkey").alias("case_id"), F.col("c_name").alias("filename"), S.verdict(risk).alias("verdict"),
        risk.alias("risk_score"), (F.col("o_custkey") % 100).alias("confidence"), (F.col("o_custkey") % 997).alias("duration_ms"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("created_at"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderstatus").alias("report"))


cte("cases", f"""
  SELECT substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4) || '-' || substr(d, 17, 4) || '-' || substr(d, 21, 12)
           AS id, case_id, filename, {B.VERDICT_SQL.format(r='risk_score')} AS verdict, risk_score, confidence, duration_ms,
         created_at, report
  FROM (SELECT md5(CAST(o_orderkey AS VARCHAR)) AS d, o_orderkey AS case_id, c_name AS filename,
               CAST(o_orderkey % 101 AS INT) AS risk_score, o_custkey % 100 AS confidence, o_custkey % 997 AS duration_ms,
               strftime(o_orderdate, '%Y-%m-%d') AS created_at, 'order ' || o_orderkey || ' ' || o_orderstatus AS report
        FROM orders JOIN customer ON c_custkey = o_custkey)""")
LISTED = "id, filename, verdict, risk_score, confidence, duration_ms, created_at"


@query("case_search", f"""
  SELECT {LISTED} FROM cases WHERE verdict = 'suspicious' AND filename ILIKE '%omer#_%9%' ORDER BY created_at DESC, id LIMIT 40""",
       ("cases",))
def _(t):
    return G.search(cases(t), "suspicious", "omer#_%9", limit=40)


@query("case_page", f"SELECT {LISTED} FROM cases ORDER BY created_at DESC, id LIMIT 60 OFFSET 30", ("cases",))
def _(t):
    return G.search(cases(t), "all", None, limit=500, offset=30)


@query("case_by_id", "SELECT * FROM cases WHERE id = 'a1d0c6e8-3f02-7327-d846-1063f4ac58a6'", ("cases",))
def _(t):
    return G.case_by_id(cases(t), "A1D0C6E8-3F02-7327-D846-1063F4AC58A6")


STATS = """
  SELECT count(*) AS total, count(*) FILTER (risk_score >= 68) AS forged,
         count(*) FILTER (risk_score >= 45 AND risk_score < 68) AS suspicious, count(*) FILTER (risk_score < 45) AS authentic,
         CAST(coalesce(round(avg(risk_score)), 0) AS INT) AS mean_risk, CAST(coalesce(round(avg(duration_ms)), 0) AS INT) AS mean_duration
  FROM """


@query("register_stats", STATS + "cases", ("cases",))
def _(t):
    return G.statistics(cases(t))


@query("stream_stats", STATS + "cases", ("cases",))
def _(t):
    """The statistics kept by a stream that has read the register's files."""
    from papertrail.streaming.intake import stream_register_stats
    folder = run_folder(t.spark, "register")
    rows = cases(t)
    rows.write.parquet(folder)
    name = "stats_" + folder[-32:]
    stream_register_stats(t.spark.readStream.schema(rows.schema).parquet(folder), name, available_now=True).awaitTermination()
    return t.spark.table(name)


@query("register_recent", STATS + "(SELECT * FROM cases ORDER BY created_at DESC, id LIMIT 50)", ("cases",))
def _(t):
    return G.statistics(G.recent(cases(t)))


@query("case_delete_cascade", """
  WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
  SELECT 'cases' AS part, count(*) AS kept, CAST(sum(case_id) AS BIGINT) AS key_sum FROM cases
    WHERE case_id NOT IN (SELECT o_orderkey FROM gone)
  UNION ALL SELECT 'findings', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone) AND l_discount > 0.05
  UNION ALL SELECT 'regions', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)""", ("cases",))
def _(t):
    gone = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("id"))
    listed = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("key"))
    regions = t.lineitem.select(F.col("l_orderkey").alias("case_id"), "l_discount")
    kept = G.delete_cases(gone, listed, regions.filter("l_discount > 0.05"), regions)
    parts = [df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("kept"), F.sum(key).alias("key_sum"))
             for df, name, key in zip(kept, ("cases", "findings", "regions"), ("key", "case_id", "case_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ----------------------------------------------------------------- evaluation
def records(t, threshold=50):
    truth = t.labels.select(F.col("doc_id").alias("case_id"), (F.col("quality") == 0).alias("truth"))
    reports = t.documents.select(F.col("doc_id").alias("case_id"), (F.col("n_chars") % 101).alias("risk"), "lang",
                                 F.when(F.col("doc_id") % 3 == 0, "none").otherwise(F.col("source")).alias("manipulation"),
                                 "n_chars")
    return E.eval_records(truth, reports, threshold)


cte("records", """
  SELECT d.doc_id AS case_id, quality = 0 AS truth, n_chars % 101 AS risk, lang, n_chars,
         CASE WHEN d.doc_id % 3 = 0 THEN 'none' ELSE source END AS manipulation
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id""")
RATES = """
  tp, tn, fp, fn, fix(precision, 4) AS precision, fix(recall, 4) AS recall,
  fix(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 4) AS f1,
  fix(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 4) AS fpr, fix(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END, 4) AS fnr"""


def rates_from(source, key="", threshold=45):
    group = f"GROUP BY {key}" if key else ""
    lead = f"{key}," if key else ""
    return f"""(SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
                       CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall
      FROM (SELECT {lead} count(*) FILTER (truth AND risk >= {threshold}) AS tp, count(*) FILTER (NOT truth AND risk < {threshold}) AS tn,
                   count(*) FILTER (NOT truth AND risk >= {threshold}) AS fp, count(*) FILTER (truth AND risk < {threshold}) AS fn
            FROM {source} {group}))"""


def _fixed(df):
    return df.withColumns({c: S.fix(c, 4) for c in ("precision", "recall", "f1", "fpr", "fnr")})


@query("eval_records", """
  SELECT case_id, truth, risk >= 50 AS predicted, CASE WHEN risk >= 50 AND NOT truth THEN 'false-positive'
         WHEN risk < 50 AND truth THEN 'false-negative' END AS error FROM records""", ("records",))
def _(t):
    return records(t).select("case_id", "truth", "predicted", "error")


@query("binary_metrics", f"SELECT {RATES} FROM {rates_from('records')}", ("records",))
def _(t):
    return _fixed(E.binary_metrics(records(t, 45)))


@query("auc", """
  SELECT fix(sum(CASE WHEN p.risk > n.risk THEN 1 WHEN p.risk = n.risk THEN 0.5 ELSE 0 END) / count(*), 6) AS auc,
         (SELECT count(*) FROM records WHERE truth) AS positives, (SELECT count(*) FROM records WHERE NOT truth) AS negatives
  FROM records p JOIN records n ON p.truth AND NOT n.truth""", ("records",))
def _(t):
    return E.auc(records(t)).withColumn("auc", S.fix("auc", 6))


_grouped = """(SELECT *, CASE WHEN NOT truth AND manipulation <> 'none' THEN 'benign_transformations' ELSE manipulation END AS grp
  FROM records)"""


@query("metrics_by_group", f"""
  SELECT grp AS "group", tp + tn + fp + fn AS cases, CASE WHEN ok THEN 'rated' ELSE 'insufficient_cases' END AS status,
         CASE WHEN ok THEN precision END AS precision, CASE WHEN ok THEN recall END AS recall, CASE WHEN ok THEN f1 END AS f1,
         CASE WHEN ok THEN fpr END AS fpr, CASE WHEN ok THEN fnr END AS fnr
  FROM (SELECT grp, {RATES}, tp + fn > 0 AND tn + fp > 0 AS ok FROM {rates_from(_grouped, 'grp', 50)})""", ("records",))
def _(t):
    return _fixed(E.metrics_by_group(records(t)))


_ALL_RATES = ("precision", "recall", "f1", "fpr", "fnr")


@query("evaluation_document", f"""
  WITH whole AS (SELECT {RATES} FROM {rates_from('records', '', 50)}),
  grouped AS (SELECT grp, {RATES}, tp + fn > 0 AND tn + fp > 0 AS ok FROM {rates_from(_grouped, 'grp', 50)})
  {" UNION ALL ".join([f"SELECT 'metrics' AS section, '{c}' AS name, {c}::DOUBLE AS value FROM whole" for c in _ALL_RATES]
                      + [f"SELECT 'confusion', '{c}', {c}::DOUBLE FROM whole" for c in ("tp", "tn", "fp", "fn")]
                      + [f"SELECT 'failures', '{c}', {c}::DOUBLE FROM whole" for c in ("fp", "fn")]
                      + ["SELECT 'metrics', 'cases', count(*)::DOUBLE FROM records",
                         "SELECT 'metrics', 'roc_auc', fix(sum(CASE WHEN p.risk > n.risk THEN 1 WHEN p.risk = n.risk THEN 0.5 ELSE 0 END) / count(*), 4) "
                         "FROM records p JOIN records n ON p.truth AND NOT n.truth"]
                      + [f"SELECT grp, '{c}', CASE WHEN ok THEN {c} END::DOUBLE FROM grouped" for c in _ALL_RATES]
                      + ["SELECT grp, 'cases', (tp + tn + fp + fn)::DOUBLE FROM grouped"])}""", ("records",))
def _(t):
    folder = run_folder(t.spark, "evaluation")
    E.write_evaluation(records(t), folder, "documents", "reference-free")
    return E.read_evaluation(t.spark, folder).withColumn("value", S.fix("value", 4))


def classes(t):
    langs = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])
    return t.documents.select(F.col("lang").alias("truth"),
                              F.when(F.col("n_chars") % 3 > 0, F.col("lang")).otherwise(
                                  F.element_at(langs, (F.col("n_chars") % 4 + 1).cast("int"))).alias("predicted"))


CLASSES = """(SELECT lang AS truth, CASE WHEN n_chars % 3 > 0 THEN lang ELSE (['de','en','es','fr'])[n_chars % 4 + 1] END AS predicted
  FROM documents)"""


@query("multiclass_metrics", f"""
  SELECT c.class, support, predicted, fix(CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END, 4) AS precision,
         fix(CASE WHEN support > 0 THEN hits / support ELSE 0 END, 4) AS recall
  FROM (SELECT class, (SELECT count(*) FROM {CLASSES} WHERE truth = class) AS support,
               (SELECT count(*) FROM {CLASSES} WHERE predicted = class) AS predicted,
               (SELECT count(*) FROM {CLASSES} WHERE truth = class AND predicted = class) AS hits
        FROM (SELECT DISTINCT unnest([truth, predicted]) AS class FROM {CLASSES})) c""")
def _(t):
    return E.multiclass_metrics(classes(t)).withColumns({"precision": S.fix("precision", 4), "recall": S.fix("recall", 4)})


@query("confusion_matrix", f"SELECT truth, predicted, count(*) AS n FROM {CLASSES} GROUP BY 1, 2")
def _(t):
    return E.confusion_counts(classes(t))


@query("failure_split", """
  SELECT case_id, risk, CASE WHEN truth THEN 'false-negative' ELSE 'false-positive' END AS error FROM records
  WHERE truth <> (risk >= 50)""", ("records",))
def _(t):
    return E.failures(records(t)).select("case_id", "risk", "error")


@query("failure_causes", """
  SELECT case_id, CASE WHEN truth = predicted THEN NULL
    WHEN truth AND NOT predicted THEN CASE WHEN NOT reference THEN 'no-trusted-value'
      WHEN field AND NOT direct THEN 'field-not-compared' WHEN alignment < 0.8::DOUBLE THEN 'alignment-too-low'
      ELSE 'evidence-below-boundary' END
    WHEN reference AND changed > 0 AND stable = 0 AND NOT direct THEN 'benign-difference-promoted'
    ELSE 'other-signal-crossed-boundary' END AS cause
  FROM (SELECT case_id, truth, risk >= 45 AS predicted, case_id % 2 = 0 AS reference, n_chars % 4 = 0 AS direct,
               case_id % 3 = 0 AS field, (60 + case_id % 40) / 100::DOUBLE AS alignment, n_chars % 5 AS changed,
               n_chars % 2 AS stable FROM records)""", ("records",))
def _(t):
    case, n = F.col("case_id"), F.col("n_chars")
    diagnosed = records(t, 45).withColumns({
        "reference": case % 2 == 0, "direct_mismatch": n % 4 == 0, "expected_field": F.when(case % 3 == 0, "name"),
        "alignment_confidence": (60 + case % 40) / 100, "changed_regions": n % 5, "stable_regions": n % 2})
    return E.failure_cause(diagnosed).select("case_id", "cause")


@query("pair_regression", """
  SELECT a.doc_id // 2 AS pair_id, b.n_chars % 101 - a.n_chars % 101 AS delta, b.n_chars % 101 > a.n_chars % 101 AS stronger,
         b.n_chars % 5 >= 2 AS independent_evidence
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0""")
def _(t):
    halves = t.documents.select(F.floor(F.col("doc_id") / 2).alias("pair_id"), (F.col("doc_id") % 2).alias("half"),
                                (F.col("n_chars") % 101).alias("risk"), (F.col("n_chars") % 5).alias("active_families"))
    return E.pair_regression(halves.filter("half = 0"), halves.filter("half = 1"))


@query("field_detected", f"""
  SELECT case_id, expected_field, m.field_type IS NOT NULL OR v.field IS NOT NULL AS detected,
         CASE WHEN m.field_type IS NOT NULL THEN 'OCR_FIELD_MISMATCH' WHEN v.field IS NOT NULL THEN 'REF-FIELD' END AS source
  FROM (SELECT o_orderkey AS case_id, ({B._field_types})[(o_orderkey + o_custkey % 3) % 11 + 1] AS expected_field FROM orders)
  LEFT JOIN (SELECT case_id AS mc, field_type FROM ({MISMATCH})) m ON mc = case_id AND m.field_type = expected_field
  LEFT JOIN (SELECT case_id AS vc, field FROM ({VISUAL})) v ON vc = case_id AND v.field = expected_field""", ("order_fields", "field_findings"))
def _(t):
    expected = t.orders.select(F.col("o_orderkey").alias("case_id"),
                               B._field_type(F.col("o_orderkey") + F.col("o_custkey") % 3).alias("expected_field"))
    return E.field_detected(expected, mismatches(t).withColumn("ord", F.lit(1)), visual(t))


_categories = C.AUTHENTIC_CATEGORIES + C.MANIPULATED_CATEGORIES
_cat_sql = "[" + ", ".join(f"'{c}'" for c in _categories) + "]"


@query("category_coverage", f"""
  SELECT category, CASE WHEN o <= {len(C.AUTHENTIC_CATEGORIES)} THEN 'authentic' ELSE 'manipulated' END AS kind,
         coalesce(n, 0) AS cases, n IS NULL AS missing
  FROM (SELECT unnest({_cat_sql}) AS category, unnest(range(1, {len(_categories) + 1})) AS o)
  LEFT JOIN (SELECT ({_cat_sql})[n_chars % 37 * 2 % 23 + 1] AS category, count(*) AS n FROM documents GROUP BY 1) USING (category)""")
def _(t):
    place = (F.col("n_chars") % 37 * 2 % 23 + 1).cast("int")
    named = t.documents.select(F.try_element_at(F.array(*[F.lit(c) for c in _categories]), place).alias("category"))
    return E.category_coverage(named)


# ----------------------------------------------------------------- features
def features(t):
    """Five text features of labelled documents; some rows have missing values."""
    text = F.col("text")
    size = F.length(text)

    def share(pattern):
        return F.regexp_count(text, F.lit(pattern)) / size
    joined = t.spread("documents", "doc_id").join(t.labels, "doc_id")
    broken = F.col("doc_id") % 17 == 0
    return joined.select(
        F.concat(F.upper("lang"), F.lit("-"), F.floor(F.col("doc_id") / 4).cast("string"), F.lit("_"),
                 F.when(F.col("quality") == 1, "none").when(F.col("toxic") == 1, "whiteout").otherwise("copy_move"))
        .alias("sample_id"), "doc_id", F.col("lang").alias("doc_type"), (1 - F.col("quality")).alias("label"),
        F.when(F.col("quality") == 1, "none").when(F.col("toxic") == 1, "whiteout").otherwise("copy_move").alias("forgery_type"),
        F.col("n_chars").cast("double").alias("ocr_confidence"), share("[0-9]").alias("ela_score"),
        share("[A-Z]").alias("copy_move_score"), F.when(broken, float("nan")).otherwise(share("[aeiou]")).alias("noise_anomaly"),
        share("\n").alias("text_inconsistency"))


def written_features(t):
    """The features, written once: Spark would else compute them anew for every condition on them, and where the texts are read,
    before these are dealt out."""
    return materialise(features(t))


def _share(pattern):
    return f"len(regexp_extract_all(text, '{pattern}')) / length(text)::DOUBLE"


cte("features", f"""
  SELECT upper(lang) || '-' || (d.doc_id // 4) || '_' || kind AS sample_id, d.doc_id, lang AS doc_type, 1 - quality AS label,
         kind AS forgery_type, CAST(n_chars AS DOUBLE) AS ocr_confidence, {_share('[0-9]')} AS ela_score,
         {_share('[A-Z]')} AS copy_move_score,
         CASE WHEN d.doc_id % 17 = 0 THEN 'NaN'::DOUBLE ELSE {_share('[aeiou]')} END AS noise_anomaly,
         {_share(chr(10))} AS text_inconsistency
  FROM documents d JOIN (SELECT *, CASE WHEN quality = 1 THEN 'none' WHEN toxic = 1 THEN 'whiteout' ELSE 'copy_move' END AS kind
                         FROM labels) l ON l.doc_id = d.doc_id""")


def _rounded_features(df, *keys):
    return df.select(*keys, *[S.fix(c, 6).alias(c) for c in C.FEATURES])


_ROUNDED = ", ".join(f"fix({c}, 6) AS {c}" for c in C.FEATURES)


@query("features_clean", f"""
  SELECT doc_id, sample_id, CASE label WHEN 1 THEN 'forged' ELSE 'genuine' END AS label, {_ROUNDED} FROM features
  WHERE NOT isnan(noise_anomaly)""", ("features",))
def _(t):
    from papertrail.sources.tables import clean_features
    clean, _dropped = clean_features(written_features(t))
    return _rounded_features(clean, "doc_id", "sample_id", "label")


@query("features_three_class", f"""
  SELECT doc_id, CASE forgery_type WHEN 'none' THEN 'genuine' ELSE forgery_type END AS label, {_ROUNDED} FROM features
  WHERE forgery_type IN ('none', 'copy_move', 'text_replace') AND NOT isnan(noise_anomaly)""", ("features",))
def _(t):
    from papertrail.sources.tables import three_class_features
    return _rounded_features(three_class_features(written_features(t))[0], "doc_id", "label")


@query("feature_summary", " UNION ALL ".join(f"""
  SELECT '{c}' AS feature, fix(min({c}) FILTER (NOT isnan({c})), 6) AS lowest, fix(avg({c}) FILTER (NOT isnan({c})), 6) AS mean,
         fix(max({c}) FILTER (NOT isnan({c})), 6) AS highest, count(*) FILTER (NOT isnan({c})) AS valid,
         count(*) FILTER (isnan({c})) AS nan_cells FROM features""" for c in C.FEATURES), ("features",))
def _(t):
    return E.feature_summary(features(t), C.FEATURES).withColumns({c: S.fix(c, 6) for c in ("lowest", "mean", "highest")})


@query("features_roundtrip", f"""
  SELECT sample_id, doc_type, CAST(label AS VARCHAR) AS label, forgery_type, {", ".join(f"fix({c}, 4) AS {c}" for c in C.FEATURES)} FROM features""", ("features",))
def _(t):
    from papertrail.sources import tables
    folder = run_folder(t.spark, "features")
    tables.write_features(features(t), folder)
    return tables.read_features(t.spark, folder).select("sample_id", "doc_type", "label", "forgery_type", *C.FEATURES)


@query("class_balance", "SELECT label, forgery_type, count(*) AS rows FROM features GROUP BY 1, 2", ("features",))
def _(t):
    return features(t).groupBy("label", "forgery_type").agg(F.count(F.lit(1)).alias("rows"))


@query("group_split", """
  WITH grouped AS (SELECT *, regexp_extract(sample_id, '^(.*-[0-9]+)_', 1) AS grp FROM features),
  ranked AS (SELECT grp, row_number() OVER (ORDER BY sha256(grp), grp) AS rk, count(*) OVER () AS n
             FROM (SELECT DISTINCT grp FROM grouped))
  SELECT doc_id, grp AS source_group, CASE WHEN rk <= ceil(n * 0.8::DOUBLE - 1e-9) THEN 'train' ELSE 'test' END AS part
  FROM grouped JOIN ranked USING (grp)""", ("features",))
def _(t):
    from papertrail.operators.learn import group_split
    return group_split(features(t), 0.8).select("doc_id", "source_group", "part")


@query("stratified_split", """
  SELECT doc_id, forgery_type, CASE WHEN rk <= ceil(n * 0.8::DOUBLE - 1e-9) THEN 'train' ELSE 'test' END AS part
  FROM (SELECT *, row_number() OVER (PARTITION BY forgery_type ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS rk,
               count(*) OVER (PARTITION BY forgery_type) AS n FROM features)""", ("features",))
def _(t):
    from papertrail.operators.learn import stratified_split
    return stratified_split(features(t), "forgery_type", "doc_id", 0.8).select("doc_id", "forgery_type", "part")


@query("ml_gate", """
  SELECT doc_id AS case_id, domain, CASE WHEN inside THEN 0.5::DOUBLE * p ELSE 0 END AS score,
         CASE WHEN inside THEN least(0.5::DOUBLE, c) ELSE 0 END AS confidence,
         CASE WHEN NOT inside THEN 'skipped' WHEN 0.5::DOUBLE * p >= 0.5::DOUBLE THEN 'alert'
              WHEN 0.5::DOUBLE * p >= 0.28::DOUBLE THEN 'review' ELSE 'pass' END AS status
  FROM (SELECT *, domain IN ('invoice', 'marksheet') AS inside FROM (
    SELECT doc_id, (n_chars % 101) / 100::DOUBLE AS p, 0.3::DOUBLE + (n_chars % 7) / 10::DOUBLE AS c,
      CASE WHEN regexp_matches(l, 'identity|reg\\.no|student''s|student’s|student id') THEN 'identity-card'
           WHEN regexp_matches(l, 'invoice|gst|subtotal|tax') THEN 'invoice'
           WHEN regexp_matches(l, 'marksheet|marks|semester|grade') THEN 'marksheet'
           WHEN regexp_matches(l, 'certificate|certify|degree') THEN 'certificate' ELSE 'general' END AS domain
    FROM (SELECT doc_id, n_chars, lower(text) AS l FROM documents)))""")
def _(t):
    from papertrail.operators.fusion import gate_ml
    predicted = t.documents.select(F.col("doc_id").alias("case_id"), S.document_domain(F.col("text")).alias("domain"),
                                   ((F.col("n_chars") % 101) / 100).alias("probability"),
                                   (0.3 + (F.col("n_chars") % 7) / 10).alias("confidence"))
    return gate_ml(predicted)
