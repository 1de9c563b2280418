"""Observation tables derived from the driver tables (and as shared SQL CTEs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail import constants as C
from papertrail.functions import scalars as S
from papertrail.plans.registry import Tables, cte


def expr(text: str) -> Column:
    return F.expr(text)


# ----------------------------------------------------------------- layers, findings
FIRST_LAYER = {"click": "pixel", "error": "metadata", "view": "layout", "signup": "qr-barcode", "purchase": "semantic"}
SECOND_LAYER = ["deep-tamper-srm", "copy-move", "aigc", "reference", "compression", "ml-classifier", "ocr"]
CODES = ["SEM-ARITH", "REF-FIELD", "REF-QR", "QR_OCR_MISMATCH", "REF-COMPARE", "PX-ELA", "SRM-LOCAL", "PX-NOISE"]
LINK_CODES = ["XC-CORR", "LXT-DEV"]


def case_of_event() -> Column:
    return (F.col("user_id") * 100 + F.day("ts")).alias("case_id")


def layers(t: Tables) -> DataFrame:
    """Every event feeds two layers of its case: one by type, one by id."""
    second = F.element_at(F.array(*[F.lit(x) for x in SECOND_LAYER]), (F.col("event_id") % 7 + 1).cast("int"))
    seen = t.events.select(case_of_event(), "event_id", "value", F.explode(F.array(
        S.lookup(FIRST_LAYER, F.col("event_type")), second)).alias("layer"))
    grouped = seen.groupBy("case_id", "layer").agg(
        F.max("value").alias("top"), F.count(F.lit(1)).alias("n"), F.max(F.col("event_id") % 10).alias("last"))
    score = F.least(F.lit(1.0), F.col("top") / 60)
    scored = grouped.withColumn("score", score)
    return scored.select(
        "case_id", "layer", S.lookup({k: v[0] for k, v in C.LAYERS.items()}, F.col("layer")).alias("name"),
        S.lookup({k: v[1] for k, v in C.LAYERS.items()}, F.col("layer")).alias("category"),
        S.lookup({k: v[2] for k, v in C.LAYERS.items()}, F.col("layer")).alias("weight"), "score",
        (0.5 + 0.5 * F.least(F.lit(1.0), F.col("n") / 4)).alias("confidence"),
        S.layer_status(F.col("score"), F.when(F.col("last") == 0, "skipped")).alias("status"),
        F.when(F.col("layer") == "aigc", "modelled").otherwise("live").alias("mode"),
        (F.col("n") * 10).alias("duration_ms"),
        F.array(F.struct(F.lit("Observations").alias("label"), F.col("n").cast("string").alias("value")),
                F.struct(F.lit("Noise divergence").alias("label"),
                         F.when(F.col("n") > 1, F.format_string("%.3f", S.fix(F.col("top") / 500, 3)))
                         .otherwise("n/a").alias("value"))).alias("metrics"))


def _values(mapping: dict) -> str:
    return ", ".join(f"('{k}', {v})" for k, v in mapping.items())


_registry_rows = ", ".join(
    f"('{k}', '{v[0]}', '{v[1]}', {v[2]}::DOUBLE, '{C.LAYER_FAMILY.get(k, C.DEFAULT_FAMILY)}')"
    for k, v in C.LAYERS.items())
cte("registry", f"SELECT * FROM (VALUES {_registry_rows}) r(layer, name, category, weight, family)")
_families = ", ".join(f"('{k}', {v}::DOUBLE, {i})" for i, (k, v) in enumerate(C.FAMILY_WEIGHTS.items()))
cte("families", f"SELECT * FROM (VALUES {_families}) f(family, fweight, ford)")
_first = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FIRST_LAYER.items())
_second = "[" + ", ".join(f"'{x}'" for x in SECOND_LAYER) + "]"
cte("layers", f"""
  SELECT g.case_id, g.layer, r.name, r.category, r.weight, r.family, g.score,
         0.5::DOUBLE + 0.5::DOUBLE * least(1::DOUBLE, n / 4::DOUBLE) AS confidence,
         CASE WHEN last = 0 THEN 'skipped' WHEN score >= 0.5::DOUBLE THEN 'alert'
              WHEN score >= 0.28::DOUBLE THEN 'review' ELSE 'pass' END AS status,
         n, top
  FROM (SELECT case_id, layer, least(1::DOUBLE, max(value) / 60) AS score, max(value) AS top,
               count(*) AS n, max(event_id % 10) AS last
        FROM (SELECT user_id * 100 + day(ts) AS case_id, event_id, value,
                     unnest([CASE event_type {_first} END, ({_second})[event_id % 7 + 1]]) AS layer
              FROM events) GROUP BY case_id, layer) g
  JOIN registry r ON r.layer = g.layer""", "registry")


def findings(t: Tables) -> DataFrame:
    """Events above the alert value, one finding each, ordered by event id."""
    codes = F.array(*[F.lit(c) for c in CODES])
    link = F.element_at(F.array(*[F.lit(c) for c in LINK_CODES]), (F.col("event_id") % 2 + 1).cast("int"))
    code = F.when(F.col("value") > 250, link).otherwise(
        F.element_at(codes, (F.col("event_id") % 8 + 1).cast("int")))
    return t.events.filter(F.col("value") > 60).select(
        case_of_event(), F.col("event_id").alias("ord"), S.lookup(FIRST_LAYER, F.col("event_type")).alias("layer"),
        code.alias("code"), S.severity_band(F.least(F.lit(1.0), F.col("value") / 200)).alias("severity"),
        F.least(F.lit(0.97), 0.4 + F.col("value") / 500).alias("confidence"))


_codes = "[" + ", ".join(f"'{x}'" for x in CODES) + "]"
_links = "[" + ", ".join(f"'{x}'" for x in LINK_CODES) + "]"
SEVERITY_SQL = ("CASE WHEN {s} >= 0.82::DOUBLE THEN 'critical' WHEN {s} >= 0.66::DOUBLE THEN 'high' "
                "WHEN {s} >= 0.45::DOUBLE THEN 'medium' WHEN {s} >= 0.26::DOUBLE THEN 'low' "
                "WHEN {s} >= 0.14::DOUBLE THEN 'info' ELSE 'benign' END")
VERDICT_SQL = ("CASE WHEN {r} >= 86 THEN 'forged' WHEN {r} >= 68 THEN 'likely-forged' WHEN {r} >= 45 THEN 'suspicious' "
               "WHEN {r} >= 24 THEN 'low-risk' ELSE 'authentic' END")
STATUS_SQL = "CASE WHEN {s} >= 0.5::DOUBLE THEN 'alert' WHEN {s} >= 0.28::DOUBLE THEN 'review' ELSE 'pass' END"
RISK_SQL = ("CAST(fix(least(0.995::DOUBLE, greatest(0.005::DOUBLE, 1 / (1 + exp(-5.2::DOUBLE * "
            "({m} - 0.45::DOUBLE))))) * 100, 0) AS INT)")
cte("findings", f"""
  SELECT user_id * 100 + day(ts) AS case_id, event_id AS ord, CASE event_type {_first} END AS layer,
         CASE WHEN value > 250 THEN ({_links})[event_id % 2 + 1] ELSE ({_codes})[event_id % 8 + 1] END AS code,
         {SEVERITY_SQL.format(s="least(1::DOUBLE, value / 200)")} AS severity,
         least(0.97::DOUBLE, 0.4::DOUBLE + value / 500) AS confidence
  FROM events WHERE value > 60""")
cte("finding_family", """
  SELECT *, CASE WHEN code LIKE 'REF-FIELD%' OR code LIKE 'REF-TEXT%' OR code LIKE 'OCR\\_FIELD%' ESCAPE '\\'
                   OR code LIKE 'SEM-%' THEN 'semantic'
                 WHEN code LIKE 'QR\\_%' ESCAPE '\\' OR code LIKE 'REF-QR%' THEN 'encoded-data'
                 WHEN code LIKE 'REF-%' THEN 'structural/reference'
                 WHEN code LIKE 'PX-ELA%' OR code LIKE 'SRM-%' THEN 'pixel/residual' END AS family
  FROM findings""", "findings")
cte("family_scores", """
  SELECT c.case_id, f.family, f.fweight, f.ford, coalesce(n.found, 0) AS found, s.members, s.conf, s.total,
         CASE WHEN s.strength IS NULL THEN 0::DOUBLE
              ELSE least(1::DOUBLE, s.strength + least(0.08::DOUBLE, coalesce(n.found, 0) * 0.01::DOUBLE)) END AS score
  FROM (SELECT DISTINCT case_id FROM layers) c CROSS JOIN families f
  LEFT JOIN (SELECT case_id, family, least(1::DOUBLE, sum(part)) AS strength, max(confidence) AS conf,
                    sum(score) AS total, string_agg(layer, ',' ORDER BY layer) AS members
             FROM (SELECT *, score * CASE WHEN rk = 1 THEN 1::DOUBLE ELSE 0.12::DOUBLE / rk END AS part
                   FROM (SELECT *, row_number() OVER (PARTITION BY case_id, family ORDER BY score DESC, layer) AS rk
                         FROM layers WHERE status <> 'skipped'))
             GROUP BY case_id, family) s ON s.case_id = c.case_id AND s.family = f.family
  LEFT JOIN (SELECT case_id, family, count(*) AS found FROM finding_family WHERE family IS NOT NULL
             GROUP BY case_id, family) n ON n.case_id = c.case_id AND n.family = f.family""",
    "layers", "families", "finding_family")
cte("alerts", """
  SELECT case_id, count(*) FILTER (severity IN ('high', 'critical')) AS alerts,
         count(*) FILTER (severity = 'critical') AS criticals, count(*) FILTER (code LIKE 'XC-%') AS links
  FROM findings GROUP BY case_id""", "findings")
cte("fused", f"""
  SELECT *, {VERDICT_SQL.format(r="risk")} AS verdict,
         fix(least(0.98::DOUBLE, 0.30::DOUBLE + mean_conf * 0.26::DOUBLE + agreement * 0.12::DOUBLE
               + active / 6::DOUBLE * 0.16::DOUBLE + least(0.16::DOUBLE, greatest(0, active - 1) * 0.04::DOUBLE)), 3)
           AS confidence
  FROM (SELECT m.case_id, mass, active, {RISK_SQL.format(m="mass")} AS risk, coalesce(mean_conf, 0) AS mean_conf,
               fix(greatest(0::DOUBLE, 1 - coalesce(sigma, 0) / 0.32::DOUBLE), 3) AS agreement,
               coalesce(a.alerts, 0) AS alerts, coalesce(a.links, 0) AS links
        FROM (SELECT case_id, sum(fweight * score) AS mass, count(*) FILTER (score > 0) AS active,
                     stddev_pop(score) FILTER (score > 0) AS sigma, avg(conf) FILTER (score > 0) AS mean_conf
              FROM family_scores GROUP BY case_id) m
        LEFT JOIN alerts a ON a.case_id = m.case_id)""", "family_scores", "alerts")


# ----------------------------------------------------------------- regions
REGION_LAYERS = {"AF": "pixel", "AO": "copy-move", "NF": "layout", "NO": "semantic", "RF": "reference",
                 "RO": "deep-tamper-srm"}
REGION_LABELS = ["portrait area", "QR block", "signature line", "issue date", "holder name", "texture anomaly"]


def regions(t: Tables) -> DataFrame:
    """One region per order line, numbered within its order."""
    from papertrail.operators.skew import row_numbers
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("case_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        ((F.col("l_partkey") % 80) / 100).alias("x"), ((F.col("l_suppkey") % 80) / 100).alias("y"),
        (0.05 + F.col("l_quantity") / 250).alias("width"), (0.05 + F.col("l_linenumber") / 50).alias("height"),
        F.least(F.lit(1.0), 10 * F.col("l_discount")).alias("score"), (0.5 + 5 * F.col("l_tax")).alias("confidence"),
        S.lookup(REGION_LAYERS, F.concat("l_returnflag", "l_linestatus")).alias("layer"),
        F.element_at(F.array(*[F.lit(x) for x in REGION_LABELS]), (F.col("l_partkey") % 6 + 1).cast("int"))
        .alias("label"))
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    bucket = [F.col("l_linenumber"), F.floor(F.col("l_partkey") / 4096)]
    out = row_numbers(lines, ["case_id"], order, bucket, out="ord")
    return out.select("case_id", "ord", "layer", F.col("layer").alias("detector"), "label", "score", "confidence",
                      "x", "y", "width", "height", F.lit("residual map").alias("technique"),
                      F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("notes"))


_region_layer = "CASE l_returnflag || l_linestatus " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in REGION_LAYERS.items()) + " END"
_region_labels = "[" + ", ".join(f"'{x}'" for x in REGION_LABELS) + "]"
cte("regions", f"""
  SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, {_region_layer} AS layer,
         ({_region_labels})[l_partkey % 6 + 1] AS label, (l_partkey % 80) / 100::DOUBLE AS x,
         (l_suppkey % 80) / 100::DOUBLE AS y, 0.05::DOUBLE + l_quantity / 250 AS width,
         0.05::DOUBLE + l_linenumber / 50::DOUBLE AS height, least(1::DOUBLE, 10 * l_discount) AS score,
         0.5::DOUBLE + 5 * l_tax AS confidence, 'part ' || l_partkey AS notes FROM lineitem""")

FIELD_TYPES = list(C.FIELD_LABELS)


def _field_type(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in FIELD_TYPES]), (number % len(FIELD_TYPES) + 1).cast("int"))


def region_fields(t: Tables) -> DataFrame:
    """Three identity fields per order."""
    return t.orders.select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).select(
        F.col("o_orderkey").alias("case_id"), F.col("i").alias("ord"),
        _field_type(F.col("o_orderkey") + F.col("i")).alias("field_type"),
        F.concat(F.lit("value "), F.col("o_custkey").cast("string")).alias("raw_text"),
        (0.5 + (F.col("o_custkey") % 40) / 100).alias("confidence"),
        F.struct(((F.col("o_custkey") % 60) / 100 + 0.1 * F.col("i")).alias("x"),
                 ((F.col("o_orderkey") % 60) / 100).alias("y"), F.lit(0.2).alias("width"),
                 F.lit(0.15).alias("height")).alias("bbox"))


_field_types = "[" + ", ".join(f"'{x}'" for x in FIELD_TYPES) + "]"
cte("region_fields", f"""
  SELECT o_orderkey AS case_id, i AS ord, ({_field_types})[(o_orderkey + i) % 11 + 1] AS field_type,
         'value ' || o_custkey AS raw_text, 0.5::DOUBLE + (o_custkey % 40) / 100::DOUBLE AS confidence,
         (o_custkey % 60) / 100::DOUBLE + 0.1::DOUBLE * i AS fx, (o_orderkey % 60) / 100::DOUBLE AS fy,
         0.2::DOUBLE AS fw, 0.15::DOUBLE AS fh
  FROM orders CROSS JOIN (SELECT unnest([0, 1, 2]) AS i)""")


def region_field_findings(t: Tables) -> DataFrame:
    """Field findings of an order: one per line."""
    return regions(t).select("case_id", "ord", _field_type(F.regexp_extract("notes", "[0-9]+", 0).cast("bigint"))
                             .alias("field_type"), "confidence", F.concat(F.lit("differs from "), "notes")
                             .alias("evidence"))


IOU_SQL = ("(CASE WHEN least({a}x + {a}width, {b}x + {b}width) > greatest({a}x, {b}x) "
           "AND least({a}y + {a}height, {b}y + {b}height) > greatest({a}y, {b}y) THEN "
           "(least({a}x + {a}width, {b}x + {b}width) - greatest({a}x, {b}x)) * "
           "(least({a}y + {a}height, {b}y + {b}height) - greatest({a}y, {b}y)) / "
           "({a}width * {a}height + {b}width * {b}height - "
           "(least({a}x + {a}width, {b}x + {b}width) - greatest({a}x, {b}x)) * "
           "(least({a}y + {a}height, {b}y + {b}height) - greatest({a}y, {b}y))) ELSE 0::DOUBLE END)")
CENTRE_SQL = ("({a}x + {a}width / 2 BETWEEN {b}x AND {b}x + {b}width "
              "AND {a}y + {a}height / 2 BETWEEN {b}y AND {b}y + {b}height)")
cte("merge_edges", f"""
  SELECT a.case_id, a.ord AS u, b.ord AS v FROM regions a JOIN regions b ON b.case_id = a.case_id AND a.ord < b.ord
  WHERE {IOU_SQL.format(a='a.', b='b.')} >= 0.18::DOUBLE OR {CENTRE_SQL.format(a='b.', b='a.')}""", "regions")
cte("typed", """
  SELECT *, CASE WHEN ftype IS NOT NULL THEN ftype
                 WHEN t LIKE '%portrait%' THEN 'portrait' WHEN t LIKE '%qr%' THEN 'QR'
                 WHEN t LIKE '%signature%' THEN 'signature' WHEN t LIKE '%date%' THEN 'date'
                 WHEN t LIKE '%name%' THEN 'name' ELSE 'unknown' END AS region_type
  FROM (SELECT r.*, lower(r.label || ' residual map ' || r.notes) AS t, m.ftype FROM regions r
        LEFT JOIN (SELECT r.case_id, r.ord, CASE arg_min(f.field_type, f.ord)
                     WHEN 'student_id' THEN 'student ID' WHEN 'registration_number' THEN 'registration number'
                     WHEN 'prn' THEN 'PRN' WHEN 'roll_number' THEN 'roll number' WHEN 'date_of_birth' THEN 'date'
                     WHEN 'department' THEN 'course' WHEN 'academic_year' THEN 'course' WHEN 'validity' THEN 'date'
                     WHEN 'institution_name' THEN 'logo' ELSE arg_min(f.field_type, f.ord) END AS ftype
                   FROM regions r JOIN (SELECT case_id, ord, field_type, fx AS x, fy AS y, fw AS width, fh AS height
                                        FROM region_fields) f ON f.case_id = r.case_id
                   WHERE """ + IOU_SQL.format(a="r.", b="f.") + """ >= 0.12::DOUBLE
                   GROUP BY r.case_id, r.ord) m ON m.case_id = r.case_id AND m.ord = r.ord)""",
    "regions", "region_fields")


# ----------------------------------------------------------------- words
LOWER = "abcdefghijklmnopqrstuvwxyz"
BLANKS = "[ \\n\\t\\r]+"
LABEL_TOKENS = [["name:", None, None], ["roll", "number", None], ["date", "of", "birth"], ["course", None, None],
                ["reg.no", None, None], ["department:", None, None]]
LEDGER_LABELS = ["Subtotal:", "TAX", "total", "Marks", "amount", "taxinvoice"]


def _placed(words: DataFrame) -> DataFrame:
    """Lay tokens out ten to a line; whole texts, one case per document."""
    return words.select(
        F.col("doc_id").alias("case_id"), F.col("pos").alias("idx"), "text",
        ((F.col("doc_id") * 31 + F.col("pos") * 17) % 101).cast("double").alias("conf"),
        (F.col("pos") % 10 * 60).cast("int").alias("left"), (F.floor(F.col("pos") / 10) * 20).cast("int").alias("top"),
        (F.length("text") * 6).cast("int").alias("width"),
        (12 + (F.col("doc_id") * 7 + F.col("pos") * 3) % 5).cast("int").alias("height"),
        F.lit(620).alias("page_width"), (F.ceil(F.col("n") / 10) * 20).cast("int").alias("page_height"))


def tokens(t: Tables) -> DataFrame:
    split = t.spread("documents", "doc_id").select("doc_id", F.split("text", BLANKS).alias("tokens"))
    return split.select("doc_id", F.size("tokens").alias("n"), F.posexplode("tokens").alias("pos", "text"))


def words(t: Tables) -> DataFrame:
    return _placed(tokens(t))


def labelled_words(t: Tables) -> DataFrame:
    """Every line starts with the words of a field label."""
    line = F.floor(F.col("pos") / 10) % len(LABEL_TOKENS)
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in LABEL_TOKENS])
    label = F.when(F.col("pos") % 10 < 3, F.element_at(F.element_at(table, (line + 1).cast("int")),
                                                       (F.least(F.col("pos") % 10, F.lit(2)) + 1).cast("int")))
    return _placed(tokens(t).withColumn("text", F.coalesce(label, "text")))


def ledger_words(t: Tables) -> DataFrame:
    """Every line starts with a totals label and holds a number in its sixth place."""
    line = F.floor(F.col("pos") / 10) % len(LEDGER_LABELS)
    label = F.element_at(F.array(*[F.lit(x) for x in LEDGER_LABELS]), (line + 1).cast("int"))
    number = (F.col("doc_id") * 13 + F.col("pos") * 7) % 900 + 100
    amount = F.when(F.col("pos") % 20 == 5, F.concat(F.lit("1,"), number.cast("string"), F.lit(".50"))).otherwise(
        number.cast("string"))
    return _placed(tokens(t).withColumn("text", F.when(F.col("pos") % 10 == 0, label)
                                        .when(F.col("pos") % 5 == 0, amount).otherwise(F.col("text"))))


def reference_words(t: Tables) -> DataFrame:
    """Second reading of the page: words of 13 letters lost, words of 7 letters
    rotated, words of 9 in upper case, everything up to two pixels to the left."""
    size = F.length("text")
    read = F.when(size == 7, F.concat(F.substring("text", 4, 4), F.substring("text", 1, 3))).when(size == 9, F.translate("text", LOWER, LOWER.upper())).otherwise(F.col("text"))
    return words(t).filter(size != 13).withColumns({
        "text": read, "left": F.greatest(F.lit(0), F.col("left") - (F.col("idx") % 3).cast("int"))})


def _words_sql(text: str) -> str:
    return f"""
  SELECT case_id, pos AS idx, text, CAST((case_id * 31 + pos * 17) % 101 AS DOUBLE) AS conf,
         CAST(pos % 10 * 60 AS INT) AS "left", CAST(pos // 10 * 20 AS INT) AS top,
         CAST(length(text) * 6 AS INT) AS width, CAST(12 + (case_id * 7 + pos * 3) % 5 AS INT) AS height,
         620 AS page_width, CAST(((n + 9) // 10) * 20 AS INT) AS page_height
  FROM (SELECT doc_id AS case_id, n, pos, {text} AS text FROM tokens)"""


cte("tokens", """
  SELECT doc_id, len(toks) AS n, unnest(toks) AS tok, unnest(range(len(toks))) AS pos
  FROM (SELECT doc_id, regexp_split_to_array(text, '[ \\n\\t\\r]+') AS toks FROM documents)""")
cte("words", _words_sql("tok"), "tokens")
_label_case = " ".join(
    f"WHEN {i * 10 + j} THEN '{token}'" for i, row in enumerate(LABEL_TOKENS) for j, token in enumerate(row) if token)
cte("labelled_words", _words_sql(f"coalesce(CASE (pos // 10) % 6 * 10 + pos % 10 {_label_case} END, tok)"), "tokens")
_ledger = "[" + ", ".join(f"'{x}'" for x in LEDGER_LABELS) + "]"
cte("ledger_words", _words_sql(
    f"CASE WHEN pos % 10 = 0 THEN ({_ledger})[(pos // 10) % 6 + 1] WHEN pos % 20 = 5 THEN "
    f"'1,' || ((doc_id * 13 + pos * 7) % 900 + 100) || '.50' WHEN pos % 5 = 0 THEN "
    f"CAST((doc_id * 13 + pos * 7) % 900 + 100 AS VARCHAR) ELSE tok END"), "tokens")
cte("reference_words", f"""
  SELECT case_id, idx, CASE length(text) WHEN 7 THEN substr(text, 4, 4) || substr(text, 1, 3) WHEN 9 THEN translate(text, '{LOWER}', '{LOWER.upper()}') ELSE text END AS text, conf,
         greatest(0, "left" - idx % 3) AS "left", top, width, height, page_width, page_height
  FROM words WHERE length(text) <> 13""", "words")
NORM_SQL = "trim(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g'))"
