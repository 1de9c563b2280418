"""Queries over recognised words."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail import constants as C
from papertrail.functions import scalars as S
from papertrail.operators import fields as FD
from papertrail.operators import words as W
from papertrail.operators.regions import region_texts, words_in_regions
from papertrail.operators.skew import gap_clusters
from papertrail.plans import bindings as B
from papertrail.plans.registry import cte, query, similarity_cte

NORM = B.NORM_SQL


@query("words_usable", """
  SELECT case_id, count(*) AS words, count(*) FILTER (ok AND conf >= 20) AS for_fields,
         count(*) FILTER (ok AND conf >= 25) AS for_labels, count(*) FILTER (ok AND conf >= 50) AS for_findings,
         count(*) FILTER (ok AND conf >= 60) AS for_lines
  FROM (SELECT *, trim(text) <> '' AND width > 0 AND height > 0 AS ok FROM words) GROUP BY case_id""", ("words",))
def _(t):
    ok = (F.trim("text") != "") & (F.col("width") > 0) & (F.col("height") > 0)
    floors = {"for_fields": 20, "for_labels": 25, "for_findings": 50, "for_lines": 60}
    return B.words(t).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("words"), *[F.count_if(ok & (F.col("conf") >= v)).alias(k) for k, v in floors.items()])


BLOCKS_SQL = """
  SELECT case_id, idx, text, fix("left" / page_width::DOUBLE, 4) AS x, fix(top / page_height::DOUBLE, 4) AS y,
         fix(width / page_width::DOUBLE, 4) AS width, fix(height / page_height::DOUBLE, 4) AS height,
         fix(conf / 100, 3) AS confidence, CASE WHEN conf < 40 THEN 'low-confidence' ELSE '' END AS anomalies
  FROM words WHERE conf >= 0"""


@query("ocr_blocks", BLOCKS_SQL, ("words",))
def _(t):
    return W.ocr_blocks(B.words(t)).withColumn("anomalies", F.array_join("anomalies", ","))


@query("box_normalize", """
  SELECT case_id, idx, fix(greatest(0, "left") / page_width::DOUBLE, 4) AS x,
         fix(greatest(0, top) / page_height::DOUBLE, 4) AS y, fix(least(1::DOUBLE, width / page_width::DOUBLE), 4) AS width,
         fix(least(1::DOUBLE, height / page_height::DOUBLE), 4) AS height FROM words""", ("words",))
def _(t):
    return B.words(t).select("case_id", "idx", W.unit_box().alias("b")).select("case_id", "idx", "b.*")


@query("ocr_rollup", """
  SELECT case_id, count(*) AS word_count, fix(avg(conf) FILTER (conf >= 0), 4) AS mean_confidence FROM words
  GROUP BY case_id""", ("words",))
def _(t):
    return W.ocr_rollup(B.words(t)).withColumn("mean_confidence", S.fix("mean_confidence", 4))


@query("ocr_text", """
  SELECT case_id, CAST(line AS BIGINT) AS line, min(top) AS top, string_agg(text, ' ' ORDER BY "left", idx) AS text FROM (
    SELECT *, sum(brk) OVER (PARTITION BY case_id ORDER BY top, idx ROWS UNBOUNDED PRECEDING) AS line FROM (
      SELECT * REPLACE (top + idx % 3 * 5 AS top), CASE WHEN top + idx % 3 * 5 - lag(top + idx % 3 * 5) OVER (PARTITION BY case_id ORDER BY top + idx % 3 * 5, idx) > 8
             THEN 1 ELSE 0 END AS brk FROM words)) GROUP BY 1, 2""",
       ("words",))
def _(t):
    # Words of a line start up to ten pixels apart, lines ten pixels or more.
    return W.ocr_text(B.words(t).withColumn("top", F.col("top") + (F.col("idx") % 3 * 5).cast("int")), gap=8)


@query("ocr_floor", f"""
  SELECT case_id, count(*) FILTER (confidence < 0.8::DOUBLE) AS low_blocks, min(confidence) AS worst_confidence,
         arg_min(text, confidence * 1e7 + idx) AS worst_text,
         CASE WHEN count(*) FILTER (confidence < 0.8::DOUBLE) > 2 THEN 'medium'
              WHEN count(*) FILTER (confidence < 0.8::DOUBLE) > 0 THEN 'low' ELSE 'none' END AS severity
  FROM ({BLOCKS_SQL}) GROUP BY case_id""", ("words",))
def _(t):
    return W.ocr_floor(W.ocr_blocks(B.words(t)))


SIZED = """
  SELECT w.*, s.typ_h, s.n, CAST(floor(top / greatest(2, typ_h * 0.5::DOUBLE)) AS BIGINT) AS row_no FROM words w
  JOIN (SELECT case_id, CASE WHEN median(height) = 0 THEN 12 ELSE median(height) END AS typ_h, count(*) AS n
        FROM words GROUP BY case_id) s USING (case_id)"""
ROWS = f"""
  SELECT case_id, row_no, max(n) AS n, count(*) FILTER (weak) AS weak_words,
         count(*) FILTER (NOT weak AND typ_h > 6 AND (height > 2 * typ_h OR height < 0.45::DOUBLE * typ_h)) AS odd_words,
         count(*) FILTER (drift) AS drift_words,
         min("left") FILTER (weak OR (typ_h > 6 AND (height > 2 * typ_h OR height < 0.45::DOUBLE * typ_h))) AS x0,
         min(top) FILTER (weak OR (typ_h > 6 AND (height > 2 * typ_h OR height < 0.45::DOUBLE * typ_h))) AS y0,
         max("left" + width) FILTER (weak OR (typ_h > 6 AND (height > 2 * typ_h OR height < 0.45::DOUBLE * typ_h))) AS x1,
         max(top + height) FILTER (weak OR (typ_h > 6 AND (height > 2 * typ_h OR height < 0.45::DOUBLE * typ_h))) AS y1,
         min("left") FILTER (drift) AS dx0, min(top) FILTER (drift) AS dy0, max("left" + width) FILTER (drift) AS dx1,
         max(top + height) FILTER (drift) AS dy1
  FROM (SELECT z.*, r.weak, r.cnt >= 4 AND abs(top + height - r.mb) > 2.5::DOUBLE * greatest(5, 0.12::DOUBLE * r.mh) AS drift
        FROM sized z JOIN (SELECT case_id, row_no, count(*) FILTER (conf < 40) >= 3 AS weak, count(*) AS cnt,
                                  median(top + height) AS mb, median(height) AS mh FROM sized GROUP BY 1, 2) r
        USING (case_id, row_no)) GROUP BY case_id, row_no"""
COLUMNS = """
  SELECT case_id, col_no, count(*) AS column_words, count(*) FILTER (off) AS off_words, min("left") FILTER (off) AS cx0,
         min(top) FILTER (off) AS cy0, max("left" + width) FILTER (off) AS cx1, max(top + height) FILTER (off) AS cy1
  FROM (SELECT z.*, c.cnt >= 3 AND abs("left" - c.ml) > 2 * greatest(6, 0.5::DOUBLE * c.mw) AS off
        FROM chained z JOIN (SELECT case_id, col_no, count(*) AS cnt, median("left") AS ml, median(width) AS mw
                             FROM chained GROUP BY 1, 2) c USING (case_id, col_no)) GROUP BY 1, 2"""
LAYOUT_WITH = f"""
  WITH sized AS ({SIZED}),
  chained AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY case_id ORDER BY centre ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c0
              FROM (SELECT *, CASE WHEN centre - lag(centre) OVER (PARTITION BY case_id ORDER BY centre)
                                        > greatest(24, typ_h) THEN 1 ELSE 0 END AS brk
                    FROM (SELECT *, "left" + width / 2::DOUBLE AS centre FROM sized))),
  chained2 AS (SELECT *, max(c0) OVER (PARTITION BY case_id, centre) AS col_no FROM chained),
  rows_out AS ({ROWS}),
  columns_out AS ({COLUMNS.replace('chained', 'chained2')})"""


@query("layout_layer", LAYOUT_WITH + """
  SELECT case_id, words, weak_words, odd_words, baseline_sets, column_sets, deviants,
         fix(CASE WHEN live THEN least(1, deviants / words::DOUBLE) ELSE 0 END, 4) AS score,
         fix(CASE WHEN live THEN least(0.95::DOUBLE, greatest(0.35::DOUBLE, 0.35::DOUBLE
           + 0.55::DOUBLE * least(1, deviants / words::DOUBLE))) ELSE 0 END, 4) AS confidence,
         CASE WHEN live THEN least(rx0, cx0) END AS x0, CASE WHEN live THEN least(ry0, cy0) END AS y0,
         CASE WHEN live THEN greatest(rx1, cx1) END AS x1, CASE WHEN live THEN greatest(ry1, cy1) END AS y1
  FROM (SELECT *, weak_words + odd_words + baseline_sets + column_sets AS deviants,
               words >= 20 AND weak_words + odd_words + baseline_sets + column_sets >= 2 AS live
        FROM (SELECT case_id, max(n) AS words, CAST(sum(weak_words) AS BIGINT) AS weak_words,
                     CAST(sum(odd_words) AS BIGINT) AS odd_words, max(CAST(drift_words >= 2 AS INT)) AS baseline_sets,
                     least(min(x0), min(dx0) FILTER (drift_words >= 2)) AS rx0,
                     least(min(y0), min(dy0) FILTER (drift_words >= 2)) AS ry0,
                     greatest(max(x1), max(dx1) FILTER (drift_words >= 2)) AS rx1,
                     greatest(max(y1), max(dy1) FILTER (drift_words >= 2)) AS ry1 FROM rows_out GROUP BY case_id)
        JOIN (SELECT case_id, max(CAST(off_words >= 3 AS INT)) AS column_sets, min(cx0) FILTER (off_words >= 3) AS cx0,
                     min(cy0) FILTER (off_words >= 3) AS cy0, max(cx1) FILTER (off_words >= 3) AS cx1,
                     max(cy1) FILTER (off_words >= 3) AS cy1 FROM columns_out GROUP BY case_id) USING (case_id))""",
       ("words",))
def _(t):
    return W.layout_layer(B.words(t)).withColumns({"score": S.fix("score", 4), "confidence": S.fix("confidence", 4)})


@query("layout_baseline", LAYOUT_WITH + """
  SELECT case_id, row_no AS row, weak_words, odd_words, drift_words FROM rows_out""", ("words",))
def _(t):
    return W.row_outliers(B.words(t)).select("case_id", "row", "weak_words", "odd_words", "drift_words")


@query("layout_columns", LAYOUT_WITH + """
  SELECT case_id, col_no AS "column", column_words, off_words FROM columns_out""", ("words",))
def _(t):
    return W.column_outliers(B.words(t)).select("case_id", "column", "column_words", "off_words")


@query("grid_residuals", """
  WITH placed AS (SELECT case_id, idx, "left" / page_width::DOUBLE AS x, top / page_height::DOUBLE AS y FROM words),
  margin AS (SELECT case_id, list_sort(list(x))[count(*) // 2 + 1] AS margin FROM placed GROUP BY case_id)
  SELECT case_id, fix(max(margin), 4) AS margin, count(*) FILTER (abs(x - margin) > 0.02::DOUBLE) AS outliers,
         fix(coalesce(stddev_samp(gap), 0), 6) AS gap_sigma
  FROM (SELECT *, lead(y) OVER (PARTITION BY case_id ORDER BY idx) - y AS gap FROM placed) JOIN margin USING (case_id)
  GROUP BY case_id""", ("words",))
def _(t):
    return W.grid_residuals(B.words(t)).withColumns({"margin": S.fix("margin", 4), "gap_sigma": S.fix("gap_sigma", 6)})


LABEL_HIT = """(lower(text) IN ('subtotal', 'tax', 'total') OR regexp_matches(lower(text),
                '^(subtotal|tax|total)[^\\p{L}\\p{N}]'))"""


@query("label_match", f"SELECT case_id, idx, text FROM ledger_words WHERE {LABEL_HIT}", ("ledger_words",))
def _(t):
    return B.ledger_words(t).filter(S.label_match(F.col("text"), ["subtotal", "tax", "total"])).select(
        "case_id", "idx", "text")


@query("label_last", f"""
  SELECT case_id, arg_max(idx, top * 1000 + "left") AS idx, arg_max(text, top * 1000 + "left") AS text, max(top) AS top,
         arg_max("left", top * 1000 + "left") AS "left" FROM ledger_words WHERE {LABEL_HIT} GROUP BY case_id""",
       ("ledger_words",))
def _(t):
    return W.last_label(B.ledger_words(t), ["subtotal", "tax", "total"])


NUM = "TRY_CAST(regexp_replace({t}, '[^0-9.\\-]', '', 'g') AS DOUBLE)"


@query("parse_numbers", f"""
  SELECT case_id, count({NUM.format(t='text')}) AS numbers, fix(sum({NUM.format(t='text')}), 2) AS total,
         count(*) FILTER (regexp_matches(trim(text), '^[0-9][0-9,.]*%?$')) AS amounts
  FROM ledger_words GROUP BY case_id""", ("ledger_words",))
def _(t):
    number = S.parse_number(F.col("text"))
    return B.ledger_words(t).groupBy("case_id").agg(
        F.count(number).alias("numbers"), S.fix(F.sum(number), 2).alias("total"),
        F.count_if(S.is_amount(F.col("text"))).alias("amounts"))


@query("value_right", f"""
  WITH z AS (SELECT w.*, m.typ_h, top + height / 2::DOUBLE AS cy FROM ledger_words w
             JOIN (SELECT case_id, median(height) AS typ_h FROM ledger_words WHERE height > 0 GROUP BY case_id) m
             USING (case_id)),
  amounts AS (SELECT *, {NUM.format(t='text')} AS value FROM z
              WHERE regexp_matches(trim(text), '^[0-9][0-9,.]*%?$') AND {NUM.format(t='text')} IS NOT NULL),
  near AS (SELECT l.case_id, l.idx AS label_idx, l.text AS label, a.idx AS value_idx, a.value,
                  a."left" - l."left" - l.width AS gap,
                  row_number() OVER (PARTITION BY l.case_id, l.idx ORDER BY a."left" - l."left" - l.width, a.idx) AS rk
           FROM (SELECT *, unnest([top // 20 - 1, top // 20, top // 20 + 1]) AS band FROM z WHERE {LABEL_HIT}) l
           JOIN amounts a ON a.case_id = l.case_id AND a.top // 20 = l.band
            AND a."left" >= l."left" + l.width - 2 AND abs(a.cy - l.cy) <= l.typ_h)
  SELECT case_id, label_idx, label, value_idx, gap, value FROM near WHERE rk = 1""", ("ledger_words",))
def _(t):
    return W.value_right(B.ledger_words(t), ["subtotal", "tax", "total"])


@query("gap_clusters", """
  SELECT user_id, cluster, count(*) AS events, min(secs) AS first_at, max(secs) AS last_at FROM (
    SELECT user_id, secs, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY secs, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
             AS cluster
    FROM (SELECT user_id, event_id, secs, CASE WHEN secs - lag(secs) OVER (PARTITION BY user_id ORDER BY secs, event_id) > 21600
                 THEN 1 ELSE 0 END AS brk
          FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS secs FROM events)))
  GROUP BY 1, 2""")
def _(t):
    stamped = t.events.select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("secs"))
    return gap_clusters(stamped, ["user_id"], "secs", 21600, width=864000).groupBy("user_id", "cluster").agg(
        F.count(F.lit(1)).alias("events"), F.min("secs").alias("first_at"), F.max("secs").alias("last_at"))


@query("anchored_clusters", """
  WITH RECURSIVE points AS (SELECT DISTINCT case_id, top // 20 AS bank, "left" + width / 2::DOUBLE AS centre FROM words),
  starts(case_id, bank, start) AS (
    SELECT case_id, bank, min(centre) FROM points GROUP BY 1, 2 UNION ALL
    SELECT s.case_id, s.bank, min(p.centre) FROM starts s JOIN points p ON p.case_id = s.case_id AND p.bank = s.bank
      AND p.centre - s.start > 34 GROUP BY s.case_id, s.bank, s.start)
  SELECT case_id, bank, count(*) AS clusters, string_agg(CAST(CAST(start * 2 AS INT) AS VARCHAR), ',' ORDER BY start) AS starts
  FROM starts GROUP BY 1, 2""", ("words",))
def _(t):
    centres = B.words(t).select("case_id", F.floor(F.col("top") / 20).alias("bank"),
                                (F.col("left") + F.col("width") / 2).alias("centre"))
    gathered = centres.groupBy("case_id", "bank").agg(F.collect_set("centre").alias("centres"))
    starts = W.anchored_clusters(F.col("centres"), 34.0)
    return gathered.withColumn("s", starts).select(
        "case_id", "bank", F.size("s").cast("bigint").alias("clusters"),
        F.array_join(F.transform("s", lambda v: (v * 2).cast("int").cast("string")), ",").alias("starts"))


@query("column_assign", """
  SELECT case_id, bank, "column", min(idx) AS idx, arg_min(text, idx) AS text FROM (
    SELECT *, CASE WHEN abs(c - 90) <= abs(c - 270) AND abs(c - 90) <= abs(c - 450) THEN 0
                   WHEN abs(c - 270) <= abs(c - 450) THEN 1 ELSE 2 END AS "column",
           least(abs(c - 90), abs(c - 270), abs(c - 450)) AS d
    FROM (SELECT *, top // 20 AS bank, "left" + width / 2::DOUBLE AS c FROM words)) WHERE d <= 55
  GROUP BY 1, 2, 3""", ("words",))
def _(t):
    banked = B.words(t).withColumn("bank", F.floor(F.col("top") / 20))
    return W.assign_columns(banked, ["case_id", "bank"], [90.0, 270.0, 450.0])


_phrases = ", ".join(f"('{k}', {v[0]}, '{v[1]}')" for k, v in FD.PHRASES.items())
SPANS_WITH = f"""
  WITH phrases AS (SELECT * FROM (VALUES {_phrases}) p(phrase, priority, field_type)),
  toks AS (SELECT *, {NORM.format(t='text')} AS norm FROM labelled_words
           WHERE trim(text) <> '' AND width > 0 AND height > 0 AND conf >= 20),
  ahead AS (SELECT *, lead(norm, 1) OVER w AS n1, lead(norm, 2) OVER w AS n2, lead(top, 1) OVER w AS t1,
                   lead(top, 2) OVER w AS t2, lead("left", 1) OVER w AS l1, lead("left", 2) OVER w AS l2,
                   lead(idx, 1) OVER w AS i1, lead(idx, 2) OVER w AS i2, lead(width, 1) OVER w AS w1,
                   lead(width, 2) OVER w AS w2, lead(height, 1) OVER w AS h1, lead(height, 2) OVER w AS h2
            FROM toks WINDOW w AS (PARTITION BY case_id ORDER BY idx)),
  options AS (
    SELECT *, norm AS phrase, 1 AS label_words, idx AS tail_idx, "left" AS tl, top AS tt, width AS tw, height AS th FROM ahead
    UNION ALL SELECT *, norm || ' ' || n1, 2, i1, l1, t1, w1, h1 FROM ahead
      WHERE NOT contains(norm, ' ') AND NOT contains(n1, ' ') AND abs(t1 - top) <= greatest(18, height * 1.8::DOUBLE)
        AND l1 >= "left"
    UNION ALL SELECT *, norm || ' ' || n1 || ' ' || n2, 3, i2, l2, t2, w2, h2 FROM ahead
      WHERE NOT contains(norm, ' ') AND NOT contains(n1, ' ') AND NOT contains(n2, ' ')
        AND abs(t1 - top) <= greatest(18, height * 1.8::DOUBLE) AND abs(t2 - top) <= greatest(18, height * 1.8::DOUBLE)
        AND l1 >= "left" AND l2 >= l1),
  spans AS (SELECT * FROM (SELECT o.*, p.field_type, row_number() OVER (PARTITION BY case_id, idx ORDER BY priority) AS rk
                           FROM options o JOIN phrases p USING (phrase)) WHERE rk = 1)"""


@query("label_spans", SPANS_WITH + """
  SELECT case_id, idx AS label_idx, field_type, label_words, tail_idx FROM spans""", ("labelled_words",))
def _(t):
    return FD.label_spans(B.labelled_words(t)).select("case_id", "label_idx", "field_type", "label_words", "tail_idx")


FIELDS_WITH = SPANS_WITH + f""",
  near AS (SELECT s.case_id, s.idx AS label_idx, s.field_type, s.conf AS lconf, s."left" AS ll, s.top AS lt,
                  s.height AS lh, w.text AS wtext, w.conf AS wconf, w."left" AS wl, w.top AS wt, w.width AS ww,
                  w.height AS wh, EXISTS (SELECT 1 FROM phrases WHERE phrase = w.norm) AS is_label,
                  row_number() OVER (PARTITION BY s.case_id, s.idx ORDER BY w.top, w."left", w.idx) AS rank
           FROM (SELECT *, unnest([tt // 20 - 1, tt // 20, tt // 20 + 1]) AS band FROM spans) s
           JOIN toks w ON w.case_id = s.case_id AND w.top // 20 = s.band AND w.idx > s.tail_idx
            AND w."left" > s.tl + s.tw AND w.top - s.tt <= greatest(24, s.th * 1.8::DOUBLE)
            AND w.top >= s.tt - greatest(8, s.th * 0.5::DOUBLE)),
  kept AS (SELECT * FROM (SELECT *, min(CASE WHEN is_label AND rank > 1 THEN rank END)
                                      OVER (PARTITION BY case_id, label_idx) AS stop FROM near)
           WHERE stop IS NULL OR rank < stop),
  found AS (SELECT case_id, label_idx, field_type,
                   regexp_replace(string_agg(trim(wtext), ' ' ORDER BY rank), '^[ :]+|[ :]+$', '', 'g') AS raw_text,
                   least(any_value(ll), arg_min(wl, rank)) AS x0, least(any_value(lt), min(wt)) AS y0,
                   max(wl + ww) AS x1, greatest(any_value(lt + lh), max(wt + wh)) AS y1,
                   fix(0.5::DOUBLE * any_value(lconf) / 100 + 0.5::DOUBLE * avg(wconf) / 100, 3) AS confidence
            FROM kept GROUP BY 1, 2, 3)"""


@query("identity_fields", FIELDS_WITH + f"""
  SELECT *, {NORM.format(t='raw_text')} AS normalized_text FROM found""", ("labelled_words",))
def _(t):
    return FD.identity_fields(B.labelled_words(t))


@query("best_field", FIELDS_WITH + """
  SELECT case_id, field_type, label_idx, raw_text, confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id, field_type ORDER BY confidence DESC, label_idx) AS rk FROM found)
  WHERE rk = 1""", ("labelled_words",))
def _(t):
    return FD.best_fields(FD.identity_fields(B.labelled_words(t))).select(
        "case_id", "field_type", "label_idx", "raw_text", "confidence")


_short = ", ".join(f"'{x}'" for x in C.SHORT_LABELS)


@query("id_label_values", f"""
  WITH toks AS (SELECT *, regexp_replace(lower(trim(text)), '[:.]+$', '') AS plain FROM labelled_words
                WHERE trim(text) <> '' AND width > 0 AND height > 0 AND conf >= 25),
  anchors AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, plain ORDER BY top, "left", idx) AS rk
                             FROM toks WHERE plain IN ({_short})) WHERE rk = 1),
  near AS (SELECT a.case_id, a.plain AS field, w.text, w.plain IN ({_short}) AS is_label,
                  row_number() OVER (PARTITION BY a.case_id, a.plain ORDER BY w."left", w.idx) AS rank
           FROM anchors a JOIN toks w ON w.case_id = a.case_id AND w."left" > a."left" + a.width
            AND abs(w.top - a.top) < greatest(12, a.height * 0.75::DOUBLE)),
  kept AS (SELECT *, min(CASE WHEN is_label AND rank > 1 THEN rank END) OVER (PARTITION BY case_id, field) AS stop
           FROM near)
  SELECT * FROM (SELECT case_id, field, regexp_replace(string_agg(trim(text), ' ' ORDER BY rank), '^[ :]+|[ :]+$', '', 'g')
                   AS value FROM kept WHERE stop IS NULL OR rank < stop GROUP BY 1, 2) WHERE value <> ''""",
       ("labelled_words",))
def _(t):
    return FD.short_label_values(B.labelled_words(t))


@query("normalize_text", f"""
  SELECT case_id, idx, {NORM.format(t='text')} AS normalized FROM words""", ("words",))
def _(t):
    return B.words(t).select("case_id", "idx", S.normalize_text(F.col("text")).alias("normalized"))


cte("word_nearest", """
  SELECT case_id, idx, text, arg_min(ridx, [d, ry, rx, ridx]) AS ridx, arg_min(rtext, [d, ry, rx, ridx]) AS rtext, min(d) AS distance
  FROM (SELECT a.case_id, a.idx, a.text, b.ridx, b.rtext, b.rx, b.ry, abs(b.rx - a.nx) + abs(b.ry - a.ny) AS d
        FROM (SELECT *, unnest([floor(ny / 0.045) - 1, floor(ny / 0.045), floor(ny / 0.045) + 1]) AS band FROM (
                SELECT case_id, idx, text, ("left" + width / 2::DOUBLE) / page_width AS nx, (top + height / 2::DOUBLE) / page_height AS ny
                FROM words WHERE trim(text) <> '' AND conf >= 20)) a
        JOIN (SELECT case_id, idx AS ridx, text AS rtext, ("left" + width / 2::DOUBLE) / page_width AS rx,
                     (top + height / 2::DOUBLE) / page_height AS ry FROM reference_words) b
          ON b.case_id = a.case_id AND floor(b.ry / 0.045) = a.band AND abs(b.ry - a.ny) < 0.045::DOUBLE AND abs(b.rx - a.nx) < 0.16::DOUBLE)
  GROUP BY 1, 2, 3""", "words", "reference_words")
similarity_cte("word_ratio", "SELECT lower(trim(text)) AS a, lower(trim(rtext)) AS b FROM word_nearest WHERE lower(trim(text)) <> lower(trim(rtext))",
               "word_nearest")
cte("word_changes", """
  SELECT n.*, ratio FROM word_nearest n JOIN word_ratio ON a = lower(trim(text)) AND b = lower(trim(rtext)) WHERE ratio < 0.8::DOUBLE""",
    "word_nearest", "word_ratio")


@query("word_nearest", "SELECT case_id, idx, ridx, fix(distance, 6) AS distance FROM word_nearest", ("word_nearest",))
def _(t):
    primary = B.words(t).filter((F.trim("text") != "") & (F.col("conf") >= 20))
    return W.nearest_words(primary, B.reference_words(t)).select("case_id", "idx", "ridx",
                                                                 S.fix("distance", 6).alias("distance"))


@query("word_nearest_diff", """
  SELECT case_id, idx, text, ridx, rtext, fix(distance, 6) AS distance, fix(ratio, 4) AS similarity FROM word_changes""", ("word_changes",))
def _(t):
    return W.word_differences(B.words(t), B.reference_words(t)).withColumns({
        "similarity": S.fix("similarity", 4), "distance": S.fix("distance", 6)})


@query("word_diff_notes", """
  SELECT case_id, idx, row_number() OVER (PARTITION BY case_id ORDER BY idx) AS note, text, rtext FROM word_changes""", ("word_changes",))
def _(t):
    differences = W.word_differences(B.words(t), B.reference_words(t))
    return W.numbered_notes(differences).select("case_id", "idx", "note", "text", "rtext")


DOC_REGIONS = """
  SELECT doc_id AS case_id, i AS region, ((doc_id * 7 + i * 31) % 70) / 100::DOUBLE AS x,
         ((doc_id * 13 + i * 17) % 80) / 100::DOUBLE AS y, 0.05::DOUBLE + ((doc_id + i) % 20) / 100::DOUBLE AS width,
         0.05::DOUBLE + ((n_chars + i) % 15) / 100::DOUBLE AS height
  FROM documents CROSS JOIN (SELECT unnest([0, 1, 2]) AS i)"""


@query("words_in_region", f"""
  SELECT case_id, region, string_agg(text, ' ' ORDER BY idx) AS words FROM (
    SELECT r.case_id, r.region, w.idx, w.text
    FROM ({DOC_REGIONS}) r JOIN (SELECT *, "left" / page_width::DOUBLE AS px, top / page_height::DOUBLE AS py FROM words) w
      ON w.case_id = r.case_id AND px BETWEEN r.x AND r.x + r.width AND py BETWEEN r.y AND r.y + r.height)
  GROUP BY 1, 2""", ("words",))
def _(t):
    doc, i = F.col("doc_id"), F.col("ord")
    boxes = t.documents.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ord")).select(
        doc.alias("case_id"), "ord", ((doc * 7 + i * 31) % 70 / 100).alias("x"), ((doc * 13 + i * 17) % 80 / 100).alias("y"),
        (0.05 + (doc + i) % 20 / 100).alias("width"), (0.05 + (F.col("n_chars") + i) % 15 / 100).alias("height"))
    return region_texts(words_in_regions(boxes, B.words(t)))


@query("document_domain", """
  SELECT doc_id, CASE
    WHEN regexp_matches(l, 'identity|reg\\.no|student''s|student’s|student id') THEN 'identity-card'
    WHEN regexp_matches(l, 'invoice|gst|subtotal|tax') THEN 'invoice'
    WHEN regexp_matches(l, 'marksheet|marks|semester|grade') THEN 'marksheet'
    WHEN regexp_matches(l, 'certificate|certify|degree') THEN 'certificate' ELSE 'general' END AS domain
  FROM (SELECT doc_id, lower(text) AS l FROM documents)""")
def _(t):
    return t.documents.select("doc_id", S.document_domain(F.col("text")).alias("domain"))
