"""Worked examples for regions, fields, reconciliation, evaluation and scalars."""

import math
import random

import pytest
from pyspark.sql import functions as F

from papertrail.functions import scalars as S
from papertrail.functions.arrow import byte_entropy
from papertrail.operators import compare, evaluate, facts, fields, quality, reconcile, regions, residuals
from papertrail.operators import words as word_ops

REGION = ("case_id string, ord int, layer string, x double, y double, width double, height double, score double, "
          "confidence double, label string, technique string, notes string")


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


def test_merge_regions_of_one_portrait(spark):
    rows = [("p", 1, "reference", .1, .2, .2, .3, .9, .9, "diff", "", "portrait changed"),
            ("p", 2, "deep-srm", .11, .21, .19, .29, .55, .6, "hotspot", "", ""),
            ("p", 3, "pixel", .1, .2, .2, .3, .5, .5, "hotspot", "", ""),
            ("q", 1, "pixel", .4, .2, .12, .04, .5, .5, "name", "", ""),
            ("q", 2, "qr-barcode", .8, .8, .1, .1, .5, .5, "QR", "", ""),
            ("q", 3, "pixel", .8, .8, .0, .1, .5, .5, "empty", "", "")]
    table = spark.createDataFrame(rows, REGION).withColumn("detector", F.col("layer"))
    none = spark.createDataFrame([], "case_id string, ord int, field_type string, bbox struct<x: double, y: double, width: double, height: double>")
    merged = regions.region_summary(regions.region_types(regions.merge_regions(table), none)).collect()
    portrait = [r for r in merged if r.case_id == "p"]
    assert len(portrait) == 1 and portrait[0].detectors == ["reference", "deep-srm", "pixel"]
    assert portrait[0].region_type == "portrait" and portrait[0].confidence == .98
    assert {r.region_type for r in merged if r.case_id == "q"} == {"name", "QR"} and len(merged) == 3


WORD = "case_id string, idx int, text string, conf double, left int, top int, width int, height int, page_width int, page_height int"


def page(case, *tokens):
    return [(case, i, text, 95.0, left, 20, 8 * len(text), 12, 800, 600) for i, (text, left) in enumerate(tokens)]


def test_identity_fields(spark):
    rows = (page("a", ("Name:", 10), ("A--", 80), ("B", 140))
            + page("b", ("Date", 10), ("of", 60), ("Birth", 90), ("29", 150), ("/", 180), ("12", 200), ("/", 230), ("2002", 250))
            + page("c", ("Date of Birth", 10), ("29/12/2002", 180))
            + page("d", ("Roll", 10), ("No", 60), ("77", 90), ("Course", 150), ("BSc", 220)))
    got = {(r.case_id, r.field_type): r for r in fields.identity_fields(spark.createDataFrame(rows, WORD)).collect()}
    assert (got["a", "name"].raw_text, got["a", "name"].normalized_text) == ("A-- B", "a b")
    assert got["b", "date_of_birth"].raw_text == "29 / 12 / 2002" and got["b", "date_of_birth"].normalized_text == "29 12 2002"
    assert got["c", "date_of_birth"].raw_text == "29/12/2002"
    assert got["d", "roll_number"].raw_text == "77" and got["d", "course"].raw_text == "BSc"
    assert got["a", "name"].confidence == .95


def test_field_states(spark):
    box = "struct<x: double, y: double, width: double, height: double>"
    def side(rows):
        df = spark.createDataFrame(rows, "case_id string, field_type string, raw_text string")
        return df.withColumns({"normalized_text": S.normalize_text(F.col("raw_text")), "bbox": F.lit(None).cast(box)})
    ref = side([("1", "registration_number", "R-23-0245"), ("2", "name", "KALEKAR ROSHANI RAJENDRA"), ("3", "course", "BSc"), ("4", "prn", "x")])
    ev = side([("1", "registration_number", "R-23-0245 Pine"), ("2", "name", "VAIDEHI SANTOSH BHUWAD"), ("3", "course", "bsc"), ("5", "prn", "y")])
    joined = compare.join_fields(ev, ref)
    got = {r.case_id: (r.state, r.confidence) for r in compare.field_states(joined).collect()}
    assert got == {"1": ("UNRELIABLE_OCR", .48), "2": ("MISMATCH", .90), "3": ("MATCH", .98)}
    assert {r.case_id: r.type for r in compare.one_sided(joined).collect()} == {"4": "OCR_FIELD_REMOVED", "5": "OCR_FIELD_ADDED"}


def test_payload_multisets(spark):
    table = lambda rows: spark.createDataFrame(rows, "case_id string, payload string")
    got = compare.compare_payloads(table([(c, "") for c in "abc"]), table([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")]),
                                   table([("a", "x"), ("b", "y"), ("b", "x")]))
    assert {r.case_id: (r.status, r.match) for r in got.collect()} == {
        "a": ("decoded", False), "b": ("decoded", True), "c": ("not-detected", None)}


def test_reconciliation(spark):
    line = "case_id string, ord int, qty double, rate double, amount double, qty_conf int, rate_conf int, amount_conf int"
    rows = [("inv", i, q, r, q * r, 90, 90, 90) for i, (q, r) in enumerate([(2.0, 500.0), (4.0, 2600.0)])]
    rows += [("inv", 2, 1.0, 100.0, 500.0, 90, 90, 90)] + [("meter", i, 10.0, 20.0, 30.0, 90, 90, 90) for i in range(3)]
    lines = spark.createDataFrame(rows, line)
    totals = spark.createDataFrame([("inv", 11400.0, 2052.0, 10452.0, 90, 90, 90), ("meter", 60.0, 1.0, 61.0, 90, 90, 90)],
                                   "case_id string, subtotal double, tax double, total double, subtotal_conf int, tax_conf int, total_conf int")
    checks = reconcile.line_checks(lines).collect()
    assert {r.case_id for r in checks} == {"inv"} and [r.ok for r in sorted(checks, key=lambda r: r.ord)] == [True, True, False]
    # The difference of 400 does not exceed 0.8 of the printed 500: a failure, but not a strong one.
    assert not next(r for r in checks if r.ord == 2).strong
    got = {(r.case_id, r.name): r for r in reconcile.total_checks(lines, totals).collect()}
    assert got["inv", "grand_total"].diff == pytest.approx(3000) and not got["inv", "grand_total"].ok
    assert ("meter", "subtotal") not in got and got["meter", "grand_total"].ok
    layer = {r.case_id: r for r in reconcile.semantic_layer(reconcile.total_checks(lines, totals)).collect()}
    assert layer["inv"].breaches == 2 and layer["inv"].confidence == .948 and layer["meter"].score == 0
    single = reconcile.semantic_layer(reconcile.total_checks(lines, totals).filter("name = 'grand_total' AND case_id = 'inv'")).first()
    assert single.confidence == .888


def test_mark_sheet(spark):
    marks = [("s", 100, 95, 100)] + [("s", m, 95, 100) for m in (85, 85, 85, 85, 85)] + [("t", m, 95, None) for m in (50, 60, 70)]
    table = spark.createDataFrame(marks, "case_id string, mark int, conf int, max_mark int")
    totals = spark.createDataFrame([("s", 495.0, 90, 87.5), ("t", 180.0, 90, 60.0)],
                                   "case_id string, total double, total_conf int, percentage double")
    got = reconcile.sheet_checks(table, totals).collect()
    assert [(r.case_id, r.name, r.ok, r.diff) for r in got] == [("s", "total", False, 30.0)]


def test_evaluation(spark):
    rows = [(True, True, .9), (True, False, .9), (False, True, .1), (False, False, .1)]
    records = spark.createDataFrame(rows, "truth boolean, predicted boolean, risk double")
    m = evaluate.binary_metrics(records).first()
    assert (m.tp, m.tn, m.fp, m.fn, m.precision, m.recall, m.f1, m.fpr, m.fnr) == (1, 1, 1, 1, .5, .5, .5, .5, .5)
    assert evaluate.auc(records, bucket=.25).first().auc == 1.0
    assert evaluate.auc(records.filter("truth"), bucket=.25).first().auc is None
    pair = evaluate.pair_regression(spark.createDataFrame([(1, 21)], "pair_id int, risk int"),
                                    spark.createDataFrame([(1, 27, 2)], "pair_id int, risk int, active_families int")).first()
    assert (pair.delta, pair.stronger, pair.independent_evidence) == (6, True, True)


def test_mask_overlap(spark):
    box = "case_id string, x double, y double, width double, height double"
    cases = spark.createDataFrame([(c,) for c in "abc"], "case_id string")
    # 10 x 10 raster, end-inclusive boxes: four columns by two rows against two by two.
    truth = spark.createDataFrame([("a", .0, .0, .3, .1), ("b", .0, .0, .3, .1)], box)
    predicted = spark.createDataFrame([("a", .0, .0, .1, .1), ("a", .05, .0, .05, .1)], box)
    got = {r.case_id: (r.iou, r.dice) for r in regions.mask_overlap(cases, predicted, truth, 10, 10).collect()}
    assert got["a"] == (.5, pytest.approx(2 / 3)) and got["b"] == (0, 0) and got["c"] == (1, 1)


def test_mask_overlap_draws_ordinary_cases(spark, monkeypatch):
    rng = random.Random(5)
    box = "case_id long, x double, y double, width double, height double"

    def some():
        return [(rng.randrange(30), rng.uniform(-.2, 1), rng.uniform(-.2, 1), rng.random() / 2, rng.random() / 2) for _ in range(300)]
    a, b = some(), some()
    cases = spark.range(31).withColumnRenamed("id", "case_id")
    seen = {}
    for c in range(31):
        drawn = [{(px, py) for k, x, y, w, h in boxes if k == c and math.floor((x + w) * 130) > math.floor(x * 130) and math.floor((y + h) * 70) > math.floor(y * 70)
                  for px in range(max(0, math.floor(x * 130)), min(130, math.floor((x + w) * 130) + 1))
                  for py in range(max(0, math.floor(y * 70)), min(70, math.floor((y + h) * 70) + 1))} for boxes in (a, b)]
        seen[c] = (len(drawn[0]), len(drawn[1]), len(drawn[0] & drawn[1]))
    frames = [spark.createDataFrame(x, box) for x in (a, b)]

    def got(drawn):
        return {r.case_id: (r.predicted_area, r.truth_area, r.shared_area) for r in regions.mask_overlap(cases, *frames, 130, 70, drawn).collect()}
    assert got(0) == got(20) == seen
    monkeypatch.setattr(regions, "_slab_areas", None)  # ordinary cases make no slabs
    assert got(4096) == seen


def test_suppression_mask_marks_lines_of_cells(spark):
    rng = random.Random(8)
    words = [(i % 3, rng.randrange(3000), rng.randrange(400), rng.randrange(1, 2500), rng.randrange(1, 40), 3000, 400) for i in range(60)]
    frame = spark.createDataFrame(words, "case_id long, left int, top int, width int, height int, page_width int, page_height int")
    expected = set()
    for c, x, y, w, h, pw, ph in words:
        x0, y0 = max(0, math.trunc(x - w * .35)), max(0, math.trunc(y - h * .5))
        x1, y1 = min(pw, math.trunc(x + w * 1.35)), min(ph, math.trunc(y + h * 1.5))
        expected |= {(c, i, j) for i in range(x0 // 20, (x1 - 1) // 20 + 1) for j in range(y0 // 20, (y1 - 1) // 20 + 1) if x1 > x0 and y1 > y0}
    cells = residuals.suppression_mask(frame)
    got = [tuple(r) for r in cells.collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert "bit_or" in cells._jdf.queryExecution().optimizedPlan().toString()


def test_small_expressions(spark):
    bands = [one(spark, S.severity_band(F.lit(v))) for v in (.82, .66, .45, .26, .14, .13)]
    assert bands == ["critical", "high", "medium", "low", "info", "benign"]
    assert [one(spark, S.layer_status(F.lit(v))) for v in (.5, .28, .27)] == ["alert", "review", "pass"]
    assert [one(spark, S.verdict(F.lit(v))) for v in (86, 68, 45, 24, 23)] == ["forged", "likely-forged", "suspicious", "low-risk", "authentic"]
    assert [one(spark, S.parse_number(F.lit(v))) for v in ("1,200.50", "₹ 99", "-", "1-2")] == [1200.5, 99, None, None]
    assert [one(spark, S.label_match(F.lit(v), ["tax"])) for v in ("TAX", "tax:", "taxinvoice")] == [True, True, False]
    assert [one(spark, byte_entropy(F.lit(bytes(v)))) for v in (b"", b"aaaa", bytes(range(256)))] == [0, 0, 8]
    quality = spark.createDataFrame([(q, float(q)) for q in (72, 71, 50, 40)], "case_id int, quantization_quality double")
    assert [round(r.score, 6) for r in facts.compression_layer(quality).orderBy(F.desc("case_id")).collect()] == [0, .05, 1, 1]


def test_pdf_facts(spark):
    text = (b"%PDF-1.7\n1 0 obj << /Type /Page /Filter /DCTDecode /Producer (Acme ) >>\n/Type /Pages /Subtype /Image %%EOF "
            b"2 0 obj /JavaScript /Filter /FlateDecode /ByteRange %%EOF")
    row = facts.pdf_facts(spark.createDataFrame([("a", bytearray(text))], "case_id string, content binary")).first()
    assert (row.version, row.producer, row.page_count, row.image_count, row.eof_count, row.incremental_updates, row.object_count) == (
        "1.7", "Acme", 1, 1, 2, 1, 2)
    assert row.javascript and row.signed and not row.encrypted and row.filters == ["DCTDecode", "FlateDecode"]


def test_perturbation_is_deterministic_and_labelled(spark):
    lines = spark.createDataFrame([("k1", 2.0, 500.0), ("k2", 3.0, 120.0)], "key string, qty double, rate double")
    first, second = (sorted(map(tuple, quality.perturb(lines.repartition(n)).collect()), key=str) for n in (1, 3))
    assert first == second and len(first) == 8 and all((r[1] == "none") == (r[5] == 0) for r in first)


def test_words_in_regions_equal_brute_force(spark):
    rng = random.Random(5)
    boxes = [(c, k, rng.random() * .9, rng.random() * .9, *rng.choice([(.001, .002), (.05, .03), (.9, .5), (0.0, 0.0), (.3, 1.2)])) for c in ("a", "hot") for k in range(12)]
    boxes.append(("a", 99, 0.0, 0.0, 1.0, 1.0))
    words = [(c, i, f"w{i}", rng.randint(0, 1000), rng.randint(0, 1000), 1000, 1000) for c, n in (("a", 50), ("hot", 300), ("none", 5)) for i in range(n)]
    got = regions.words_in_regions(spark.createDataFrame(boxes, "case_id string, ord int, x double, y double, width double, height double"),
                                   spark.createDataFrame(words, "case_id string, idx int, text string, left int, top int, page_width int, page_height int"))
    expected = sorted((c, k, i, t) for c, k, x, y, w, h in boxes for d, i, t, left, top, pw, ph in words
                      if c == d and x <= left / pw <= x + w and y <= top / ph <= y + h)
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 100


def test_lines_hold_words_that_start_at_about_one_height(spark):
    words = [("a", 0, "two", 50, 101), ("a", 1, "one", 10, 96), ("a", 2, "three", 90, 110), ("a", 3, "next", 10, 140), ("b", 0, "alone", 5, 7)]
    got = word_ops.ocr_text(spark.createDataFrame(words, "case_id string, idx int, text string, left int, top int")).collect()
    assert sorted((r["case_id"], r["line"], r["top"], r["text"]) for r in got) == [
        ("a", 0, 96, "one two three"), ("a", 1, 140, "next"), ("b", 0, 7, "alone")]
