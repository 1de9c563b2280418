"""Hand-computed fusion vectors and ordering rules."""

import pytest
from pyspark.sql import functions as F

from papertrail import constants as C
from papertrail.operators import detectors, fusion

LAYER = "case_id string, layer string, score double, confidence double, status string"
CASES = {
    "A": ({"pixel": .95, "deep-tamper-srm": .95, "ml-classifier": .95}, []),
    "B": ({"layout": .9}, ["OCR_FIELD_MISMATCH", "REF-FIELD"]),
    "C": ({"pixel": .8}, []),
    "D": ({"pixel": .8, "layout": .8, "qr-barcode": .8}, ["OCR_FIELD_MISMATCH", "QR_REFERENCE_MISMATCH"]),
    "E": ({"reference": .86, "pixel": .98, "deep-tamper-srm": .20}, ["REF-FIELD", "REF-TEXT", "REF-QR"]),
    "all": ({layer: 1.0 for layer in C.LAYER_FAMILY}, []),
}
EXPECTED = {"A": (.18, 20, 1.0, .681, "authentic"), "B": (.2208, 23, 1.0, .681, "authentic"), "C": (.144, 17, 1.0, .681, "authentic"),
            "D": (.468, 52, .985, .812, "suspicious"), "E": (.38496, 42, .794, .723, "low-risk"),
            "all": (1.0, 95, 1.0, .974, "forged")}


def tables(spark):
    rows = [(case, layer, score, .9, "pass") for case, (layers, _) in CASES.items() for layer, score in layers.items()]
    layers = spark.createDataFrame(rows + [("none", "pixel", .9, .9, "skipped")], LAYER).withColumns(
        {"name": F.col("layer"), "weight": F.lit(.1)})
    found = [(case, code, "high") for case, (_, codes) in CASES.items() for code in codes]
    return layers, spark.createDataFrame(found, "case_id string, code string, severity string")


def test_golden_vectors(spark):
    got = {r.case_id: r for r in fusion.fuse_cases(*tables(spark)).collect()}
    for case, (mass, risk, agreement, confidence, verdict) in EXPECTED.items():
        row = got[case]
        assert row.mass == pytest.approx(mass, abs=1e-6)
        assert (row.risk, row.agreement, row.verdict) == (risk, agreement, verdict)
        assert row.confidence == pytest.approx(confidence, abs=1e-3)
    assert (got["none"].mass, got["none"].risk, got["none"].confidence, got["none"].verdict) == (0, 9, .42, "authentic")
    assert got["B"].risk > got["A"].risk and got["D"].confidence > got["C"].confidence
    families = {f.family: f for f in got["E"].families}
    assert families["semantic"].finding_count == 2 and families["encoded-data"].finding_count == 1
    assert families["semantic"].score == 0 and families["encoded-data"].score == 0


def test_contributions_sum_to_mass(spark):
    fused = fusion.fuse_cases(*tables(spark))
    sums = {r.case_id: r.s for r in fusion.contributions(fused).groupBy("case_id").agg(F.sum("contribution").alias("s")).collect()}
    for row in fused.collect():
        assert sums[row.case_id] == pytest.approx(row.mass, abs=1e-9)
        assert all(0 <= f.score <= 1 for f in row.families)


def test_leaving_a_layer_out_never_raises_risk_of_single_layer_case(spark):
    rows = {r.case_id: r for r in fusion.ablate(fusion.fuse_cases(*tables(spark))).filter("case_id = 'C'").collect()}
    assert rows["C"].risk_without == 9 and rows["C"].delta == 8


def test_detector_plug_in(spark):
    def bright(tables):
        return tables["cases"].select("case_id", F.lit("bright").alias("layer"), F.lit("Bright").alias("name"), F.lit("signal").alias("category"),
                                      F.lit(.1).alias("weight"), F.lit(.9).alias("score"), F.lit(.8).alias("confidence"), F.lit("alert").alias("status"))
    detectors.register("bright", bright)
    try:
        results = detectors.run({"cases": spark.createDataFrame([("x",)], "case_id string")})
        none = spark.createDataFrame([], "case_id string, code string, severity string")
        # An unmapped layer counts as file history.
        assert fusion.fuse_cases(results, none).first().mass == pytest.approx(.09)
        with pytest.raises(ValueError):
            detectors.register("bright", bright)
    finally:
        detectors.unregister("bright")
