"""The job over detectors: order, neutral cases, results of earlier detectors, shared tables."""

import pytest
from pyspark.sql import types as T

from papertrail.operators import analysis as A
from papertrail.operators import facts
from test_ledger import LINES, WORDS, invoice


def nothing(_):
    raise AssertionError("not run")


def test_detectors_come_behind_what_they_read():
    a, b, c = A.Detector("a", ("layer:c", "words"), nothing), A.Detector("b", (), nothing), A.Detector("c", ("layer:b",), nothing)
    assert [d.layer for d in A.ordered([a, b, c])] == ["b", "c", "a"]
    assert [d.layer for d in A.ordered(A.STANDARD)][-1] == "deep-tamper-srm"
    with pytest.raises(ValueError, match="wait for each other"):
        A.ordered([A.Detector("x", ("layer:y",), nothing), A.Detector("y", ("layer:x",), nothing)])
    with pytest.raises(ValueError, match="without a detector"):
        A.ordered([a])
    with pytest.raises(ValueError, match="two detectors"):
        A.ordered([b, b])


def tables(spark, tampered="10452"):
    words = spark.createDataFrame(invoice("tampered", LINES, "11400", "2052", tampered) + invoice("clean", LINES, "11400", "2052", "13452"),
                                  T.StructType([T.StructField("case_id", T.StringType()), *WORDS.fields[1:]]))
    return {"words": words, "metadata": spark.createDataFrame([("tampered", "Microsoft Word", "2020:01:02 00:00:00", "2020:01:01 00:00:00")],
                                                              "case_id string, software string, created string, modified string"),
            "facts": spark.createDataFrame([("tampered", 50.0), ("clean", 90.0), ("stranger", 40.0)], "case_id string, quantization_quality double"),
            "residual_stats": spark.createDataFrame([("tampered", .02, .6, .5), ("clean", .02, .6, .5)], "case_id string, area double, p95 double, stability double")}


def test_a_job_from_words_to_cases(spark):
    cases = spark.createDataFrame([("tampered",), ("clean",), ("silent",), ("silent",)], "case_id string")
    done = A.analyze_cases(cases, tables(spark), A.STANDARD)
    layers = {(r["case_id"], r["layer"]): r for r in done.layers.collect()}
    assert len(layers) == 15
    assert layers["tampered", "semantic"]["score"] == pytest.approx(.888) and layers["tampered", "semantic"]["status"] == "alert"
    assert layers["clean", "semantic"]["score"] == 0 and layers["silent", "layout"]["status"] == "pass"
    findings = {(r["case_id"], r["code"]): r for r in done.findings.collect()}
    assert set(findings) == {("tampered", "SEM-ARITH"), ("tampered", "META-CONS"), ("tampered", "CMP-RESAVE"), ("tampered", "SRM-LOCAL"), ("clean", "SRM-LOCAL")}
    assert findings["tampered", "SRM-LOCAL"]["severity"] == "high" and findings["clean", "SRM-LOCAL"]["severity"] == "medium"
    box = [r for r in done.regions.collect()]
    assert [(r["case_id"], r["layer"], r["x0"]) for r in box] == [("tampered", "semantic", 600)]
    register = {r["case_id"]: r for r in done.cases.collect()}
    assert register["tampered"]["risk"] > register["clean"]["risk"] >= register["silent"]["risk"]
    assert register["tampered"]["findings"] == 4 and register["silent"]["findings"] == 0 and set(register) == {"tampered", "clean", "silent"}


def test_tables_of_several_readers_are_computed_once(spark):
    seen = []

    def run(t):
        seen.append(t["words"])
        return A.Results(spark.createDataFrame([("tampered", .5, .5)], "case_id string, score double, confidence double"),
                         spark.createDataFrame([("tampered", "X", "low", .5, 1.0)], "case_id string, code string, severity string, confidence double, metric double"),
                         spark.createDataFrame([("tampered", "r", .5, .5, 0, 0, 1, 1)], "case_id string, label string, score double, confidence double, x0 long, y0 long, x1 long, y1 long"))
    cases = spark.createDataFrame([("tampered",)], "case_id string")
    done = A.analyze_cases(cases, tables(spark), [A.Detector("layout", ("words",), run), A.Detector("semantic", ("words",), run)])
    assert seen[0] is seen[1] and done.cases.count() == 1


def test_empty_tables(spark):
    empty = {n: t.limit(0) for n, t in tables(spark).items()}
    done = A.analyze_cases(spark.createDataFrame([], "case_id string"), empty, A.STANDARD)
    assert done.cases.count() == 0 and done.findings.count() == 0


def test_pdf_facts_of_odd_files(spark):
    rows = [(1, None), (2, bytearray()), (3, bytearray(b"%PDF-1.4 /Type /Page/Type/Page>> /BaseFont /A+B /BaseFont /A+B /Title (/JavaScript) /FT /Sig /JSX")),
            (4, bytearray(b"/Producer () /Author (A) /AcroForm /Linearized /EmbeddedFile \xff\xfe 1 0 obj 2 0 obj"))]
    found = {r["case_id"]: r for r in facts.pdf_facts(spark.createDataFrame(rows, "case_id int, content binary")).collect()}
    assert (found[1]["version"], found[1]["page_count"], found[1]["javascript"], found[2]["fonts"]) == ("unknown", 1, False, [])
    assert (found[3]["page_count"], found[3]["font_count"], found[3]["signed"], found[3]["title"]) == (2, 1, True, "/JavaScript")
    assert (found[4]["producer"], found[4]["author"], found[4]["object_count"], found[4]["linearized"]) == (None, "A", 2, True)


def test_one_pass_over_words_says_what_both_detectors_read(spark):
    given = tables(spark)["words"]
    plain, crowded = A.read_pages(given), A.read_pages(given, crowd=0)
    assert dict(plain.dtypes) == dict(crowded.dtypes)
    names = sorted(plain.columns)
    assert sorted(map(repr, plain.select(names).collect())) == sorted(map(repr, crowded.select(names).collect())) != []
    assert [r["name"] for r in plain.filter("words IS NULL").collect()] == ["grand_total"] and plain.filter("words = 20").count() == 0
    assert "Window" in plain._jdf.queryExecution().executedPlan().toString() and plain.filter("words IS NOT NULL").count() == 2
