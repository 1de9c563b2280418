"""Files in and out, and the streaming intake."""

import json

import pytest
from pyspark.sql import functions as F

from papertrail import constants as C
from papertrail.operators import register
from papertrail.plans import evaluation_queries, report_queries  # noqa: F401 (their queries)
from papertrail.plans.registry import callables
from papertrail.sources import intake, reports, tables
from papertrail.streaming import intake as stream

HEAD = "sample_id,doc_type,label,forgery_type," + ",".join(C.FEATURES)


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_feature_csv(spark, tmp_path):
    path = write(tmp_path / "f.csv", HEAD, "A-000_none,invoice,0,none,80.5,1,0,0.25,0.1", "A-000_copy_move,invoice,forged,copy_move,81,1,0,nan,0.1",
                 "A-001_whiteout,invoice,1,whiteout,82,1,0,0.3,0.2")
    rows, dropped = tables.clean_features(tables.read_features(spark, path))
    assert {r.sample_id: r.label for r in rows.collect()} == {"A-000_none": "genuine", "A-001_whiteout": "forged"}
    assert dropped.first().dropped == 1
    assert tables.require_classes(rows, ["genuine", "forged"]).first().complete
    typed, _ = tables.three_class_features(tables.read_features(spark, path))
    assert [r.label for r in typed.collect()] == ["genuine"]
    out = str(tmp_path / "out")
    tables.write_features(tables.read_features(spark, path), out)
    back = {r.sample_id: r for r in spark.read.csv(out, header=True).collect()}
    assert len(back) == 3 and back["A-000_copy_move"].noise_anomaly == "nan" and back["A-000_none"].ocr_confidence == "80.5000"


def test_feature_csv_errors(spark, tmp_path):
    bad = write(tmp_path / "bad.csv", HEAD, "A-000_none,invoice,0,none,eighty,1,0,0.25,0.1")
    with pytest.raises(Exception):
        tables.read_features(spark, bad).collect()
    short = write(tmp_path / "short.csv", HEAD.rsplit(",", 1)[0], "A-000_none,invoice,0,none,80,1,0,0.25")
    with pytest.raises(Exception):
        tables.read_features(spark, short).collect()
    unknown = write(tmp_path / "unknown.csv", HEAD, "A-000_none,invoice,maybe,none,80,1,0,0.25,0.1")
    with pytest.raises(Exception, match="invalid label"):
        tables.clean_features(tables.read_features(spark, unknown))[0].collect()
    single = write(tmp_path / "single.csv", HEAD, "A-000_none,invoice,0,none,80,1,0,0.25,0.1")
    with pytest.raises(Exception, match="all classes required"):
        tables.require_classes(tables.clean_features(tables.read_features(spark, single))[0], ["genuine", "forged"]).collect()


def test_manifest(spark, tmp_path):
    sample = {"id": "A-000_none", "doc_type": "invoice", "manipulation": "none", "original_path": "o/a.png", "forged_path": None,
              "mask_path": None, "region_box": None, "image_size": [800, 600], "attributes": {"font": "serif"}}
    path = write(tmp_path / "m.json", json.dumps({"dataset": "x", "samples": [sample, {**sample, "id": "A-001_none"}]}, indent=1))
    rows = tables.read_manifest(spark, path).orderBy("id").collect()
    assert [r.id for r in rows] == ["A-000_none", "A-001_none"] and rows[0].image_size == [800, 600] and rows[0].region_box is None


def test_intake(spark):
    rows = [("a.png", "", 10), ("b.html", "text/html", 10), ("c.bin", "application/pdf; x", 10), ("d.png", "image/png", 0),
            ("e.png", "image/png", C.MAX_UPLOAD_BYTES + 1)]
    got = intake.intake(spark.createDataFrame(rows, "name string, mime string, size_bytes long"))
    assert {r.name: r.status for r in got.collect()} == {"a.png": 200, "b.html": 415, "c.bin": 200, "d.png": 400, "e.png": 413}


def report(i, sha=None, findings=1):
    finding = {"id": "F", "layer": "pixel", "code": "PX-ELA", "title": "t", "severity": "high", "confidence": .9, "description": "d", "evidence": []}
    return {"case_id": i, "caseCode": f"C-{i}", "engine": {"name": "worker", "version": "2"}, "file": {"name": f"{i}.png", "sizeBytes": 5},
            "hashes": {"sha256": sha or f"s{i}", "md5": "m", "sha1": "s"},
            "verdict": {"label": "suspicious", "riskScore": 50 + i, "confidence": .605}, "layers": [
                {"layer": "pixel", "name": "P", "score": .5, "confidence": .9, "status": "alert", "mode": "live", "metrics": [], "findings": [finding]}],
            "findings": [finding] * findings, "regions": [{"label": "r", "layer": "pixel", "score": .5, "confidence": .5, "x": .1, "y": .1, "width": .1, "height": .1}],
            "durationMs": 7, "reference": {"mode": "reference-free"}, "createdAt": f"2026-01-01T00:00:{i:02d}Z"}


def test_reports_to_tables(spark, tmp_path):
    docs = [report(1, findings=130), report(2), {**report(3), "verdict": {"label": "x"}}, {**report(4), "layers": None}]
    path = write(tmp_path / "r.json", *map(json.dumps, docs))
    good = reports.read_reports(spark, path).filter(reports.accepted())
    cases = {r.case_id: r for r in reports.to_cases(good).collect()}
    assert set(cases) == {1, 2} and cases[1].confidence == 61 and cases[1].engine == "worker v2" and cases[1].execution_mode == "live"
    assert cases[1].layer_scores == {"pixel": .5}
    assert reports.to_findings(good).filter("case_id = 1").count() == 130
    assert reports.to_regions(good).count() == 2 and reports.flatten_findings(good).count() == 2


def test_stream_deduplicates_and_restarts(spark, tmp_path):
    source, out, checkpoint = (tmp_path / n for n in ("in", "out", "cp"))
    source.mkdir()
    write(source / "1.json", *[json.dumps(r) for r in (report(1), report(2), report(3, sha="s1"))])
    stream.stream_reports(spark, str(source), str(out), str(checkpoint), available_now=True).awaitTermination()
    write(source / "2.json", *[json.dumps(r) for r in (report(4), report(5, sha="s2"))])
    stream.stream_reports(spark, str(source), str(out), str(checkpoint), available_now=True).awaitTermination()
    cases = spark.read.parquet(str(out / "cases"))
    assert cases.count() == 3 and {r.sha256 for r in cases.collect()} == {"s1", "s2", "s4"}
    assert spark.read.parquet(str(out / "regions")).count() == 3
    again = tmp_path / "cp2"  # batches of a new checkpoint replace nothing
    stream.stream_reports(spark, str(source), str(out), str(again), available_now=True).awaitTermination()
    assert spark.read.parquet(str(out / "cases")).count() == 6


def test_a_batch_that_dies_between_two_tables_is_not_seen(spark, tmp_path, monkeypatch):
    source, out, checkpoint = (tmp_path / n for n in ("in", "out", "cp"))
    source.mkdir()
    write(source / "1.json", *[json.dumps(r) for r in (report(1), report(2))])
    stream.stream_reports(spark, str(source), str(out), str(checkpoint), available_now=True).awaitTermination()
    write(source / "2.json", json.dumps(report(3)))

    def broken(_):
        raise RuntimeError("the disk is gone")
    monkeypatch.setitem(stream.TABLES, "regions", broken)
    with pytest.raises(Exception):
        stream.stream_reports(spark, str(source), str(out), str(checkpoint), available_now=True).awaitTermination()
    assert spark.read.parquet(str(out / "cases")).count() == 3  # written, but not committed
    seen = {name: stream.committed(spark, str(out), name).count() for name in ("cases", "findings", "regions")}
    assert seen["cases"] == 2
    monkeypatch.setitem(stream.TABLES, "regions", reports.to_regions)
    stream.stream_reports(spark, str(source), str(out), str(checkpoint), available_now=True).awaitTermination()
    assert stream.committed(spark, str(out), "cases").count() == 3
    assert {r.sha256 for r in stream.committed(spark, str(out), "cases").collect()} == {"s1", "s2", "s3"}


def test_a_committed_batch_is_not_written_again(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1,)], "case_id long")
    monkeypatch.setattr(stream, "TABLES", {name: lambda batch: batch for name in stream.TABLES})
    for batch, expected in ((rows, 1), (rows.unionByName(rows), 1)):
        stream._append(batch, "r", 0, str(tmp_path))
        assert stream.committed(spark, str(tmp_path), "cases").count() == expected


def test_streaming_statistics(spark, tmp_path):
    source = tmp_path / "cases"
    rows = spark.createDataFrame([(70, 10), (50, 20), (10, 30)], "risk_score int, duration_ms int")
    rows.write.parquet(str(source))
    live = spark.readStream.schema(rows.schema).parquet(str(source))
    query = stream.stream_register_stats(live, "live_stats")
    query.processAllAvailable()
    query.stop()
    assert tuple(spark.table("live_stats").first()) == tuple(register.statistics(rows).first()) == (3, 1, 1, 1, 43, 20)


def test_register_search_and_delete(spark):
    cases = spark.createDataFrame([("a", "Bill_1.png", "forged", "r", 2), ("b", "bill-2.png", "forged", "r", 3), ("c", "card.png", "authentic", "r", 1)],
                                  "id string, filename string, verdict string, report string, created_at int")
    assert [r.id for r in register.search(cases, "forged", "BILL").collect()] == ["b", "a"]
    assert "report" not in register.search(cases).columns and register.search(cases, limit=0).count() == 1
    assert register.case_by_id(cases, "a").count() == 0
    children = cases.select(F.col("id").alias("case_id"))
    kept = register.delete_cases(cases.filter("id = 'a'").select("id"), cases, children, children)
    assert [df.count() for df in kept] == [2, 2, 2]


def test_stream_query_keeps_its_files_small(spark, tmp_path, monkeypatch):
    from papertrail.plans import registry, report_queries
    spark.createDataFrame([(i, " ".join(f"longerword{i}x{k % 7}" for k in range(300)), "en", "web", 300 + i) for i in range(1, 41)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "t" / "documents.parquet"))
    monkeypatch.setattr(report_queries, "run_folder", lambda *_: str(tmp_path / "run"))
    tables = registry.Tables(spark, str(tmp_path / "t"))
    accepted = sum(i % 13 != 0 and i % 17 != 0 for i in range(1, 41))
    assert registry.QUERIES["stream_intake"](tables).count() == accepted
    rows = report_queries.reports(tables)
    as_text = sum(len(r.report) for r in reports.report_to_json(rows).collect())
    assert sum(f.stat().st_size for f in (tmp_path / "run").rglob("part-*")) < as_text / 4


def test_reports_read_the_length_of_every_word_once(spark, tmp_path):
    from papertrail.plans import registry, report_queries
    text = " ".join(["short", "eightlet", "twelveletter", "a", "overtwelveletters"])
    spark.createDataFrame([(1, text, "en", "web", len(text)), (2, None, "en", "web", 0), (3, "", "en", "web", 0)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = report_queries.reports(registry.Tables(spark, str(tmp_path)))
    rows = {r.case_id: r for r in found.collect()}
    assert [(f.id, f.title) for f in rows[1].findings] == [("F-1", "eightlet"), ("F-2", "twelveletter"), ("F-4", "overtwelveletters")]
    assert [(g.label, g.layer) for g in rows[1].regions] == [("twelveletter", "layout"), ("overtwelveletters", "aigc")]
    assert rows[2].findings is None and rows[3].findings == []
    assert found._jdf.queryExecution().optimizedPlan().toString().count("length(lambda") == 1


def test_rows_of_reports_ask_nothing_of_the_arrays_before_they_are_made(spark, tmp_path):
    texts = ["a longword and unbelievably longer words", "tiny", "", "considerations"]
    spark.createDataFrame([(i + 1, text, "en", "web", len(text)) for i, text in enumerate(texts)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {name: callables()[name](spark, str(tmp_path)) for name in ("finding_rows", "region_rows")}
    for rows in found.values():  # the texts are cut once, behind the move
        assert rows._jdf.queryExecution().executedPlan().toString().split("DataFilters")[0].count("split(") == 1
    assert sorted((r.case_id, r.ord, r.title) for r in found["finding_rows"].collect()) == [
        (1, 0, "longword"), (1, 1, "unbelievably"), (4, 0, "considerations")]
    assert sorted((r.case_id, r.label) for r in found["region_rows"].collect()) == [(1, "unbelievably"), (4, "considerations")]


def test_features_are_computed_once_and_not_where_texts_are_read(spark, tmp_path):
    texts = ["Abc 12", "XYZ\nu", "none", "A1e"]
    spark.createDataFrame([(i + 1, text, "en", "web", len(text)) for i, text in enumerate(texts)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in (1, 2, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, labels in (("features_clean", ["forged", "genuine", "genuine"]), ("features_three_class", ["copy_move", "genuine", "genuine"])):
        rows = callables()[name](spark, str(tmp_path))
        assert "regexp" not in rows._jdf.queryExecution().executedPlan().toString()
        found = {r.doc_id: r for r in rows.collect()}
        assert sorted(r.label for r in found.values()) == labels and found[1].ela_score == pytest.approx(2 / 6, abs=1e-6)
