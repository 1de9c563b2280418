"""Corpus validation: every rule broken once, odd rows, and one shuffle for all rules."""

from papertrail.operators import quality as Q

MANIFEST = "id string, doc_type string, manipulation string, original_path string, forged_path string, mask_path string, region_box array<int>"
BOX = [0, 0, 1, 1]


def entry(i, kind="erase", **changed):
    out = {"id": f"s{i}", "doc_type": "invoice", "manipulation": kind, "original_path": f"originals/{i}.png", "forged_path": f"forged/{i}f.png",
           "mask_path": f"masks/{i}f.png", "region_box": BOX}
    if kind == "none":
        out |= {"forged_path": None, "mask_path": None, "region_box": None}
    return tuple({**out, **changed}.values())


def listed(rows):
    out = [("originals", r[3]) for r in rows] + [("forged", r[4]) for r in rows if r[4]] + [("masks", r[5]) for r in rows if r[5]]
    return [(c, p) for c, p in out if p]


def report(spark, rows, files, originals, forged, types):
    frame = Q.validate_corpus(spark.createDataFrame(rows, MANIFEST), spark.createDataFrame(files, "category string, path string"), originals, forged, types)
    return {r["check"]: (r["problems"], r["ok"]) for r in frame.collect()}


def test_a_sound_corpus_has_no_problem(spark):
    rows = [entry(1, "none"), entry(2), entry(3)]
    found = report(spark, rows, listed(rows), 1, 2, {"invoice": 3})
    # Every entry lists its original, so there are more of them than genuine rows.
    assert {k for k, (n, _) in found.items() if n} == {"count/originals"} and found["count/originals"] == (2, False)


def test_every_rule_finds_its_problem(spark):
    rows = [entry(1, "none", region_box=BOX), entry(2, id="s1"), entry(3, mask_path="masks/other.png"), entry(4, mask_path=None), entry(5)]
    files = [f for f in listed(rows) if f != ("masks", "masks/5f.png") and f != ("originals", "originals/5.png")]
    files += [("masks", "masks/lonely.png"), ("forged", "x/2f.png"), ("originals", "y/2f.png"), ("masks", None)]
    found = {k: n for k, (n, _) in report(spark, rows, files, 1, 4, {"invoice": 4, "letter": 0}).items()}
    assert found == {"count/manifest": 0, "count/type/invoice": 1, "count/type/letter": 0, "pairing/manifest_fields": 2, "count/originals": 4, "count/forged": 1,
                     "count/masks": 0, "uniqueness/filenames": 1, "uniqueness/no_original_name_collision": 1, "uniqueness/mask_names_match_forged": 6,
                     "uniqueness/ids": 1, "pairing/mask_exists": 2, "pairing/no_orphan_masks": 2, "pairing/mask_name": 1, "pairing/paths_exist": 1}


def test_empty_tables(spark):
    found = report(spark, [], [], 0, 0, {"invoice": 0})
    assert len(found) == 14 and all(ok for _, ok in found.values())


def test_all_rules_share_one_shuffle_by_key(spark):
    rows = [entry(1, "none")]
    frame = Q.validate_corpus(spark.createDataFrame(rows, MANIFEST), spark.createDataFrame(listed(rows), "category string, path string"), 1, 0, {})
    plan = frame._jdf.queryExecution().sparkPlan().toString() + frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
