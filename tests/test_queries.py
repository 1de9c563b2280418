"""Named queries against their SQL twins on the smallest tables.

All queries of the library run (the corpus queries have tests of their own); PAPERTRAIL_SOME=1 takes a spread of them.
check.py does the same at any scale.
"""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare
from papertrail.plans.registry import QUERIES

FOLDER = os.environ.get("PAPERTRAIL_DATA", "/root/testdata/sf0.001")
SOME = ["fuse_cases", "ablation", "region_components", "mask_overlap", "layout_layer", "identity_fields", "word_nearest", "reconcile_totals",
        "reference_layer", "field_states", "word_nearest_diff", "word_diff_notes", "change_lists", "comparison_findings", "payload_layer",
        "feature_vector", "jpeg_quality", "rolling_fingerprint", "words_in_region", "ocr_text", "metadata_entries", "case_search", "auc", "group_split", "hotspot_blobs", "offset_voting", "validator_report", "finding_rows"]
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", SOME if os.environ.get("PAPERTRAIL_SOME") else sorted(QUERIES))
def test_query(spark, con, name):
    text, _, ok, _ = compare(spark, con, FOLDER, name)
    assert ok, text


def test_every_sql_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_finding_rows_are_all_findings(spark):
    counts = [entry.queries()[name](spark, FOLDER).count() for name in ("finding_rows", "flatten_findings")]
    assert counts[0] == counts[1] > 0
