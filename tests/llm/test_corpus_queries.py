"""The registered corpus queries over the smallest tables: against their SQL twins where there are any."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare
from papertrail.llm.queries import QUERIES, SQL

FOLDER = os.environ.get("PAPERTRAIL_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_twin(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    text, _, ok, _ = compare(spark, connection, FOLDER, name)
    assert ok, text


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))


@pytest.mark.parametrize("name,columns", [
    ("op3_packing", "doc_id start length ids_crc32 doc_tokens sequence_id offset"), ("op5_bitpack", "doc_id start n_tokens ids_crc32"),
    ("op9_html_region", "page_id url text n_chars"), ("op11_importance", "doc_id n_features weight score rank"),
    ("op12_hard_negatives", "anchor_id positive_id rank negative_id positive_score negative_score"),
    ("op13_mixing", "doc_id size source_size target taken")])
def test_columns_of_the_others(spark, name, columns):
    assert QUERIES[name](spark, FOLDER).columns == columns.split()
