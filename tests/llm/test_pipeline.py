"""The pipeline's stages one after another on the smallest tables, each against a plain version."""

import os

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_bagminhash import bag, classes
from test_suffix import plain

FOLDER = os.environ.get("PAPERTRAIL_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="driver tables not present")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    (_, quality), (_, dedup), (_, clean), (_, pack) = corpus_pipeline.STAGES
    good = quality(spark, docs, FOLDER)
    assert good.columns == docs.columns
    rows = good.collect()
    ids = {r.doc_id for r in rows}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    right = sum((d in ids) == (q == 1) for d, q in marks.items())
    assert right / len(marks) > .9
    one = dedup(spark, spark.createDataFrame(rows, docs.schema), FOLDER)
    assert one.columns == docs.columns
    kept = one.collect()
    expected = {c for (_, c), r in zip(classes([(r.doc_id, r.text) for r in rows]), rows) if bag(r.text)}
    assert {r.doc_id for r in kept if bag(r.text)} == expected
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text", F.lit(0)).collect()]
    report = plain([(r.doc_id, r.text) for r in kept], items)
    left = clean(spark, spark.createDataFrame(kept, docs.schema), FOLDER)
    assert left.columns == docs.columns
    final = left.collect()
    assert {r.doc_id for r in final} == {r[0] for r in report if not r[5]}
    out = pack(spark, spark.createDataFrame(final, docs.schema), FOLDER).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in final}
    assert {r.doc_id: r.doc_tokens for r in out} == sizes and sum(r.length for r in out) == sum(sizes.values())
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.start, r.ids_crc32) for r in out)


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score string, node long, component string, k long, length string"


def folder_of(spark, path, rows, labels=(), items=()):
    spark.createDataFrame(list(rows), EXTRA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def row(i, text):
    return (i, text, "en", None, 3, "clash", 1, "clash", 2, "clash")


def test_odd_rows_pass_all_stages(spark, tmp_path):
    item = " ".join(f"item{k}" for k in range(14))
    texts = {1: None, 2: "", 3: "...", 4: "one two three", 5: " ".join(f"w{k}" for k in range(5000)), 6: f"{item} tail", 7: item, None: "without an id here"}
    rows = [row(i, t) for i, t in texts.items()] + [row(8, texts[5]), row(9, texts[4]), row(4, texts[4]), row(None, None)]
    folder = folder_of(spark, tmp_path / "odd", rows, items=[("a", item), ("b", None)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [c.split()[0] for c in EXTRA.split(", ")], name
        docs = spark.createDataFrame(docs.collect(), EXTRA)
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.score, r.component) for r in docs.collect())
    assert [k[1] for k in kept if not k[0]] == [1, 2, 3, 4, 5] and sum(k[0] for k in kept) == 2
    assert {k[2:] for k in kept} == {("clash", "clash")}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4, 5, None} and sum(r.doc_tokens for r in pieces if r.doc_id in (1, 2)) == 2


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder_of(spark, tmp_path / "none", [])).count() == 0
