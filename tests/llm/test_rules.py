"""Rule ensemble: statistics, rules, compiled scores, accuracy on held-out labels."""

import math
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papertrail.llm import rules

FOLDER = os.environ.get("PAPERTRAIL_DATA", "/root/testdata/sf0.001").replace("sf0.001", "sf0.01")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("score", T.StringType()), T.StructField("symbols", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def test_statistics_of_odd_texts(spark):
    rows = [(0, None), (1, ""), (2, "a a b"), (3, "AB!! c##\nAB!! c##"), (4, "word " * 50_000)]
    out = {r.doc_id: r for r in spark.createDataFrame(rows, "doc_id long, text string").select(
        "doc_id", *[c.alias(n) for n, c in rules.statistics(F.col("text")).items()]).collect()}
    assert set(rules.NAMES) <= set(out[0].asDict())
    assert all(out[0][n] == out[1][n] for n in rules.NAMES) and out[0].symbols == 0
    assert out[2].variety == pytest.approx(2 / 3) and out[2].stutter == pytest.approx(1 / 3)
    assert out[3].symbols == pytest.approx(4 / 17) and out[3].line_variety == .5
    assert out[4].variety == pytest.approx(1 / 50_000)


def test_compiled_score_equals_the_rules(spark):
    rng = random.Random(3)
    ensemble = rules.RuleEnsemble(.3, (
        (rules.Rule((("symbols", True, .2), ("variety", False, .5))), 1.5), (rules.Rule((("capitals", False, .1),)), -2.0)))
    texts = ["".join(rng.choice("aB #!\n") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "clash", "own") for i, t in enumerate(texts)], DOCS)
    out = rules.classify(docs, ensemble).join(docs.select("doc_id", *[c.alias(f"s_{n}") for n, c in rules.statistics(F.col("text")).items()]), "doc_id").collect()
    assert len(out) == 60
    for r in out:
        total = .3 + 1.5 * (r.s_symbols <= .2 and r.s_variety > .5) - 2 * (r.s_capitals > .1)
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)))
        assert r.predicted == (r.score >= .3) and r.symbols == "own"


def test_redundant_conditions_are_merged():
    rule = rules.Rule((("a", True, 3.0), ("a", True, 2.0), ("b", False, 1.0), ("b", False, 4.0)))
    assert rules._shortest(rule).conditions == (("a", True, 2.0), ("b", False, 4.0))


def test_edge_tables(spark):
    docs = spark.createDataFrame([(None, None, "x", "y"), (1, "", "x", "y"), (1, "", "x", "y"), (2, "good text here", "x", "y")], DOCS)
    nothing = rules.learn(docs, spark.createDataFrame([], LABELS))
    assert [r.score for r in rules.classify(docs, nothing).collect()] == [.5] * 4
    one_class = rules.learn(docs, spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 0), (2, None, 0)], LABELS))
    assert all(r.predicted == 1 for r in rules.classify(docs, one_class).collect())
    kept = rules.accepted(docs, one_class)
    assert kept.columns == docs.columns and kept.count() == 4
    assert rules.classify(docs.limit(0), nothing).count() == 0


def test_held_out_is_the_remainder_of_the_crc(spark):
    rows = spark.range(200).select("id", rules.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="driver tables not present")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    ensemble = rules.learn(docs, labels)
    assert 0 < len(ensemble.weights) < 60
    tested = rules.classify(docs, ensemble).join(labels, "doc_id").filter(rules.held_out(F.col("doc_id")))
    right = tested.filter("predicted = quality").count()
    assert right / tested.count() > .93
