"""What moves: rows of ordinary keys once, rows that lie by case never again; crowded keys still go through all tasks."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from papertrail.operators import regions as R
from papertrail.operators import words as W
from papertrail.operators.residuals import offset_voting, repeated_blocks, text_blocks
from papertrail.operators.skew import anchored_starts, gap_clusters, row_numbers, with_following
from papertrail.plans.registry import Tables
from papertrail.session import tune


def moves(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_row_numbers_move_ordinary_keys_once_and_cut_crowded_ones(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice("aaaab"), p, float(rng.randrange(90))) for p in rng.sample(range(9000), 300)], "k string, pos long, v double")
    order, bucket = [F.col("v"), F.col("pos")], [F.floor(F.col("v") / 7)]
    plain = rows(df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*order))))
    ours = row_numbers(df, ["k"], order, bucket)
    assert moves(ours) == 1 and rows(ours) == plain
    assert rows(row_numbers(df, ["k"], order, bucket, most=100)) == plain


def test_anchored_starts_of_ordinary_keys_move_once(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.choice("aaab"), rng.randrange(4000) / 2) for _ in range(600)], "k string, x double")
    folded = anchored_starts(df, ["k"], "x", 34.0, width=64)
    assert moves(folded) == 1
    linked = anchored_starts(df, ["k"], "x", 34.0, width=64, crowd=200)
    assert rows(folded) == rows(linked)
    assert rows(anchored_starts(df, ["k"], "x", 34.0, 64, most=3)) == rows(linked.filter("ordinal < 3"))


def page(rng, n, spread):
    return [(1, i, rng.choice(["ab", "cd", "ef"]), rng.randrange(600), rng.randrange(spread), rng.randrange(10, 90), 12, 620, spread) for i in range(n)]


BOXED = "case_id long, idx long, text string, left int, top int, width int, height int, page_width int, page_height int"


def test_nearest_words_of_a_page_equal_those_of_a_crowded_page_and_brute_force(spark):
    rng = random.Random(8)
    a, b = page(rng, 220, 900), page(rng, 160, 900)
    left, right = (spark.createDataFrame(x, BOXED) for x in (a + a[:3], b))

    def centre(w):
        return (w[3] + w[5] / 2) / w[7], (w[4] + w[6] / 2) / w[8]
    want = []
    for w in a:
        (x, y), best = centre(w), None
        for o in b:
            ox, oy = centre(o)
            if abs(ox - x) < 0.16 and abs(oy - y) < 0.045:
                key = (abs(ox - x) + abs(oy - y), oy, ox, o[1], o[2])
                best = key if best is None or key < best else best
        if best:
            want.append((1, w[1], w[2], best[3], best[4], best[0]))
    assert rows(W.nearest_words(left, right)) == sorted(want)
    assert rows(W.nearest_words(left, right, crowd=100)) == sorted(want)
    kept = W.nearest_words(left, right, keep=["left"]).select("idx", "left")
    assert rows(kept) == rows(W.nearest_words(left, right, keep=["left"], crowd=100).select("idx", "left"))


def test_words_that_lie_by_case_do_not_move_again(spark):
    left, right = (spark.createDataFrame(page(random.Random(n), 60, 400), BOXED).repartition(4, "case_id") for n in (1, 2))
    assert moves(W.nearest_words(left, right)) == 2


def test_spread_texts_feed_blocks_without_a_second_move(spark, tmp_path):
    text = " ".join(str(i % 20) for i in range(80))
    spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = Tables(tune(spark), str(tmp_path)).spread("documents", "doc_id").select(F.col("doc_id").alias("case_id"), "text")
    linked = offset_voting(text_blocks(texts, F.split("text", " ")))
    assert "Exchange hashpartitioning(case_id" not in linked._jdf.queryExecution().executedPlan().toString()
    assert {r["shift"] for r in linked.collect()} == {20}


def test_layout_of_ordinary_and_crowded_pages(spark):
    rng = random.Random(8)
    made = [(c, i, "x", rng.choice([None, 10.0, 45.0, 80.0]), rng.choice([None, *range(0, 400, 7)]), rng.choice([None, *range(0, 200, 3)]), rng.choice([20, 40, 0]),
             rng.choice([None, 0, 12, 12, 12, 13, 30])) for c in (1, 2, 3, None) for i in range(120)]
    made += [(4, 1, "x", 50.0, 5, None, 10, 12), (5, 1, "x", 50.0, None, 5, 10, 12), (6, 1, "x", 50.0, 5, 5, 10, None)]
    words = spark.createDataFrame(made, "case_id long, idx long, text string, conf double, left int, top int, width int, height int")
    for judge in (W.row_outliers, W.column_outliers, W.layout_layer):
        plain, crowded = judge(words), judge(words, crowd=0)
        assert dict(plain.dtypes) == dict(crowded.dtypes)
        assert [repr(r) for r in rows(plain.fillna(-1))] == [repr(r) for r in rows(crowded.select(plain.columns).fillna(-1))]
    lain = words.filter("case_id < 4").repartition(4, "case_id")
    assert moves(W.layout_layer(lain)) == 1


def test_clusters_of_ordinary_and_crowded_keys(spark):
    rng = random.Random(7)
    made = [(rng.choice([1, 2, 3, None]), i, rng.choice([None, *range(0, 900, 9)])) for i in range(300)]
    df = spark.createDataFrame(made, "case_id long, idx long, top int").repartition(4, "case_id")
    plain = gap_clusters(df, ["case_id"], "top", 18, width=64)
    assert moves(plain) == 1
    names = ["case_id", "idx", "top", "cluster"]
    assert rows(plain.select(names)) == rows(gap_clusters(df, ["case_id"], "top", 18, width=64, most=90).select(names)) != []


def test_followers_of_ordinary_and_crowded_keys(spark):
    df = spark.createDataFrame([(c, i, str(i * c)) for c in (1, 2, 3) for i in range(0, 90 * c, c)], "case_id long, idx long, text string").repartition(4, "case_id")
    got = [with_following(df, ["case_id"], "idx", ["text"], n=2, width=16, most=most) for most in (1000, 80, None)]
    text = got[0]._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in text and moves(got[0]) == 1
    first, *others = [rows(g.select("case_id", "idx", "text", "next1_text", "next2_text").fillna("")) for g in got]
    assert len(first) == 270 and all(o == first for o in others)


def test_only_blocks_that_repeat_become_rows(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 3, 5, 40, 300, 7)] + [" ".join(str(i % 20) for i in range(80)), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "case_id long, text string")
    whole = text_blocks(df, F.split("text", " "))
    kept = repeated_blocks(df, F.split("text", " "))
    copies = whole.groupBy("case_id", "block").agg(F.collect_list("pos").alias("at")).filter(F.size("at") > 1)
    assert rows(kept) == rows(copies.select("case_id", F.explode("at").alias("pos"), "block"))
    assert rows(offset_voting(kept)) == rows(offset_voting(whole)) != []


def test_regions_merge_where_their_case_lies(spark):
    rng = random.Random(4)
    shape = "case_id long, ord long, detector string, x double, y double, width double, height double"
    made = [(c, i, rng.choice("ab"), rng.randrange(20) / 25, rng.randrange(20) / 25, rng.randrange(6) / 40, .1) for c in range(5) for i in range(30)]
    df = spark.createDataFrame(rng.sample(made, len(made)), shape)
    merged = R.merge_regions(df)
    assert moves(merged) == 1
    assert rows(merged.select("case_id", "ord", "component")) == rows(R.merge_regions(df, crowd=10).select("case_id", "ord", "component"))


def test_words_in_region_are_the_text_in_page_order(spark):
    words = spark.createDataFrame([(1, i, text, x, 100, 30, 12, 600, 600) for i, text, x in ((2, "c", 90), (0, "a", 60), (1, "b", 400), (3, "d", 120))], BOXED)
    boxes = spark.createDataFrame([(1, 7, .05, .1, .2, .2)], "case_id long, ord int, x double, y double, width double, height double")
    assert rows(R.region_texts(R.words_in_regions(boxes, words))) == [(1, 7, "a c d")]


def test_values_beside_labels_on_short_and_long_lines(spark):
    rng = random.Random(6)
    made = [(c, i, rng.choice(["total", "12", "7.50", "x"]), 90.0, rng.randrange(500), rng.randrange(6) * 9, 20, 10) for c in (1, 2) for i in range(80)]
    words = spark.createDataFrame(made, "case_id long, idx long, text string, conf double, left int, top int, width int, height int")
    want = []
    for c, i, text, _, left, top, _, _ in made:
        if text == "total":
            right = [(o[4] - left - 20, o[1]) for o in made if o[0] == c and o[2] in ("12", "7.50") and o[4] >= left + 18 and abs(o[5] - top) <= 10]
            want += [(c, i, *min(right)[::-1])] if right else []
    labels = words.filter("text = 'total'").select("case_id", F.col("idx").alias("label_idx"), F.col("text").alias("label"), "left", "top", "width", "height")

    def got(crowd):
        return rows(W.values_beside(words, labels, crowd).select("case_id", "label_idx", "v.idx", "v.gap"))
    assert got(1024) == got(5) == sorted(want)
    assert moves(W.values_beside(words, labels)) <= 5
