"""Bucketed operators against plain windows, with one key holding most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from papertrail.operators import regions as R
from papertrail.operators import words as W
from papertrail.operators.components import connected_components
from papertrail.operators.skew import exact_quantiles, gap_clusters, row_numbers, top_k, with_following


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < .7 else f"k{rng.randrange(9)}", p, float(rng.randrange(400)) / 4) for p in rng.sample(range(20000), 1500)]
    return spark.createDataFrame(rows, "k string, pos long, v double").cache()


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_row_numbers(hot):
    plain = hot.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("v", "pos")))
    ours = row_numbers(hot, ["k"], [F.col("v"), F.col("pos")], [F.floor(F.col("v") / 7)])
    same(plain.select("k", "pos", "rn"), ours.select("k", "pos", "rn"))


def test_with_following(hot):
    w = Window.partitionBy("k").orderBy("pos")
    plain = hot.select("k", "pos", F.lead("v", 1).over(w), F.lead("v", 2).over(w))
    ours = with_following(hot, ["k"], "pos", ["v"], n=2, width=40).select("k", "pos", "next1_v", "next2_v")
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, plain.collect()), key=key) == sorted(map(tuple, ours.collect()), key=key)


def test_gap_clusters(hot):
    w = Window.partitionBy("k").orderBy("pos")
    broken = hot.withColumn("b", F.coalesce((F.col("pos") - F.lag("pos").over(w) > 30).cast("int"), F.lit(0)))
    plain = broken.select("k", "pos", F.sum("b").over(w).alias("c"))
    same(plain, gap_clusters(hot, ["k"], "pos", 30, width=250).select("k", "pos", F.col("cluster").alias("c")))


def test_chained_clusters_of_fixture(spark):
    points = spark.createDataFrame([("a", float(x)) for x in (10, 30, 50, 90)], "k string, x double")
    got = {r.x: r.cluster for r in gap_clusters(points, ["k"], "x", 34, width=16).collect()}
    assert got == {10: 0, 30: 0, 50: 0, 90: 1}
    starts = spark.range(1).select(W.anchored_clusters(F.array(*[F.lit(float(x)) for x in (90, 10, 50, 30)]), 34.0)).first()[0]
    assert starts == [10, 50, 90]


def test_exact_quantiles(hot):
    plain = hot.groupBy("k").agg(F.percentile("v", .5), F.percentile("v", .95)).orderBy("k").collect()
    ours = exact_quantiles(hot, ["k"], "v", {"m": .5, "p": .95}, width=3).orderBy("k").collect()
    for a, b in zip(plain, ours, strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1]) and a[2] == pytest.approx(b[2])


def test_top_k_prunes_before_the_shuffle(hot):
    plan = top_k(hot, ["k"], [F.desc("v"), F.col("pos")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_components_of_path_and_random_graph(spark):
    rng = random.Random(3)
    nodes = list(range(120))
    rng.shuffle(nodes)
    path = [(nodes[i], nodes[i + 1]) for i in range(79)]
    extra = [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(25)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in path + extra:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    edges = spark.createDataFrame(path + extra, "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {n: find(n) for n in parent if n in got} and set(got) == {x for e in path + extra if e[0] != e[1] for x in e}


def box_rows(n, seed):
    rng = random.Random(seed)
    return [("hot", i, rng.random(), rng.random(), .02 + rng.random() * .2, .02 + rng.random() * .2) for i in range(n)]


def iou(a, b):
    w = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
    h = min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
    inter = max(0, w) * max(0, h)
    return inter / (a[4] * a[5] + b[4] * b[5] - inter)


def test_grid_pairs_equal_all_pairs(spark):
    rows = box_rows(400, 5)
    boxes = spark.createDataFrame(rows, "case_id string, ord int, x double, y double, width double, height double")
    # 400 boxes in one case: the search runs on a grid of several cells.
    assert R.with_grid(boxes, ["case_id"]).first()["__g"] > 1
    got = R.overlapping_pairs(boxes, ["case_id"], "ord", []).withColumn("iou", R.pair_iou()).filter("iou > 0.12")
    expected = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and iou(a, b) > .12}
    found = [(r.a_ord, r.b_ord) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_copies_of_a_box_collapse_before_the_pair_search(spark):
    rows = box_rows(30, 9) + [("hot", 1000 + i, .5, .5, .1, .1) for i in range(300)]
    boxes = spark.createDataFrame(rows, "case_id string, ord int, x double, y double, width double, height double")
    merged = {r.ord: r.component for r in R.merge_regions(boxes).collect()}
    parent = {r[1]: r[1] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in rows:
        for b in rows:
            inside = a[2] <= b[2] + b[4] / 2 <= a[2] + a[4] and a[3] <= b[3] + b[5] / 2 <= a[3] + a[5]
            if a[1] < b[1] and (iou(a, b) >= .18 or inside):
                ra, rb = find(a[1]), find(b[1])
                parent[max(ra, rb)] = min(ra, rb)
    assert merged == {o: find(o) for o in parent}


def word_table(spark, n, seed, page=(1000, 1400)):
    rng = random.Random(seed)
    rows = [("c", i, f"w{rng.randrange(50)}", 90.0, rng.randrange(page[0]), rng.randrange(page[1]), 30, 12, *page) for i in range(n)]
    return rows, spark.createDataFrame(rows, "case_id string, idx int, text string, conf double, left int, top int, width int, "
                                             "height int, page_width int, page_height int")


def test_nearest_words_equals_brute_force(spark):
    a_rows, a = word_table(spark, 250, 1)
    b_rows, b = word_table(spark, 250, 2)
    centre = lambda r: ((r[4] + r[6] / 2) / r[8], (r[5] + r[7] / 2) / r[9])
    expected = {}
    for w in a_rows:
        x, y = centre(w)
        near = [(abs(centre(r)[0] - x) + abs(centre(r)[1] - y), centre(r)[1], centre(r)[0], r[1]) for r in b_rows
                if abs(centre(r)[1] - y) < .045 and abs(centre(r)[0] - x) < .16]
        if near:
            expected[w[1]] = min(near)[3]
    assert {r.idx: r.ridx for r in W.nearest_words(a, b).collect()} == expected


def test_word_differences_use_the_ratio(spark):
    import difflib
    _, a = word_table(spark, 60, 1)
    shifted = a.withColumn("text", F.when(F.col("idx") % 3 == 0, F.concat(F.lit("zz"), "text", F.lit("q"))).otherwise(F.upper("text")))
    changed = {r.idx: r for r in W.word_differences(a, shifted).collect()}
    texts = {r.idx: r.text for r in a.collect()}
    for i, text in texts.items():
        other = f"zz{text}q"
        ratio = difflib.SequenceMatcher(None, text, other).ratio()
        assert (i in changed) == (i % 3 == 0 and ratio < .8)
