"""Mixtures against a plain version, and the promises they keep."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from papertrail.llm import mixing

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("size", T.StringType()), T.StructField("place", T.LongType()), T.StructField("rest", T.LongType())])


def corpus(seed=2):
    rng = random.Random(seed)
    sources = ["b", "a", "hot", None, "", "é", "empty", "z"]
    rows = []
    for i in range(300):
        source = "hot" if rng.random() < .4 else rng.choice(sources)
        n = 0 if source == "empty" else rng.choice([0, 1, 5, 40, 400])
        rows.append((i if i % 41 else None, "\t".join(rng.choice(["x", "Él,", "—", " ", "1 2"]) for _ in range(n)), source, "clash", 1, 2))
    rows += [(301, None, "a", "c", 1, 1), (302, "\x0b\x0c \n", "a", "c", 1, 1)]
    return rows + [(400, "same words again", "b", "c", 1, 1)] * 7


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, capped, left = dict.fromkeys(order, 0.0), set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            break
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > most * sizes[s]]
        if not over:
            target.update({s: weight[s] * level for s in free})
            break
        for s in over:
            capped.add(s)
            target[s] = float(most * sizes[s])
            left -= most * sizes[s]
    return target


def plain(rows):
    sized = [(r[0], size(r[1]), r[2], int(hashlib.md5((f"{'' if r[0] is None else r[0]}:" + hashlib.md5((r[1] or "").encode()).hexdigest()).encode()).hexdigest()[:15], 16))
             for r in rows]
    sums = defaultdict(int)
    for _, n, s, _ in sized:
        sums[s] += n
    target = plain_targets(sums)
    out = []
    for doc_id, n, s, h in sized:
        copies = int(target[s] // sums[s]) if sums[s] else 0
        rest = int(target[s]) - copies * sums[s]
        before = sum(m for _, m, t, g in sized if t == s and g < h)
        ties = sum(t == s and g == h for _, _, t, g in sized)
        out.append((doc_id, n, sums[s], round(target[s], 6), copies * n + max(0, min(n, (rest - before) // ties))))
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def rounded(rows):
    return sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in rows), key=key)


@pytest.mark.parametrize("level,broadcast", [(12, 100_000), (3, 0)])
def test_mixture_matches_the_plain_version(spark, monkeypatch, level, broadcast):
    monkeypatch.setattr(mixing, "LEVEL", level)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rows = corpus()
    out = mixing.mixed_sizes(spark.createDataFrame(rows, DOCS).repartition(3))
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert rounded(out.collect()) == rounded(plain(rows))


def test_sums_meet_their_targets(spark):
    rows = corpus(9)
    by_source = mixing.mix(spark.createDataFrame(rows, DOCS)).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for row in by_source:
        assert abs(row["sum(taken)"] - row["max(target)"]) <= 1 + 7  # rows that tie share what is missing
    assert all(r["taken"] <= 3 * r["size"] for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect())


def test_reruns_agree_whatever_the_partitions(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    one, two = (sorted(map(str, mixing.mixed_sizes(docs.repartition(n)).collect())) for n in (1, 5))
    assert one == two


def test_columns_stay_but_for_the_results(spark):
    rows = corpus()
    out = mixing.mix(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "source", "place", "rest", "size", "source_size", "target", "taken"]
    assert sorted(((r["doc_id"], r["text"], r["source"], r["place"], r["rest"]) for r in out.collect()), key=str) == \
        sorted(((r[0], r[1], r[2], r[4], r[5]) for r in rows), key=str)


def test_texts_of_the_mixture_hold_the_words_taken(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    texts = mixing.mixed_texts(docs)
    assert texts.columns == [*docs.columns, "copy"]
    taken = mixing.mix(docs).agg({"taken": "sum"}).first()[0]
    assert sum(size(r["text"]) for r in texts.collect()) == taken > 0


@pytest.mark.parametrize("rows", [[], [(1, None, None, "c", 1, 1)], [(1, "", "a", "c", 1, 1), (2, None, "b", "c", 1, 1)]])
def test_empty_tables_and_texts(spark, rows):
    out = mixing.mixed_sizes(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in out) == [(r[0], 0, 0) for r in rows]


def test_one_source_takes_all_its_words(spark):
    rows = [(i, "w " * (i + 1), "only", "c", 1, 1) for i in range(20)]
    out = mixing.mixed_sizes(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r["taken"] == r["size"] for r in out)
