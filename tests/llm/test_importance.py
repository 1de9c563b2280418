"""Importance resampling against a plain version."""

import hashlib
import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import types as T

from papertrail.llm import importance
from papertrail.llm.common import words

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()),
                     T.StructField("rank", T.LongType()), T.StructField("bucket", T.LongType())])
TARGET = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("text", T.StringType())])


def features(text):
    ws = words(text)
    return [b" ".join(ws[i:i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def plain(rows, target, percent=5, least=20):
    def counted(texts):
        return Counter(crc32(f) % 10000 for t in texts for f in features(t))
    s, t = counted(r[1] for r in rows), counted(target)
    ss, tt = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text, *_ in rows:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (ss + 10000) / ((s[b] + 1) * (tt + 10000)))) for b in (crc32(f) % 10000 for f in features(text)))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(features(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296)))])
    eligible = sorted((i for i, r in enumerate(rows) if len(words(r[1])) >= least),
                      key=lambda i: (-out[i][3], out[i][0] is not None, out[i][0] or 0, out[i][1], out[i][2]))
    ranks = {i: k + 1 for k, i in enumerate(eligible[:percent * len(eligible) // 100])}
    return [(*row, ranks.get(i)) for i, row in enumerate(out)]


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Éa", "THE", "中文"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 19, 20, 21, 80]))) for _ in range(160)]
    texts += [None, "", "...", "one two", "w1 " * 3000, texts[5], texts[5]]
    rows = [(i if i % 31 else None, t, "clash", 3, 4) for i, t in enumerate(texts)]
    return rows + [rows[9], rows[9]], [" ".join(rng.choices(vocabulary[:40], k=30)) for _ in range(20)] + [None, ""]


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("percent,least", [(5, 20), (100, 0), (30, 21)])
def test_scores_and_ranks_match_the_plain_version(spark, percent, least):
    rows, target = corpus()
    out = importance.resample(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame([(str(i), t) for i, t in enumerate(target)], TARGET),
                              percent=percent, least_words=least)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, out.collect()), key=key) == sorted(plain(rows, target, percent, least), key=key)


def test_long_texts_are_cut_into_slices_without_loss(monkeypatch):
    ws = words("a b c d e f g h i j " * 7)
    whole = np.sort(np.concatenate(list(importance.feature_buckets(ws))))
    expected = np.sort([crc32(b" ".join(ws[i:i + n])) % 10000 for n in (1, 2, 3) for i in range(len(ws) - n + 1)])
    for size in (1, 2, 3, 7, 69, 70):
        monkeypatch.setattr(importance, "_SLICE", size)
        assert np.array_equal(np.sort(np.concatenate(list(importance.feature_buckets(ws)))), whole)
    assert np.array_equal(whole, expected)
    assert list(importance.feature_buckets([])) == []


def test_empty_tables(spark):
    empty, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], TARGET)
    assert importance.resample(empty, none).count() == 0
    rows = corpus()[0]
    got = importance.resample(spark.createDataFrame(rows, DOCS), none).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows, []), key=key)


def test_drawn_documents_come_with_their_columns(spark):
    rows, target = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    wanted = spark.createDataFrame([(str(i), t) for i, t in enumerate(target)], TARGET)
    drawn = {r["doc_id"] for r in importance.resample(docs, wanted, percent=30).filter("rank IS NOT NULL").collect()}
    kept = importance.resampled(docs, wanted, percent=30)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in rows if r[0] in drawn), key=str)
