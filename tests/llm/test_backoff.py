"""Stupid-backoff scores against plain counting."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from papertrail.llm import backoff
from papertrail.llm.common import words

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.StringType()),
                     T.StructField("chunk", T.LongType())])


def corpus():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "the", "of"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60))) for _ in range(60)]
    texts += [None, "", "...", "of the of the", "of the of the", "lonely", "of the " * 4000]
    rows = [(i if i % 13 else None, t, "clash", 3) for i, t in enumerate(texts)]
    return rows + [rows[4], rows[4], rows[61]]


def plain(rows, order, least, alpha):
    docs = [words(t) for _, t, *_ in rows]
    counts = [Counter(tuple(d[i:i + n]) for d in docs for i in range(len(d) - n + 1)) for n in range(1, order + 1)]
    total = sum(counts[0].values())

    def rated(d, i):
        given_up = 0
        for n in range(min(order, i + 1), 1, -1):
            gram = tuple(d[i - n + 1:i + 1])
            if counts[n - 1][gram] >= least:
                return given_up * math.log10(alpha) + math.log10(counts[n - 1][gram] / counts[n - 2][gram[:-1]]), 1
            given_up += 1
        return given_up * math.log10(alpha) + math.log10(counts[0][(d[i],)] / total), 0

    out = []
    for (doc_id, *_), d in zip(rows, docs):
        rates = [rated(d, i) for i in range(len(d))]
        out.append((doc_id, len(d), sum(f for _, f in rates), sum(s for s, _ in rates) / len(d) if d else None))
    return out


def agree(got, expected):
    def order(row):
        return row[0] is None, row[0] or 0, row[1], row[2]
    got, expected = sorted(map(tuple, got), key=order), sorted(expected, key=order)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert all((g[3] is None) == (e[3] is None) and (g[3] is None or abs(g[3] - e[3]) < 2e-6) for g, e in zip(got, expected))


@pytest.mark.parametrize("order,least", [(1, 2), (2, 2), (2, 1), (3, 2), (4, 1)])
def test_scores_match_plain_counting(spark, order, least):
    rows = corpus()
    agree(backoff.backoff_scores(spark.createDataFrame(rows, DOCS), order=order, least=least).collect(), plain(rows, order, least, .4))


def test_empty_table(spark):
    assert backoff.backoff_scores(spark.createDataFrame([], DOCS)).count() == 0


def test_chunks_and_ranges_do_not_change_the_scores(spark, monkeypatch):
    rows = corpus()
    whole = sorted(map(str, backoff.backoff_scores(spark.createDataFrame(rows, DOCS)).collect()))
    monkeypatch.setattr(backoff, "CHUNK_WORDS", 100)
    monkeypatch.setattr(backoff, "RANGE_GRAMS", 50)
    assert whole == sorted(map(str, backoff.backoff_scores(spark.createDataFrame(rows, DOCS).repartition(3)).collect()))


def test_every_word_is_known(spark):
    rows = [(i, " ".join(f"r{i}x{k}" for k in range(1000)) + " of the", "clash", 3) for i in range(70)] + [(70, "lonely", "clash", 3)]
    agree(backoff.backoff_scores(spark.createDataFrame(rows, DOCS)).collect(), plain(rows, 2, backoff.LEAST, backoff.BACKOFF))


@pytest.mark.parametrize("values", [[], [0], [255, 256, 0], [2 ** 64 - 1, 1]])
def test_integers_are_packed_whole(values):
    assert backoff.unpacked(backoff.packed(np.array(values, np.uint64))).tolist() == values
