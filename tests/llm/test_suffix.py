"""Suffix-array decontamination against plain scans."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from papertrail.llm import suffix

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("n_words", T.StringType()), T.StructField("lang", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()),
                      T.StructField("doc_id", T.LongType())])


def plain_words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def corpus(seed=4):
    rng = random.Random(seed)
    letters = ["a", "B", "c", "Éa", "e9"]
    text = lambda n: " ".join(rng.choice(letters) + rng.choice(["", ",", "!"]) for _ in range(n))
    items = [(i, text(n), 0) for i, n in enumerate([3, 5, 13, 14, 20, 30, 12])] + [(7, None, 0), (8, "", 0), (8, " . ", 0), (9, "b b b", 0), (9, "b b b", 0)]
    docs = [(i, text(rng.randint(0, 80)), "clash", "en") for i in range(60)]
    for k, (_, t, _) in enumerate(items[:7]):
        docs.append((100 + k, text(20) + " " + t + " " + text(300), None, None))
        docs.append((None, t.upper(), "x", None))
    docs += [(200, None, "x", "y"), (201, "", "x", "y"), (202, "... !!", "x", "y"), (5, docs[5][1], "clash", "en"), (203, text(3000), "x", "y")]
    return docs, items


def plain(docs, items, window=13):
    out = []
    for doc_id, text, *_ in docs:
        ws, hit, names = plain_words(text), set(), set()
        for item, it, _ in items:
            iw = plain_words(it)
            length = min(window, len(iw))
            for at in range(len(iw) - length + 1) if iw else []:
                for p in range(len(ws) - length + 1):
                    if ws[p:p + length] == iw[at:at + length]:
                        hit.update(range(p, p + length))
                        names.add(str(item))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(ws), len(hit), len(names), digest, len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize("shard,block", [(1 << 19, 4 << 20), (50, 40)])
def test_report_matches_a_plain_scan(spark, monkeypatch, shard, block):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", block)
    docs, items = corpus()
    got = suffix.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert got.columns == ["doc_id", "text", "lang", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()]
    assert sorted(rows, key=key) == sorted(plain(docs, items), key=key)


def test_small_shards_give_the_same_hits():
    docs, items = corpus(9)
    own = [(str(i), suffix.words(t)) for i, t, _ in items if suffix.words(t)]
    block = suffix.Benchmark(own)
    shard = suffix.Shard()
    for d in docs:
        shard.add(d[0], suffix.words(d[1]))
    text = shard.coded(block.vocabulary)
    hit = np.zeros(shard.size, bool)
    for length, _, at in suffix._occurrences(text, block):
        for step in range(length):
            hit[at + step] = True
    assert np.add.reduceat(hit, shard.starts, dtype=int).tolist() == [r[2] for r in plain(docs, items)]


def test_longest_matches_are_maximal(spark):
    docs, items = corpus(6)
    found = suffix.longest_matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    expected = []
    for doc_id, text, *_ in docs:
        ws = plain_words(text)
        for item, it, _ in items:
            iw = plain_words(it)
            least = min(13, len(iw))
            for p in range(len(ws)):
                for q in range(len(iw)):
                    if ws[p] == iw[q] and not (p and q and ws[p - 1] == iw[q - 1]):
                        n = 0
                        while p + n < len(ws) and q + n < len(iw) and ws[p + n] == iw[q + n]:
                            n += 1
                        if n >= least:
                            expected.append((doc_id, p, str(item), q, n))
    assert sorted(map(key, ((r.doc_id, r.doc_start, r.item_id, r.item_start, r.length) for r in found))) == sorted(map(key, expected))


def test_decontaminate_keeps_columns_and_clean_rows(spark):
    docs, items = corpus()
    got = suffix.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert got.columns == ["doc_id", "text", "n_words", "lang"]
    clean = [d for d, r in zip(docs, plain(docs, items)) if not r[5]]
    assert sorted(map(key, got.collect())) == sorted(map(key, clean))


def test_empty_tables(spark):
    docs, items = corpus()
    none = suffix.contamination(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS))
    assert none.count() == 0
    clean = suffix.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS))
    assert clean.filter("contaminated or n_hit > 0").count() == 0 and clean.count() == len(docs)
