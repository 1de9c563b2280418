"""BagMinHash near-duplicates against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from papertrail.llm import bagminhash as bm
from papertrail.llm.common import words

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("hash", T.StringType()), T.StructField("node", T.LongType())])


def bag(text):
    ws = words(text)
    n = min(5, len(ws))
    return Counter(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)) if ws else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0


def classes(docs):
    bags_, group = [bag(t) for _, t in docs], list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            if similarity(bags_[i], bags_[j]) >= .8:
                group[root(i)] = root(j)
    out = []
    for i in range(len(docs)):
        ids = [docs[j][0] for j in range(len(docs)) if root(j) == root(i)]
        out.append((docs[i][0], min((d for d in ids if d is not None), default=None)))
    return out


def edited(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[rng.randrange(len(ws))] = f"e{rng.randrange(10 ** 6)}"
    return ws


def corpus(seed=1):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 250))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[:25]:
        texts += [" ".join(edited(rng, b, n)) for n in (0, 1, 2, 3, 5, 8)]
    texts += [" ".join(edited(rng, base[0] * 3, 1)) for _ in range(60)]  # a large group of near copies
    texts += [("ab cd " * n).strip() for n in (1, 2, 3, 30, 31, 40, 300)] + [t.upper() + "!" for t in texts[:5]]
    texts += [None, "", "  ", "...", "one", "one", "One!", "x " * 20_000]
    rng.shuffle(texts)
    return [(None if i in (5, 6) else i, t) for i, t in enumerate(texts)]


def test_bags_are_counted_shingles():
    texts = [t for _, t in corpus()]
    owner, value, count = bm.bags(texts)
    for i, t in enumerate(texts):
        own = bag(t)
        assert sorted(count[owner == i].tolist()) == sorted(own.values())
    a, b = bm.bags(["a b c d e f"]), bm.bags(["b c d e f"])
    assert b[1][0] in a[1]


@pytest.mark.parametrize("wx,wy", [((1, 2, 3), (2, 2, 1)), ((5, 1, 0), (1, 1, 9)), ((40, 3, 3), (30, 3, 5)), ((1, 1, 1), (1, 1, 1))])
def test_signatures_estimate_weighted_jaccard(wx, wy):
    hits = trials = 0
    for seed in range(40):
        value = bm._mix(np.arange(3, dtype=np.uint64) + np.uint64(1000 * seed + 7))
        owner = np.repeat([0, 1], 3)
        both, count = np.concatenate([value, value]), np.array([*wx, *wy])
        keep = count > 0
        s = bm.signatures(owner[keep], both[keep], count[keep], 2, 64)
        assert np.isfinite(s).all()
        hits += int((s[0] == s[1]).sum())
        trials += 64
    expected = sum(map(min, wx, wy)) / sum(map(max, wx, wy))
    assert abs(hits / trials - expected) < 4 * max((expected * (1 - expected) / trials) ** .5, 1e-9) + .004


def test_signature_components_are_exponential():
    value = bm._mix(np.arange(500, dtype=np.uint64))
    s = bm.signatures(np.zeros(500, int), value, np.full(500, 2), 1, 256)
    assert abs(s.mean() * 1000 - 1) < .3


def test_groups_match_brute_force(spark):
    docs = corpus()
    out = bm.near_duplicates(spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS)).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id is None, r.component_id or 0) for r in out)
    assert got == sorted((d is None, d or 0, c is None, c or 0) for d, c in classes(docs))
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_chain_across_a_bucket_is_kept_together(spark):
    rng = random.Random(4)
    ws = [f"w{i}" for i in range(200)]
    docs = [(0, " ".join(ws))]
    for i in range(1, 14):
        k = 12 * i
        ws = [*ws[:k % 190], f"new{i}", *ws[k % 190 + 1:]]
        docs.append((i, " ".join(ws)))
    rng.shuffle(docs)
    out = bm.near_duplicates(spark.createDataFrame([(d, t, None, None) for d, t in docs], DOCS)).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == sorted(classes(docs))


def test_two_unlinked_documents_are_compared_once(spark, monkeypatch):
    rng = random.Random(8)
    docs = []
    for i in range(30):
        ws = [f"p{i}w{j}" for j in range(200)]
        docs += [(2 * i, " ".join(ws)), (2 * i + 1, " ".join(edited(rng, ws, 9)))]
    assert all(.5 < similarity(bag(docs[k][1]), bag(docs[k + 1][1])) < .8 for k in range(0, 60, 2))
    compared, compare = [], bm._compare

    def counted(pairs, *rest):
        compared.extend((min(r.a, r.b), max(r.a, r.b)) for r in pairs.select("a", "b").collect())
        return compare(pairs, *rest)
    monkeypatch.setattr(bm, "_compare", counted)
    out = bm.near_duplicates(spark.createDataFrame([(d, t, None, None) for d, t in docs], DOCS)).collect()
    assert all(r.kept for r in out) and len(out) == 60
    assert len(set(compared)) >= 20 and len(compared) == len(set(compared))


def test_one_document_of_each_group_stays(spark):
    docs = corpus(3)
    docs += [(None, "... "), (None, "another text of its own here now"), docs[3], docs[3]]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS)
    kept = bm.without_duplicates(frame)
    assert kept.columns == frame.columns
    rows = kept.collect()
    roots = [r.text for r in rows if bag(r.text)]
    bags_ = [bag(t) for t in roots]
    assert not any(similarity(bags_[i], bags_[j]) >= .8 and bags_[i] == bags_[j] for i in range(len(roots)) for j in range(i))
    smallest = {c for d, c in classes(docs) if c is not None}
    assert smallest <= {r.doc_id for r in rows}
    assert sum(1 for r in rows if not bag(r.text)) == len({(d, t) for d, t in docs if not bag(t)})


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert bm.near_duplicates(empty).count() == 0 and bm.without_duplicates(empty).count() == 0
