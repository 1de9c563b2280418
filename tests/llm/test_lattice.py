"""Lattice hashing against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from papertrail.llm import lattice

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType()), T.StructField("node", T.StringType())])


def test_roots_are_the_shortest_vectors():
    assert lattice.ROOTS.shape == (240, 8) and len(np.unique(lattice.ROOTS, axis=0)) == 240
    assert (np.abs((lattice.ROOTS ** 2).sum(axis=1) - 2) < 1e-12).all()
    assert (np.abs(lattice.decode(lattice.ROOTS) - lattice.ROOTS) < 1e-12).all()


def test_decoding_gives_the_nearest_point():
    x = np.random.default_rng(1).uniform(-2, 2, (500, 8))
    near = lattice.decode(x)
    assert (np.abs((2 * near) % 1) < 1e-12).all()
    steps = np.concatenate([lattice.ROOTS, np.zeros((1, 8))])
    best = (((x - near)[:, None] - steps[None]) ** 2).sum(axis=2).min(axis=1)
    assert (((x - near) ** 2).sum(axis=1) <= best + 1e-12).all()


@pytest.mark.parametrize("cosine,least", [(.95, .995), (.96, .998), (.99, .9999)])
def test_pairs_meet(cosine, least):
    rng = np.random.default_rng(3)
    u = rng.normal(size=(4000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    v = cosine * u + (1 - cosine ** 2) ** .5 * w / np.linalg.norm(w, axis=1, keepdims=True)
    a, b = lattice.cells(u), lattice.cells(v)
    met = ((a[:, :, :1] == b) | (b[:, :, :1] == a)).any(axis=(1, 2))
    assert met.mean() >= least


def corpus(seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 16))
    rows = []
    for b in base:
        rows += [b + rng.normal(size=16) * s for s in (0, .1, .2, .25, .3)]
    rows += [base[0] + rng.normal(size=16) * .05 for _ in range(150)]  # a crowded cell
    rows += [base[1]] * 20 + [base[1] * 7, base[1] * 1e-30, base[2] * 1e30, -base[2]]
    rows = [np.asarray(r, np.float32).tolist() for r in rows]
    rows += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]]
    random.Random(seed).shuffle(rows)
    return rows


def plain(rows):
    n = len(rows)
    ok = [r is not None and len(r) > 0 and all(x is not None and np.isfinite(x) for x in r) and any(r) for r in rows]
    unit = [np.array(r, float) / np.linalg.norm(np.array(r, float)) if good else None for r, good in zip(rows, ok)]
    links, group = [0] * n, list(range(n))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i, j in itertools.combinations(range(n), 2):
        if ok[i] and ok[j] and len(rows[i]) == len(rows[j]) and unit[i] @ unit[j] >= .95:
            links[i] += 1
            links[j] += 1
            a, b = sorted((root(i), root(j)))
            group[b] = a
    return [(i, links[i], root(i), root(i) == i) for i in range(n)]


@pytest.mark.parametrize("block", [2048, 40])
def test_links_and_groups_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    rows = corpus()
    out = lattice.near_vectors(spark.createDataFrame([(i, r, 1, "x") for i, r in enumerate(rows)], VECTORS))
    assert sorted(map(tuple, out.collect())) == plain(rows)


def test_more_lattices_keep_exactness(spark):
    rows = corpus(5)
    out = lattice.near_vectors(spark.createDataFrame([(i, r, 1, "x") for i, r in enumerate(rows)], VECTORS), lattices=2, scale=2.0, tables=10, probes=8)
    assert sorted(map(tuple, out.collect())) == plain(rows)


def test_null_and_repeated_ids(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    out = lattice.near_vectors(spark.createDataFrame([(None, x, 1, ""), (3, x, 1, ""), (3, x, 1, ""), (None, y, 1, ""), (None, None, 1, "")], VECTORS)).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [
        (None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (None, 0, None, True), (None, 0, None, True)]))
    assert lattice.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
