"""Hard negatives against all pairs, and the bounds against exact scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papertrail.llm import hard_negatives as hn

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                        T.StructField("position", T.StringType()), T.StructField("score", T.LongType())])


def clustered(n, dims=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    out = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(size=dims) * rng.choice([.1, 1])
        out.append((i, [float(x) for x in np.float32(v * rng.choice([.3, 1, 2]))], int(rng.integers(4)), "clash", 7))
    return out


def odd():
    rows = clustered(160)
    rows += [(200, None, 1, "x", 1), (201, [1.0, None], 1, "x", 1), (250, [float("nan")] * 12, 1, "x", 1), (300, [float("inf")] * 12, 2, "x", 1),
             (350, [0.0] * 12, 2, "x", 1), (400, [0.0] * 12, 2, "x", 1), (450, [], 2, "x", 1), (500, rows[3][1], None, "x", 1),
             (None, rows[4][1], 1, "x", 1), (550, [1.0, 2.0], 1, "x", 1), (600, [2.0, 1.0], 1, "x", 1), (601, [1.5, 1.0], 2, "x", 1),
             (50, rows[50][1], rows[50][2], "x", 1), (51, rows[50][1], rows[50][2], "x", 1), (52, rows[50][1], (rows[50][2] + 1) % 4, "x", 1),
             (650, [-x for x in rows[60][1]], 3, "x", 1), (700, [3e38] * 12, 1, "x", 1)]
    return rows


def plain(rows, positives=5, negatives=3, low=50, high=95):
    valid = []
    for at, (vec_id, e, label, *_) in enumerate(rows):
        if None in (vec_id, e, label) or any(x is None or not math.isfinite(x) for x in e):
            continue
        ints = [math.floor(256 * float(np.float32(x))) for x in e]
        if sum(c * c for c in ints) < 2 ** 62:
            valid.append((vec_id, ints, label, at))
    out = []
    for a in valid:
        if a[0] % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[1], b[1])), b[0], b[3], b[2]) for b in valid if b[3] != a[3] and len(b[1]) == len(a[1]))
        for p in [s for s in scored if s[3] == a[2]][:positives]:
            fit = [s for s in scored if s[3] != a[2] and low * -p[0] <= 100 * -s[0] <= high * -p[0]][:negatives]
            out += [(a[0], p[1], k + 1, s[1], -p[0], -s[0]) for k, s in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block,slices,run", [(1 << 14, 1 << 16, 32), (16, 1, 3), (40, 2, 64)])
def test_rows_match_all_pairs(spark, monkeypatch, block, slices, run):
    for name, value in (("BLOCK", block), ("SLICE", slices), ("RUN", run)):
        monkeypatch.setattr(hn, name, value)
    rows = odd()
    out = hn.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 50 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = plain(rows)
    assert sorted(map(tuple, out.collect())) == expected and len(expected) > 20


def test_empty_tables_and_no_anchors(spark):
    assert hn.hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") % 50 == 0).count() == 0
    assert hn.hard_negatives(spark.createDataFrame(clustered(20), VECTORS), F.lit(False)).count() == 0


def test_bounds_hold_and_exclude(seed=4):
    rng = np.random.default_rng(seed)
    rows = np.floor(256 * np.stack([np.array(r[1]) for r in clustered(400, 8, seed)]))
    rows[7] = rows[3]
    refs = hn.directions([r.tolist() for r in rows[:60]])[8]
    angles, sizes = hn._angles(rows, refs), np.linalg.norm(rows, axis=1)
    left_out = 0
    for a in rng.integers(0, 400, 60):
        lower, upper = hn.score_bounds(angles, angles, sizes, sizes, angles[a], sizes[a])
        exact = rows @ rows[a]
        assert (lower <= exact).all() and (exact <= upper).all()
        left_out += (upper < .5 * sizes[a] ** 2).sum()
    assert left_out > 60 * 400 / 4  # the filter leaves rows out


def test_few_rows_are_scored_in_clustered_data(monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32)) * 4
    ints = np.floor(256 * np.concatenate([c + .2 * rng.normal(size=(50, 32)) for c in centres]))
    refs = hn.directions([r.tolist() for r in ints[::7]])[32]
    angles = hn._angles(ints, refs)
    table = pa.table({"ints": [r.astype("<i8").tobytes() for r in ints], "angles": [a.tobytes() for a in angles], "cell": angles.argmin(axis=1),
                      "label": np.arange(2000) % 3, "vec_id": np.arange(2000), "position": np.arange(2000), "n": [256] * 2000})
    seen = []
    scores = hn.Rows.scores
    monkeypatch.setattr(hn.Rows, "scores", lambda self, i, s, at: seen.append(len(at)) or scores(self, i, s, at))
    hn.best_of_label(table, table.slice(0, 200), 5)
    assert sum(seen) < 200 * 2000 / 10
