"""Search by bit distance against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from papertrail.operators import fingerprints as FP


def signed(code):
    return code - (1 << 64) if code >= 1 << 63 else code


def prints():
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1, 1 << 63]
    out = list(base)
    for code in base:
        for _ in range(3):
            near = code
            for bit in rng.sample(range(64), rng.randint(1, 10)):
                near ^= 1 << bit
            out.append(near)
    crowd = rng.getrandbits(16)  # many share a band, few are near
    out += [crowd | rng.getrandbits(48) << 16 for _ in range(120)]
    return [(i, signed(c)) for i, c in enumerate(out + out[:5])] + [(9999, None)]


@pytest.mark.parametrize("limit,crowd", [(8, FP.CROWD), (8, 10), (8, 0), (3, 5), (0, 0)])
def test_all_pairs_within_the_limit_are_found(spark, limit, crowd):
    rows = prints()
    codes = sorted({c for _, c in rows if c is not None})
    expected = {(a, b, bits) for k, a in enumerate(codes) for b in codes[k + 1:] if (bits := ((a ^ b) & (1 << 64) - 1).bit_count()) <= limit}
    found = FP.neighbours(spark.createDataFrame(rows, "id long, fingerprint long"), limit, crowd).collect()
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_copies_are_counted_once(spark):
    rows = [(1, 5), (2, 5), (3, 7), (4, None)]
    found = FP.near_copies(spark.createDataFrame(rows, "id long, fingerprint long")).collect()
    assert [r.asDict() for r in found] == [{"a": 5, "b": 7, "bits": 1, "n_a": 2, "n_b": 1, "id_a": 1, "id_b": 3}]


def test_ids_of_any_type_stay(spark):
    rows = [("x", 5), (None, 7), ("y", -1), ("z", -2)]
    found = FP.near_copies(spark.createDataFrame(rows, "id string, fingerprint long")).collect()
    assert sorted((r.a, r.b, r.id_a, r.id_b) for r in found if r.bits == 1) == [(-2, -1, "z", "y"), (5, 7, "x", None)]


def test_pairs_found_do_not_move_again(spark):
    found = FP.near_copies(spark.createDataFrame(prints(), "id long, fingerprint long"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    after = plan[:plan.index("MapInArrow")]
    assert "Exchange" not in after and "Join" not in after and "Aggregate" not in after


def test_hexadecimal_digits(spark):
    digits = ["0000000000000000", "ffffffffffffffff", "8000000000000001", "0123456789abcdef"]
    frame = spark.createDataFrame([(d,) for d in digits], "d string")
    assert [r[0] for r in frame.select(FP.to_hex(FP.from_hex(F.col("d")))).collect()] == digits
    assert [r[0] for r in frame.select(FP.from_hex(F.col("d"))).collect()] == [signed(int(d, 16)) for d in digits]


def test_empty_table(spark):
    assert FP.near_copies(spark.createDataFrame([], "id long, fingerprint long")).count() == 0
