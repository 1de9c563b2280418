"""Price lists and mark sheets from words, as-of look-ups and anchored clusters, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papertrail.operators import ledger as L
from papertrail.operators.skew import anchored_starts, first_from

WORDS = T.StructType([T.StructField("case_id", T.LongType()), T.StructField("idx", T.LongType()), T.StructField("text", T.StringType()),
                      T.StructField("conf", T.DoubleType())] + [T.StructField(c, T.LongType()) for c in ("left", "top", "width", "height")])


def page(case, words):
    return [(case, i, text, float(conf), left, top, width, 12) for i, (text, left, top, width, conf) in enumerate(words)]


def invoice(case, lines, subtotal, tax, total, conf=90):
    words = [("TAXINVOICE", 60, 20, 120, conf), ("Qty", 310, 100, 30, conf)]
    for k, (q, r, a) in enumerate(lines):
        words += [(t, x, 140 + 40 * k + k % 3, 40, conf) for t, x in ((q, 320), (r, 450), (a, 600)) if t is not None]
    y = 160 + 40 * len(lines)
    words += [("Subtotal", 450, y, 70, conf), (subtotal, 600, y + 1, 60, conf), ("Tax:", 450, y + 40, 40, conf), (tax, 600, y + 39, 60, conf),
              ("TOTAL", 450, y + 80, 50, conf), (total, 600, y + 80, 60, conf)]
    return page(case, words)


LINES = [("2", "1,500.00", "3000.00"), ("4", "600", "2400"), ("10", "600", "6000")]


def checks(spark, rows, fn):
    return {(r["case_id"], r["name"], r["ord"]): r for r in fn(spark.createDataFrame(rows, WORDS)).collect()}


def test_invoices(spark):
    rows = invoice(1, LINES, "11,400.00", "2052", "₹13452") + invoice(2, LINES, "11400", "2052", "10452.00")
    rows += invoice(3, [("7231", "7487", "256"), ("100", "200", "100"), ("55", "66", "11")], "367", "0", "367")  # a meter, no price list
    rows += invoice(4, [*LINES, ("3", None, "900")], "12300", "1", "12301")  # one row has a gap: no subtotal
    rows += invoice(5, LINES[:2], "5400", "972", "6372")  # too short a list
    rows += page(6, [("12", 320, 100, 30, 90)])  # no labels
    rows += [(7, 0, None, None, None, None, None, None), (7, 1, "total", 90.0, 10, 10, 30, 12)]
    found = checks(spark, rows, L.invoice_checks)
    assert found[2, "grand_total", None]["diff"] == pytest.approx(3000) and not found[2, "grand_total", None]["ok"]
    assert found[2, "grand_total", None]["expected"] == 13452 and found[2, "grand_total", None]["x0"] == 600
    assert (1, "grand_total", None) not in found  # a currency sign makes the figure no plain amount
    assert found[1, "subtotal", None]["ok"] and found[1, "subtotal", None]["expected"] == 11400
    assert sum(k[0] == 1 and k[1] == "line_amount" for k in found) == 3
    assert {k[1] for k in found if k[0] == 3} == {"grand_total"}
    assert {k[1] for k in found if k[0] == 4} == {"grand_total", "line_amount"}
    assert {k[1] for k in found if k[0] == 5} == {"grand_total"}
    assert not [k for k in found if k[0] in (6, 7)]


def test_breaches_weigh_confidence_and_support(spark):
    one = invoice(1, LINES, "11400", "2052", "10452", conf=90)
    two = invoice(2, [("2", "1500", "3000"), ("4", "600", "2400"), ("10", "600", "9000")], "11400", "2052", "10452", conf=90)
    low = invoice(3, LINES, "11400", "2052", "10452", conf=40)
    found = {(r["case_id"], r["name"]): r for r in L.breaches(L.invoice_checks(spark.createDataFrame(one + two + low, WORDS))).collect()}
    assert found[1, "grand_total"]["confidence"] == pytest.approx(.888) and found[1, "grand_total"]["severity"] == "critical"
    assert found[2, "grand_total"]["confidence"] == pytest.approx(.948)
    assert not [k for k in found if k[0] == 3]  # no figure was readable


def sheet(case, marks, total, percentage, maxima=None, conf=90):
    words = [("Subject", 60, 100, 60, conf), ("Marks", 380, 100, 50, conf), ("Maximum", 520, 100, 60, conf)]
    for k, m in enumerate(marks):
        words += [(f"Paper{k}", 60, 130 + 30 * k, 60, conf), (str(m), 385, 131 + 30 * k, 30, conf)]
    words += [("100", 530, 132 + 30 * k, 30, conf) for k in range(len(marks) if maxima is None else maxima)]
    y = 150 + 30 * len(marks)
    words += [("Total", 60, y, 40, conf), (str(total), 385, y, 30, conf), ("Percentage", 60, y + 30, 80, conf), (percentage, 385, y + 30, 40, conf)]
    return page(case, words)


def test_mark_sheets(spark):
    rows = sheet(1, [100, 85, 90, 95, 155], 495, "99") + sheet(2, [100, 80, 60], 240, "80.0%") + sheet(3, [100, 80, 60], 240, "85%")
    rows += sheet(4, [100, 80, 60], 240, "80%", maxima=2) + sheet(5, [100, 80], 180, "90%") + sheet(6, [100, 80, 60, 3], 240, "80", maxima=3, conf=80)
    found = checks(spark, rows, L.sheet_checks)
    assert found[1, "total", None]["diff"] == 30 and not found[1, "total", None]["ok"] and (1, "percentage", None) not in found
    assert found[2, "total", None]["ok"] and found[2, "percentage", None]["ok"]  # a mark of 100 is no maximum
    assert found[3, "total", None]["ok"] and not found[3, "percentage", None]["ok"]
    assert not [k for k in found if k[0] in (4, 5)]
    assert found[6, "total", None]["ok"]  # a hardly readable mark below ten is left out


def test_empty_tables(spark):
    assert L.arithmetic_checks(spark.createDataFrame([], WORDS)).count() == 0


def test_one_long_invoice_is_read_like_a_short_one(spark):
    lines = [(str(1 + k % 9), "50", str(50 * (1 + k % 9))) for k in range(3000)]
    total = sum(int(a) for *_, a in lines)
    found = checks(spark, invoice(1, lines, str(total), "0", str(total)), L.invoice_checks)
    assert len(found) == 3002 and all(r["ok"] for r in found.values())


@pytest.mark.parametrize("beyond", [False, True])
def test_first_from_equals_brute_force(spark, beyond):
    rng = random.Random(4)
    asks = [(rng.choice(["a", "b", "hot"]), rng.randint(-50, 400), i) for i in range(300)] + [("only asks", 3, 1000), (None, 3, 1001)]
    items = [(rng.choice(["a", "hot", "hot", "other"]), rng.randint(-40, 380), rng.randint(0, 99)) for _ in range(200)]
    found = first_from(spark.createDataFrame(asks, "k string, at int, ask int"), spark.createDataFrame(items, "k string, at int, v int"), ["k"], "at",
                       F.struct("at", "v"), width=37, beyond=beyond)
    got = {r["ask"]: r["found"] and tuple(r["found"]) for r in found.collect()}
    for k, at, ask in asks:
        fit = [(x, v) for key, x, v in items if key == k and (x > at if beyond else x >= at)]
        assert got[ask] == min(fit, default=None), (k, at)
    assert len(got) == len(asks)


@pytest.mark.parametrize("most", [None, 1, 3])
def test_anchored_starts_equal_the_greedy_scan(spark, most):
    rng = random.Random(7)
    rows = [(key, float(rng.randint(0, 2000)) / 2) for key in ("a", "b") for _ in range(400)] + [("c", 5.0), ("d", 10.0), ("d", 30.0), ("d", 50.0), ("d", 90.0)]
    out = anchored_starts(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", 34.0, width=100, most=most).collect()
    for key in {k for k, _ in rows}:
        starts = []
        for x in sorted(x for k, x in rows if k == key):
            if not starts or x - starts[-1] > 34:
                starts.append(x)
        assert [s for _, s in sorted((r["ordinal"], r["start"]) for r in out if r["k"] == key)] == starts[:most]


def test_ordinary_and_crowded_pages_have_the_same_checks(spark):
    rng = random.Random(11)
    rows = []
    for case in range(1, 60):
        lines = [(str(rng.randint(1, 9)), "50", str(rng.choice([50, 100, 150, 200, 400]))) for _ in range(rng.randint(1, 6))]
        lines = [tuple(None if rng.random() < .04 else t for t in line) for line in lines]
        total = sum(int(a or 0) for *_, a in lines)
        made = invoice(case, lines, rng.choice([str(total), f"{total}.00", "x"]), "0", str(total + rng.choice([0, 0, 700]))) if case % 3 else \
            sheet(case, marks := [rng.choice([9, 40, 80, 100]) for _ in range(rng.randint(2, 5))], sum(marks), f"{sum(marks) / len(marks):.1f}%")
        for w in made:
            w = list(w)
            for i in (1, 3, 4, 5, 6, 7):  # some values are missing, some places and sizes are odd
                if rng.random() < .01:
                    w[i] = None
            if rng.random() < .05 and w[4] is not None:
                w[4] += rng.randint(-40, 40)
            if rng.random() < .05:
                w[3] = float(rng.randint(0, 99))
            if rng.random() < .02:
                w[7] = 0
            rows.append(tuple(w))
    rows += rows[:60] + [(None, *w[1:]) for w in rows[:30]]  # rows that come twice, pages of no case
    words = spark.createDataFrame(rows, WORDS).withColumns({c: F.col(c).cast("int") for c in ("left", "top")})
    for read in (L.invoice_checks, L.sheet_checks, L.arithmetic_checks):
        plain, crowded = read(words), read(words, crowd=0)
        assert plain.dtypes == crowded.dtypes
        found = sorted(map(repr, plain.collect()))
        assert len(found) > 20 and found == sorted(map(repr, crowded.collect()))


def test_pages_that_lie_by_case_are_read_without_a_move(spark):
    words = spark.createDataFrame(invoice(1, LINES, "11400", "2052", "13452"), WORDS).repartition(4, "case_id")
    plan = L.arithmetic_checks(words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "checkpoint" not in plan and "ExistingRDD" in plan
