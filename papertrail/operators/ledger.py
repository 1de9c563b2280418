"""Price lists and mark sheets read off a page's words, and the checks on them.

A price list is what stands above the totals in the right part of the page: numeric words fall into rows (chained by
height) and, from the first row with three columns on, into the three columns that this row opens. A mark sheet is the
numbers under its header. The words of a page are read where they lie, many pages at a time
(``arrow.checks_of``). Words of pages that no task takes whole are not gathered: rows are chained across buckets,
columns follow successor links, values beside labels are as-of look-ups, and both end as the plain tables that
``reconcile`` judges.

Checks are rows as in ``reconcile``, with the box (x0, y0, x1, y1) of the figure that a breach points to.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.functions import scalars as S
from papertrail.functions.arrow import CHECK_FIELDS, CHECKS, LABEL_BITS, checks_of, mark_sheets, price_lists
from papertrail.operators import reconcile as R
from papertrail.operators.skew import CROWD, anchored_starts, gap_clusters
from papertrail.operators.words import pixels, read_pages, values_beside
from papertrail.session import materialise

#: Names of totals, and whether the first word so named counts (in page order) or the bottom-most.
INVOICE_LABELS = {"subtotal": "first", "tax": "first", "total": "last"}
SHEET_LABELS = {"marks": "last", "total": "last", "percentage": "first"}
CHECK = ["case_id", "ord", "name", "ok", "strong", "expected", "actual", "diff", "base", "min_conf", "x0", "y0", "x1", "y1"]
BOX = ["x0", "y0", "x1", "y1"]


def _box(word: str) -> Column:
    left, top = F.col(f"{word}.left"), F.col(f"{word}.top")
    return F.struct(left.alias("x0"), top.alias("y0"), (left + F.col(f"{word}.width")).alias("x1"), (top + F.col(f"{word}.height")).alias("y1"))


def labels_of(words: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """One row per case that has any of the labels, one column per label: the word (NULL if there is none)."""
    word = F.struct("idx", "text", "left", "top", "width", "height")
    hit = {name: S.label_match(F.col("text"), [name]) for name in wanted}
    picks = []
    for name, which in wanted.items():
        order = F.col("idx") if which == "first" else F.struct(-F.col("top"), -F.col("left"), "idx")
        picks.append(F.min_by(word, F.when(hit[name], order)).alias(name))
    any_hit = F.lit(False)
    for condition in hit.values():
        any_hit = any_hit | condition
    return words.filter(any_hit).groupBy("case_id").agg(*picks)


def printed_totals(words: DataFrame, labels: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """``labels`` with the figure beside each of them: ``<name>_value`` (value, conf, left, top, width, height)."""
    anchors = labels.select("case_id", F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("w")) for n in wanted])).alias("l"))
    anchors = anchors.filter("l.w IS NOT NULL AND l.w.height > 0").select("case_id", "l.label", F.col("l.w.idx").alias("label_idx"),
                                                                         "l.w.left", "l.w.top", "l.w.width", "l.w.height")
    value = F.struct(S.parse_number(F.col("v.text")).alias("value"), "v.conf", "v.left", "v.top", "v.width", "v.height")
    found = values_beside(words, anchors).select("case_id", "label", value.alias("value"))
    beside = found.groupBy("case_id").agg(*[F.max(F.when(F.col("label") == n, F.col("value"))).alias(f"{n}_value") for n in wanted])
    return labels.join(beside, "case_id", "left")


def price_rows(words: DataFrame, totals: DataFrame, from_left: int = 300, row_gap: float = 18, column_gap: float = 34, span: float = 55,
               least_rows: int = 3) -> DataFrame:
    """Rows of each case's price list: case_id, ord, the words ``qty``, ``rate``, ``amount`` (NULL where a cell is empty) and
    ``rows``, ``complete``: how many rows the list has, and how many of them have all cells. Lists of fewer than
    ``least_rows`` rows are left out."""
    bottom = totals.select("case_id", (F.coalesce("subtotal.top", "total.top") - 12).alias("bottom")).filter("bottom IS NOT NULL")
    figures = words.filter(S.parse_number(F.col("text")).isNotNull() & (F.col("left") >= from_left)).join(bottom, "case_id").filter("top < bottom")
    figures = figures.select("case_id", "idx", "text", "conf", "left", "top", "width", "height", (F.col("left") + F.col("width") / 2).alias("centre"))
    banked = materialise(gap_clusters(figures, ["case_id"], "top", row_gap, width=1024, out="bank"))
    starts = anchored_starts(banked, ["case_id", "bank"], "centre", column_gap, width=512, most=3)
    columns = starts.groupBy("case_id", "bank").agg(*[F.max(F.when(F.col("ordinal") == i, F.col("start"))).alias(f"c{i}") for i in range(3)])
    first = columns.filter("c2 IS NOT NULL").groupBy("case_id").agg(F.min_by(F.struct("bank", "c0", "c1", "c2"), "bank").alias("first"))
    inside = banked.join(first, "case_id").filter("bank >= first.bank")
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col("centre") - F.col(f"first.c{i}")).alias("d"), F.lit(i).alias("i")) for i in range(3)]))
    placed = inside.withColumn("near", nearest)
    word = F.struct("text", "conf", "left", "top", "width", "height")
    cells = [F.min_by(word, F.when((F.col("near.d") <= span) & (F.col("near.i") == i), F.struct("top", "left", "idx"))).alias(n)
             for i, n in enumerate(("qty", "rate", "amount"))]
    rows = materialise(placed.groupBy("case_id", "bank").agg(*cells))
    whole = F.col("qty").isNotNull() & F.col("rate").isNotNull() & F.col("amount").isNotNull()
    sizes = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(whole).alias("complete")).filter(F.col("rows") >= least_rows)
    return rows.join(sizes, "case_id").withColumnRenamed("bank", "ord")


def entry() -> tuple[Column | str, ...]:
    """What is read of each word (see ``arrow.checks_of``)."""
    text, number = F.col("text"), S.parse_number(F.col("text"))
    bits = [F.when(S.label_match(text, [name]), bit).otherwise(0) for name, bit in LABEL_BITS.items()]
    labels = bits[0]
    for bit in bits[1:]:
        labels = labels + bit
    return ("idx", "left", "top", "width", "height", "conf", number.alias("number"),
            F.when(S.is_amount(text), text).alias("amount"), labels.alias("labels"))


def check_rows(found: DataFrame, words: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Checks that were read off pages, judged; boxes in the types of the words' boxes. Columns ``keep`` stay beside them."""
    line, share = (F.col("kind") == CHECKS.index(n) for n in ("line_amount", "percentage"))
    known = F.col("kind").isNotNull()  # rows of other readers have no check
    expected = F.when(share, S.fix("expected", 1)).otherwise(F.col("expected"))
    diff = F.abs(expected - F.col("actual"))
    shown = found.select(
        "case_id", F.col("ord").cast("long").alias("ord"), F.when(known, F.get(F.array(*[F.lit(n) for n in CHECKS]), F.col("kind").cast("int"))).alias("name"),
        (diff <= F.col("tolerance")).alias("ok"), F.when(line, diff > 0.8 * F.col("actual")).when(known, True).alias("strong"), S.fix(expected, 2).alias("expected"),
        "actual", diff.alias("diff"), F.when(line, R.ROW_BASE).when(known, R.SUM_BASE).alias("base"), "min_conf", *BOX, *keep)
    return pixels(shown, words, tuple(BOX))


def _read(words: DataFrame, crowd: int, crowded_checks, *readers) -> DataFrame:
    pages, crowded = read_pages(words, entry(), [checks_of(*readers)], CHECK_FIELDS, crowd)
    found = check_rows(pages, words)
    return found if crowded is None else found.unionByName(crowded_checks(crowded))


def invoice_checks(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """All checks of the price lists: every line, the subtotal over the lines of a list without gaps, the grand total.

    A case whose lines never satisfy quantity x rate = amount has no price list, so neither its lines nor its subtotal are judged. Words
    without a number, height or label do nothing; a case without totals has no row; equal words count once each. Pages of more than
    ``crowd`` words are read by all tasks.
    """
    return _read(words, crowd, _crowded_invoices, price_lists)


def _crowded_invoices(words: DataFrame) -> DataFrame:
    totals = materialise(printed_totals(words, labels_of(words, INVOICE_LABELS), INVOICE_LABELS))
    rows = price_rows(words, totals).filter("qty IS NOT NULL AND rate IS NOT NULL AND amount IS NOT NULL")
    lines = materialise(rows.select("case_id", "ord", "rows", "complete", *[x for n in ("qty", "rate", "amount") for x in (
        S.parse_number(F.col(f"{n}.text")).alias(n), F.col(f"{n}.conf").alias(f"{n}_conf"))], _box("amount").alias("box")))
    each = R.line_checks(lines, ["box"])
    figures = totals.select("case_id", *[x for n in INVOICE_LABELS for x in (
        F.col(f"{n}_value.value").alias(n), F.col(f"{n}_value.conf").alias(f"{n}_conf"))])
    sums = R.total_checks(lines.filter("rows = complete"), figures)
    # Only a figure for all three makes the grand total a check.
    boxes = totals.filter("subtotal_value IS NOT NULL OR total_value IS NOT NULL").select(
        "case_id", _box("subtotal_value").alias("subtotal_box"), _box("total_value").alias("total_box"))
    sums = sums.join(boxes, "case_id").withColumn("box", F.when(F.col("name") == "subtotal", F.col("subtotal_box")).otherwise(F.col("total_box")))
    both = each.unionByName(sums.drop("subtotal_box", "total_box"), allowMissingColumns=True)
    return both.select("*", "box.*").select(*CHECK)


def sheet_checks(words: DataFrame, reach: float = 40, least_rows: int = 3, crowd: int = CROWD) -> DataFrame:
    """All checks of the mark sheets: the sum of the marks, and their mean if the sum holds.

    Marks are the numbers under the bottom-most header ``marks`` (centres at most ``reach`` apart) down to the total; beside them every row has
    a maximum of 100, so as many of these must stand outside the column. Marks below ten that were hardly readable are left out. Pages as in
    ``invoice_checks``.
    """
    return _read(words, crowd, lambda rows: _crowded_sheets(rows, reach, least_rows), partial(mark_sheets, reach=reach, least_rows=least_rows))


def _crowded_sheets(words: DataFrame, reach: float, least_rows: int) -> DataFrame:
    totals = materialise(printed_totals(words, labels_of(words, SHEET_LABELS), SHEET_LABELS).filter(
        "marks IS NOT NULL AND total_value IS NOT NULL"))
    frame = totals.select("case_id", (F.col("marks.left") + F.col("marks.width") / 2).alias("middle"), (F.col("marks.top") + 14).alias("above"),
                          (F.col("total.top") - 4).alias("below"))
    number = S.parse_number(F.col("text"))
    inside = words.filter(number.isNotNull()).join(frame, "case_id").filter("top > above AND top < below")
    under = F.abs(F.col("left") + F.col("width") / 2 - F.col("middle")) <= reach
    marks = inside.select("case_id", F.when(under, number).alias("mark"), F.when(under, F.col("conf")).alias("conf"),
                          F.when(~under, number).alias("max_mark"))
    figures = totals.select("case_id", F.col("total_value.value").alias("total"), F.col("total_value.conf").alias("total_conf"),
                            F.col("percentage_value.value").alias("percentage"), F.col("percentage_value.conf").alias("percentage_conf"))
    boxes = totals.select("case_id", _box("total_value").alias("total_box"), _box("percentage_value").alias("percentage_box"))
    checks = R.sheet_checks(marks, figures, least_rows).join(boxes, "case_id").withColumn(
        "box", F.when(F.col("name") == "total", F.col("total_box")).otherwise(F.col("percentage_box")))
    return checks.select("*", F.lit(None).cast("long").alias("ord"), "box.*").select(*CHECK)


def crowded_checks(words: DataFrame) -> DataFrame:
    """Checks of both kinds of pages that no task takes whole."""
    return _crowded_invoices(words).unionByName(_crowded_sheets(words, 40, 3))


def arithmetic_checks(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Checks of both kinds."""
    return _read(words, crowd, crowded_checks, price_lists, mark_sheets)


def breaches(checks: DataFrame) -> DataFrame:
    """One finding per breached identity that rests on at least one readable figure: case_id, ord, name, code, severity, confidence, expected,
    actual, diff and box. Several breaches of a case support each other."""
    failed = checks.filter(~F.col("ok") & F.col("strong") & F.col("min_conf").isNotNull())
    several = checks.filter(~F.col("ok") & F.col("strong")).groupBy("case_id").agg((F.count(F.lit(1)) > 1).alias("several"))
    weighed = F.col("base") * (0.65 + 0.35 * F.col("min_conf") / 100)
    confidence = S.fix(S.clip(F.when(F.col("several"), F.least(F.lit(0.97), weighed + 0.06)).otherwise(weighed), 0, 0.97), 3)
    return failed.join(several, "case_id").withColumn("confidence", confidence).select(
        "case_id", "ord", "name", F.lit("SEM-ARITH").alias("code"), S.severity_band(F.col("confidence")).alias("severity"), "confidence", "expected",
        "actual", "diff", *BOX)
