"""Arithmetic identities a document must satisfy: invoices and mark sheets.

Every check is a row (case_id, name, ok, strong, expected, actual, diff, base,
min_conf); ``min_conf`` is the lowest confidence of the tokens involved that is
at least 50. Sums and minima combine map-side, so one huge invoice is no problem.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.functions import scalars as S

SUM_BASE, ROW_BASE, TOKEN_FLOOR = 0.92, 0.45, 50


def _trusted(conf: Column) -> Column:
    return F.when(conf >= TOKEN_FLOOR, conf)


def _check(name: str, ok: Column, expected: Column, actual: Column, base: float, strong: Column, min_conf: Column):
    return [F.lit(name).alias("name"), ok.alias("ok"), strong.alias("strong"), S.fix(expected, 2).alias("expected"),
            actual.alias("actual"), F.abs(expected - actual).alias("diff"), F.lit(base).alias("base"),
            min_conf.cast("double").alias("min_conf")]


def line_checks(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """qty x rate = amount per line. The whole block of a case is dropped unless at
    least one of its lines reconciles: only then is the table a price list. Columns
    ``keep`` of the lines stay beside the check."""
    expected = F.col("qty") * F.col("rate")
    diff = F.abs(expected - F.col("amount"))
    ok = diff <= F.greatest(F.lit(2.0), 0.05 * expected)
    read = lines.filter((F.least("qty_conf", "rate_conf", "amount_conf") >= 60) & (expected > 0))
    checks = read.select("case_id", "ord", *keep, *_check(
        "line_amount", ok, expected, F.col("amount"), ROW_BASE, diff > 0.8 * F.col("amount"),
        F.least("qty_conf", "rate_conf", "amount_conf")))
    tables = checks.groupBy("case_id").agg(F.max("ok").alias("any_ok")).filter("any_ok").select("case_id")
    return checks.join(tables, "case_id", "left_semi")


def total_checks(lines: DataFrame, totals: DataFrame, min_rows: int = 3) -> DataFrame:
    """Grand total = subtotal + tax; subtotal = sum of line amounts."""
    grand = F.col("subtotal") + F.col("tax")
    grand_total = totals.filter(F.col("total").isNotNull() & grand.isNotNull()).select("case_id", *_check(
        "grand_total", F.abs(grand - F.col("total")) <= F.greatest(F.lit(2.0), 0.01 * grand), grand, F.col("total"),
        SUM_BASE, F.lit(True), F.least(_trusted(F.col("subtotal_conf")), _trusted(F.col("tax_conf")),
                                       _trusted(F.col("total_conf")))))
    tables = line_checks(lines).select("case_id").distinct()
    sums = lines.groupBy("case_id").agg(F.sum("amount").alias("line_sum"), F.count(F.lit(1)).alias("rows"),
                                        F.min(_trusted(F.col("amount_conf"))).alias("line_conf"))
    block = sums.filter(F.col("rows") >= min_rows).join(tables, "case_id", "left_semi").join(totals, "case_id")
    tolerance = F.greatest(F.lit(2.0), 0.01 * F.col("subtotal"))
    subtotal = block.filter(F.col("subtotal").isNotNull()).select("case_id", *_check(
        "subtotal", F.abs(F.col("line_sum") - F.col("subtotal")) <= tolerance, F.col("line_sum"), F.col("subtotal"),
        SUM_BASE, F.lit(True), F.least("line_conf", _trusted(F.col("subtotal_conf")))))
    return grand_total.unionByName(subtotal)


def sheet_checks(marks: DataFrame, totals: DataFrame, min_rows: int = 3) -> DataFrame:
    """Mark sheet: total = sum of marks; percentage = mean, judged only if the total holds.
    The number of marks must equal the number of maximum-mark tokens beside them."""
    kept = ~((F.col("mark") < 10) & (F.col("conf") < 85))
    sums = marks.groupBy("case_id").agg(
        F.sum(F.when(kept, F.col("mark"))).cast("double").alias("mark_sum"), F.count_if(kept).alias("n"),
        F.count_if(F.col("max_mark") == 100).alias("maxima"), F.min(F.when(kept, _trusted(F.col("conf")))).alias("low"))
    sound = sums.filter((F.col("n") >= min_rows) & (F.col("n") == F.col("maxima"))).join(totals, "case_id")
    holds = F.abs(F.col("mark_sum") - F.col("total")) <= F.greatest(F.lit(2.5), 0.015 * F.col("total"))
    total = sound.select("case_id", *_check("total", holds, F.col("mark_sum"), F.col("total"), SUM_BASE, F.lit(True),
                                            F.least("low", _trusted(F.col("total_conf")))))
    mean = S.fix(F.col("mark_sum") / F.col("n"), 1)
    percentage = sound.filter(holds & F.col("percentage").isNotNull()).select("case_id", *_check(
        "percentage", F.abs(mean - F.col("percentage")) <= 0.5, mean, F.col("percentage"), SUM_BASE, F.lit(True),
        F.least("low", _trusted(F.col("percentage_conf" if "percentage_conf" in totals.columns else "total_conf")))))
    return total.unionByName(percentage)


def semantic_layer(checks: DataFrame) -> DataFrame:
    """Score of the breached identities of a case."""
    failed = ~F.col("ok") & F.col("strong")
    by_case = checks.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(failed).alias("breaches"),
        F.max(F.when(failed & F.col("min_conf").isNotNull(), F.col("base") * (0.65 + 0.35 * F.col("min_conf") / 100)))
        .alias("strongest"))
    lifted = F.when(F.col("breaches") > 1, F.least(F.lit(0.97), F.col("strongest") + 0.06)).otherwise(F.col("strongest"))
    confidence = S.fix(S.clip(F.coalesce(lifted, F.lit(0.0)), 0, 0.97), 3)
    return by_case.select(
        "case_id", "checks", "breaches", F.least(F.lit(0.95), confidence).alias("score"),
        F.when(F.col("breaches") > 0, F.greatest(F.lit(0.5), confidence)).otherwise(0.0).alias("confidence"))


def recompute_tax(lines: DataFrame, declared: DataFrame, rate: float = 0.18) -> DataFrame:
    """Declared totals and tax against recomputation from the lines."""
    sums = lines.groupBy("case_id").agg(S.fix(F.sum(F.col("qty") * F.col("rate")), 2).alias("computed"))
    delta = S.fix(F.col("declared_total") - F.col("computed"), 2)
    tax = S.fix(F.col("computed") * rate, 2)
    share = F.abs(delta) / F.greatest(F.lit(1.0), F.col("computed"))
    return sums.join(declared, "case_id").select(
        "case_id", "computed", delta.alias("delta"), tax.alias("tax_expected"),
        F.when(F.abs(delta) > 0.005, F.when(share > 0.05, "critical").otherwise("high")).otherwise("benign")
        .alias("total_severity"),
        F.when(F.abs(F.col("declared_tax") - tax) > 1, "high").otherwise("benign").alias("tax_severity"))
