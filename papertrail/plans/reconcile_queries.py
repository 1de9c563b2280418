"""Queries over invoice lines and marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail.functions import scalars as S
from papertrail.operators import reconcile as R
from papertrail.plans.registry import cte, query


def lines(t):
    """Order lines as invoice rows; lines of every ninth part have a doubled amount."""
    amount = F.col("l_extendedprice")
    return t.lineitem.select(
        F.col("l_orderkey").alias("case_id"),
        (F.col("l_linenumber") * 1000000000000 + F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("ord"),
        F.col("l_quantity").alias("qty"), S.fix(amount / F.col("l_quantity"), 2).alias("rate"),
        F.when(F.col("l_partkey") % 9 == 0, amount * 2).otherwise(amount).alias("amount"),
        (60 + F.col("l_suppkey") % 40).alias("qty_conf"), (58 + F.col("l_partkey") % 42).alias("rate_conf"),
        (45 + F.col("l_partkey") % 55).alias("amount_conf"))


def totals(t):
    """Printed figures: even orders print the sum of their lines, odd ones the order value."""
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    printed = t.orders.join(sums, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("case_id"), "o_custkey",
        S.fix(F.when(F.col("o_orderkey") % 2 == 0, F.col("s")).otherwise(F.col("o_totalprice")), 2).alias("subtotal"))
    taxed = printed.withColumn("tax", S.fix(F.col("subtotal") * 0.18, 2))
    gross = F.col("subtotal") + F.col("tax")
    return taxed.select("case_id", "subtotal", "tax",
                        F.when(F.col("o_custkey") % 3 == 0, gross + 3000).otherwise(gross).alias("total"),
                        (40 + F.col("o_custkey") % 60).alias("subtotal_conf"), F.lit(90).alias("tax_conf"),
                        (45 + F.col("o_custkey") % 50).alias("total_conf"))


def marks(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("case_id"), (F.col("l_quantity") * 2).cast("int").alias("mark"),
        (70 + F.col("l_suppkey") % 30).alias("conf"), F.when(F.col("l_tax") < 0.08, 100).alias("max_mark"))


def mark_totals(t):
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.sum((F.col("l_quantity") * 2).cast("int")).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.select("case_id", F.when(F.col("case_id") % 2 == 0, F.col("s")).otherwise(F.col("s") - 30)
                       .cast("double").alias("total"), F.lit(88).alias("total_conf"),
                       S.fix(F.col("s") / F.col("n"), 1).alias("percentage"))


cte("inv_lines", """
  SELECT l_orderkey AS case_id, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS ord, l_quantity AS qty,
         fix(l_extendedprice / l_quantity, 2) AS rate,
         CASE WHEN l_partkey % 9 = 0 THEN l_extendedprice * 2 ELSE l_extendedprice END AS amount,
         60 + l_suppkey % 40 AS qty_conf, 58 + l_partkey % 42 AS rate_conf, 45 + l_partkey % 55 AS amount_conf
  FROM lineitem""")
cte("inv_totals", """
  SELECT case_id, subtotal, tax, CASE WHEN o_custkey % 3 = 0 THEN subtotal + tax + 3000 ELSE subtotal + tax END AS total,
         40 + o_custkey % 60 AS subtotal_conf, 90 AS tax_conf, 45 + o_custkey % 50 AS total_conf
  FROM (SELECT *, fix(subtotal * 0.18::DOUBLE, 2) AS tax FROM (
    SELECT o_orderkey AS case_id, o_custkey, fix(CASE WHEN o_orderkey % 2 = 0 THEN s ELSE o_totalprice END, 2) AS subtotal
    FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) x
      ON x.l_orderkey = o_orderkey))""")
cte("line_checks", """
  SELECT * FROM (
    SELECT *, bool_or(ok) OVER (PARTITION BY case_id) AS any_ok FROM (
      SELECT case_id, ord, 'line_amount' AS name, abs(qty * rate - amount) <= greatest(2, 0.05::DOUBLE * qty * rate) AS ok,
             abs(qty * rate - amount) > 0.8::DOUBLE * amount AS strong, fix(qty * rate, 2) AS expected, amount AS actual,
             abs(qty * rate - amount) AS diff, 0.45::DOUBLE AS base,
             CAST(least(qty_conf, rate_conf, amount_conf) AS DOUBLE) AS min_conf
      FROM inv_lines WHERE least(qty_conf, rate_conf, amount_conf) >= 60 AND qty * rate > 0)) WHERE any_ok""",
    "inv_lines")
cte("total_checks", """
  SELECT case_id, 'grand_total' AS name, abs(subtotal + tax - total) <= greatest(2, 0.01::DOUBLE * (subtotal + tax)) AS ok,
         true AS strong, fix(subtotal + tax, 2) AS expected, total AS actual, abs(subtotal + tax - total) AS diff,
         0.92::DOUBLE AS base, CAST(least(CASE WHEN subtotal_conf >= 50 THEN subtotal_conf END, tax_conf,
                                 CASE WHEN total_conf >= 50 THEN total_conf END) AS DOUBLE) AS min_conf
  FROM inv_totals WHERE total IS NOT NULL AND subtotal + tax IS NOT NULL
  UNION ALL
  SELECT case_id, 'subtotal', abs(s - subtotal) <= greatest(2, 0.01::DOUBLE * subtotal), true, fix(s, 2), subtotal,
         abs(s - subtotal), 0.92::DOUBLE,
         CAST(least(low, CASE WHEN subtotal_conf >= 50 THEN subtotal_conf END) AS DOUBLE)
  FROM (SELECT case_id, sum(amount) AS s, count(*) AS n, min(amount_conf) FILTER (amount_conf >= 50) AS low
        FROM inv_lines GROUP BY 1) JOIN inv_totals USING (case_id)
  WHERE n >= 3 AND subtotal IS NOT NULL AND case_id IN (SELECT case_id FROM line_checks)""", "line_checks", "inv_totals")


def _rounded(checks, *keys):
    return checks.select(*keys, "name", "ok", "strong", "expected", S.fix("actual", 2).alias("actual"),
                         S.fix("diff", 2).alias("diff"), "min_conf")


_ROUNDED = "name, ok, strong, expected, fix(actual, 2) AS actual, fix(diff, 2) AS diff, min_conf"


@query("reconcile_lines", f"SELECT case_id, ord, {_ROUNDED} FROM line_checks", ("line_checks",))
def _(t):
    return _rounded(R.line_checks(lines(t)), "case_id", "ord")


@query("reconcile_totals", f"SELECT case_id, {_ROUNDED} FROM total_checks", ("total_checks",))
def _(t):
    return _rounded(R.total_checks(lines(t), totals(t)), "case_id")


@query("reconcile_sheet", """
  WITH sheets AS (
    SELECT s.*, p.total, p.percentage, abs(mark_sum - total) <= greatest(2.5::DOUBLE, 0.015::DOUBLE * total) AS holds,
           fix(mark_sum / n::DOUBLE, 1) AS mean
    FROM (SELECT l_orderkey AS case_id,
                 sum(CAST(l_quantity * 2 AS INT)) FILTER (NOT (l_quantity * 2 < 10 AND l_suppkey % 30 < 15)) AS mark_sum,
                 count(*) FILTER (NOT (l_quantity * 2 < 10 AND l_suppkey % 30 < 15)) AS n,
                 count(*) FILTER (l_tax < 0.08::DOUBLE) AS maxima FROM lineitem GROUP BY 1) s
    JOIN (SELECT l_orderkey AS case_id, sum(CAST(l_quantity * 2 AS INT)) - 30 * (l_orderkey % 2) AS total,
                 fix(sum(CAST(l_quantity * 2 AS INT)) / count(*)::DOUBLE, 1) AS percentage FROM lineitem GROUP BY l_orderkey) p
      USING (case_id) WHERE n >= 3 AND n = maxima)
  SELECT case_id, 'total' AS name, holds AS ok, CAST(mark_sum AS DOUBLE) AS expected, CAST(total AS DOUBLE) AS actual,
         CAST(abs(mark_sum - total) AS DOUBLE) AS diff FROM sheets
  UNION ALL SELECT case_id, 'percentage', abs(mean - percentage) <= 0.5::DOUBLE, fix(mean, 2), percentage,
         fix(abs(mean - percentage), 2) FROM sheets WHERE holds""")
def _(t):
    return R.sheet_checks(marks(t), mark_totals(t)).select("case_id", "name", "ok", "expected", "actual",
                                                           S.fix("diff", 2).alias("diff"))


@query("semantic_layer", """
  WITH all_checks AS (SELECT case_id, ok, strong, base, min_conf FROM line_checks
                      UNION ALL SELECT case_id, ok, strong, base, min_conf FROM total_checks),
  rolled AS (SELECT case_id, count(*) AS checks, count(*) FILTER (NOT ok AND strong) AS breaches,
                    max(base * (0.65::DOUBLE + 0.35::DOUBLE * min_conf / 100)) FILTER (NOT ok AND strong) AS strongest
             FROM all_checks GROUP BY case_id),
  lifted AS (SELECT *, fix(coalesce(CASE WHEN breaches > 1 THEN least(0.97::DOUBLE, strongest + 0.06::DOUBLE)
                                         ELSE strongest END, 0), 3) AS conf FROM rolled)
  SELECT case_id, checks, breaches, least(0.95::DOUBLE, conf) AS score,
         CASE WHEN breaches > 0 THEN greatest(0.5::DOUBLE, conf) ELSE 0 END AS confidence FROM lifted""",
       ("line_checks", "total_checks"))
def _(t):
    checks = R.line_checks(lines(t)).drop("ord").unionByName(R.total_checks(lines(t), totals(t)))
    return R.semantic_layer(checks)


@query("recompute_tax", """
  SELECT case_id, computed, fix(o_totalprice - computed, 2) AS delta, fix(computed * 0.18::DOUBLE, 2) AS tax_expected,
         CASE WHEN abs(fix(o_totalprice - computed, 2)) > 0.005::DOUBLE
              THEN CASE WHEN abs(fix(o_totalprice - computed, 2)) / greatest(1, computed) > 0.05::DOUBLE THEN 'critical'
                        ELSE 'high' END ELSE 'benign' END AS total_severity,
         CASE WHEN abs(fix(o_totalprice * 0.18::DOUBLE, 2) - fix(computed * 0.18::DOUBLE, 2)) > 1 THEN 'high'
              ELSE 'benign' END AS tax_severity
  FROM (SELECT case_id, fix(sum(qty * rate), 2) AS computed FROM inv_lines GROUP BY 1)
  JOIN orders ON o_orderkey = case_id""", ("inv_lines",))
def _(t):
    declared = t.orders.select(F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").alias("declared_total"),
                               S.fix(F.col("o_totalprice") * 0.18, 2).alias("declared_tax"))
    return R.recompute_tax(lines(t), declared)
