"""Price lists and mark sheets as words on pages, made of order lines, and the checks read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papertrail.functions import scalars as S
from papertrail.operators import ledger as L
from papertrail.operators.skew import anchored_starts, first_from
from papertrail.plans import bindings as B
from papertrail.plans.registry import cte, query

#: A line's place on its page: the order of its keys.
_LINE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)"

_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


def _money_sql(cents: str) -> str:
    return f"CAST(({cents}) // 100 AS VARCHAR) || '.' || lpad(CAST(({cents}) % 100 AS VARCHAR), 2, '0')"


# A line is a part name and three figures; every ninth part has a doubled amount, some rates were not read, and orders ending in 3
# are no price lists (their third figure is something else).
cte("order_lines", f"""
  SELECT l_orderkey AS case_id, {_LINE} AS n, l_partkey AS part, l_suppkey AS supp, CAST(l_quantity AS BIGINT) AS qty, l_tax AS tax,
         {_money_sql(f"({_CENTS} * 2 + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT))")} AS rate,
         {_money_sql(f"CASE WHEN l_orderkey % 10 = 3 THEN {_CENTS} // 7 WHEN l_partkey % 9 = 0 THEN {_CENTS} * 2 ELSE {_CENTS} END")} AS amount,
         {_CENTS} AS cents FROM lineitem""")
cte("invoice_words", """
  SELECT case_id, n * 10 + k AS idx, text, CAST(45 + (part * 7 + supp * 3 + k * 11) % 55 AS DOUBLE) AS conf, x + (part + k) % 5 AS "left",
         200 + n * 40 + (supp + k) % 6 AS top, w AS width, 12 AS height
  FROM (SELECT *, unnest([1, 2, 3, 4]) AS k, unnest(['Part' || part, CAST(qty AS VARCHAR), rate, amount]) AS text,
               unnest([60, 320, 450, 600]) AS x, unnest([80, 20, 50, 60]) AS w FROM order_lines) WHERE NOT (k = 3 AND supp % 23 = 0)
  UNION ALL
  SELECT case_id, k, text, 90.0::DOUBLE, x, y, 60, 12
  FROM (SELECT o_orderkey AS case_id, unnest([1, 2, 3, 4]) AS k, unnest(['TAXINVOICE', 'Qty', 'Rate', 'Total']) AS text,
               unnest([60, 320, 450, 600]) AS x, unnest([40, 200, 200, 200]) AS y FROM orders)
  UNION ALL
  SELECT case_id, 1000 + k, text, CAST(40 + (case_id * 7 + k * 9) % 60 AS DOUBLE), x, 280 + rows * 40 + y, 60, 12
  FROM (SELECT case_id, rows, unnest([1, 2, 3, 4, 5, 6]) AS k, unnest(['Subtotal', s, 'Tax:', x, 'TOTAL', g]) AS text,
               unnest([450, 600, 450, 600, 450, 600]) AS x, unnest([0, 1, 40, 38, 80, 81]) AS y
        FROM (SELECT case_id, max(n) AS rows, """ + _money_sql("sum(cents)") + " AS s, " + _money_sql("sum(cents) * 18 // 100") + " AS x, "
    + _money_sql("sum(cents) + sum(cents) * 18 // 100 + CASE WHEN case_id % 4 = 0 THEN 300000 ELSE 0 END") + """ AS g
              FROM order_lines GROUP BY case_id))""", "order_lines")
cte("sheet_words", """
  SELECT case_id, n * 10 + k AS idx, text, CAST(60 + (part + supp + k * 11) % 40 AS DOUBLE) AS conf, x + (part + k) % 7 AS "left",
         200 + n * 30 + supp % 4 AS top, 30 AS width, 12 AS height
  FROM (SELECT *, unnest([1, 2, 3]) AS k, unnest(['Subject' || part, CAST(qty * 2 AS VARCHAR), '100']) AS text, unnest([60, 380, 520]) AS x
        FROM order_lines) WHERE NOT (k = 3 AND part % 17 = 0)
  UNION ALL
  SELECT case_id, k, text, 90.0::DOUBLE, x, 180, 40, 12
  FROM (SELECT o_orderkey AS case_id, unnest([1, 2, 3]) AS k, unnest(['Subject', 'Marks', 'Maximum']) AS text, unnest([60, 380, 520]) AS x FROM orders)
  UNION ALL
  SELECT case_id, 1000 + k, text, CAST(40 + (case_id * 7 + k * 9) % 60 AS DOUBLE), x, 280 + rows * 30 + y, 60, 12
  FROM (SELECT case_id, rows, unnest([1, 2, 3, 4]) AS k, unnest(['Total', s, 'Percentage', p]) AS text,
               unnest([60, 380, 60, 380]) AS x, unnest([0, 1, 40, 38]) AS y
        FROM (SELECT case_id, max(n) AS rows, CAST(CAST(sum(qty * 2) - CASE WHEN case_id % 5 = 0 THEN 30 ELSE 0 END AS BIGINT) AS VARCHAR) AS s,
                     CAST(CAST(sum(qty * 2) / count(*) + CASE WHEN case_id % 7 = 0 THEN 2 ELSE 0 END AS DECIMAL(18,1)) AS VARCHAR) || '%' AS p
              FROM order_lines GROUP BY case_id))""", "order_lines")


def _money(cents):
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


LINE, HEAD, FOOT = range(3)


def _rows(t, **sums) -> DataFrame:
    """Lines, orders and one row per order that has lines, moved once, so all words of a page are made where its lines lie. A line has its place
    ``n`` on the page (SQL: order_lines), every row the number of lines and the ``sums`` over them; words that are only counted need neither."""
    def kind(df: DataFrame, which: int) -> DataFrame:
        return df.withColumn("kind", F.lit(which))
    key = F.col("l_orderkey").alias("case_id")
    lines = t.lineitem.select(key, "l_linenumber", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), "l_shipdate", "l_extendedprice", "l_quantity")
    orders, ends = t.orders.select(F.col("o_orderkey").alias("case_id")), t.lineitem.select(key).distinct()
    rows = kind(lines, LINE).unionByName(kind(orders, HEAD), allowMissingColumns=True).unionByName(kind(ends, FOOT), allowMissingColumns=True)
    page = Window.partitionBy("case_id").orderBy("kind", "l_linenumber", "part", "supp", "l_shipdate", "l_extendedprice")
    whole = page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    priced = rows.withColumns({"cents": F.round(F.col("l_extendedprice") * 100).cast("long"), "qty": F.col("l_quantity").cast("long")})
    return priced.withColumns({"n": F.row_number().over(page).cast("long"), "rows": F.count_if(F.col("kind") == LINE).over(whole),
                               **{name: F.sum(value).over(whole) for name, value in sums.items()}})


def _words(rows: DataFrame, step: int, conf, left, top, below: int, body: list, head: list, foot: list, lost) -> DataFrame:
    """One row per entry (k, text, x, y, w; k from 1 on) of each row; ``lost`` body words were not read."""
    line, first, k = F.col("kind") == LINE, F.col("kind") == HEAD, F.col("k")

    def pick(at: int, made=F.lit):
        return F.when(line, F.array(*[made(e[at]) for e in body])).when(first, F.array(*[made(e[at]) for e in head])).otherwise(F.array(*[made(e[at]) for e in foot]))
    each = rows.withColumn("texts", pick(1, lambda text: text)).withColumn("k", F.explode(pick(0))).filter(~line | ~lost)
    x, y = F.element_at(pick(2), k), F.element_at(pick(3), k)
    return each.select(
        "case_id", F.when(line, F.col("n") * 10 + k).when(first, k).otherwise(1000 + k).cast("long").alias("idx"), F.element_at("texts", k).alias("text"),
        F.when(line, conf(k)).when(first, F.lit(90)).otherwise(40 + (F.col("case_id") * 7 + k * 9) % 60).cast("double").alias("conf"),
        F.when(line, left(x, k)).otherwise(x).cast("long").alias("left"),
        F.when(line, top(k)).when(first, y).otherwise(below + F.col("rows") * step + y).cast("long").alias("top"),
        F.element_at(pick(4), k).cast("long").alias("width"), F.lit(12).cast("long").alias("height"))


def invoice_words(t) -> DataFrame:
    rows = _rows(t, total=F.col("cents"))
    cents, qty, total = F.col("cents"), F.col("qty"), F.col("total")
    amount = F.when(F.col("case_id") % 10 == 3, F.floor(cents / 7)).when(F.col("part") % 9 == 0, cents * 2).otherwise(cents)
    tax = F.floor(total * 18 / 100)
    body = [(1, F.concat(F.lit("Part"), "part"), 60, 0, 80), (2, qty.cast("string"), 320, 0, 20),
            (3, _money(F.floor((cents * 2 + qty) / (2 * qty))), 450, 0, 50), (4, _money(amount), 600, 0, 60)]
    head = [(1, F.lit("TAXINVOICE"), 60, 40, 60), (2, F.lit("Qty"), 320, 200, 60), (3, F.lit("Rate"), 450, 200, 60), (4, F.lit("Total"), 600, 200, 60)]
    foot = [(1, F.lit("Subtotal"), 450, 0, 60), (2, _money(total), 600, 1, 60), (3, F.lit("Tax:"), 450, 40, 60), (4, _money(tax), 600, 38, 60),
            (5, F.lit("TOTAL"), 450, 80, 60), (6, _money(total + tax + F.when(F.col("case_id") % 4 == 0, 300000).otherwise(0)), 600, 81, 60)]
    return _words(rows, 40, lambda k: 45 + (F.col("part") * 7 + F.col("supp") * 3 + k * 11) % 55, lambda x, k: x + (F.col("part") + k) % 5,
                  lambda k: 200 + F.col("n") * 40 + (F.col("supp") + k) % 6, 280, body, head, foot, (F.col("k") == 3) & (F.col("supp") % 23 == 0))


def sheet_words(t) -> DataFrame:
    rows = _rows(t, total=F.col("qty") * 2)
    total = F.col("total")
    printed = total - F.when(F.col("case_id") % 5 == 0, 30).otherwise(0)
    share = total / F.col("rows") + F.when(F.col("case_id") % 7 == 0, 2).otherwise(0)
    body = [(1, F.concat(F.lit("Subject"), "part"), 60, 0, 30), (2, (F.col("qty") * 2).cast("string"), 380, 0, 30), (3, F.lit("100"), 520, 0, 30)]
    head = [(1, F.lit("Subject"), 60, 180, 40), (2, F.lit("Marks"), 380, 180, 40), (3, F.lit("Maximum"), 520, 180, 40)]
    foot = [(1, F.lit("Total"), 60, 0, 60), (2, printed.cast("string"), 380, 1, 60), (3, F.lit("Percentage"), 60, 40, 60),
            (4, F.concat(share.cast("decimal(18,1)").cast("string"), F.lit("%")), 380, 38, 60)]
    return _words(rows, 30, lambda k: 60 + (F.col("part") + F.col("supp") + k * 11) % 40, lambda x, k: x + (F.col("part") + k) % 7,
                  lambda k: 200 + F.col("n") * 30 + F.col("supp") % 4, 280, body, head, foot, (F.col("k") == 3) & (F.col("part") % 17 == 0))


_NUMBER = "TRY_CAST(regexp_replace({0}, '[^0-9.\\-]', '', 'g') AS DOUBLE)"


def _label(name: str) -> str:
    return f"regexp_matches(lower(text), '^{name}($|[^\\p{{L}}\\p{{N}}])')"


def _beside(words: str, chosen: str) -> str:
    """Labels chosen per case and the figure right of each, by all pairs of a page."""
    return f"""
  typical AS (SELECT case_id, coalesce(nullif(median(height), 0), 12) AS typ_h FROM {words} WHERE height > 0 GROUP BY case_id),
  chosen AS ({chosen}),
  pairs AS (SELECT c.case_id, c.label, {_NUMBER.format('w.text')} AS value, w.conf, w."left" AS x0, w.top AS y0, w."left" + w.width AS x1, w.top + w.height AS y1,
                   row_number() OVER (PARTITION BY c.case_id, c.label ORDER BY w."left" - c."left" - c.width, w.idx) AS rk
            FROM chosen c JOIN typical USING (case_id) JOIN {words} w ON w.case_id = c.case_id AND w."left" >= c."left" + c.width - 2 AND w.height > 0
             AND abs(w.top + w.height / 2 - c.top - c.height / 2) <= typ_h
            WHERE regexp_matches(trim(w.text), '^[0-9][0-9,.]*%?$') AND {_NUMBER.format('w.text')} IS NOT NULL),
  figures AS (SELECT * FROM pairs WHERE rk = 1)"""


def _choice(words: str, labels: dict[str, str]) -> str:
    parts = []
    for name, which in labels.items():
        order = "idx" if which == "first" else 'top DESC, "left" DESC, idx'
        parts.append(f"SELECT * FROM (SELECT *, '{name}' AS label, row_number() OVER (PARTITION BY case_id ORDER BY {order}) AS k "
                     f"FROM {words} WHERE {_label(name)}) WHERE k = 1")
    return " UNION ALL ".join(parts)


_TRUST = "CASE WHEN {0} >= 50 THEN {0} END"
INVOICE_SQL = f"""
  WITH RECURSIVE {_beside('invoice_words', _choice('invoice_words', L.INVOICE_LABELS))},
  bottoms AS (SELECT case_id, coalesce(max(top) FILTER (label = 'subtotal'), max(top) FILTER (label = 'total')) - 12 AS bottom FROM chosen GROUP BY 1),
  cand AS (SELECT w.*, {_NUMBER.format('text')} AS value, "left" + width / 2::DOUBLE AS centre FROM invoice_words w JOIN bottoms USING (case_id)
           WHERE top < bottom AND "left" >= 300 AND {_NUMBER.format('text')} IS NOT NULL),
  broken AS (SELECT *, CASE WHEN top - lag(top) OVER (PARTITION BY case_id ORDER BY top, "left", idx) > 18 THEN 1 ELSE 0 END AS brk FROM cand),
  banked AS (SELECT *, sum(brk) OVER (PARTITION BY case_id ORDER BY top, "left", idx ROWS UNBOUNDED PRECEDING) AS bank FROM broken),
  starts(case_id, bank, k, start) AS (
    SELECT case_id, bank, 0, min(centre) FROM banked GROUP BY 1, 2 UNION ALL
    SELECT s.case_id, s.bank, s.k + 1, min(p.centre) FROM starts s JOIN banked p ON p.case_id = s.case_id AND p.bank = s.bank
      AND p.centre - s.start > 34 GROUP BY s.case_id, s.bank, s.k, s.start),
  grids AS (SELECT case_id, bank, list(start ORDER BY k) AS c FROM starts GROUP BY 1, 2 HAVING count(*) >= 3),
  grid AS (SELECT case_id, min(bank) AS first, arg_min(c, bank) AS c FROM grids GROUP BY 1),
  placed AS (SELECT b.*, CASE WHEN abs(centre - c[1]) <= abs(centre - c[2]) AND abs(centre - c[1]) <= abs(centre - c[3]) THEN 1
                              WHEN abs(centre - c[2]) <= abs(centre - c[3]) THEN 2 ELSE 3 END AS col,
                    least(abs(centre - c[1]), abs(centre - c[2]), abs(centre - c[3])) AS d
             FROM banked b JOIN grid g ON g.case_id = b.case_id AND b.bank >= g.first),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id, bank, col, d <= 55 ORDER BY top, "left", idx) AS rk FROM placed),
  rows_ AS (SELECT case_id, bank, max(value) FILTER (col = 1 AND rk = 1 AND d <= 55) AS q, max(value) FILTER (col = 2 AND rk = 1 AND d <= 55) AS r,
                   max(value) FILTER (col = 3 AND rk = 1 AND d <= 55) AS a, max(conf) FILTER (col = 1 AND rk = 1 AND d <= 55) AS qc,
                   max(conf) FILTER (col = 2 AND rk = 1 AND d <= 55) AS rc, max(conf) FILTER (col = 3 AND rk = 1 AND d <= 55) AS ac,
                   max("left") FILTER (col = 3 AND rk = 1 AND d <= 55) AS x0, max(top) FILTER (col = 3 AND rk = 1 AND d <= 55) AS y0,
                   max("left" + width) FILTER (col = 3 AND rk = 1 AND d <= 55) AS x1, max(top + height) FILTER (col = 3 AND rk = 1 AND d <= 55) AS y1
            FROM ranked GROUP BY 1, 2),
  sized AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS n, count(*) FILTER (q IS NOT NULL AND r IS NOT NULL AND a IS NOT NULL) OVER (PARTITION BY case_id) AS whole
            FROM rows_),
  lines AS (SELECT * FROM sized WHERE n >= 3 AND q IS NOT NULL AND r IS NOT NULL AND a IS NOT NULL),
  judged AS (SELECT *, abs(q * r - a) <= greatest(2, 0.05::DOUBLE * q * r) AS ok FROM lines WHERE least(qc, rc, ac) >= 60 AND q * r > 0),
  lists AS (SELECT case_id FROM judged GROUP BY 1 HAVING bool_or(ok)),
  totals AS (SELECT case_id, {", ".join(f"max({c}) FILTER (label = '{n}') AS {n}_{c}" for n in L.INVOICE_LABELS for c in ("value", "conf", "x0", "y0", "x1", "y1"))}
             FROM figures GROUP BY 1),
  sums AS (SELECT case_id, sum(a) AS s, count(*) AS n, min(ac) FILTER (ac >= 50) AS low FROM lines WHERE n = whole GROUP BY 1),
  all_checks AS (
    SELECT case_id, bank AS ord, 'line_amount' AS name, ok, abs(q * r - a) > 0.8::DOUBLE * a AS strong, fix(q * r, 2) AS expected, a AS actual,
           abs(q * r - a) AS diff, 0.45::DOUBLE AS base, least(qc, rc, ac) AS min_conf, x0, y0, x1, y1 FROM judged JOIN lists USING (case_id)
    UNION ALL
    SELECT case_id, NULL, 'grand_total', abs(subtotal_value + tax_value - total_value) <= greatest(2, 0.01::DOUBLE * (subtotal_value + tax_value)), true,
           fix(subtotal_value + tax_value, 2), total_value, abs(subtotal_value + tax_value - total_value), 0.92::DOUBLE,
           least({", ".join(_TRUST.format(f"{n}_conf") for n in L.INVOICE_LABELS)}), total_x0, total_y0, total_x1, total_y1
    FROM totals WHERE subtotal_value + tax_value + total_value IS NOT NULL
    UNION ALL
    SELECT case_id, NULL, 'subtotal', abs(s - subtotal_value) <= greatest(2, 0.01::DOUBLE * subtotal_value), true, fix(s, 2), subtotal_value, abs(s - subtotal_value),
           0.92::DOUBLE, least(low, {_TRUST.format("subtotal_conf")}), subtotal_x0, subtotal_y0, subtotal_x1, subtotal_y1
    FROM sums JOIN totals USING (case_id) JOIN lists USING (case_id) WHERE n >= 3 AND subtotal_value IS NOT NULL)"""
SHEET_SQL = f"""
  WITH {_beside('sheet_words', _choice('sheet_words', L.SHEET_LABELS))},
  totals AS (SELECT case_id, {", ".join(f"max({c}) FILTER (label = '{n}') AS {n}_{c}" for n in ("total", "percentage") for c in ("value", "conf", "x0", "y0", "x1", "y1"))}
             FROM figures GROUP BY 1),
  frame AS (SELECT case_id, max("left" + width / 2::DOUBLE) FILTER (label = 'marks') AS middle, max(top) FILTER (label = 'marks') + 14 AS above,
                   max(top) FILTER (label = 'total') - 4 AS below FROM chosen GROUP BY 1),
  inside AS (SELECT w.*, {_NUMBER.format('text')} AS value, abs("left" + width / 2::DOUBLE - middle) <= 40 AS under FROM sheet_words w JOIN frame USING (case_id)
             WHERE top > above AND top < below AND {_NUMBER.format('text')} IS NOT NULL),
  sums AS (SELECT case_id, sum(value) FILTER (under AND NOT (value < 10 AND conf < 85)) AS s, count(*) FILTER (under AND NOT (value < 10 AND conf < 85)) AS n,
                  count(*) FILTER (NOT under AND value = 100) AS maxima, min(conf) FILTER (under AND NOT (value < 10 AND conf < 85) AND conf >= 50) AS low
           FROM inside GROUP BY 1),
  sound AS (SELECT *, abs(s - total_value) <= greatest(2.5::DOUBLE, 0.015::DOUBLE * total_value) AS holds, fix(s / n, 1) AS mean
            FROM sums JOIN totals USING (case_id) WHERE n >= 3 AND n = maxima AND total_value IS NOT NULL),
  all_checks AS (
    SELECT case_id, 'total' AS name, holds AS ok, true AS strong, fix(s, 2) AS expected, total_value AS actual, abs(s - total_value) AS diff, 0.92::DOUBLE AS base,
           least(low, {_TRUST.format("total_conf")}) AS min_conf, total_x0 AS x0, total_y0 AS y0, total_x1 AS x1, total_y1 AS y1 FROM sound
    UNION ALL
    SELECT case_id, 'percentage', abs(mean - percentage_value) <= 0.5::DOUBLE, true, fix(mean, 2), percentage_value, abs(mean - percentage_value), 0.92::DOUBLE,
           least(low, {_TRUST.format("percentage_conf")}), percentage_x0, percentage_y0, percentage_x1, percentage_y1 FROM sound
    WHERE holds AND percentage_value IS NOT NULL)"""
_SHOWN = "name, ok, strong, expected, fix(actual, 2) AS actual, fix(diff, 2) AS diff, min_conf, x0, y0, x1, y1"


def _shown(checks: DataFrame, *keys: str) -> DataFrame:
    return checks.select(*keys, "name", "ok", "strong", "expected", S.fix("actual", 2).alias("actual"), S.fix("diff", 2).alias("diff"), "min_conf", *L.BOX)


@query("invoice_checks", f"{INVOICE_SQL} SELECT case_id, CAST(ord AS BIGINT) AS ord, {_SHOWN} FROM all_checks", ("invoice_words",))
def _(t):
    return _shown(L.invoice_checks(invoice_words(t)), "case_id", "ord")


@query("marksheet_checks", f"{SHEET_SQL} SELECT case_id, {_SHOWN} FROM all_checks", ("sheet_words",))
def _(t):
    return _shown(L.sheet_checks(sheet_words(t)), "case_id")


@query("arithmetic_breaches", f"""{INVOICE_SQL},
  failed AS (SELECT *, count(*) OVER (PARTITION BY case_id) > 1 AS several FROM all_checks WHERE NOT ok AND strong),
  weighed AS (SELECT *, fix(least(0.97::DOUBLE, base * (0.65::DOUBLE + 0.35::DOUBLE * min_conf / 100) + CASE WHEN several THEN 0.06::DOUBLE ELSE 0 END), 3) AS confidence
              FROM failed WHERE min_conf IS NOT NULL)
  SELECT case_id, CAST(ord AS BIGINT) AS ord, name, 'SEM-ARITH' AS code, CASE WHEN confidence >= 0.82::DOUBLE THEN 'critical' WHEN confidence >= 0.66::DOUBLE THEN 'high'
         WHEN confidence >= 0.45::DOUBLE THEN 'medium' WHEN confidence >= 0.26::DOUBLE THEN 'low' WHEN confidence >= 0.14::DOUBLE THEN 'info' ELSE 'benign' END AS severity,
         confidence, expected, fix(actual, 2) AS actual, fix(diff, 2) AS diff, x0, y0, x1, y1 FROM weighed""", ("invoice_words",))
def _(t):
    return L.breaches(L.invoice_checks(invoice_words(t))).withColumns({"actual": S.fix("actual", 2), "diff": S.fix("diff", 2)})


@query("anchored_starts", """
  WITH RECURSIVE points AS (SELECT DISTINCT case_id, top // 20 AS bank, "left" + width / 2::DOUBLE AS centre FROM words),
  starts(case_id, bank, ordinal, start) AS (
    SELECT case_id, bank, 0, min(centre) FROM points GROUP BY 1, 2 UNION ALL
    SELECT s.case_id, s.bank, s.ordinal + 1, min(p.centre) FROM starts s JOIN points p ON p.case_id = s.case_id AND p.bank = s.bank
      AND p.centre - s.start > 34 GROUP BY s.case_id, s.bank, s.ordinal, s.start)
  SELECT case_id, bank, CAST(ordinal AS BIGINT) AS ordinal, start FROM starts""", ("words",))
def _(t):
    centres = B.words(t).select("case_id", F.floor(F.col("top") / 20).alias("bank"), (F.col("left") + F.col("width") / 2).alias("centre"))
    return anchored_starts(centres, ["case_id", "bank"], "centre", 34.0, width=512).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("next_purchase", """
  SELECT a.user_id, a.event_id, CAST(arg_min(b.event_id, [floor(epoch(b.ts))::BIGINT, b.event_id]) AS BIGINT) AS next_event, CAST(min(floor(epoch(b.ts))::BIGINT) AS BIGINT) AS next_at
  FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND floor(epoch(b.ts))::BIGINT >= floor(epoch(a.ts))::BIGINT
  WHERE a.event_type = 'view' GROUP BY 1, 2""")
def _(t):
    stamped = t.events.select("user_id", "event_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    asks = stamped.filter("event_type = 'view'").select("user_id", "event_id", "at")
    items = stamped.filter("event_type = 'purchase'").select("user_id", "at", F.col("event_id").alias("purchase"))
    found = first_from(asks, items, ["user_id"], "at", F.struct("at", "purchase"), width=86400)
    return found.select("user_id", "event_id", F.col("found.purchase").alias("next_event"), F.col("found.at").alias("next_at"))
