"""Window-like operators that survive one key holding a large share of all rows.

A plain ``Window.partitionBy(case)`` sends a whole case to one task. The helpers
here cut every key into buckets that follow the ordering, do the per-row work
inside ``(key, bucket)`` and run a window over the whole key only on the bucket
summaries, which are smaller by the bucket size. Results equal the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertrail.session import materialise


#: Rows of a key that one task may take at once.
CROWD = 1 << 16


def _bucketed(df: DataFrame, bucket: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"__b{i}" for i in range(len(bucket))]
    return df.withColumns(dict(zip(names, bucket))), names


def hot_keys(df: DataFrame, keys: Sequence[str], most: int = CROWD) -> DataFrame | None:
    """Keys with more than ``most`` rows, one row each, or None where there is none. There are at most rows / ``most`` of them,
    so they may be sent to all tasks."""
    found = materialise(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).select(*keys))
    return None if found.isEmpty() else found


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of all other keys, and rows of the hot ones."""
    return df.join(F.broadcast(hot), list(keys), "left_anti"), df.join(F.broadcast(hot), list(keys), "left_semi")


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Sequence[Column],
                out: str = "rn", most: int = CROWD) -> DataFrame:
    """``row_number() over (partition by keys order by order)``, 1-based.

    ``bucket`` must be monotone in ``order`` and ``order`` total within a key. Only keys of more than ``most`` rows are cut
    into buckets; the rows of all others move once.
    """
    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    hot = hot_keys(df, keys, most)
    if hot is None:
        return plain(df)
    others, crowded = split_hot(df, keys, hot)
    return plain(others).unionByName(_bucketed_row_numbers(crowded, keys, order, bucket, out))


def _bucketed_row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Sequence[Column], out: str) -> DataFrame:
    keyed, names = _bucketed(df, bucket)
    at = [*keys, *names]
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy(*at).agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(*at, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy(*at).orderBy(*order))
    numbered = keyed.withColumn("__in", inside).join(offsets, at)
    return numbered.withColumn(out, F.col("__in") + F.col("__offset")).drop(*names, "__in", "__offset")


def with_following(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], n: int = 1,
                   width: int = 1024, most: int | None = None) -> DataFrame:
    """Add ``next1_c … nextn_c``: column ``c`` of the following rows of the key.

    ``order`` is a numeric column unique within a key. Each bucket borrows the
    first ``n`` rows of the next ``n`` non-empty buckets, so no row looks further.
    With ``most``, only keys of more rows are cut into buckets; the others are read where they lie.
    """
    if most is not None:
        hot, whole = hot_keys(df, keys, most), Window.partitionBy(*keys).orderBy(order)

        def plain(rows: DataFrame) -> DataFrame:
            return rows.withColumns({f"next{i}_{c}": F.lead(c, i).over(whole) for i in range(1, n + 1) for c in cols})
        if hot is None:
            return plain(df)
        others, crowded = split_hot(df, keys, hot)
        return plain(others).unionByName(with_following(crowded, keys, order, cols, n, width))
    keyed, (b,) = _bucketed(df, [F.floor(F.col(order) / width)])
    at = [*keys, b]
    in_bucket = Window.partitionBy(*at).orderBy(order)
    payload = list(dict.fromkeys([order, *cols]))
    heads = (keyed.select(*at, *payload).withColumn("__r", F.row_number().over(in_bucket)).filter(F.col("__r") <= n)
             .groupBy(*at).agg(F.sort_array(F.collect_list(F.struct(*payload))).alias("__heads")))
    over_key = Window.partitionBy(*keys).orderBy(b)
    borrowed = F.concat(*[F.coalesce(F.lead("__heads", i).over(over_key), F.slice("__heads", 1, 0))
                          for i in range(1, n + 1)])
    halo = (heads.select(*at, borrowed.alias("__h"))
            .select(*at, F.explode(F.slice("__h", 1, n)).alias("__w"))
            .select(*at, *[F.col(f"__w.{c}").alias(c) for c in payload], F.lit(True).alias("__halo")))
    both = keyed.withColumn("__halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    leads = {f"next{i}_{c}": F.lead(c, i).over(in_bucket) for i in range(1, n + 1) for c in cols}
    return both.withColumns(leads).filter(~F.col("__halo")).drop("__halo", b)


def gap_clusters(df: DataFrame, keys: Sequence[str], col: str, gap: float | str, width: float,
                 out: str = "cluster", most: int = CROWD) -> DataFrame:
    """Chained clustering: a new cluster (0, 1, …) starts where the distance to the
    previous value of the key exceeds ``gap`` (a number, or a column constant per key).

    Rows of a key with at most ``most`` rows are read in order where they lie; only longer keys are cut into buckets."""
    df = df.dropna(subset=[*keys, col])
    hot = hot_keys(df, keys, most)
    if hot is None:
        return _read_clusters(df, keys, col, gap, out)
    others, crowded = split_hot(df, keys, hot)
    return _read_clusters(others, keys, col, gap, out).unionByName(_bucketed_clusters(crowded, keys, col, gap, width, out))


def _read_clusters(df: DataFrame, keys: Sequence[str], col: str, gap: float | str, out: str) -> DataFrame:
    ordered = Window.partitionBy(*keys).orderBy(col)
    distance = F.col(col) - F.lag(col).over(ordered)
    marked = df.withColumn("__break", F.coalesce((distance > (F.col(gap) if isinstance(gap, str) else F.lit(gap))).cast("int"), F.lit(0)))
    count = F.sum("__break").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn(out, count).drop("__break")


def _bucketed_clusters(df: DataFrame, keys: Sequence[str], col: str, gap: float | str, width: float, out: str) -> DataFrame:
    extra = [gap] if isinstance(gap, str) else []
    gap = F.col(gap) if isinstance(gap, str) else F.lit(gap)
    points, (b,) = _bucketed(df.select(*keys, col, *extra).distinct(), [F.floor(F.col(col) / width)])
    at = [*keys, b]
    over_key = Window.partitionBy(*keys).orderBy(b)
    ends = points.groupBy(*at).agg(F.max(col).alias("__max"))
    previous_bucket = ends.select(*at, F.lag("__max").over(over_key).alias("__before"))
    ordered = Window.partitionBy(*at).orderBy(col)
    points = points.join(previous_bucket, at)
    distance = F.col(col) - F.coalesce(F.lag(col).over(ordered), F.col("__before"))
    marked = points.withColumn("__break", F.coalesce((distance > gap).cast("int"), F.lit(0)))
    totals = marked.groupBy(*at).agg(F.sum("__break").alias("__breaks"))
    offsets = totals.select(*at, F.coalesce(F.sum("__breaks").over(
        over_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    inside = F.sum("__break").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    labelled = (marked.withColumn("__in", inside).join(offsets, at)
                .select(*keys, col, (F.col("__in") + F.col("__offset")).alias(out)))
    return df.join(labelled, [*keys, col])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], width: float,
                    upper: bool = False) -> DataFrame:
    """Exact quantiles per key, one output column per entry of ``probs``.

    Equal values are counted before the shuffle; a window over a key sees bucket
    totals only, and only the buckets holding a wanted rank are opened. Linear
    interpolation, or with ``upper`` the element at ``floor(p * n)``.
    """
    counts, (b,) = _bucketed(
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c")),
        [F.floor(F.col(value) / width)])
    at = [*keys, b]
    key_window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    totals = counts.groupBy(*at).agg(F.sum("__c").alias("__bc"))
    totals = totals.select(
        *at, F.sum("__bc").over(key_window).alias("__n"),
        (F.sum("__bc").over(key_window.orderBy(b).rowsBetween(Window.unboundedPreceding, 0))
         - F.col("__bc")).alias("__start"), "__bc")

    def ranks(p: float) -> tuple[Column, Column, Column]:
        if upper:
            at_rank = F.least(F.floor(F.lit(p) * F.col("__n")), F.col("__n") - 1)
            return at_rank, at_rank, F.lit(0.0)
        position = F.lit(p) * (F.col("__n") - 1)
        return F.floor(position), F.ceil(position), position - F.floor(position)

    def holds(rank: Column, start: Column, size: Column) -> Column:
        return (rank >= start) & (rank < start + size)

    wanted = F.lit(False)
    for p in probs.values():
        lo, hi, _ = ranks(p)
        wanted = wanted | holds(lo, F.col("__start"), F.col("__bc")) | holds(hi, F.col("__start"), F.col("__bc"))
    opened = counts.join(totals.filter(wanted), at)
    first = F.sum("__c").over(Window.partitionBy(*at).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) \
        - F.col("__c") + F.col("__start")
    opened = opened.withColumn("__first", first)
    picks = []
    for name, p in probs.items():
        lo, hi, part = ranks(p)
        picks += [F.max(F.when(holds(lo, F.col("__first"), F.col("__c")), F.col(value))).alias(f"__lo_{name}"),
                  F.max(F.when(holds(hi, F.col("__first"), F.col("__c")), F.col(value))).alias(f"__hi_{name}"),
                  F.max(part).alias(f"__part_{name}")]
    found = opened.groupBy(*keys).agg(*picks)
    return found.select(*keys, *[
        (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__part_{n}")).alias(n)
        for n in probs])


def first_from(asks: DataFrame, items: DataFrame, keys: Sequence[str], at: str, value: Column, width: float, out: str = "found",
               beyond: bool = False) -> DataFrame:
    """As-of to the right: adds ``out``, the ``value`` of the first item of the key whose ``at`` is not below the ask's own
    ``at`` (with ``beyond``: is above it); of several items there the least value; NULL where none follows.

    Both sides have ``keys`` and a numeric ``at``; they are put under each other, cut into buckets of ``width`` and read
    backwards by one window, so asks and items never form pairs. A bucket borrows the first item behind it.
    """
    single = items.groupBy(*keys, at).agg(F.min(value).alias("__v"))
    held, (b,) = _bucketed(single, [F.floor(F.col(at) / width)])
    asked, _ = _bucketed(asks, [F.floor(F.col(at) / width)])
    where = [*keys, b]
    firsts = held.groupBy(*where).agg(F.min(F.struct(F.col(at).alias("at"), F.col("__v").alias("v"))).alias("__first"))
    known = firsts.unionByName(asked.select(*where).distinct(), allowMissingColumns=True).groupBy(*where).agg(
        F.min("__first").alias("__first"))
    behind = Window.partitionBy(*keys).orderBy(F.desc(b)).rowsBetween(Window.unboundedPreceding, -1)
    halo = known.select(*where, F.last("__first", ignorenulls=True).over(behind).alias("__next")).filter("__next IS NOT NULL")
    rows = (asked.withColumn("__ask", F.lit(True))
            .unionByName(held.withColumn("__ask", F.lit(False)), allowMissingColumns=True)
            .unionByName(halo.select(*where, F.col("__next.at").alias(at), F.col("__next.v").alias("__v"), F.lit(False).alias("__ask")),
                         allowMissingColumns=True))
    # Backwards, an item counts for asks at its own place unless only items beyond are wanted.
    side = F.desc("__ask") if beyond else F.asc("__ask")
    seen = Window.partitionBy(*where).orderBy(F.desc(at), side).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(out, F.last("__v", ignorenulls=True).over(seen)).filter("__ask").drop("__ask", "__v", b)


def anchored_starts(df: DataFrame, keys: Sequence[str], col: str, gap: float, width: float, most: int | None = None,
                    crowd: int = 1024) -> DataFrame:
    """Anchored greedy clustering: a value opens a cluster when it lies more than ``gap`` beyond the start of the current
    one. Returns the keys, ``ordinal`` (from 0) and ``start`` of every cluster, or of the first ``most`` ones.

    The values of a key with at most ``crowd`` rows are gathered and folded. In all other keys each distinct value is linked
    with the first value more than ``gap`` beyond it. The starts are what the least value reaches over these links; they are
    followed in steps that double, so a key with n clusters takes log2(n) rounds and no task holds such a key's values.
    """
    df = df.select(*keys, col).filter(F.col(col).isNotNull())
    hot = hot_keys(df, keys, crowd)
    if hot is None:
        return _folded_starts(df, keys, col, gap, most)
    others, crowded = split_hot(df, keys, hot)
    return _folded_starts(others, keys, col, gap, most).unionByName(_linked_starts(crowded, keys, col, gap, width, most))


def _folded_starts(df: DataFrame, keys: Sequence[str], col: str, gap: float, most: int | None) -> DataFrame:
    none = F.array().cast(f"array<{df.schema[col].dataType.simpleString()}>")
    starts = F.aggregate(F.array_sort(F.collect_set(col)), none, lambda found, v: F.when(
        (F.size(found) == 0) | (v > F.element_at(found, -1) + F.lit(gap)), F.concat(found, F.array(v))).otherwise(found))
    gathered = df.groupBy(*keys).agg((starts if most is None else F.slice(starts, 1, most)).alias("__starts"))
    return gathered.select(*keys, F.posexplode("__starts").alias("ordinal", "start"))


def _linked_starts(df: DataFrame, keys: Sequence[str], col: str, gap: float, width: float, most: int | None) -> DataFrame:
    points = materialise(df.select(*keys, col).filter(F.col(col).isNotNull()).distinct())
    asks = points.select(*keys, F.col(col).alias("__start"), (F.col(col) + F.lit(gap)).alias("__at"))
    items = points.select(*keys, F.col(col).alias("__at"))
    links = first_from(asks, items, keys, "__at", F.col("__at"), width, "__next", beyond=True)
    step = materialise(links.select(*keys, "__start", "__next").filter("__next IS NOT NULL"))
    reached = points.groupBy(*keys).agg(F.min(col).alias("__start")).withColumn("ordinal", F.lit(0))
    length = 1
    while most is None or length < most:
        ahead = reached.join(step, [*keys, "__start"]).select(
            *keys, F.col("__next").alias("__start"), (F.col("ordinal") + length).alias("ordinal"))
        ahead = materialise(ahead if most is None else ahead.filter(F.col("ordinal") < most))
        if ahead.isEmpty():
            break
        reached = materialise(reached.unionByName(ahead))
        onward = step.select(*keys, F.col("__start").alias("__next"), F.col("__next").alias("__far"))
        step = materialise(step.join(onward, [*keys, "__next"]).select(*keys, "__start", F.col("__far").alias("__next")))
        length *= 2
    return reached.select(*keys, "ordinal", F.col("__start").alias("start"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark prunes each map task to ``k`` rows per key
    before the shuffle (window group limit), so a hot key ships k rows per task."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(out) <= k)
