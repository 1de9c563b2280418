"""Mixing of sources to target weights by hash thresholds; DataFrame functions only.

Every document has a fixed pseudo-random place in its source: a 60-bit hash of its id and text. Copy after copy of
all its documents is taken while a source's target allows; the copy that the target ends in is taken up to a place, so
the budgets of the copies are nested thresholds on the same hash. To find the place, the words of a source are summed
per hash bucket. The bucket in which the running sum passes the budget is the only one that is looked into, with
finer buckets, until it holds documents of one hash value. A task passes on one sum per source and bucket, a window
sees the buckets of one source (a fixed number), and no document is ever sorted. The documents at the boundary give the
words that are missing; all others are taken whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertrail.llm.common import positions, stored

#: Bits of the hash, and bits that one level of buckets reads.
BITS, LEVEL = 60, 12
#: Sources whose plan is sent to all tasks; with more of them it is joined.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text: runs of anything but blanks and control white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_of(doc_id: Column, text: Column) -> Column:
    """Hash of id and text below 2^60; equal for equal rows and for every run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")),
                                                F.md5(F.coalesce(text, F.lit(""))))), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """Adds ``target`` to rows ``source``, ``source_size``.

    Weights repeat over the sources in order of code points, null last. ``share`` times the sum of all sizes is dealt by
    weight; a source stops at ``most`` times its size, and what it leaves is dealt to the others by weight again until
    none is above. Only sums of sources travel to the driver.
    """
    ordered = positions(sizes, [F.col("source").isNull(), F.col("source")], "sources", "at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    open_sources = ordered.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    total = share * (open_sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0  # words per unit of weight
    while True:
        full = F.col("weight") * level >= F.col("cap")
        free, used = open_sources.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, F.col("cap")))).first()
        if free is None:  # every source is at its cap
            break
        raised = (total - (used or 0)) / free
        if raised <= level:
            break
        level = raised
    return open_sources.select("source", "source_size", F.least(F.col("weight") * level, F.col("cap").cast("double")).alias("target"))


def boundaries(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Place in each source at which its last copy ends: ``source, copies, rest, place, before, ties``.

    ``docs`` has source, size, place; ``plan`` source, source_size, target. ``copies`` whole copies are taken, and ``rest``
    words of one more: all documents before ``place``, which hold ``before`` words, and what is missing from the ``ties``
    documents at it. Where nothing is missing ``place`` is null.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = plan.select("source", whole.alias("copies"), (F.floor("target") - whole * F.col("source_size")).cast("long").alias("rest"))
    budget = stored(budget, "budgets")
    # Of every source still open: the bucket that the boundary lies in and the words before it.
    opened = budget.filter("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("before"))
    settled = None
    for level in range(BITS // LEVEL):
        shift = BITS - LEVEL * (level + 1)
        bucket = F.shiftright("place", shift).alias("bucket")
        few = F.broadcast(opened) if opened.count() <= BROADCAST_SOURCES else opened
        totals = [F.sum("size").alias("words"), F.min("place").alias("least"), F.max("place").alias("most"), F.count(F.lit(1)).alias("ties")]
        same = F.col("d.source").eqNullSafe(F.col("o.source"))
        kept = ["d.source", "o.rest", F.col("o.before").alias("base")]
        if level == 0:  # sums of all sources first, so that only they meet the budgets
            summed = docs.groupBy("source", bucket).agg(*totals).alias("d")
            sums = summed.join(few.alias("o"), same).select(*kept, "d.bucket", "words", "least", "most", "ties")
        else:
            coarse = F.shiftright("place", shift + LEVEL)
            sums = (docs.alias("d").join(few.alias("o"), same & (coarse == F.col("o.bucket")))
                    .select(*kept, "place", "size").groupBy("source", "rest", "base", bucket).agg(*totals))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        passed = (sums.withColumn("until", F.col("base") + F.sum("words").over(running))
                  .withColumn("before", F.col("until") - F.col("words"))
                  .filter("before < rest AND until >= rest"))
        passed = stored(passed.select("source", "rest", "bucket", "before", "least", "most", "ties"), "boundary")
        done = passed.filter("least = most").select("source", F.col("least").alias("place"), "before", "ties")
        settled = done if settled is None else settled.unionByName(done)
        opened = passed.filter("least < most").select("source", "rest", "bucket", "before")
        if opened.isEmpty():
            break
    found = settled.withColumnRenamed("source", "__source")
    return budget.join(found, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def _taken(size: Column, place: Column) -> Column:
    """Words that the mix takes of a document beside the boundary of its source."""
    missing = F.floor((F.col("__rest") - F.col("__before")) / F.col("__ties"))
    last = F.when(F.col("__boundary").isNull(), 0).when(place < F.col("__boundary"), size).when(
        place == F.col("__boundary"), F.least(size, missing)).otherwise(0)
    return (F.col("__copies") * size + last).cast("long")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, ``source``, any others) with size, source_size, target and taken; columns of
    ``docs`` with one of these names are replaced.

    ``taken`` is how many words the mix takes of a document, repeats counted: whole copies, and at most one further
    copy that is taken whole but for the documents at the boundary of their source, of which only the first words are taken.
    Sums meet the targets to a word per source and tie.

    Defined cases: a null text has size 0; a null source is a source of its own and the last one; a null id hashes as an
    empty one; rows that are equal in id and text have the same place, and what is missing is shared by them evenly; a
    source without words has target 0; a text of any length is counted whole; an empty table gives no rows.
    """
    names = ["size", "source_size", "target", "taken"]
    own = [c for c in docs.columns if c not in names]
    narrow = stored(docs.select("source", size_of(F.col("text")).alias("size"), place_of(F.col("doc_id"), F.col("text")).alias("place")), "sizes")
    marked = docs.select(*own, size_of(F.col("text")).alias("size"), place_of(F.col("doc_id"), F.col("text")).alias("__place"))
    return _apply(marked, narrow, weights, share, most).select(*own, *names)


def mixed_sizes(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken as ``mix`` gives them, from one pass over the texts."""
    narrow = stored(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"),
                                place_of(F.col("doc_id"), F.col("text")).alias("__place")), "sizes")
    return _apply(narrow, narrow.withColumnRenamed("__place", "place"), weights, share, most).select(
        "doc_id", "size", "source_size", "target", "taken")


def _apply(marked: DataFrame, narrow: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    sizes = stored(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    plan = stored(targets(sizes, weights, share, most), "targets")
    ends = boundaries(narrow, plan).select(*[F.col(c).alias(f"__{n}") for c, n in {
        "source": "source", "copies": "copies", "rest": "rest", "place": "boundary", "before": "before", "ties": "ties"}.items()])
    per_source = stored(plan.join(ends, F.col("source").eqNullSafe(F.col("__source"))).drop("source"), "mix-plan")
    few = F.broadcast(per_source) if per_source.count() <= BROADCAST_SOURCES else per_source
    joined = marked.join(few, F.col("source").eqNullSafe(F.col("__source")))
    return joined.withColumn("taken", _taken(F.col("size"), F.col("__place")))


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: one row per copy with all columns of ``docs`` and ``copy`` (from 0); a copy that is not
    taken whole holds its first words, joined by blanks. A column ``copy`` of ``docs`` is replaced."""
    own = [c for c in docs.columns if c != "copy"]
    marked = mix(docs.select(*[F.col(c).alias(f"__own_{c}") for c in own], "doc_id", "text", "source"), **how)
    size, whole = F.col("size"), F.floor(F.col("taken") / F.greatest("size", F.lit(1)))
    rest = F.col("taken") - whole * size
    copies = marked.withColumns({"__n": whole + (rest > 0).cast("long"), "__rest": rest, "__whole": whole})
    copies = copies.filter("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    cut = F.array_join(F.slice(F.regexp_extract_all("__own_text", F.lit(WORD), F.lit(0)), 1, F.col("__rest").cast("int")), " ")
    text = F.when(F.col("copy") < F.col("__whole"), F.col("__own_text")).otherwise(cut)
    return copies.select(*[(text if c == "text" else F.col(f"__own_{c}")).alias(c) for c in own], "copy")
