"""Importance resampling of documents towards a target distribution over hashed n-grams.

A 256-byte table lower-cases A-Z and blanks separators in the UTF-8 of a text, ``bytes.split`` yields the words, and
a word's ``zlib.crc32`` seeds the checksum of the longer n-grams that start with it, so no n-gram is ever joined to a
string. Counters add up the buckets of a task; Spark adds up the tasks.

The corpus and the target are counted in one pass each: a task passes on one row per bucket, however many
documents it read. The logarithmic gain of every bucket (one number per bucket, a fixed table) goes with the tasks of
the second pass, which adds up the gains of each document. Gumbel noise from a hash of the document's id turns the
highest scores into a sample without replacement. Ranks come from a sort by ranges, not from one task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import bounded_batches, ddl, longs, positions, record_batch, stored, words

BUCKETS, LENGTH = 10_000, 3
#: Words whose n-grams are made at a time; bounds the memory that a very long text needs.
_SLICE = 1 << 16

COUNTS = longs("bucket", "n")
WEIGHTS = longs("doc_id", "n_words", "n_features", "weight")


def feature_buckets(ws: list[bytes], buckets: int = BUCKETS, length: int = LENGTH) -> Iterator[np.ndarray]:
    """Buckets of all runs of 1 to ``length`` consecutive words, in slices: crc32 of the words joined by one blank."""
    for at in range(0, len(ws), _SLICE):
        part = ws[at:at + _SLICE]
        tail = [b" " + w for w in islice(ws, at + 1, at + _SLICE + length - 1)]
        sums = list(map(crc32, part))
        found = sums
        for n in range(1, length):
            sums = list(map(crc32, tail[n - 1:], sums))  # ends with the words of the text
            found = found + sums
        yield np.array(found, np.uint32) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, length: int = LENGTH) -> DataFrame:
    """Features per bucket (``bucket``, ``n``) over the column ``text``; buckets without features have no row."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[int] = Counter()
        for batch in batches:
            for text in batch["text"]:
                for found in feature_buckets(words(text.as_py()), buckets, length):
                    held.update(found.tolist())
        yield record_batch(sorted(held.items()), COUNTS)

    bounded_batches(texts.sparkSession)
    return texts.select("text").mapInArrow(count, ddl(COUNTS)).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Thousandths of the log ratio of target to source per bucket, both smoothed by one feature a bucket, rounded down."""
    s_all, t_all = sum(source.values()) + buckets, sum(target.values()) + buckets
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all)))
            for b in range(buckets)]


def weights(docs: DataFrame, table: list[int], length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_features and weight: the sum of the gains of all features of the document."""
    gain = np.array(table, np.int64)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ws = words(text.as_py())
                n, total = 0, 0
                for found in feature_buckets(ws, len(gain), length):
                    n += len(found)
                    total += int(gain[found].sum())
                rows.append((doc_id, len(ws), n, total))
            yield record_batch(rows, WEIGHTS)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(add_up, ddl(WEIGHTS))


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise from the first 32 bits of the SHA-256 of ``seed:doc_id``, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(uniform)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42,
             buckets: int = BUCKETS, length: int = LENGTH) -> DataFrame:
    """One row per document (``doc_id``, ``text``; other columns are left out) with n_features, weight, score, rank.

    Of the N documents with at least ``least_words`` words the ``percent * N // 100`` with the highest scores are drawn
    and ranked from 1; all others have a null rank. ``target`` is any table with a column ``text``.

    Defined cases: null and wordless texts have no features and weight 0; equal scores go by the smaller doc_id (null
    first), then by fewer features and less weight, so that only equal rows could change places; repeated rows count and
    are drawn once each; a null doc_id is scored as an empty one; a text of any length is read whole, in slices; an empty
    target leaves the gains of the smoothing; without documents there are no rows.
    """
    source = {r["bucket"]: r["n"] for r in bucket_counts(docs, buckets, length).collect()}  # at most ``buckets`` rows
    wanted = {r["bucket"]: r["n"] for r in bucket_counts(target, buckets, length).collect()}
    scored = stored(weights(docs, gains(source, wanted, buckets), length).withColumns({
        "score": F.col("weight") + gumbel(F.col("doc_id"), seed), "eligible": F.col("n_words") >= least_words}), "weights")
    drawn = percent * scored.filter("eligible").count() // 100
    order = [F.desc("eligible"), F.desc("score"), F.col("doc_id"), F.col("n_features"), F.col("weight")]
    placed = positions(scored, order, "ranks")
    return placed.select("doc_id", "n_features", "weight", "score",
                         F.when(F.col("position") < drawn, F.col("position") + 1).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents themselves, with all their columns as they came. Where a ``doc_id`` repeats, all its rows stay
    if one of them was drawn."""
    kept = resample(docs, target, **how).filter("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__drawn")), "left_semi")
