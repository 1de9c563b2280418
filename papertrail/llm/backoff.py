"""Language-model scores of documents by stupid backoff, from n-gram count tables dealt by hash.

The model is counted on all documents and knows all their words and n-grams up to ``order``. A word scores
c(n-gram) / c(its first n - 1 words) for the longest n-gram ending at it that occurs at least ``least`` times, times ``backoff`` for
every order given up, and c(w) / N as a single word. A document's score is the mean of the decimal logarithms.

Documents are coded once, in chunks of a bounded number of words: numbers of words, and the hash of each distinct word.
From these a task makes the 64-bit hashes of all n-grams of a chunk and counts them. The space of hashes is cut into ranges;
a chunk sends each range one row with its sorted hashes (as differences) and counts, some six bytes per distinct n-gram of a
chunk, however common it is. The range adds the chunks up and answers each of them with one row of totals in the same order. A
chunk meets its answers by a shuffle on its number, makes the same hashes again and adds the scores up per document.
No table of words or n-grams is held whole by any task or by the driver, and a pair that fills the corpus is one entry per chunk.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import bounded_batches, ddl, shuffle_partitions, stored, words

ORDER, LEAST, BACKOFF = 2, 2, 0.4
#: Words and documents of a chunk: bounds of a task's memory. A longer document is a chunk of its own.
CHUNK_WORDS, CHUNK_DOCS = 1 << 20, 1 << 15
#: N-grams of a range (before chunks are added up), and ranges at most.
RANGE_GRAMS, MOST_RANGES = 1 << 21, 1 << 16
CODED = pa.schema([("chunk", pa.int64()), ("size", pa.int64()), ("docs", pa.binary()), ("numbers", pa.binary()), ("hashes", pa.binary())])
BLOCKS = pa.schema([("range", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
TOTALS = pa.schema([("chunk", pa.int64()), ("range", pa.int64()), ("totals", pa.binary())])
SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_found", pa.int64()), ("score", pa.float64())])


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers in the least number of bytes each, all lowest bytes first, then the next: planes that are mostly
    zero vanish when Spark compresses the row."""
    values = values.astype("<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :data[0]] = planes.T
    return out.reshape(-1).view("<u8")


def coded(docs: DataFrame) -> DataFrame:
    """Chunks of documents: number of words, per document id, whether it is null and number of words, the numbers of
    all words, and the 64-bit hash of each numbered word."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        numbers: dict[bytes, int] = {}
        ids, parts, size = [], [], 0

        def ended() -> pa.RecordBatch:
            nonlocal chunk, numbers, ids, parts, size
            own = np.array([(d or 0, d is None, len(p)) for d, p in zip(ids, parts)], "<i8")
            hashes = b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in numbers)
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(
                ([chunk], [size], [own.tobytes()], [packed(np.concatenate(parts))], [hashes]), CODED)], schema=CODED)
            chunk, numbers, ids, parts, size = chunk + 1, {}, [], [], 0
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ws = words(text.as_py())
                if ids and (size + len(ws) > CHUNK_WORDS or len(ids) == CHUNK_DOCS):
                    yield ended()
                number = numbers.setdefault
                parts.append(np.fromiter((number(w, len(numbers)) for w in ws), np.int32, len(ws)))
                ids.append(doc_id)
                size += len(ws)
        if ids:
            yield ended()

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(code, ddl(CODED))


class Chunk:
    """Words of a chunk and the hashes of its n-grams: per order, the hash of the n-gram that ends at a word (0 where the
    document has not so many words before)."""

    def __init__(self, docs: bytes, numbers: bytes, hashes: bytes, order: int):
        self.docs = np.frombuffer(docs, "<i8").reshape(-1, 3)
        self.sizes = self.docs[:, 2]
        self.starts = np.cumsum(self.sizes) - self.sizes
        flat = unpacked(numbers).astype(np.int64)
        word = np.frombuffer(hashes, "<u8")[flat] if len(flat) else np.zeros(0, np.uint64)
        self.place = np.arange(len(flat)) - np.repeat(self.starts, self.sizes)
        grams = [word]
        for _ in range(1, order):
            longer = np.zeros_like(word)
            mixed = grams[-1][:-1] * np.uint64(0x9E3779B97F4A7C15)
            longer[1:] = ((mixed ^ (mixed >> np.uint64(31))) + word[1:]) * np.uint64(0xD6E8FEB86659FD93)
            grams.append(longer ^ (longer >> np.uint64(29)))
        self.known = [self.place >= k for k in range(order)]
        self.distinct, self.at, self.counts = np.unique(np.concatenate([g[k] for g, k in zip(grams, self.known)]),
                                                        return_inverse=True, return_counts=True)

    def scores(self, totals: np.ndarray, total: int, least: int, backoff: float) -> pa.RecordBatch:
        """Scores of the documents, given the corpus count of every distinct n-gram."""
        ends = np.cumsum([k.sum() for k in self.known])
        counts = []  # per order, of the n-gram that ends at each word
        for known, begin, end in zip(self.known, [0, *ends[:-1]], ends):
            each = np.zeros(len(known), np.int64)
            each[known] = totals[self.at[begin:end]]
            counts.append(each)
        logs = np.log10(np.maximum(counts[0], 1)) - math.log10(max(total, 1))
        found = np.zeros(len(logs), bool)
        for k in range(1, len(counts)):  # a longer n-gram that occurs takes the place of what the shorter ones gave
            before = np.concatenate([np.ones(1, np.int64), counts[k - 1][:-1]])[:len(logs)]
            hit = self.known[k] & (counts[k] >= least)
            longer = np.log10(np.maximum(counts[k], 1)) - np.log10(np.maximum(before, 1))
            logs = np.where(hit, longer, np.where(self.known[k], logs + math.log10(backoff), logs))
            found |= hit
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        sums, hits = (np.bincount(owner, x, len(self.sizes)) for x in (logs, found))
        mean = np.round(sums / np.maximum(self.sizes, 1), 6)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.docs[:, 0].copy(), mask=self.docs[:, 1].astype(bool)), pa.array(self.sizes.copy()), pa.array(hits.astype(np.int64)),
             pa.array(mean, mask=self.sizes == 0)], schema=SCORES)


def _blocks(chunks: DataFrame, order: int, ranges: int) -> DataFrame:
    """One row per chunk and range of hashes that it has n-grams in."""
    # Range r holds hashes of which the upper 32 bits times ``ranges``, again in the upper bits, are r.
    edges = (np.array([-(-(r << 32) // ranges) for r in range(1, ranges)], np.uint64)) << np.uint64(32)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, docs, numbers, hashes in zip(*(batch[c].to_pylist() for c in ("chunk", "docs", "numbers", "hashes"))):
                own = Chunk(docs, numbers, hashes, order)
                bounds = [0, *np.searchsorted(own.distinct, edges).tolist(), len(own.distinct)]
                rows = [(r, chunk, packed(np.diff(own.distinct[a:b], prepend=np.uint64(0))), packed(own.counts[a:b]))
                        for r, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]
                for at in range(0, len(rows), 512):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[at:at + 512]), BLOCKS)], schema=BLOCKS)

    return chunks.mapInArrow(cut, ddl(BLOCKS))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _totals(blocks: DataFrame, ranges: int) -> DataFrame:
    """Answers: per chunk and range the counts over all chunks, in the order of the chunk's hashes."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in groupby(_rows(batches), lambda row: row[0]):
            chunks, hashes, counts = [], [], []
            for _, chunk, h, c in rows:
                chunks.append(chunk)
                hashes.append(np.cumsum(unpacked(h), dtype=np.uint64))
                counts.append(unpacked(c))
            sizes = [len(h) for h in hashes]
            distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
            del hashes
            sums = np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.uint64)[at]  # exact below 2^53
            parts = np.split(sums, np.cumsum(sizes)[:-1])
            for k in range(0, len(parts), 64):
                part = parts[k:k + 64]
                yield pa.RecordBatch.from_arrays([pa.array(chunks[k:k + 64], pa.int64()), pa.array([number] * len(part), pa.int64()),
                                                  pa.array(list(map(packed, part)), pa.binary())], schema=TOTALS)

    dealt = blocks.repartition(ranges, "range").sortWithinPartitions("range", "chunk")
    return dealt.mapInArrow(add_up, ddl(TOTALS))


def backoff_scores(docs: DataFrame, order: int = ORDER, least: int = LEAST, backoff: float = BACKOFF) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``; other columns are left out) with doc_id, n_words, n_found (words that an
    n-gram of two or more words gave the score) and score (mean decimal logarithm, rounded to six digits; null without words).

    All words and n-grams are known, whatever their number; n-grams of two or more words count from ``least`` occurrences on.
    Null, empty and wordless texts have no words; a text of any length is read whole (one longer than a chunk is a chunk of its
    own); repeated rows each count for the model and are each returned; ids may be null; an empty table gives an empty one.
    N-grams are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    chunks = stored(coded(docs), "coded")
    total = chunks.agg(F.sum("size")).first()[0] or 0
    ranges = min(max(1, shuffle_partitions(spark), -(-order * total // RANGE_GRAMS)), MOST_RANGES)
    answers = _totals(_blocks(chunks, order, ranges), ranges)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches), lambda row: row[0]):
            own, totals = None, [np.zeros(0, np.uint64)]
            for _, number, answer, own_docs, numbers, hashes in rows:
                if number < 0:
                    own = Chunk(own_docs, numbers, hashes, order)
                else:
                    totals.append(unpacked(answer))
            yield own.scores(np.concatenate(totals).astype(np.int64), total, least, backoff)

    asked = chunks.select("chunk", F.lit(-1).cast("long").alias("range"), F.lit(None).cast("binary").alias("totals"), "docs", "numbers", "hashes")
    met = asked.unionByName(answers, allowMissingColumns=True).repartition(shuffle_partitions(spark), "chunk").sortWithinPartitions("chunk", "range")
    return met.select("chunk", "range", "totals", "docs", "numbers", "hashes").mapInArrow(score, ddl(SCORES))
