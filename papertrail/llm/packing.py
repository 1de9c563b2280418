"""Packing of documents into fixed windows: best-fit decreasing.

A document longer than a window is first cut into full windows; its rest and all shorter documents are
placed in order of decreasing length, each into the open window with the least room that still holds it.
The open windows stand in a segment tree over remaining capacity, so the tightest one is found in
``log2(window)`` steps.

Pieces are dealt to shards by a hash of document and start, so one very long document spreads over all
shards; each shard packs its pieces in one pass over its sorted rows and holds only the open windows. The number
of shards follows from the tokens, so that padding does not depend on a session's settings: the windows that a shard
leaves half filled are few among the thousands it packs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import bounded_batches, ddl, longs, record_batch, stored
from papertrail.llm.encode import encoder

PIECES = longs("doc_id", "start", "length", "ids_crc32", "doc_tokens")
PACKED = longs(*PIECES.names, "sequence_id", "offset")
#: Sequence ids of a shard start at its number times this.
SHARD_STRIDE = 1 << 40
#: Windows of tokens that a shard packs, and shards at most (they then get larger, not fuller of padding).
SHARD_WINDOWS, MOST_SHARDS = 1 << 14, 1 << 15


class OpenWindows:
    """Segment tree over remaining capacity 0 … window; a leaf holds the windows with that much room."""

    def __init__(self, window: int):
        self.window = window
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]
        self.opened = 0

    def _add(self, room: int, change: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += change
            node >>= 1

    def _tightest(self, length: int) -> int:
        """Least room of at least ``length`` for which a window is open; -1 if there is none."""
        node = self.leaves + length
        if self.count[node]:
            return length
        while node > 1:  # climb until a right sibling has windows, then go down to its leftmost leaf
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset for a piece; opens a window if none has room."""
        room = self._tightest(length)
        if room < 0:
            window, room = self.opened, self.window
            self.opened += 1
        else:
            window = self.at[room].pop()
            self._add(room, -1)
        if room > length:  # full windows need no place in the tree
            self.at[room - length].append(window)
            self._add(room - length, 1)
        return window, self.window - room


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """One row per piece: full windows of a document, then its rest.

    A null text is an empty one; it still has its end id, so every document has at least one piece.
    """
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, False).encode
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"].to_pylist())):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start:4 * (start + window)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
            yield record_batch(rows, PIECES)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, ddl(PIECES))


def best_fit_decreasing(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id, start, length``, all lengths in 1 … window.

    Equal lengths are placed in order of document, start and checksum, so a repeated run or task gives the
    same sequences; fully equal rows are interchangeable. An empty table gives an empty one. ``pieces`` is read twice, once for
    the number of tokens.
    """
    tokens = pieces.agg(F.sum("length")).first()[0] or 0
    shards = min(max(1, -(-tokens // (window * SHARD_WINDOWS))), MOST_SHARDS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = OpenWindows(window)
        base = TaskContext.get().partitionId() * SHARD_STRIDE
        for batch in batches:
            placed = [windows.place(n) for n in batch["length"].to_pylist()]
            columns = [*batch.columns, pa.array([base + w for w, _ in placed], pa.int64()),
                       pa.array([at for _, at in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=PACKED)

    dealt = pieces.repartition(shards, F.xxhash64("doc_id", "start", "ids_crc32"))
    return (dealt.sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32").select(*PIECES.names)
            .mapInArrow(pack, ddl(PACKED)))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048) -> DataFrame:
    """Rows of ``docs`` (``doc_id``, ``text``; other columns are left out) packed into sequences of at most
    ``window`` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Defined cases: a null or empty text is one piece holding the end id alone; a text of any length is cut
    into full windows first; a null ``doc_id`` stays null; repeated rows are packed once each; an empty table
    gives an empty result.
    """
    return best_fit_decreasing(stored(cut_documents(docs, tokenizer, end_id, window), "pieces"), window)
