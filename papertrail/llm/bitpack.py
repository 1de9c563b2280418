"""Token ids on disk with a fixed number of bits.

File format (all numbers little-endian):

    8 bytes   magic ``PTBITS01``
    blocks    each holds ``BLOCK`` ids (the last one fewer), ``bits`` bits an id, least significant first,
              padded to a whole byte
    footer    uint64 block offsets; int64 document ids; uint8 1 where the document id is null;
              uint64 first id of each document and, behind them, the number of ids
    tail      uint32 bits, uint32 ids per block, uint64 blocks, uint64 documents, uint64 footer position

``bits`` is the least number that holds every id of the vocabulary. A block is unpacked with numpy in one
step, and block offsets give access to any id without reading what lies before it.

Files are written by the tasks that hold their documents; documents are in ascending order within a file and
from file to file. A table of the files (its rows come from the attempts that Spark committed) lists them, so a
file of a lost or repeated attempt is never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papertrail.llm.common import bounded_batches, ddl, filesystem, longs, new_folder, record_batch, shuffle_partitions
from papertrail.llm.encode import encoder

MAGIC = b"PTBITS01"
BLOCK = 1 << 16
_TAIL = struct.Struct("<IIQQQ")
FILES = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
READ = longs("doc_id", "start", "n_tokens", "ids_crc32")


def bits_for(vocabulary: int) -> int:
    """Least number of bits that holds the ids 0 … vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    spread = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype="<u4")).astype(np.uint8) & 1
    return np.packbits(spread, bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    padded = np.zeros((count, 32), np.uint8)
    padded[:, :bits] = spread
    return np.packbits(padded, axis=1, bitorder="little").view("<u4")[:, 0]


class PackedWriter:
    """Writes one file; holds one block of ids and the document index."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.pending: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.position = self.stream.write(MAGIC)
        self.offsets: list[int] = []
        self.doc_ids: list[int] = []
        self.null: list[bool] = []
        self.starts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"id {int(ids.max())} needs more than {self.bits} bits")
        self.doc_ids.append(0 if doc_id is None else doc_id)
        self.null.append(doc_id is None)
        self.starts.append(self.total)
        self.pending.append(ids)
        self.total += len(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, "<u4")
        end = len(ids) if last else len(ids) - len(ids) % BLOCK
        for at in range(0, end, BLOCK):
            self.offsets.append(self.position)
            self.position += self.stream.write(pack(ids[at:min(at + BLOCK, end)], self.bits))
        self.pending, self.waiting = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        footer = b"".join([np.array(self.offsets, "<u8").tobytes(), np.array(self.doc_ids, "<i8").tobytes(),
                           np.array(self.null, np.uint8).tobytes(), np.array([*self.starts, self.total], "<u8").tobytes()])
        self.stream.write(footer + _TAIL.pack(self.bits, BLOCK, len(self.offsets), len(self.doc_ids), self.position))
        self.stream.close()


class PackedFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        system, path = filesystem(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(_TAIL.size, size - _TAIL.size)
        self.bits, self.block, blocks, docs, at = _TAIL.unpack(tail)
        footer = self.file.read_at(size - _TAIL.size - at, at)
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is no packed token file")
        self.offsets = np.append(np.frombuffer(footer, "<u8", blocks), at).astype(np.int64)
        self.doc_ids = np.frombuffer(footer, "<i8", docs, 8 * blocks)
        self.null = np.frombuffer(footer, np.uint8, docs, 8 * (blocks + docs)).astype(bool)
        self.starts = np.frombuffer(footer, "<u8", docs + 1, 8 * (blocks + docs) + docs).astype(np.int64)

    def _block(self, k: int) -> np.ndarray:
        count = min(self.block, int(self.starts[-1]) - k * self.block)
        return unpack(self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k])), self.bits, count)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` … ``stop - 1`` of the file; reads only the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first = start // self.block
        parts = [self._block(k) for k in range(first, (stop - 1) // self.block + 1)]
        return np.concatenate(parts)[start - first * self.block:stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order; each block is unpacked once."""
        held, base = np.zeros(0, "<u4"), 0  # ids from position ``base`` on
        for k, doc_id in enumerate(self.doc_ids):
            start, stop = int(self.starts[k]), int(self.starts[k + 1])
            parts = [held[start - base:]]
            have, base = base + len(held), start
            while have < stop:
                parts.append(self._block(have // self.block))
                have += len(parts[-1])
            held = np.concatenate(parts) if len(parts) > 1 else parts[0]
            yield None if self.null[k] else int(doc_id), held[:stop - start]


def write_packed(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, folder: str) -> DataFrame:
    """Encode ``docs`` (``doc_id``, ``text``; other columns are left out) and write them below ``folder``.

    Returns the table of files: shard, path, n_docs, n_ids, base (ids in the files before it). Runs the job.
    A null text is empty and has its end id alone; null document ids come first; repeated rows are written once
    each, in order of the text's hash; an empty table gives no files.
    """
    spark, bits, end = docs.sparkSession, bits_for(vocabulary), end_id.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = encoder(tokenizer, True).encode, None
        shard = TaskContext.get().partitionId()
        for batch in batches:
            if writer is None:
                system, path = filesystem(folder)
                system.create_dir(path, recursive=True)
                name = f"{shard:08d}-{uuid.uuid4().hex}.bits"
                writer = PackedWriter(system.open_output_stream(f"{path}/{name}"), bits)
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"].to_pylist())):
                writer.add(doc_id, np.frombuffer(ids + end, "<u4"))
        if writer is not None:
            writer.close()
            yield record_batch([(shard, f"{folder}/{name}", len(writer.starts), writer.total)], FILES)

    bounded_batches(spark)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(shuffle_partitions(spark), *order)
    files = dealt.sortWithinPartitions(*order).mapInArrow(write, ddl(FILES))
    files.write.parquet(f"{folder}/files")
    return read_files(spark, folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Table of the files of a folder, one row a file, with the number of ids before each."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (spark.read.schema(ddl(FILES)).parquet(f"{folder}/files")
            .withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))))


def read_documents(files: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist()):
                rows = []
                for doc_id, ids in PackedFile(path).documents():
                    rows.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    base += len(ids)
                    if len(rows) == 4096:
                        yield record_batch(rows, READ)
                        rows = []
                yield record_batch(rows, READ)

    partitions = shuffle_partitions(files.sparkSession)
    return (files.select("path", "base").repartition(partitions, "path")
            .mapInArrow(read, ddl(READ)))


def round_trip(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to a new shared folder and return what reading the files gives."""
    return read_documents(write_packed(docs, tokenizer, vocabulary, end_id, new_folder(docs.sparkSession, "bits")))
