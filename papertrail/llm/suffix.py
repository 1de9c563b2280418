"""Benchmark decontamination with suffix arrays over the training text.

Every partition of the documents is cut into shards of bounded size. A shard's words become integers, its
suffixes are sorted by prefix doubling, and every suffix of the benchmark is found in it by binary search, all
suffixes at once with numpy. A suffix whose first word no benchmark text holds can match nothing, so it is left
out of the array. Matches at neighbouring positions join to the longest verbatim matches and their locations.

The benchmark is the query side. It is cut into blocks of bounded size, written to the shared folder by the tasks
that hold them; a task reads one block after the other for each of its shards, so neither the driver nor a
broadcast holds the benchmark, and the documents are read once. Any usual benchmark is one block.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import bounded_batches, ddl, filesystem, new_folder, record_batch, words

WINDOW = 13
#: Words of one shard's suffix array and bytes of one benchmark block: bounds of a task's memory.
SHARD_WORDS, BLOCK_BYTES = 1 << 19, 4 << 20
#: Occurrences expanded at a time.
_EXPAND = 1 << 20
MATCHES = pa.schema([("doc_id", pa.int64()), ("doc_start", pa.int64()), ("item_id", pa.string()),
                     ("item_start", pa.int64()), ("length", pa.int64())])


class Benchmark:
    """One block of benchmark items: vocabulary, windows and, per window length, their distinct word rows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids = [item for item, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        learn = self.vocabulary.setdefault
        coded = [np.array([learn(w, len(self.vocabulary) + 1) for w in ws], np.int32) for _, ws in items]
        by_length: dict[int, list[tuple[int, int]]] = {}
        for k, ws in enumerate(coded):
            length = min(len(ws), window)
            if length:
                by_length.setdefault(length, []).extend((k, at) for at in range(len(ws) - length + 1))
        #: length -> (rows of words, for each row the items and starts that have it)
        self.windows: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = {}
        for length, places in by_length.items():
            rows = np.array([coded[k][at:at + length] for k, at in places], np.int32)
            distinct, inverse = np.unique(rows, axis=0, return_inverse=True)
            owners: list[list[tuple[int, int]]] = [[] for _ in distinct]
            for place, row in zip(places, inverse.ravel().tolist()):
                owners[row].append(place)
            self.windows[length] = (distinct, owners)


class SuffixArray:
    """Suffixes of coded text, sorted by their first ``depth`` or more words. 0 stands for a word outside the
    vocabulary and between documents. No query has a 0 and none is shorter than ``least``, so runs of fewer words
    between zeros match nothing and are left out."""

    def __init__(self, text: np.ndarray, least: int, depth: int):
        self.text = np.concatenate([text, np.zeros(depth, np.int32)])
        n = len(self.text)
        zeros = np.flatnonzero(self.text == 0)
        run = np.diff(zeros, prepend=-1) - 1  # words before each zero
        self.text[:zeros[-1] + 1][np.repeat(run < least, run + 1)] = 0
        rank = self.text.astype(np.int64)
        kept = np.flatnonzero(self.text)
        covered = 1
        self.order = kept[np.argsort(rank[kept], kind="stable")]
        while covered < depth and len(kept):
            following = np.zeros(n, np.int64)
            following[:n - covered] = rank[covered:]
            key = rank[kept] * (n + 1) + following[kept]
            by = np.argsort(key, kind="stable")
            self.order = kept[by]
            steps = np.concatenate([[1], np.diff(key[by]) != 0]).cumsum()
            rank = np.zeros(n, np.int64)
            rank[self.order] = steps
            if steps[-1] == len(kept):
                break
            covered *= 2

    def _less(self, at: np.ndarray, queries: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether the suffixes at ``at``, cut to the queries' length, come before the queries."""
        difference = self.text[at[:, None] + np.arange(queries.shape[1])] - queries
        first = (difference != 0).argmax(axis=1)
        sign = difference[np.arange(len(at)), first]
        return (sign < 0) | (sign == 0) if or_equal else sign < 0

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the range of the array whose suffixes start with it."""
        ends = []
        for or_equal in (False, True):
            low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.order), np.int64)
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                right = self._less(self.order[middle], queries[open_], or_equal)
                low[open_[right]] = middle[right] + 1
                high[open_[~right]] = middle[~right]
            ends.append(low)
        return ends[0], ends[1]


class Shard:
    """About SHARD_WORDS words of whole documents; ``starts`` counts a separator behind every document."""

    def __init__(self):
        self.keys: list[int | None] = []
        self.texts: list[list[bytes]] = []
        self.starts: list[int] = []
        self.size = 0

    def add(self, key: int | None, ws: list[bytes]) -> None:
        self.keys.append(key)
        self.texts.append(ws)
        self.starts.append(self.size)
        self.size += len(ws) + 1

    def coded(self, vocabulary: dict[bytes, int]) -> np.ndarray:
        text, get = np.zeros(self.size, np.int32), vocabulary.get
        for start, ws in zip(self.starts, self.texts):
            text[start:start + len(ws)] = [get(w, 0) for w in ws]
        return text


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    shard = Shard()
    for batch in batches:
        for key, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            ws = words(text)
            if shard.size and shard.size + len(ws) > SHARD_WORDS:
                yield shard
                shard = Shard()
            shard.add(key, ws)
    if shard.keys:
        yield shard


def _occurrences(text: np.ndarray, benchmark: Benchmark) -> Iterator[tuple[int, int, np.ndarray]]:
    """Window length, index of the window and positions of its occurrences, in bounded portions."""
    if not benchmark.windows:
        return
    array = SuffixArray(text, min(benchmark.windows), max(benchmark.windows))
    for length, (rows, _) in benchmark.windows.items():
        low, high = array.ranges(rows)
        for k in np.flatnonzero(high > low):
            for at in range(int(low[k]), int(high[k]), _EXPAND):
                yield length, int(k), array.order[at:min(at + _EXPAND, int(high[k]))]


def write_blocks(benchmark: DataFrame, window: int = WINDOW) -> list[str]:
    """Write the benchmark as blocks of whole items to a new shared folder; returns their paths, one a block.
    An item without an id has the empty id."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = new_folder(spark, "benchmark")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(item, ws) for batch in batches for item, text in
               zip(batch["item_id"].to_pylist(), batch["text"].to_pylist()) if (ws := words(text))]
        if own:
            system, path = filesystem(folder)
            system.create_dir(path, recursive=True)
            name = uuid.uuid4().hex
            with system.open_output_stream(f"{path}/{name}") as stream:
                stream.write(pickle.dumps(Benchmark(own, window)))
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})

    dealt = items.repartition(1 + size // BLOCK_BYTES, "item_id")
    return [row.path for row in dealt.mapInArrow(write, "path string").collect()]


@functools.lru_cache(maxsize=1)
def _block(path: str) -> Benchmark:
    system, name = filesystem(path)
    with system.open_input_stream(name) as stream:
        return pickle.loads(stream.read())


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Longest verbatim matches: doc_id, doc_start, item_id, item_start, length (word positions from 0).

    A match has at least ``window`` words, or all words of a shorter item, and cannot be made longer at either
    end. Null texts have no words; an item without words matches nothing; repeated rows give their matches once
    each; other columns are left out; empty tables give no rows.
    """
    bounded_batches(docs.sparkSession)
    paths = write_blocks(benchmark, window)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            for block in map(_block, paths):
                rows = []
                for item, diagonal, first, length in _runs(shard.coded(block.vocabulary), block):
                    d = int(np.searchsorted(shard.starts, first, "right")) - 1
                    rows.append((shard.keys[d], first - shard.starts[d], block.ids[item], first - diagonal, length))
                for p in range(0, len(rows), 8192):
                    yield record_batch(rows[p:p + 8192], MATCHES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, ddl(MATCHES))


def _runs(text: np.ndarray, block: Benchmark) -> list[tuple[int, int, int, int]]:
    """Matches joined along diagonals: item, text position minus item position, text position, length."""
    found = []
    for length, k, at in _occurrences(text, block):
        for item, start in block.windows[length][1][k]:
            found.append(np.stack([np.full(len(at), item), at - start, at, np.full(len(at), length)]))
    if not found:
        return []
    item, diagonal, at, length = np.concatenate(found, axis=1)
    by = np.lexsort((at, diagonal, item))
    item, diagonal, at, length = item[by], diagonal[by], at[by], length[by]
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(at)) - 1
    return list(zip(item[heads].tolist(), diagonal[heads].tolist(), at[heads].tolist(),
                    (at[ends] - at[heads] + length[heads]).tolist()))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20,
                  keep: list[str] | None = None) -> DataFrame:
    """Every document with n_words, n_hit (words inside an occurrence of a benchmark window), n_items (items with
    occurring windows), items_sha256 (of their ids, sorted as strings, comma-joined) and contaminated
    (``n_hit > 0 and share * n_hit >= n_words``), beside the columns ``keep`` of ``docs`` (all by default) except
    those names.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. Null or wordless texts
    have no words and are clean; an item without words has no window; repeated rows are reported once each; a
    document of any length is searched whole; with an empty benchmark nothing is hit.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    paths = write_blocks(benchmark, window)
    own = [c for c in keep or docs.columns if c not in REPORT]
    schema = docs.select(own).schema
    for name, kind in REPORT.items():
        schema = schema.add(name, kind)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, shard in _with_rows(batches):
            hit = np.zeros(shard.size, bool)
            items: dict[int, set[str]] = {}
            for block in map(_block, paths):
                for length, k, at in _occurrences(shard.coded(block.vocabulary), block):
                    for step in range(length):
                        hit[at + step] = True
                    owners = {block.ids[item] for item, _ in block.windows[length][1][k]}
                    for d in np.unique(np.searchsorted(shard.starts, at, "right") - 1).tolist():
                        items.setdefault(d, set()).update(owners)
            hits = np.add.reduceat(hit, shard.starts, dtype=np.int64)
            counts = np.array([len(ws) for ws in shard.texts], np.int64)
            names = [sorted(items.get(d, ())) for d in range(len(counts))]
            at = 0
            for batch in held:
                part = slice(at, at + batch.num_rows)
                at += batch.num_rows
                digests = [hashlib.sha256(",".join(n).encode()).hexdigest() for n in names[part]]
                yield pa.RecordBatch.from_arrays(
                    [*[batch[c] for c in own], pa.array(counts[part]), pa.array(hits[part]),
                     pa.array([len(n) for n in names[part]], pa.int64()), pa.array(digests, pa.string()),
                     pa.array((hits[part] > 0) & (share * hits[part] >= counts[part]))],
                    names=[*own, *REPORT])

    return docs.select(*dict.fromkeys([*own, "text"])).mapInArrow(search, schema)


REPORT = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean"}


def _with_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], Shard]]:
    """Shards of whole batches together with these batches."""
    held, shard = [], Shard()
    for batch in batches:
        held.append(batch)
        for text in batch["text"].to_pylist():
            shard.add(None, words(text))
        if shard.size > SHARD_WORDS:
            yield held, shard
            held, shard = [], Shard()
    if shard.size:
        yield held, shard


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """``docs`` without the contaminated documents; columns as they came."""
    marked = contamination(docs.withColumns({f"__own_{c}": F.col(c) for c in docs.columns if c in REPORT}),
                           benchmark, window, share)
    clean = marked.filter(~F.col("contaminated"))
    return clean.select([F.col(f"__own_{c}").alias(c) if c in REPORT else F.col(c) for c in docs.columns])
