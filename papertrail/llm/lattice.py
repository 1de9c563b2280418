"""Embedding near-duplicates by lattice hashing.

Every vector is brought to length one. In each of several tables a random orthonormal projection takes it to eight
dimensions (or several blocks of eight), where it is decoded to the nearest point of the E8 lattice: its home cell. A
vector also probes the neighbouring cells behind its nearest walls. Vectors that meet, one of them at home, are compared
by cosine in double precision, in matrix products over bounded blocks; what leaves a block are link counts and one edge per
vector, never the pairs. A pair that meets in several cells counts in the first of them only, which both vectors' lists
of cells tell.

Equal vectors become one node with a weight first. A cell with more than ``BLOCK`` rows is cut into chunks and every pair of
chunks is a block of its own, so no cell has to fit into one task. The number of cells grows with ``blocks`` and ``scale``;
for many more vectors take more of either.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import bounded_batches, shuffle_partitions, stored
from papertrail.operators.components import connected_components

THRESHOLD = 0.95
#: A pair at cosine 0.95 meets in one table with a probability of about 0.83, so it misses all six with about 2 in 100,000.
TABLES, PROBES, SCALE, LATTICES = 6, 2, 4.0, 1
#: Rows of a cell compared in one block.
BLOCK = 2048
#: Most cells with more rows than that for which their table is sent to all tasks.
BROADCAST_ROWS = 100_000
SEED = 20240601


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to the neighbouring cells."""
    pairs = [(i, j) for i in range(8) for j in range(i)]
    whole = np.zeros((4 * len(pairs), 8))
    for k, (i, j) in enumerate(pairs):
        whole[4 * k:4 * k + 4, i] = [1, 1, -1, -1]
        whole[4 * k:4 * k + 4, j] = [1, -1, 1, -1]
    signs = 0.5 - (np.arange(256)[:, None] >> np.arange(8) & 1)
    return np.concatenate([whole, signs[(signs < 0).sum(axis=1) % 2 == 0]])


ROOTS = _roots()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates of an even sum: round, and round the worst coordinate the other way
    where the sum is odd."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: the even points and those moved by one half in each coordinate."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


@functools.lru_cache(maxsize=16)
def _projection(dimension: int, table: int, lattices: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dimension, table])
    width = 8 * lattices
    basis = np.linalg.qr(rng.normal(size=(max(dimension, width), width)))[0][:dimension]
    return basis, rng.uniform(0, 1, width)


def _hash(points: np.ndarray, salt: int) -> np.ndarray:
    """64-bit keys of lattice points (twice the coordinates are whole numbers)."""
    key = np.full(len(points), salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for column in np.rint(2 * points).astype(np.int64).view(np.uint64).T:
        key = (key ^ column) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, lattices: int = LATTICES) -> np.ndarray:
    """Keys of each unit vector's cells: per table the home cell and the cells behind its nearest walls.

    ``scale`` is for 64 dimensions; projected distances shrink with the root of the dimension, so it grows with that.
    """
    n, dimension = unit.shape
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        basis, shift = _projection(dimension, t, lattices)
        x = unit @ basis * (scale * (max(dimension, 8 * lattices) / 64) ** 0.5) + shift
        home = np.concatenate([decode(x[:, 8 * b:8 * b + 8]) for b in range(lattices)], axis=1)
        # Room to the wall towards a neighbour; the smaller, the likelier a near vector lies behind it.
        lean = np.concatenate([(x[:, 8 * b:8 * b + 8] - home[:, 8 * b:8 * b + 8]) @ ROOTS.T for b in range(lattices)], axis=1)
        nearest = np.argsort(-lean, axis=1, kind="stable")[:, :probes]
        salt = dimension * 1009 + t
        out[:, t, 0] = _hash(home, salt)
        for k in range(probes):
            moved = home.copy()
            for b in range(lattices):
                rows = np.flatnonzero(nearest[:, k] // len(ROOTS) == b)
                moved[rows, 8 * b:8 * b + 8] += ROOTS[nearest[rows, k] % len(ROOTS)]
            out[:, t, 1 + k] = _hash(moved, salt)
    return out


def _meet_before(a: np.ndarray, b: np.ndarray, slot: np.ndarray, key: int) -> np.ndarray:
    """Whether pairs with the cells ``a``, ``b`` (pairs x tables x cells) meet in a table before ``slot``, or in this
    table in a cell with a smaller key."""
    at_a = (b == a[:, :, :1]).any(axis=2)  # b comes to a's home
    at_b = (a == b[:, :, :1]).any(axis=2)
    table = np.arange(a.shape[1])
    before = ((at_a | at_b) & (table < slot)).any(axis=1)
    smaller = (at_a[:, slot] & (a[:, slot, 0] < key)) | (at_b[:, slot] & (b[:, slot, 0] < key))
    return before | smaller


def _block_links(node: np.ndarray, weight: np.ndarray, unit: np.ndarray, home: np.ndarray, chunk: np.ndarray, slot: int, key: int,
                 pair: tuple[int, int], threshold: float, shape: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one block: nodes, linked weight and smallest node reached, for nodes with a link. ``shape`` holds the
    parameters of ``cells``, which are worked out again for the few vectors that are near another."""
    low, high = (np.flatnonzero(chunk == c) for c in pair)
    near = []
    for at in range(0, len(low), 512):
        rows = low[at:at + 512]
        close = unit[rows] @ unit[high].T >= threshold
        close &= home[rows][:, None] | home[high][None, :]
        if pair[0] == pair[1]:
            close &= rows[:, None] < high[None, :]
        i, j = np.nonzero(close)
        near.append(np.stack([rows[i], high[j]]))
    i, j = np.concatenate(near, axis=1) if near else np.zeros((2, 0), np.int64)
    if not len(i):
        return (np.zeros(0, np.int64),) * 3
    some, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    keys, a, b = cells(unit[some], *shape), place[:len(i)], place[len(i):]
    new = np.concatenate([~_meet_before(keys[a[p:p + (1 << 16)]], keys[b[p:p + (1 << 16)]], slot, key) for p in range(0, len(i), 1 << 16)])
    i, j = i[new], j[new]
    linked, reach = np.zeros(len(node), np.int64), node.copy()
    np.add.at(linked, i, weight[j])
    np.add.at(linked, j, weight[i])
    while True:  # smallest node over all paths inside the block
        least = np.minimum(reach[i], reach[j])
        before = reach.copy()
        np.minimum.at(reach, i, least)
        np.minimum.at(reach, j, least)
        if (before == reach).all():
            break
    met = np.unique(np.concatenate([i, j]))
    return node[met], linked[met], reach[met]


def _unit(vectors: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length, brought to length one in double precision."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares of huge or tiny numbers finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _links(rows: DataFrame, threshold: float, shape: tuple, kind: str) -> DataFrame:
    """Rows (key, slot, low, high, chunk, home, node, weight, vector), blocks kept together: node, links, reach."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("reach", pa.int64())])
    names = ["node", "weight", "home", "chunk"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current: tuple | None = None

        def close() -> pa.RecordBatch | None:
            if sum(b.num_rows for b in held) < 2:
                return None
            table = pa.Table.from_batches(held)
            node, weight, home, chunk = (table[n].to_numpy(zero_copy_only=False) for n in names)
            if not home.any():
                return None
            key, slot, low, high = current
            out = _block_links(node, weight, _unit(table["vector"].to_pylist(), kind), home, chunk, slot, key, (low, high), threshold, shape)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in out], schema=schema) if len(out[0]) else None

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch[n].to_numpy() for n in ("key", "slot", "low", "high")], axis=1)
            heads = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for a, b in zip(heads, heads[1:]):
                mark = tuple(marks[a].tolist())
                if mark != current:
                    if held and (out := close()) is not None:
                        yield out
                    held, current = [], mark
                held.append(batch.slice(a, b - a))
        if held and (out := close()) is not None:
            yield out

    return rows.mapInArrow(link, "node long, links long, reach long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE,
                 lattices: int = LATTICES) -> DataFrame:
    """Every row of ``vectors`` (``vec_id``, ``embedding``; other columns are left out) with vec_id, n_links (other rows
    linked directly), component_id (smallest vec_id reachable by links, itself included) and kept (vec_id = component_id).

    A vector that is null, empty, zero or holds a null or non-finite component links with nothing; vectors of different lengths
    do not link; equal rows are different rows and link with each other; a null id comes into play only where a group has no
    other; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"  # as wide as it came
    vector = F.col("embedding").cast("array<double>")
    valid = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) \
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding")).withColumn("valid", valid)
    # Adding 0.0 makes a negative zero an ordinary one, so that equal vectors are equal keys.
    rows = rows.withColumn("embedding", F.when(F.col("valid"), F.transform("embedding", lambda x: x + 0.0)))
    nodes = rows.filter("valid").groupBy("embedding").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["embedding"]
            sizes = np.diff(lists.offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(own))
                x = [v.tobytes() for v in part["embedding"].flatten().to_numpy().astype(kind).reshape(len(own), size)]
                keys = cells(_unit(x, kind), tables, probes, scale, lattices)
                yield pa.RecordBatch.from_arrays(
                    [part["node"], part["weight"], pa.array(x, pa.binary()), pa.array(list(keys.reshape(len(own), -1)), pa.list_(pa.int64()))],
                    names=["node", "weight", "vector", "cells"])

    placed = nodes.select("node", "weight", "embedding").mapInArrow(place, "node long, weight long, vector binary, cells array<long>")
    placed = stored(placed, "cells")
    slot = F.floor(F.col("place") / (1 + probes)).alias("slot")
    counts = placed.select(F.posexplode("cells").alias("place", "key")).groupBy("key", slot).agg(F.count(F.lit(1)).alias("n"))
    crowded = stored(counts.filter(F.col("n") > BLOCK).select("key", "slot", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks")), "crowded")
    # Usually few cells; only a table of checked size is sent to all tasks.
    few = crowded.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    each = placed.select("node", "weight", "vector", F.posexplode("cells").alias("place", "key"))
    each = each.select("key", slot, (F.col("place") % (1 + probes) == 0).alias("home"), "node", "weight", "vector")
    cut = each.join(F.broadcast(crowded) if few else crowded, ["key", "slot"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    blocks = cut.select("*", other.alias("other")).select(
        "key", "slot", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "home", "node", "weight", "vector")
    mark = ["key", "slot", "low", "high"]
    found = _links(blocks.repartition(shuffle_partitions(spark), *mark).sortWithinPartitions(*mark), threshold, (tables, probes, scale, lattices), kind)
    found = stored(found, "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select(F.col("node").alias("a"), F.col("reach").alias("b")))
    named = (nodes.join(counts, "node", "left").join(labels, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.join(named, "embedding", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
