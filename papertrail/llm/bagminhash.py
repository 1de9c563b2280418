"""Near-duplicate documents by BagMinHash: weighted Jaccard similarity of word-shingle bags.

A document is the bag of its shingles (five consecutive words; a shorter one is a single shingle). For every shingle
and every dyadic weight interval [0,1), [1,2), [2,4), [4,8), … a Poisson process seeded by both drops points
with a time, a signature component and a weight inside the interval. A bag takes the points whose weight lies below
the shingle's count; a component of its signature is its earliest point. Two bags share the point of a component with
a probability equal to their weighted Jaccard similarity. Points come in order of time, so a process stops once it is
behind the latest component, and most shingles need one or two points.

Signatures are cut into bands; documents that share a band are compared exactly:

1. documents with equal bags become one node (counted before any shuffle of large rows);
2. every node of a band bucket is compared with its head, the smallest node, so a bucket of n nodes gives n - 1 pairs.
   Buckets of one head are one group, so nodes that share several of its bands meet it once;
3. a group whose other nodes are all linked to one of its heads is done, as is one whose nodes have all met; the others
   take the node nearest to their last head as the next one. Copies of one text may be too far from each other and all
   near that text: the nearest node leads there. After ``ROUNDS`` rounds few groups are left, and links join to components;
4. in these, pairs in different components are compared too. Nodes within ``NEAR`` of their last head are joined by what
   sets them apart from it: two bags differ by exactly the symmetric difference of their differences from the head, so
   linked ones share most of the rarer differences (a prefix filter, exact). Pairs with a node farther off are left out
   only where their known distances to a head differ by more than a link allows (Jaccard distance is a metric).

So no link between documents that share a band is lost, and neither a large group of copies nor one of texts that are
somewhat alike becomes all its pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papertrail.llm.common import bounded_batches, stored, words
from papertrail.llm.groups import components
from papertrail.operators.components import connected_components

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold misses all bands with a probability of (1 - .8**4)**20, about 3 in 100,000.
BANDS, ROWS = 20, 4
ROUNDS, NEAR = 3, 0.7

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _nth(k: int) -> np.uint64:
    """k times the golden constant, modulo 2**64."""
    return np.uint64(k * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public-domain splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = _mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)


def bags(texts: list[str | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bags of many texts: owner (text number), shingle hash and count, ordered by owner and hash. A text without
    words has an empty bag."""
    split = [words(t) for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    digest = xxhash.xxh3_64_intdigest
    flat = np.fromiter((digest(w) for s in split for w in s), np.uint64, int(sizes.sum()))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    span = np.minimum(sizes, shingle)
    places = np.where(sizes > 0, sizes - span + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), places)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(places) - places, places) + starts[owner]
    padded = np.concatenate([flat, np.zeros(shingle, np.uint64)])
    value = span[owner].astype(np.uint64)
    for k in range(shingle):
        value = np.where(k < span[owner], _mix((value ^ padded[at + k]) * _POWERS[k % SHINGLE] + _GOLDEN), value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    heads = np.flatnonzero(first)
    return owner[heads], value[heads], np.diff(np.append(heads, len(owner)))


def signatures(owner: np.ndarray, value: np.ndarray, count: np.ndarray, texts: int, size: int) -> np.ndarray:
    """BagMinHash signatures, ``texts`` rows of ``size`` times; infinite for an empty bag."""
    out = np.full(texts * size, np.inf)
    who, seed, low, length, weight = [], [], [], [], []
    level, left = 0, np.arange(len(owner))
    while left.size:  # dyadic weight intervals that a count reaches into
        base = 0 if level == 0 else 1 << (level - 1)
        left = left[count[left] > base]
        who.append(owner[left])
        seed.append(_mix(value[left] + _nth(level)))
        low.append(np.full(left.size, float(base)))
        length.append(np.full(left.size, float(max(base, 1))))
        weight.append(count[left].astype(float))
        level += 1
    who, seed, low, length, weight = map(np.concatenate, (who, seed, low, length, weight)) if who else (np.zeros(0, int),) * 5
    time = np.zeros(len(who))
    step = 0
    while len(who):
        draw = _mix(seed + _nth(2 * step + 1))
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53) / (size * length)
        draw = _mix(seed + _nth(2 * step + 2))
        part = ((draw >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        height = low + length * ((draw & np.uint64(0xFFFFFFFF)).astype(float) + 0.5) * 2.0 ** -32
        taken = height < weight
        np.minimum.at(out, who[taken] * size + part[taken], time[taken])
        go = time < out.reshape(texts, size).max(axis=1)[who]
        who, seed, low, length, weight, time = who[go], seed[go], low[go], length[go], weight[go], time[go]
        step += 1
    return out.reshape(texts, size)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of smaller counts over sum of larger counts of two bags (hashes in order, counts); 0 for an empty bag."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def _slices(batches: Iterator[pa.RecordBatch], size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` characters, or one text: the arrays made of a text are many times as large."""
    for batch in batches:
        start, held = 0, 0
        for row, text in enumerate(batch["text"]):
            held += len(text.as_py() or "")
            if held > size:
                yield batch.slice(start, row + 1 - start)
                start, held = row + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def _sketch(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """Per row: doc_id, hash of the text, node (digest of the bag; null without words), shingles and its bands' hashes."""
    size = bands * rows
    out = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.binary()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n = batch.num_rows
            owner, value, count = bags(batch["text"].to_pylist(), shingle)
            times = signatures(owner, value, count, n, size).view(np.uint64).reshape(n, bands, rows)
            band = np.zeros((n, bands), np.uint64)
            for r in range(rows):
                band = _mix((band ^ times[:, :, r]) * _POWERS[r % SHINGLE] + np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN)
            cuts = np.searchsorted(owner, np.arange(n + 1))
            nodes = [xxhash.xxh3_128_digest(value[a:b].tobytes() + count[a:b].tobytes()) if b > a else None
                     for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            sizes = np.bincount(owner, count, n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], pa.array(nodes, pa.binary()), pa.array(sizes),
                 pa.array(list(band.view(np.int64)), pa.list_(pa.int64()))], schema=out)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        sketch, "doc_id long, text_hash long, node binary, size long, bands array<long>")


def _compare(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Node pairs (a, b; other columns stay) with their exact similarity."""
    kept = pairs.columns

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @functools.lru_cache(maxsize=32)
        def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
            return bags([text], shingle)[1:]

        for batch in batches:
            found = [weighted_jaccard(bag(a), bag(b)) for a, b in zip(batch["text_a"].to_pylist(), batch["text_b"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(found, pa.float64())], names=[*kept, "similarity"])

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select(*kept, "text_a", "text_b").mapInArrow(
        compare, ", ".join(f"{n} {kind}" for n, kind in [*pairs.dtypes, ("similarity", "double")]))


def _differences(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Per pair (head, node): what is in one bag only, as one 64-bit digest per shingle and place in its count, and the
    number of these differences."""
    out = pa.schema([("head", pa.int64()), ("node", pa.int64()), ("apart", pa.int64()), ("elements", pa.list_(pa.int64()))])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @functools.lru_cache(maxsize=32)
        def members(text: str) -> np.ndarray:
            _, value, count = bags([text], shingle)
            place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            return _mix(np.repeat(value, count) ^ _mix((place + 1).astype(np.uint64)))

        for batch in batches:
            own = [members(t) for t in batch["text_b"].to_pylist()]
            apart = [np.setxor1d(members(h), m, assume_unique=True) for h, m in zip(batch["text_a"].to_pylist(), own)]
            yield pa.RecordBatch.from_arrays(
                [batch["a"], batch["b"], pa.array([len(d) for d in apart], pa.int64()),
                 pa.array([d.view(np.int64) for d in apart], pa.list_(pa.int64()))], schema=out)

    with_a = pairs.select(F.col("head").alias("a"), F.col("node").alias("b")).join(
        texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(
        differ, "head long, node long, apart long, elements array<long>")


def _unsettled(around: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """Pairs (a, b) of nodes around one head (head, node, component, size, far) in different components that may still be
    linked."""
    def pairs(one: DataFrame, two: DataFrame, *conditions) -> DataFrame:
        met = one.alias("l").join(two.alias("r"), functools.reduce(lambda x, y: x & y, [F.col("l.component") != F.col("r.component"), *conditions]))
        return met.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"))

    distant = F.col("far") > NEAR
    metric = F.abs(F.col("l.far") - F.col("r.far")) <= 1 - threshold + 1e-9
    # The smaller bag of a link has at least ``threshold`` of the larger one's size.
    alike = F.least("l.size", "r.size") >= threshold * F.greatest("l.size", "r.size") - 1e-6
    direct = pairs(around.filter(distant), around, F.col("l.head") == F.col("r.head"), F.col("l.node") != F.col("r.node"),
                   ~((F.col("r.far") > NEAR) & (F.col("l.node") > F.col("r.node"))), alike, metric)

    # A link allows bags x, y to differ in share * (|x| + |y|) members, and |y| <= |x| / threshold. Of the differences from
    # the head, the node with fewer has at most half of these for itself, the other one at most all.
    share = (1 - threshold) / (1 + threshold)
    close = around.filter(~distant).drop("far")
    sizes = close.groupBy("head").agg(F.max("size").alias("largest"))
    allowed = F.floor(share * (F.col("size") + F.least("largest", F.col("size") / threshold)) + 1e-9)
    apart = _differences(close, texts, shingle).join(close, ["head", "node"]).join(sizes, "head").select(
        F.monotonically_increasing_id().alias("k"), "head", "node", "component", "size", "apart", allowed.alias("allowed"), "elements")
    apart = stored(apart, "apart")
    # A difference of a head is one key; only keys that several nodes have are ranked, rarer ones first. Those a node has alone are
    # rarer still, so they take the ranks before. What is known of a node travels with its keys.
    known = ["k", "node", "component", "size", "apart", "allowed"]
    each = apart.select(*known, F.explode(F.transform("elements", lambda e: F.xxhash64("head", e))).alias("key"))
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = Window.partitionBy("k")
    ranked = each.join(often, "key").select("key", *known, F.row_number().over(own.orderBy("n", "key")).alias("at"), F.count(F.lit(1)).over(own).alias("held"))
    shared = ranked.withColumn("rank", F.col("at") + F.col("apart") - F.col("held")).filter(F.col("rank") <= F.col("allowed") + 1)
    # Bags that differ less than allowed may share nothing, so all of them share one more key as their last difference.
    last = apart.filter(F.col("apart") <= F.col("allowed")).withColumns({"key": F.xxhash64("head", F.lit("last")), "rank": F.col("apart") + 1})
    columns = ["key", "node", "component", "size", "apart", "allowed", "rank"]
    shared = stored(shared.select(columns).unionByName(last.select(columns)), "shared")
    short = shared.filter(F.col("rank") <= F.floor(F.col("allowed") / 2) + 1)
    order = F.struct("l.apart", "l.node") < F.struct("r.apart", "r.node")
    # Differences that two linked nodes share; where they first meet, no more than the rest of either can be shared. The
    # common last number counts as shared by all.
    most = share * (F.col("l.size") + F.col("r.size"))
    need = (F.col("l.apart") + F.col("r.apart") - most) / 2 - 1e-6
    rest_shared = 1 + F.least(F.col("l.apart") - F.col("l.rank"), F.col("r.apart") - F.col("r.rank"))
    by_difference = pairs(short, shared, F.col("l.key") == F.col("r.key"), order, alike,
                          F.col("r.apart") - F.col("l.apart") <= most + 1e-6, rest_shared >= need)
    return direct.unionByName(by_difference).distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``; other columns are left out) with doc_id, text_hash (xxhash64 of the text),
    component (a digest that names the group; null without words), component_id (smallest doc_id of the documents
    linked with it, itself included) and kept (whether that is its own).

    Documents are linked from a weighted Jaccard similarity of ``threshold`` on. A null, empty or wordless text is
    linked with nothing; null ids come after all others, so a null component has null ids only; rows equal in id
    and text are one document; texts of any length are compared whole; an empty table gives an empty one.
    """
    sketch = stored(_sketch(docs, shingle, bands, rows), "sketch")
    nodes = sketch.filter("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"), F.first("bands").alias("bands"), F.first("size").alias("size"))
    # From here on a node is a number; the table is written, so the numbers stay.
    nodes = stored(nodes.select(F.col("node").alias("bag"), F.monotonically_increasing_id().alias("node"), "first.doc_id", "first.text_hash", "size", "bands"), "nodes")
    members = nodes.select("node", "size", F.posexplode("bands").alias("band", "hash"))
    heads = members.groupBy("band", "hash").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = members.join(heads, ["band", "hash"]).filter("node <> head")
    stars = stored(met.groupBy("head", "node").agg(F.first("size").alias("size"), F.max("n").alias("n")), "stars")
    wanted = stars.select("node").unionByName(stars.select(F.col("head").alias("node"))).distinct()
    keys = nodes.select("node", "text_hash", F.col("doc_id").alias("id")).join(wanted, "node")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("hash", F.xxhash64("text"))
    texts = source.join(keys, source["doc_id"].eqNullSafe(keys["id"]) & (source["hash"] == keys["text_hash"]))
    texts = stored(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")

    def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    # A node of a group: the group's first and last head, and a bit for each of its heads that the node is linked to. Heads
    # have met all nodes and leave; nodes that are alone with a head have met all that they share a bucket with.
    pairs = stars.select(F.col("head").alias("a"), F.col("node").alias("b"), F.col("head").alias("group"), "size", "n", F.lit(0).alias("mask"))
    links = None
    for k in range(ROUNDS):
        compared = stored(_compare(pairs, texts, shingle), "compared")
        linked = F.col("similarity") >= threshold
        found = compared.filter(linked).select("a", "b")
        links = found if links is None else links.unionByName(found)
        rows = compared.filter("n > 2").select(
            "group", F.col("a").alias("head"), F.col("b").alias("node"), "size", "n", (1 - F.col("similarity")).alias("far"),
            F.col("mask").bitwiseOR(F.when(linked, 1 << k).otherwise(0)).alias("mask"))
        state = rows.groupBy("group").agg(F.count(F.lit(1)).alias("unmet"), F.bit_and("mask").alias("common"), F.min(F.struct("far", "node")).alias("near"))
        left = rows.join(state.filter("unmet > 1 AND common = 0").select("group", F.col("near.node").alias("next")), "group")
        pairs = left.filter("node <> next").select(F.col("next").alias("a"), F.col("node").alias("b"), "group", "size", "n", "mask")

    labels = components(links)
    left = labelled(left, labels)
    mixed = left.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("group")
    # Nodes meet once for a head they share, not once for each of its groups.
    around = left.join(mixed, "group").groupBy("head", "node").agg(*[F.first(c).alias(c) for c in ("component", "size", "far")])
    open_ = _unsettled(stored(around, "around"), texts, threshold, shingle)
    more = stored(_compare(open_, texts, shingle).filter(F.col("similarity") >= threshold).select("a", "b"), "more")
    if not more.isEmpty():
        labels = connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    named = stored(labelled(nodes.select("node", "bag", "doc_id"), labels), "named")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    groups = smallest.join(named.select(F.col("node").alias("component"), F.col("bag").alias("name")), "component")
    classes = named.join(groups, "component").select(F.col("bag").alias("node"), F.col("name").alias("component"), "component_id")
    return (sketch.drop("bands", "size").join(classes, "node", "left")
            .select("doc_id", "text_hash", "component", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def without_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest id (of those, the smallest
    hash of the text); columns as they came. Rows equal in id and text count once."""
    marked = near_duplicates(docs.select("doc_id", "text"), **parameters)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    chosen = marked.filter("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("k")).select("k.doc_id", "k.text_hash")
    chosen = chosen.unionByName(marked.filter("component IS NULL").select("doc_id", "text_hash").distinct())
    keys = chosen.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    rows = docs.withColumn("__text_hash", F.xxhash64("text"))
    kept = rows.join(keys, rows["doc_id"].eqNullSafe(keys["__id"]) & (rows["__text_hash"] == keys["__hash"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__text_hash"]).select(docs.columns)
