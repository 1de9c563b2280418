"""Hard negatives of anchors: the best rows of another label whose score lies in a window below a positive's score.

Components become integers, so scores are exact inner products. Every row stores its angles to a few reference
directions. For an anchor at angle a and a row at angle x to the same direction, the angle between both lies between
|a - x| and min(a + x, 2 pi - a - x); over all directions this gives an interval of cosines and, times both norms, of
scores. The interval is widened for rounding, so no row that belongs to the result is left out. Rows lie in order of
their nearest direction and angle, and bounds are taken for runs of neighbouring rows first, then for rows; only rows
whose interval meets the wanted window are scored in integers.

Rows are cut into blocks of a bounded number, anchors into slices; a task compares one slice with one block and passes
on the best few rows per anchor. Slices and blocks meet by an equi-join on their numbers: a row is shipped once per
slice, an anchor once per block. No label has a task of its own, so a label that holds most rows changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import bounded_batches, ddl, longs, positions, record_batch, stored
from papertrail.operators.skew import top_k

#: Rows of a block, anchors of a slice, neighbouring rows bounded together.
BLOCK, SLICE, RUN = 1 << 14, 1 << 16, 32
#: Reference directions, and rows they are chosen from (they decide about speed only).
REFERENCES, SAMPLE = 16, 512
#: Added to both ends of an interval: far above the rounding of an arc cosine, which is worst for parallel vectors.
SLACK = 1e-6
#: Squared norms below this keep every inner product, and every partial sum of one, within 64 bits.
_LARGEST = float(1 << 62)

PACKED = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()), ("ints", pa.binary()),
                    ("angles", pa.binary()), ("cell", pa.int64())])
BEST = longs("anchor", "score", "vec_id", "position")
NEGATIVES = longs("anchor", "anchor_id", "place", "positive_id", "positive_score", "score", "vec_id", "position")


def directions(sample: list[list[float]]) -> dict[int, np.ndarray]:
    """Per vector length, unit vectors that lie far apart among the sampled ones."""
    by_length: dict[int, list[np.ndarray]] = {}
    for vector in sample:
        v = np.array(vector, np.float64)
        size = np.linalg.norm(v)
        if 0 < size < np.inf:
            by_length.setdefault(len(v), []).append(v / size)
    chosen = {}
    for length, vectors in by_length.items():
        pool = np.stack(vectors)
        picks, nearest = [0], pool @ pool[0]
        while len(picks) < min(REFERENCES, len(pool)):
            picks.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, pool @ pool[picks[-1]])
        chosen[length] = pool[picks]
    return chosen


def _angles(ints: np.ndarray, refs: np.ndarray | None) -> np.ndarray:
    """Angles of rows to the reference directions; a right angle for rows without direction or references."""
    if refs is None:
        return np.full((len(ints), 1), np.pi / 2)
    sizes = np.linalg.norm(ints, axis=1)
    cosines = np.divide(ints @ refs.T, sizes[:, None], out=np.zeros((len(ints), len(refs))), where=sizes[:, None] > 0)
    return np.arccos(np.clip(cosines, -1, 1))


def _packed(vectors: DataFrame, anchors: Column, scale: float) -> DataFrame:
    """Rows that take part, with integer components, angles to the references and their nearest reference."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                           F.coalesce(anchors, F.lit(False)).alias("anchor"), x.alias("x")).filter(
        "vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND "
        "forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))")
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").collect()  # a bounded number of rows
    refs = directions([r["x"] for r in sample])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for vec_id, label, anchor, x in zip(*(batch[c].to_pylist() for c in ("vec_id", "label", "anchor", "x"))):
                ints = np.floor(scale * np.array(x, np.float64))
                if not ints @ ints < _LARGEST:
                    continue
                angles = _angles(ints[None], refs.get(len(x)))[0]
                rows.append((vec_id, label, anchor, ints.astype("<i8").tobytes(), angles.tobytes(), int(angles.argmin())))
            yield record_batch(rows, PACKED)

    bounded_batches(vectors.sparkSession)
    return valid.mapInArrow(pack, ddl(PACKED)).withColumn("n", F.length("ints"))


class Rows:
    """Rows of one block and one vector length, in order of label, nearest direction and angle, cut into runs."""

    def __init__(self, table: pa.Table):
        self.ints = np.frombuffer(b"".join(table["ints"].to_pylist()), "<i8").reshape(len(table), -1)
        angles = np.frombuffer(b"".join(table["angles"].to_pylist()), np.float64).reshape(len(table), -1)
        label, cell = table["label"].to_numpy(), table["cell"].to_numpy()
        by = np.lexsort((angles[np.arange(len(cell)), cell], cell, label))
        self.ints, self.angles, self.label = self.ints[by], angles[by], label[by]
        self.vec_id, self.position = table["vec_id"].to_numpy()[by], table["position"].to_numpy()[by]
        as_floats = self.ints.astype(np.float64)
        self.sizes = np.sqrt((as_floats ** 2).sum(axis=1))
        # Inner products below 2^53 are exact in doubles whatever the order of summation.
        self.small = as_floats if self.sizes.max(initial=0) < 2 ** 26 else None
        n = len(label)
        new = np.zeros(n, bool)
        new[::RUN] = True
        new[1:] |= label[by][1:] != label[by][:-1]
        self.starts = np.flatnonzero(new)
        self.ends = np.append(self.starts[1:], n)
        self.run_label = self.label[self.starts]
        self.low, self.high = np.minimum.reduceat(self.angles, self.starts), np.maximum.reduceat(self.angles, self.starts)
        self.least, self.most = np.minimum.reduceat(self.sizes, self.starts), np.maximum.reduceat(self.sizes, self.starts)

    def scores(self, ints: np.ndarray, size: float, at: np.ndarray) -> np.ndarray:
        if self.small is not None and size < 2 ** 26:
            return (self.small[at] @ ints.astype(np.float64)).astype(np.int64)
        return self.ints[at] @ ints

    def run_bounds(self, angles: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
        return score_bounds(self.low, self.high, self.least, self.most, angles, size)

    def rows_between(self, runs: np.ndarray, angles: np.ndarray, size: float, low: float, high: float) -> np.ndarray:
        """Rows of the runs whose bounds meet low … high."""
        if not len(runs):
            return np.zeros(0, np.int64)
        lengths = self.ends[runs] - self.starts[runs]
        at = np.repeat(self.starts[runs] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        least, most = score_bounds(self.angles[at], self.angles[at], self.sizes[at], self.sizes[at], angles, size)
        return at[(most >= low) & (least <= high)]

    def first(self, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places in ``at`` of the k highest scores; ties by the smaller vec_id, then position."""
        if len(at) > 4 * k:  # all that reach the k-th score
            keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        else:
            keep = np.arange(len(at))
        return keep[np.lexsort((self.position[at[keep]], self.vec_id[at[keep]], -scores[keep]))[:k]]


def score_bounds(low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray, angles: np.ndarray,
                 size: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score between an anchor and rows whose angles to the references lie in low … high and whose
    norms lie in least … most, by the triangle inequality of angles; widened for rounding."""
    near = np.maximum(low - angles, angles - high).max(axis=1) - SLACK
    far = np.minimum(high + angles, 2 * np.pi - low - angles).min(axis=1) + SLACK
    top, bottom = np.cos(np.clip(near, 0, np.pi)), np.cos(np.clip(far, 0, np.pi))
    upper = size * np.where(top > 0, most, least) * top
    lower = size * np.where(bottom > 0, least, most) * bottom
    slack = 1 + 1e-12 * size * most
    return np.floor(lower - slack), np.ceil(upper + slack)


def _anchors(table: pa.Table, length: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray, float]]:
    for row in table.to_pylist():
        if row["n"] == length:
            ints = np.frombuffer(row["ints"], "<i8")
            yield row, ints, np.frombuffer(row["angles"], np.float64), float(np.sqrt((ints.astype(np.float64) ** 2).sum()))


def _by_length(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    lengths = table["n"].to_numpy()
    for length in np.unique(lengths).tolist():
        yield length, table.take(pa.array(np.flatnonzero(lengths == length)))


def best_of_label(rows: pa.Table, anchors: pa.Table, k: int) -> pa.RecordBatch:
    """The k best rows of the anchor's own label within a block, the anchor itself left out."""
    out = []
    for length, part in _by_length(rows):
        block = Rows(part)
        for row, ints, angles, size in _anchors(anchors, length):
            own = np.flatnonzero(block.run_label == row["label"])
            if not len(own):
                continue
            _, upper = score_bounds(block.low[own], block.high[own], block.least[own], block.most[own], angles, size)
            # The runs that promise most, until they hold k other rows, set the score to be reached.
            by = np.argsort(-upper)
            enough = int(np.searchsorted(np.cumsum(block.ends[own[by]] - block.starts[own[by]]), k + 1)) + 1
            at = block.rows_between(own[by[:enough]], angles, size, -np.inf, np.inf)
            at = at[block.position[at] != row["position"]]
            found = block.scores(ints, size, at)
            floor = float(np.partition(found, len(found) - k)[len(found) - k]) if len(found) >= k else -np.inf
            rest = by[enough:]
            more = block.rows_between(own[rest[upper[rest] >= floor]], angles, size, floor, np.inf)
            more = more[block.position[more] != row["position"]]
            at, found = np.append(at, more), np.append(found, block.scores(ints, size, more))
            out += [(row["position"], int(found[i]), int(block.vec_id[at[i]]), int(block.position[at[i]]))
                    for i in block.first(at, found, k)]
    return record_batch(out, BEST)


def best_in_windows(rows: pa.Table, anchors: pa.Table, k: int, low: int, high: int) -> pa.RecordBatch:
    """For each positive of an anchor, the k best rows of another label within the positive's window, in a block."""
    out = []
    for length, part in _by_length(rows):
        block = Rows(part)
        for row, ints, angles, size in _anchors(anchors, length):
            # low * p <= 100 * s <= high * p; for p < 0 nothing lies in between.
            windows = [(-(-low * p["score"] // 100), high * p["score"] // 100, p) for p in row["positives"]]
            windows = [w for w in windows if w[0] <= w[1]]
            if not windows:
                continue
            least, most = min(w[0] for w in windows), max(w[1] for w in windows)
            lower, upper = block.run_bounds(angles, size)
            runs = np.flatnonzero((block.run_label != row["label"]) & (upper >= least) & (lower <= most))
            at = block.rows_between(runs, angles, size, least, most)
            found = block.scores(ints, size, at)
            for first, last, p in windows:
                inside = np.flatnonzero((found >= first) & (found <= last))
                for i in inside[block.first(at[inside], found[inside], k)]:
                    out.append((row["position"], row["vec_id"], p["place"], p["vec_id"], p["score"], int(found[i]),
                                int(block.vec_id[at[i]]), int(block.position[at[i]])))
    return record_batch(out, NEGATIVES)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50,
                   high: int = 95, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor and positive.

    ``vectors`` has vec_id, embedding, label (other columns are left out); ``anchors`` is a condition on them. A component
    x becomes floor(scale * x); a score is the inner product with the anchor; higher scores come first, ties by the smaller
    vec_id. Positives are the first ``positives`` other rows of the anchor's label. Their negatives are the first
    ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    Defined cases: rows with a null id, label, vector or component, or with a component that is not finite, take no part,
    nor do vectors whose integer components have a squared norm of 2^62 or more (their scores need not fit a long). Vectors
    of different lengths have no score with each other; zero and empty vectors score 0. Repeated rows are rows of their
    own, so a copy of an anchor may be its positive. An anchor without positives, or a positive without negatives, has
    no rows. Empty tables, or a condition that no row meets, give no rows.
    """
    # By length, direction and angle: neighbouring rows then fill a block.
    place = [F.col("n"), F.col("cell"), F.col("angles"), F.col("vec_id"), F.col("label")]
    rows = positions(stored(_packed(vectors, anchors, scale), "vectors"), place, "placed")
    asked = stored(rows.filter("anchor"), "anchors")
    counts = rows.agg(F.max("position"), F.count_if("anchor")).first()
    blocks, slices = (counts[0] or 0) // BLOCK + 1, max(1, -(-counts[1] // SLICE))
    dealt = rows.select("position", "vec_id", "label", "ints", "angles", "cell", "n",
                        F.floor(F.col("position") / BLOCK).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))

    def compare(anchor_rows: DataFrame, work, schema: pa.Schema) -> DataFrame:
        sent = anchor_rows.select("*", F.pmod(F.xxhash64("position"), F.lit(slices)).cast("int").alias("slice"),
                                  F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
        return dealt.groupBy("block", "slice").cogroup(sent.groupBy("block", "slice")).applyInArrow(
            lambda left, right: pa.Table.from_batches([work(left, right)]), ddl(schema))

    columns = ["position", "vec_id", "label", "ints", "angles", "n"]
    best = compare(asked.select(*columns), lambda a, b: best_of_label(a, b, positives), BEST)
    chosen = top_k(best, ["anchor"], [F.desc("score"), F.col("vec_id"), F.col("position")], positives, "place")
    lists = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(
        F.col("place").cast("long").alias("place"), "vec_id", "score"))).alias("positives"))  # at most ``positives`` each
    with_positives = stored(asked.select(*columns).join(lists.withColumnRenamed("anchor", "position"), "position"), "positives")
    found = compare(with_positives, lambda a, b: best_in_windows(a, b, negatives, low, high), NEGATIVES)
    ranked = top_k(found, ["anchor", "place"], [F.desc("score"), F.col("vec_id"), F.col("position")], negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                         "positive_score", F.col("score").alias("negative_score"))
