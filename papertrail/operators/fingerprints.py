"""Search by bit distance among 64-bit image fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.session import materialise

BITS = 64
#: Fingerprints of one band value that lie in one block.
CROWD = 4096
#: Pairs that a task compares at once, and pairs found that it passes on together.
_SLAB, _HELD = 1 << 18, 1 << 16


def from_hex(fingerprint: Column) -> Column:
    """A fingerprint of 16 hexadecimal digits as a long (the first digit may set the sign)."""
    def half(start: int) -> Column:
        return F.conv(F.substring(fingerprint, start, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def to_hex(code: Column) -> Column:
    return F.lpad(F.lower(F.hex(code)), 16, "0")


def distance(a: Column, b: Column) -> Column:
    """Number of differing bits."""
    return F.bit_count(a.bitwiseXOR(b))


def _bands(bands: int) -> list[tuple[int, int]]:
    """First bit and number of bits of every band."""
    return [(BITS * i // bands, BITS * (i + 1) // bands - BITS * i // bands) for i in range(bands)]


def _blocks(known: DataFrame, bands: int, crowd: int) -> DataFrame:
    """Fingerprints (code, n, id) under each of their band values, about ``crowd`` in a block at most: band, value, part, block."""
    values = [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("code", first).bitwiseAND(F.lit((1 << size) - 1)).alias("value"))
              for i, (first, size) in enumerate(_bands(bands))]
    listed = known.select("code", "n", "id", F.inline(F.array(*values)))
    at = ["band", "value"]
    parts = F.ceil(F.count(F.lit(1)) / max(1, crowd)).alias("parts")
    crowded = listed.groupBy(*at).agg(parts).filter("parts > 1")  # one row per ``crowd`` fingerprints at most
    part = F.pmod(F.xxhash64("code"), F.coalesce("parts", F.lit(1))).alias("part")
    dealt = listed.join(F.broadcast(crowded), at, "left").select(*at, part, "code", "n", "id")
    return dealt.groupBy(*at, "part").agg(F.collect_list(F.struct("code", "n", "id")).alias("block")).select(
        *at, "part", *[F.col(f"block.{c}").alias(c) for c in ("code", "n", "id")])


def _meet(blocks: DataFrame, bands: int) -> DataFrame:
    """Pairs of blocks whose values in a band are equal or differ in one bit, each pair once. They are dealt out as pairs, so
    the pairs of a common value do not stay in one task."""
    def above(size: int) -> Column:
        # The value itself and those with one bit more; with one bit less, the other block asks.
        more = [F.when(F.col("value").bitwiseAND(1 << b) == 0, F.col("value").bitwiseOR(1 << b)) for b in range(size)]
        return F.array_compact(F.array("value", *more))

    wanted = F.lit(None).cast("array<long>")
    for i, (_, size) in enumerate(_bands(bands)):
        wanted = F.when(F.col("band") == i, above(size)).otherwise(wanted)
    left = blocks.select("band", F.explode(wanted).alias("value"), F.col("value").alias("own"), F.col("part").alias("l_part"),
                         *[F.col(c).alias(f"l_{c}") for c in ("code", "n", "id")])
    right = blocks.select("band", "value", F.col("part").alias("r_part"), *[F.col(c).alias(f"r_{c}") for c in ("code", "n", "id")])
    met = left.join(right, ["band", "value"]).filter("own <> value OR l_part <= r_part").withColumn(
        "same", F.expr("own = value AND l_part = r_part"))
    count = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(count, "band", "value", "own", "l_part", "r_part").drop("value", "own", "l_part", "r_part")


def _compared(met: DataFrame, bands: int, limit: int) -> DataFrame:
    """Pairs at most ``limit`` bits apart in pairs of blocks. A pair counts in the first band that it meets in, so none is found twice."""
    masks = np.array([((1 << size) - 1) << first for first, size in _bands(bands)], np.uint64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = {s: batch[f"{s}_code"].offsets.to_numpy().tolist() for s in "lr"}
            codes = {s: batch[f"{s}_code"].values.to_numpy().view(np.uint64) for s in "lr"}
            known = {c: pa.concat_arrays([batch[f"l_{c}"].values, batch[f"r_{c}"].values]) for c in ("code", "n", "id")}
            held, size = [], 0

            def found() -> pa.RecordBatch:
                a, b, bits = (np.concatenate(c) for c in zip(*held))
                columns = {f"{c}_{s}": known[c].take(pa.array(at)) for c in ("n", "id") for s, at in (("a", a), ("b", b))}
                return pa.RecordBatch.from_pydict({"a": known["code"].take(pa.array(a)), "b": known["code"].take(pa.array(b)),
                                                   "bits": pa.array(bits, pa.int32()), **columns})

            for row, (band, same) in enumerate(zip(batch["band"].to_pylist(), batch["same"].to_pylist())):
                l0, l1, r0, r1 = *bounds["l"][row:row + 2], *bounds["r"][row:row + 2]
                a, b = codes["l"][l0:l1], codes["r"][r0:r1]
                step = max(1, _SLAB // len(b))
                for start in range(0, len(a), step):
                    apart = np.bitwise_count(a[start:start + step, None] ^ b)
                    at = np.flatnonzero(apart <= limit)
                    bits, (i, j) = apart.ravel()[at], np.divmod(at, len(b))
                    i += start
                    keep = i < j if same else np.ones(len(at), bool)
                    for mask in masks[:band]:
                        keep &= np.bitwise_count((a[i] ^ b[j]) & mask) > 1
                    if not keep.any():
                        continue
                    i, j = i[keep], j[keep]
                    turned = a[i].view(np.int64) > b[j].view(np.int64)
                    i, j = i + l0, j + r0 + len(codes["l"])
                    held.append((np.where(turned, j, i), np.where(turned, i, j), bits[keep]))
                    size += len(i)
                    if size >= _HELD:
                        yield found()
                        held, size = [], 0
            if held:
                yield found()

    kind = met.schema["l_id"].dataType.elementType.simpleString()
    return met.mapInArrow(compare, f"a long, b long, bits int, n_a long, n_b long, id_a {kind}, id_b {kind}")


def _near(known: DataFrame, limit: int, crowd: int) -> DataFrame:
    """All pairs of different fingerprints (code, n, id; one row each) at most ``limit`` bits apart, with what is known of both.

    The bits are cut into ``limit // 2 + 1`` bands. If every band differed in two bits, the pair would be too far apart, so
    some band differs in one at most: blocks of equal band values meet, and those of values one bit apart. What is found
    grows with the square of the table; a task holds one pair of blocks, and nothing found moves again.
    """
    bands = max(2, limit // 2 + 1)
    return _compared(_meet(materialise(_blocks(materialise(known), bands, crowd)), bands), bands, limit)


def neighbours(prints: DataFrame, limit: int = 8, crowd: int = CROWD) -> DataFrame:
    """All pairs of different fingerprints at most ``limit`` bits apart: longs ``a`` and ``b`` (a < b) and ``bits``.

    ``prints`` has a long column ``fingerprint``; copies are one fingerprint here (see ``members``), nulls are left out.
    Band values that more than ``crowd`` fingerprints have are cut into blocks, which meet in pairs.
    """
    codes = prints.filter("fingerprint IS NOT NULL").select(F.col("fingerprint").alias("code")).distinct()
    return _near(codes.withColumns({"n": F.lit(1).cast("long"), "id": F.lit(0).cast("long")}), limit, crowd).select("a", "b", "bits")


def members(prints: DataFrame) -> DataFrame:
    """Rows per fingerprint: ``fingerprint``, ``n`` and the smallest ``id``."""
    return prints.filter("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))


def near_copies(prints: DataFrame, limit: int = 8) -> DataFrame:
    """``neighbours`` with the number of rows and the smallest id of both fingerprints (``prints``: id, fingerprint)."""
    known = members(prints).select(F.col("fingerprint").alias("code"), "n", "id")
    return _near(known, limit, CROWD)
