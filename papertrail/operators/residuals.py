"""Residual cell tables: stable hotspots, blobs, repeated blocks, dispersion.

``residuals`` rows are (case_id, map_id, cell_x, cell_y, value), one per cell and map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.functions import scalars as S
from papertrail.functions.arrow import repeated_runs
from papertrail.operators.components import connected_components
from papertrail.operators.skew import exact_quantiles, with_following

CELL = ["case_id", "cell_x", "cell_y"]


def robust_z(df: DataFrame, keys: list[str], col: str, k: float, width: float = 1.0) -> DataFrame:
    """Distance above the median in units of k median absolute deviations, within 0 … 1."""
    middle = exact_quantiles(df, keys, col, {"__med": 0.5}, width)
    centred = df.join(middle, keys).withColumn("__dev", F.abs(F.col(col) - F.col("__med")))
    spread = exact_quantiles(centred, keys, "__dev", {"__mad": 0.5}, width)
    z = (F.col(col) - F.col("__med")) / (k * (F.col("__mad") + 1e-3))
    return centred.join(spread, keys).withColumn("z", S.clip(z, 0, 1)).drop("__med", "__dev", "__mad")


def stable_hotspots(residuals: DataFrame, suppressed: DataFrame, maps: int, z_min: float = 0.72, share: float | None = None,
                    k: float = 8.0) -> DataFrame:
    """Cells whose deviation persists over the maps. ``composite`` is the median
    deviation times the share of maps above ``z_min``; a cell has at most ``maps`` rows."""
    scored = robust_z(residuals, ["case_id", "map_id"], "value", k)
    cells = scored.groupBy(*CELL).agg(F.median("z").alias("mid"), (F.count_if(F.col("z") > z_min) / maps).alias("stability"))
    kept = cells.join(suppressed.select(*CELL).distinct(), CELL, "left_anti")
    limit = 2.0 / maps if share is None else share
    return kept.select(*CELL, "stability", (F.col("mid") * F.col("stability")).alias("composite"),
                       (F.col("stability") >= limit).alias("stable"))


def hotspot_stats(cells: DataFrame) -> DataFrame:
    spread = exact_quantiles(cells, ["case_id"], "composite", {"median": 0.5, "p90": 0.90, "p95": 0.95}, width=1 / 256)
    shares = cells.groupBy("case_id").agg(
        F.avg(F.col("stable").cast("double")).alias("area"),
        F.coalesce(F.avg(F.when(F.col("stable"), F.col("stability"))), F.lit(0.0)).alias("stability"))
    return shares.join(spread, "case_id")


def localization_score(stats: DataFrame, weights: tuple[float, float, float] = (0.40, 0.30, 0.30)) -> DataFrame:
    """Reward compact evidence: broad coverage scales the score down to nothing."""
    compact = S.clip(1.0 - F.greatest(F.lit(0.0), F.col("area") - 0.04) / 0.18, 0, 1)
    a, b, c = weights
    raw = (a * F.col("p95") + b * F.col("stability") + c * compact) * compact
    return stats.withColumns({"localization": compact, "score": S.clip(raw, 0, 0.65)})


def hotspot_blobs(hot: DataFrame, min_cells: int = 2) -> DataFrame:
    """8-connected groups of hot cells (case_id, cell_x, cell_y, score). Neighbours meet by
    equi-join on the four forward offsets, so work is linear in the cells."""
    node = F.struct(*CELL)
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1))])
    offers = hot.select(node.alias("a"), "case_id", "cell_x", "cell_y", F.explode(steps).alias("s")).select(
        "a", "case_id", (F.col("cell_x") + F.col("s.dx")).alias("cell_x"), (F.col("cell_y") + F.col("s.dy")).alias("cell_y"))
    edges = offers.join(hot.select(*CELL, node.alias("b")), CELL).select("a", "b")
    labels = connected_components(edges).select("node.*", "component")
    labelled = hot.join(labels, CELL, "left").withColumn("component", F.coalesce("component", node))
    blobs = labelled.groupBy("case_id", "component").agg(
        F.count(F.lit(1)).alias("cells"), F.min("cell_x").alias("x0"), F.min("cell_y").alias("y0"),
        F.max("cell_x").alias("x1"), F.max("cell_y").alias("y1"), F.avg("score").alias("score"))
    return blobs.filter(F.col("cells") >= min_cells).drop("component")


def suppression_mask(words: DataFrame, cell: int = 20, pad_x: float = 0.35, pad_y: float = 0.5) -> DataFrame:
    """Cells touched by padded word boxes. A word marks its cells in the few lines of cells it touches, 64 cells a number, so a
    line of words is one row before its cells are listed."""
    def cut(value: Column) -> Column:
        return value.cast("int")
    x0 = F.greatest(F.lit(0), cut(F.col("left") - F.col("width") * pad_x))
    y0 = F.greatest(F.lit(0), cut(F.col("top") - F.col("height") * pad_y))
    x1 = F.least("page_width", cut(F.col("left") + F.col("width") * (1 + pad_x)))
    y1 = F.least("page_height", cut(F.col("top") + F.col("height") * (1 + pad_y)))
    boxes = words.select("case_id", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).filter("x1 > x0 AND y1 > y0")

    def cells(low: str, high: str) -> tuple[Column, Column]:
        return F.floor(F.col(low) / cell), F.floor((F.col(high) - 1) / cell)
    first, last = cells("x0", "x1")
    lines = boxes.select("case_id", first.alias("first"), last.alias("last"), F.explode(F.sequence(*cells("y0", "y1"))).alias("cell_y"))
    blocks = lines.select("case_id", "cell_y", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / 64), F.floor(F.col("last") / 64))).alias("block"))
    marks = F.expr("shiftleft(-1L, CAST(greatest(0, first - block * 64) AS INT)) & shiftrightunsigned(-1L, CAST(63 - least(63, last - block * 64) AS INT))")
    marked = blocks.groupBy("case_id", "cell_y", "block").agg(F.bit_or(marks).alias("marks"))
    listed = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("marks", i) == 1))
    return marked.select("case_id", "cell_y", "block", listed.alias("i")).select("case_id", (F.col("block") * 64 + F.col("i")).alias("cell_x"), "cell_y")


def noise_divergence(cells: DataFrame, in_tile: Column) -> DataFrame:
    """Dispersion of one tile against the whole case."""
    spread = cells.groupBy("case_id").agg(F.stddev_pop("value").alias("sigma"),
                                          F.stddev_pop(F.when(in_tile, F.col("value"))).alias("tile_sigma"))
    divergence = F.abs(F.coalesce("tile_sigma", F.lit(0.0)) - F.col("sigma")) / F.greatest(F.lit(1e-6), "sigma")
    return spread.select("case_id", divergence.alias("divergence"),
                         (S.clip((divergence - 0.15) / 0.85, 0, 1) * 0.8).alias("score"))


def text_blocks(texts: DataFrame, tokens: Column, size: int = 5) -> DataFrame:
    """All runs of ``size`` tokens of a text with their positions."""
    starts = F.sequence(F.lit(0), F.size("__t") - size)
    blocks = F.when(F.size("__t") >= size, F.transform(starts, lambda i: F.array_join(F.slice("__t", i + 1, size), " ")))
    return texts.withColumn("__t", tokens).select("case_id", F.posexplode(blocks).alias("pos", "block"))


def repeated_blocks(texts: DataFrame, tokens: Column, size: int = 5) -> DataFrame:
    """The blocks of ``text_blocks`` that stand in their text more than once (by 64-bit hash, so rarely another one); the others
    match nothing and never become rows."""
    found = texts.select("case_id", tokens.alias("__t")).withColumn("__p", repeated_runs(F.col("__t"), size))
    blocks = F.transform("__p", lambda p: F.struct(p.alias("pos"), F.array_join(F.slice("__t", p + 1, size), " ").alias("block")))
    return found.select("case_id", F.inline(blocks))


def offset_voting(blocks: DataFrame, min_distance: int = 12, min_matches: int = 6, min_votes: int = 12) -> DataFrame:
    """Copy-move on block tables. Each block is matched with its next occurrence in
    the case (one match per block, never all pairs); matches vote for displacements."""
    linked = with_following(blocks, ["case_id", "block"], "pos", ["pos"], width=4096)
    matches = linked.withColumn("shift", F.col("next1_pos") - F.col("pos")).filter(F.col("shift") >= min_distance)
    votes = matches.groupBy("case_id", "shift").agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first_pos"),
                                                    F.max("pos").alias("last_pos"))
    totals = votes.groupBy("case_id").agg(F.sum("votes").alias("matched"))
    ratio = F.col("votes") / F.col("matched")
    return (votes.filter(F.col("votes") >= min_votes).join(totals.filter(F.col("matched") >= min_matches), "case_id")
            .withColumns({"ratio": ratio, "score": S.clip((ratio - 0.25) / 0.5, 0, 1)}))


def changed_cells_box(before: DataFrame, after: DataFrame, declared: tuple[int, int, int, int]) -> DataFrame:
    """Box (half-open) of cells that differ between two versions of a case, and whether
    it lies in the declared region; no differing cell means identical."""
    joined = before.select(*CELL, F.col("value").alias("a")).join(after.select(*CELL, F.col("value").alias("b")), CELL, "full")
    changed = ~F.col("a").eqNullSafe(F.col("b"))
    def edge(agg, col, plus=0):
        return agg(F.when(changed, F.col(col) + plus))
    boxes = joined.groupBy("case_id").agg(
        F.count_if(changed).alias("changed"), edge(F.min, "cell_x").alias("x0"), edge(F.min, "cell_y").alias("y0"),
        edge(F.max, "cell_x", 1).alias("x1"), edge(F.max, "cell_y", 1).alias("y1"))
    x0, y0, x1, y1 = declared
    inside = (F.col("x0") >= x0) & (F.col("y0") >= y0) & (F.col("x1") <= x1) & (F.col("y1") <= y1)
    return boxes.withColumn("state", F.when(F.col("changed") == 0, "identical").when(inside, "inside").otherwise("outside"))
