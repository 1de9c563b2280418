"""Recognised words: blocks, roll-ups, layout outliers, label-value joins.

Pixel columns (left, top, width, height) are integers inside a page, so exact
medians over them use the built-in aggregate: its buffer holds one counter per
distinct pixel value and combines map-side, whatever the number of words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from papertrail.functions import scalars as S
from papertrail.functions.arrow import DEVIANT, DRIFT, OFF, SUMMARY_CORNERS, page_columns, page_layout, page_rows, pages_read
from papertrail.operators.skew import CROWD, first_from, gap_clusters, hot_keys, row_numbers, split_hot, with_following
from papertrail.session import materialise

BAND = 32  # pixel height of the horizontal bands that words and search windows meet in
PAIRS = 1 << 20  # pairs of words of a page that are compared at a time


def usable(words: DataFrame, floor: float) -> DataFrame:
    """Words that are readable: not blank, positive size, confidence at least ``floor``."""
    return words.filter((F.trim("text") != "") & (F.col("width") > 0) & (F.col("height") > 0)
                        & (F.col("conf") >= floor))


def unit_box() -> Column:
    return S.unit_box(F.col("left"), F.col("top"), F.col("left") + F.col("width"), F.col("top") + F.col("height"),
                      F.col("page_width"), F.col("page_height"))


def ocr_blocks(words: DataFrame) -> DataFrame:
    """Words as blocks in page units, weak ones tagged."""
    return words.filter(F.col("conf") >= 0).select(
        "case_id", "idx", "text", S.fix(F.col("left") / F.col("page_width"), 4).alias("x"),
        S.fix(F.col("top") / F.col("page_height"), 4).alias("y"),
        S.fix(F.col("width") / F.col("page_width"), 4).alias("width"),
        S.fix(F.col("height") / F.col("page_height"), 4).alias("height"),
        S.fix(F.col("conf") / 100, 3).alias("confidence"),
        F.when(F.col("conf") < 40, F.array(F.lit("low-confidence"))).otherwise(F.array().cast("array<string>"))
        .alias("anomalies"))


def ocr_rollup(words: DataFrame) -> DataFrame:
    """Word count and mean confidence (over words with one) per case."""
    known = F.when(F.col("conf") >= 0, F.col("conf"))
    return words.groupBy("case_id").agg(F.count(F.lit(1)).alias("word_count"),
                                        F.coalesce(F.avg(known), F.lit(0.0)).alias("mean_confidence"))


def ocr_text(words: DataFrame, gap: float = 18) -> DataFrame:
    """Text of every line of a page, its words from left to right: case_id, line (0, 1, … down the page), top, text. Words of
    one line start some pixels apart, so a line ends where the next word starts more than ``gap`` lower."""
    lined = gap_clusters(words, ["case_id"], "top", gap, width=1024, out="line")
    return lined.groupBy("case_id", "line").agg(F.min("top").alias("top"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("left", "idx", "text"))), lambda w: w["text"]), " ").alias("text"))


def ocr_floor(blocks: DataFrame, floor: float = 0.80) -> DataFrame:
    """Blocks below the confidence floor, the worst of them, and how grave that is."""
    low = F.col("confidence") < floor
    found = blocks.groupBy("case_id").agg(F.count_if(low).alias("low_blocks"), F.min_by(
        F.struct("confidence", "text"), F.struct("confidence", "idx")).alias("worst"))
    return found.select("case_id", "low_blocks", F.col("worst.confidence").alias("worst_confidence"),
                        F.col("worst.text").alias("worst_text"),
                        F.when(F.col("low_blocks") > 2, "medium").when(F.col("low_blocks") > 0, "low")
                        .otherwise("none").alias("severity"))


def _typical(height: Column) -> Column:
    return F.when(height == 0, 12.0).otherwise(height)


def _sum_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def _corners(condition: Column, name: str) -> list[Column]:
    return [F.min(F.when(condition, F.col("x0"))).alias(f"{name}_x0"), F.min(F.when(condition, F.col("y0"))).alias(f"{name}_y0"),
            F.max(F.when(condition, F.col("x1"))).alias(f"{name}_x1"), F.max(F.when(condition, F.col("y1"))).alias(f"{name}_y1")]


def _by_page(words: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame | None]:
    """Pages as arrays of words, and the words of pages with more than ``crowd`` ones (None where there is none)."""
    words = words.filter("case_id IS NOT NULL").select("case_id", "left", "top", "width", "height", "conf")
    hot = hot_keys(words.select("case_id"), ["case_id"], crowd)
    crowded = None
    if hot is not None:
        words, crowded = split_hot(words, ["case_id"], hot)
    return words.groupBy("case_id").agg(F.collect_list(F.struct("left", "top", "width", "height", "conf")).alias("page")), crowded


def read_pages(words: DataFrame, entry: tuple[Column | str, ...], readers, fields: list[StructField], crowd: int) -> tuple[DataFrame, DataFrame | None]:
    """What ``readers`` say of pages (``arrow.pages_read``), from ``entry`` of their words; and the words of pages with more than ``crowd``
    ones (None where there is none). Words move once at most, and are put in order by page; no page becomes a row."""
    words = words.filter("case_id IS NOT NULL")
    hot = hot_keys(words.select("case_id"), ["case_id"], crowd)
    crowded = None
    if hot is not None:
        words, crowded = split_hot(words, ["case_id"], hot)
    # The window comes first: what makes the words and what reads them would else be one method, too large to be compiled.
    lain = words.withColumn("page_words", F.count(F.lit(1)).over(Window.partitionBy("case_id"))).select("case_id", *entry, "page_words")
    return lain.mapInArrow(pages_read(readers, fields), StructType([words.schema["case_id"], *fields])), crowded


def pixels(found: DataFrame, words: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Corners in the types of the words' boxes."""
    kinds = {a: words.select((F.col(a) + F.col(b)).alias("s")).schema["s"].dataType for a, b in (("left", "width"), ("top", "height"))}
    own = {"x0": words.schema["left"].dataType, "y0": words.schema["top"].dataType, "x1": kinds["left"], "y1": kinds["top"]}
    return found.withColumns({n: F.col(n).cast(own[n[-2:]]) for n in names})


def row_outliers(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Per text row of a case: weak line, odd font sizes, baseline drift.

    The words of a page are gathered and judged where they lie (``arrow.page_rows``), many pages at a time; pages of more
    than ``crowd`` words are counted by all tasks (``_crowded_rows``).
    """
    pages, crowded = _by_page(words, crowd)
    found = pixels(pages.select("case_id", F.inline(page_rows(F.col("page")))), words, DEVIANT + DRIFT)
    return found if crowded is None else found.unionByName(_crowded_rows(crowded))


def column_outliers(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Per column (chained clusters of word centres): words off the median left edge. Pages as in ``row_outliers``."""
    pages, crowded = _by_page(words, crowd)
    found = pixels(pages.select("case_id", F.inline(page_columns(F.col("page")))), words, OFF)
    return found if crowded is None else found.unionByName(_crowded_columns(crowded))


def _crowded_rows(words: DataFrame) -> DataFrame:
    """``row_outliers`` of pages that no task takes whole.

    Words are first counted per (case, top, height), which is all the rules look at;
    the map-side combine leaves at most one row per pixel pair of a page. That small
    table is computed once.
    """
    shapes = materialise(words.groupBy("case_id", "top", "height").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("conf") < 40).alias("weak_n"), F.min("left").alias("x0"),
        F.max(F.col("left") + F.col("width")).alias("x1")))
    stats = shapes.groupBy("case_id").agg(F.percentile("height", F.lit(0.5), F.col("n")).alias("m"), F.sum("n").alias("case_words"))
    sized = shapes.join(stats.select("case_id", _typical(F.col("m")).alias("typ_h"), "case_words"), "case_id")
    sized = sized.withColumns({"row": F.floor(F.col("top") / F.greatest(F.lit(2.0), F.col("typ_h") * 0.5)),
                               "y0": F.col("top"), "y1": F.col("top") + F.col("height")})
    rows = sized.groupBy("case_id", "row").agg(
        (F.sum("weak_n") >= 3).alias("weak"), F.sum("n").alias("row_words"),
        F.percentile("y1", F.lit(0.5), F.col("n")).alias("med_bottom"), F.percentile("height", F.lit(0.5), F.col("n")).alias("med_height"))
    marked = sized.join(rows, ["case_id", "row"])
    odd = (F.col("typ_h") > 6) & ((F.col("height") > 2.0 * F.col("typ_h")) | (F.col("height") < 0.45 * F.col("typ_h")))
    drift = (F.col("row_words") >= 4) & (F.abs(F.col("y1") - F.col("med_bottom"))
                                         > 2.5 * F.greatest(F.lit(5.0), 0.12 * F.col("med_height")))
    marked = marked.withColumns({"is_weak": F.col("weak"), "is_odd": ~F.col("weak") & odd, "is_drift": drift})
    return marked.groupBy("case_id", "row").agg(
        F.max("case_words").alias("case_words"), F.max("typ_h").alias("typ_h"), _sum_if(F.col("is_weak")).alias("weak_words"),
        _sum_if(F.col("is_odd")).alias("odd_words"), _sum_if(F.col("is_drift")).alias("drift_words"),
        *_corners(F.col("is_weak") | F.col("is_odd"), "dev"), *_corners(F.col("is_drift"), "drift"))


def _crowded_columns(words: DataFrame) -> DataFrame:
    """``column_outliers`` of such pages. Words are counted per (case, left, width, height) first, as in ``_crowded_rows``."""
    shapes = materialise(words.groupBy("case_id", "left", "width", "height").agg(
        F.count(F.lit(1)).alias("n"), F.min("top").alias("y0"), F.max(F.col("top") + F.col("height")).alias("y1")))
    stats = shapes.groupBy("case_id").agg(F.percentile("height", F.lit(0.5), F.col("n")).alias("m"))
    sized = shapes.join(stats.select("case_id", F.greatest(F.lit(24.0), _typical(F.col("m"))).alias("reach")), "case_id")
    sized = sized.withColumns({"centre": F.col("left") + F.col("width") / 2, "x0": F.col("left"), "x1": F.col("left") + F.col("width")})
    clustered = gap_clusters(sized, ["case_id"], "centre", "reach", width=256, out="column")
    columns = clustered.groupBy("case_id", "column").agg(
        F.sum("n").alias("column_words"), F.percentile("left", F.lit(0.5), F.col("n")).alias("med_left"),
        F.percentile("width", F.lit(0.5), F.col("n")).alias("med_width"))
    marked = clustered.join(columns, ["case_id", "column"])
    off = (F.col("column_words") >= 3) & (F.abs(F.col("left") - F.col("med_left"))
                                          > 2.0 * F.greatest(F.lit(6.0), 0.5 * F.col("med_width")))
    return marked.withColumn("is_off", off).groupBy("case_id", "column").agg(
        _sum_if(F.col("is_off")).alias("off_words"), F.max("column_words").alias("column_words"), *_corners(F.col("is_off"), "off"))


def crowded_layout(words: DataFrame) -> DataFrame:
    """Counts and corners per case of pages that no task takes whole."""
    rows = _crowded_rows(words)
    drifting = F.col("drift_words") >= 2
    by_case = rows.groupBy("case_id").agg(
        F.max("case_words").alias("words"), F.sum("weak_words").alias("weak_words"),
        F.sum("odd_words").alias("odd_words"), F.max(drifting.cast("int")).alias("baseline_sets"),
        F.least(F.min("dev_x0"), F.min(F.when(drifting, F.col("drift_x0")))).alias("rx0"),
        F.least(F.min("dev_y0"), F.min(F.when(drifting, F.col("drift_y0")))).alias("ry0"),
        F.greatest(F.max("dev_x1"), F.max(F.when(drifting, F.col("drift_x1")))).alias("rx1"),
        F.greatest(F.max("dev_y1"), F.max(F.when(drifting, F.col("drift_y1")))).alias("ry1"))
    off = F.col("off_words") >= 3
    by_column = _crowded_columns(words).groupBy("case_id").agg(
        F.max(off.cast("int")).alias("column_sets"), F.min(F.when(off, F.col("off_x0"))).alias("cx0"),
        F.min(F.when(off, F.col("off_y0"))).alias("cy0"), F.max(F.when(off, F.col("off_x1"))).alias("cx1"),
        F.max(F.when(off, F.col("off_y1"))).alias("cy1"))
    return by_case.join(by_column, "case_id")


def layout_layer(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Layout score of a case: deviant words (plus one per outlier set) over all words.
    Fewer than 20 words, or fewer than two deviants, is neutral. Pages as in ``row_outliers``."""
    pages, crowded = _by_page(words, crowd)
    found = pixels(pages.select("case_id", page_layout(F.col("page")).alias("p")).select("case_id", "p.*"), words, SUMMARY_CORNERS)
    return layout_judged(found if crowded is None else found.unionByName(crowded_layout(crowded)))


def layout_judged(found: DataFrame) -> DataFrame:
    """Layout layer from the summaries of pages."""
    joined = found.filter("words > 0").withColumns({c: F.col(c).cast("int") for c in ("baseline_sets", "column_sets")})
    joined = joined.withColumns({c: F.col(c).cast("long") for c in ("words", "weak_words", "odd_words")})
    deviants = F.col("weak_words") + F.col("odd_words") + F.col("baseline_sets") + F.col("column_sets")
    live = (F.col("words") >= 20) & (deviants >= 2)
    score = F.when(live, F.least(F.lit(1.0), deviants / F.col("words"))).otherwise(0.0)
    return joined.select(
        "case_id", "words", "weak_words", "odd_words", "baseline_sets", "column_sets", deviants.alias("deviants"),
        score.alias("score"), F.when(live, S.clip(0.35 + score * 0.55, 0.35, 0.95)).otherwise(0.0).alias("confidence"),
        *[F.when(live, fn(a, b)).alias(n) for fn, a, b, n in (
            (F.least, "rx0", "cx0", "x0"), (F.least, "ry0", "cy0", "y0"),
            (F.greatest, "rx1", "cx1", "x1"), (F.greatest, "ry1", "cy1", "y1"))])


def grid_residuals(words: DataFrame, residual: float = 0.02) -> DataFrame:
    """Left-margin residuals against the upper median, and spread of interline gaps."""
    placed = words.withColumns({"x": F.col("left") / F.col("page_width"), "y": F.col("top") / F.col("page_height")})
    margin = placed.groupBy("case_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x DESC)").alias("margin"))
    outliers = placed.join(margin, "case_id").groupBy("case_id").agg(
        F.max("margin").alias("margin"), F.count_if(F.abs(F.col("x") - F.col("margin")) > residual).alias("outliers"))
    gaps = with_following(placed.select("case_id", "idx", "y"), ["case_id"], "idx", ["y"])
    spread = gaps.groupBy("case_id").agg(F.coalesce(F.stddev_samp(F.col("next1_y") - F.col("y")), F.lit(0.0))
                                         .alias("gap_sigma"))
    return outliers.join(spread, "case_id")


def bands(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / BAND), F.floor(high / BAND)))


def value_right(words: DataFrame, labels: list[str]) -> DataFrame:
    """For each label word, the nearest amount to its right on the same line."""
    anchors = words.filter(S.label_match(F.col("text"), labels) & (F.col("height") > 0)).select(
        "case_id", F.col("idx").alias("label_idx"), F.col("text").alias("label"), "left", "top", "width", "height")
    return values_beside(words, anchors).select("case_id", "label_idx", "label", F.col("v.idx").alias("value_idx"), F.col("v.gap").alias("gap"),
                                                S.parse_number(F.col("v.text")).alias("value"))


def values_beside(words: DataFrame, anchors: DataFrame, crowd: int = 1024) -> DataFrame:
    """Per anchor (case_id, label_idx, label, left, top, width, height) the nearest amount ``v`` (gap, idx, text, conf, left,
    top, width, height) that starts at its right edge or behind it, its middle at most a typical word height off.

    Amounts whose middles lie at one height are a line; an anchor asks every line it can see for its first amount from
    the edge on. A page has few lines, so anchors never meet all amounts beside them. Lines are arrays; on pages with a line
    of more than ``crowd`` words the look-up is an as-of over rows (``skew.first_from``).
    """
    sized = words.filter(F.col("height") > 0).withColumn("middle", 2 * F.col("top") + F.col("height"))
    long = hot_keys(sized.select("case_id", "middle"), ["case_id", "middle"], crowd)
    if long is None:
        return _values_on_lines(sized, anchors)
    pages = long.select("case_id").distinct()
    (sized, many), (anchors, asking) = split_hot(sized, ["case_id"], pages), split_hot(anchors, ["case_id"], pages)
    return _values_on_lines(sized, anchors).unionByName(_values_in_rows(many, asking))


def _asking(sized: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors once per band of the page that they can see."""
    heights = sized.groupBy("case_id").agg(_typical(F.median("height")).alias("typ_h"))
    at = 2 * F.col("top") + F.col("height")
    return anchors.join(heights, "case_id").select(
        "case_id", "label_idx", "label", at.alias("own"), "typ_h", (F.col("left") + F.col("width")).alias("right")).withColumn(
        "band", bands(F.col("own") / 2 - F.col("typ_h"), F.col("own") / 2 + F.col("typ_h")))


def _amounts(sized: DataFrame) -> DataFrame:
    return sized.filter(S.is_amount(F.col("text")) & S.parse_number(F.col("text")).isNotNull())


def _nearest_value(found: DataFrame) -> DataFrame:
    order = ["idx", "text", "conf", "left", "top", "width", "height"]
    return found.filter("found IS NOT NULL").groupBy("case_id", "label_idx", "label").agg(
        F.min(F.struct((F.col("found.left") - F.col("right")).alias("gap"), *[F.col(f"found.{c}").alias(c) for c in order])).alias("v"))


def _values_on_lines(sized: DataFrame, anchors: DataFrame) -> DataFrame:
    lines = _amounts(sized).groupBy("case_id", "middle").agg(
        F.collect_list(F.struct("left", "idx", "text", "conf", "top", "width", "height")).alias("items"))
    seen = _asking(sized, anchors).join(lines.withColumn("band", F.floor(F.col("middle") / 2 / BAND)), ["case_id", "band"]).filter(
        F.abs(F.col("middle") - F.col("own")) <= 2 * F.col("typ_h"))
    return _nearest_value(seen.withColumn("found", F.array_min(F.filter("items", lambda v: v["left"] >= F.col("right") - 2))))


def _values_in_rows(sized: DataFrame, anchors: DataFrame) -> DataFrame:
    amounts = _amounts(sized)
    lines = amounts.select("case_id", "middle").distinct().withColumn("band", F.floor(F.col("middle") / 2 / BAND))
    asks = _asking(sized, anchors).join(lines, ["case_id", "band"]).filter(F.abs(F.col("middle") - F.col("own")) <= 2 * F.col("typ_h")).select(
        "case_id", "middle", "label_idx", "label", "right", (F.col("right") - 2).alias("at"))
    value = F.struct("idx", "text", "conf", "left", "top", "width", "height")
    return _nearest_value(first_from(asks, amounts.withColumn("at", F.col("left")), ["case_id", "middle"], "at", value, width=256))


def last_label(words: DataFrame, labels: list[str]) -> DataFrame:
    """Bottom-most label of a case in reading order."""
    hits = words.filter(S.label_match(F.col("text"), labels))
    return hits.groupBy("case_id").agg(F.max_by(F.struct("idx", "text", "top", "left"),
                                                F.struct("top", "left", "idx")).alias("w")).select("case_id", "w.*")


def anchored_clusters(values: Column, gap: float) -> Column:
    """Start values of greedy clusters: a value opens a cluster when it lies more than
    ``gap`` beyond the start of the current one."""
    return F.aggregate(F.array_sort(values), F.array().cast("array<double>"),
                       lambda starts, v: F.when((F.size(starts) == 0) | (v - F.element_at(starts, -1) > gap),
                                                F.concat(starts, F.array(v))).otherwise(starts))


def assign_columns(words: DataFrame, row_keys: list[str], centres: list[float], span: float = 55.0) -> DataFrame:
    """First word (page order) per row and column; a word belongs to the nearest
    centre if that is within ``span``."""
    middle = F.col("left") + F.col("width") / 2
    nearest = F.array_min(F.array(*[F.struct(F.abs(middle - c).alias("d"), F.lit(i).alias("i"))
                                    for i, c in enumerate(centres)]))
    placed = words.withColumn("__n", nearest).filter(F.col("__n.d") <= span).withColumn("column", F.col("__n.i"))
    return placed.groupBy(*row_keys, "column").agg(F.min_by(
        F.struct("idx", "text"), F.struct("top", "left", "idx")).alias("w")).select(*row_keys, "column", "w.*")


def _nearest_within(primary: DataFrame, reference: DataFrame, rx: Column, ry: Column, reach_x: float, reach_y: float) -> DataFrame:
    """Best match ``m`` at most (rx, ry) away, NULL where there is none. Cells are four
    radii wide; a reference word is listed in each cell its search square touches
    (about two), a primary word in its own."""
    def cells(value: str, r: Column) -> Column:
        return F.explode(F.sequence(F.floor((F.col(value) - r) / (r * 4)), F.floor((F.col(value) + r) / (r * 4))))
    spread = reference.withColumn("__cx", cells("rx", rx)).withColumn("__cy", cells("ry", ry)).drop("radius")
    own = primary.withColumns({"__cx": F.floor(F.col("nx") / (rx * 4)), "__cy": F.floor(F.col("ny") / (ry * 4))})
    at = ["case_id", "__cx", "__cy"]  # grouping by them too, the rows stay where the join put them
    near = own.join(spread, at, "left")
    dx, dy = F.abs(F.col("rx") - F.col("nx")), F.abs(F.col("ry") - F.col("ny"))
    match = F.when((dx <= rx) & (dy <= ry) & (dx < reach_x) & (dy < reach_y),
                   F.struct((dx + dy).alias("d"), "ry", "rx", "ridx", "rtext"))
    return near.groupBy(*at, *[c for c in primary.columns if c != "case_id"]).agg(F.min(match).alias("m")).drop("__cx", "__cy")


def _nearest_crowded(primary: DataFrame, reference: DataFrame, reach_x: float, reach_y: float) -> DataFrame:
    """``nearest_words`` of pages that no task takes whole.

    The first search radius fits the page's word density. A match closer than the
    radius is final, because everything closer lies inside it too; only the words
    left over search four times as far and at last the full window. Dense pages thus
    never meet all their words. Ties go to the first word in (y, x) order. Each pass
    is materialised, so the next one starts from its leftovers.
    """
    def centre(size: str, start: str, page: str) -> Column:
        return (F.col(start) + F.col(size) / 2) / F.greatest(F.lit(1), F.col(page))
    density = reference.groupBy("case_id").agg(
        F.least(F.lit(reach_y), 0.5 / F.sqrt(F.count(F.lit(1)))).alias("radius"))
    left = primary.select("case_id", "idx", "text", centre("width", "left", "page_width").alias("nx"),
                          centre("height", "top", "page_height").alias("ny")).join(density, "case_id")
    right = reference.select("case_id", F.col("idx").alias("ridx"), F.col("text").alias("rtext"),
                             centre("width", "left", "page_width").alias("rx"),
                             centre("height", "top", "page_height").alias("ry")).join(density, "case_id")
    rest, found = left, None
    for factor in (1, 4):
        radius = F.col("radius") * factor
        tried = materialise(_nearest_within(rest, right, radius, radius, reach_x, reach_y))
        near = F.col("m").isNotNull() & (F.col("m.d") < radius)
        final = tried.filter(near)
        found = final if found is None else found.unionByName(final)
        rest = tried.filter(~near).drop("m")
    last = _nearest_within(rest, right, F.lit(reach_x), F.lit(reach_y), reach_x, reach_y).filter(F.col("m").isNotNull())
    return found.unionByName(last).select("case_id", "idx", "text", F.col("m.ridx").alias("ridx"), F.col("m.rtext").alias("rtext"),
                                          F.col("m.d").alias("distance"))


def _nearest_on_page(nx, ny, rx, ry, ridx, reach_x: float, reach_y: float):
    """Positions of words and of their nearest reference words, and the distances, all on one page. Cells are as wide as the
    search radius, so a word meets the cells around it only; radii as in ``_nearest_crowded``."""
    rank = np.lexsort((ridx, rx, ry))  # ties go to the first of these
    rx, ry = rx[rank], ry[rank]
    rest, found = np.arange(len(nx)), []
    for factor in (1, 4, None):
        radius = min(reach_y, 0.5 / np.sqrt(len(rx))) * (factor or 1)
        hx, hy = (radius, radius) if factor else (reach_x, reach_y)

        def cells(values, size):
            return np.floor(values / (size * (1 + 1e-9))).astype(np.int64)
        cx, cy = cells(rx, hx), cells(ry, hy)
        px, py = cells(nx[rest], hx), cells(ny[rest], hy)
        first, wide = min(cx.min(), px.min()) - 1, max(cx.max(), px.max()) - min(cx.min(), px.min()) + 3
        own = cy * wide + cx - first
        order = np.argsort(own, kind="stable")
        own = own[order]
        at = np.concatenate([(py + step) * wide + px - first for step in (-1, 0, 1)])
        low, high = np.searchsorted(own, at - 1, "left"), np.searchsorted(own, at + 1, "right")
        count = (high - low).reshape(3, -1)
        low = low.reshape(3, -1)
        ends = np.cumsum(count.sum(axis=0))
        final = np.zeros(len(rest), dtype=bool)
        begin = 0
        while begin < len(rest):  # some words at a time, by the pairs they make
            done = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            sizes, starts = count[:, begin:stop].ravel(), low[:, begin:stop].ravel()
            word = np.repeat(np.tile(np.arange(begin, stop), 3), sizes)
            place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
            other = order[place]
            dx, dy = np.abs(rx[other] - nx[rest[word]]), np.abs(ry[other] - ny[rest[word]])
            d = dx + dy
            near = (dx <= hx) & (dy <= hy) & (dx < reach_x) & (dy < reach_y)
            if factor:
                near &= d < radius
            word, other, d = word[near], other[near], d[near]
            by = np.lexsort((other, d, word))
            head = by[np.flatnonzero(np.diff(word[by], prepend=-1))]
            final[word[head]] = True
            found.append((rest[word[head]], rank[other[head]], d[head]))
            begin = stop
        rest = rest[~final]
        if not len(rest):
            break
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _match_page(reach_x: float, reach_y: float, kept: list[str]):
    """Arrow function over the words and the reference words of one page."""
    def match(left, right):
        import pyarrow as pa

        def centres(table):
            def centre(start, size, page):
                a, b, c = (table[n].to_numpy().astype("float64") for n in (start, size, page))
                return (a + b / 2) / np.maximum(1.0, c)
            return centre("left", "width", "page_width"), centre("top", "height", "page_height")
        if len(np.unique(left["idx"].to_numpy())) < left.num_rows:  # equal words count once
            left = left.group_by(left.column_names, use_threads=False).aggregate([])
        (nx, ny), (rx, ry) = centres(left), centres(right)
        words, others = np.flatnonzero(np.isfinite(nx + ny)), np.flatnonzero(np.isfinite(rx + ry))
        if len(words) and len(others):
            a, b, d = _nearest_on_page(nx[words], ny[words], rx[others], ry[others], right["idx"].to_numpy()[others], reach_x, reach_y)
            a, b = words[a], others[b]
        else:
            a, b, d = np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)
        mine, theirs = left.take(pa.array(a)), right.take(pa.array(b))
        out = {"case_id": mine["case_id"], "idx": mine["idx"], "text": mine["text"], "ridx": theirs["idx"], "rtext": theirs["text"],
               "distance": pa.array(d), **{c: mine[c] for c in kept}}
        return pa.table(out)
    return match


def nearest_words(primary: DataFrame, reference: DataFrame, reach_x: float = 0.16, reach_y: float = 0.045, keep: list[str] = (),
                  crowd: int = CROWD) -> DataFrame:
    """Nearest reference word (L1 distance of centres in page units) of each word, with the columns ``keep`` of the word's box.

    Words of a page meet on that page: both sides move once by case, and the search inside is per cell of the page. Pages of
    more than ``crowd`` words on both sides together are searched by all tasks (``_nearest_crowded``). Ties go to the first
    word in (y, x) order.
    """
    box = ["left", "top", "width", "height", "page_width", "page_height"]
    left, right = (df.select("case_id", "idx", "text", *box) for df in (primary, reference))
    hot = hot_keys(left.select("case_id").unionAll(right.select("case_id")), ["case_id"], crowd)
    crowded = None
    if hot is not None:
        (left, left_hot), (right, right_hot) = split_hot(left, ["case_id"], hot), split_hot(right, ["case_id"], hot)
        crowded = _nearest_crowded(left_hot, right_hot, reach_x, reach_y)
        if keep:
            crowded = crowded.join(left_hot.select("case_id", "idx", "text", *keep).distinct(), ["case_id", "idx", "text"])
    kinds = {c: left.schema[c].dataType for c in left.columns}
    schema = StructType([StructField(n, kind) for n, kind in (
        ("case_id", kinds["case_id"]), ("idx", kinds["idx"]), ("text", kinds["text"]), ("ridx", right.schema["idx"].dataType),
        ("rtext", right.schema["text"].dataType), ("distance", DoubleType()), *((c, kinds[c]) for c in keep))])
    found = left.groupBy("case_id").cogroup(right.groupBy("case_id")).applyInArrow(_match_page(reach_x, reach_y, list(keep)), schema)
    return found if crowded is None else found.unionByName(crowded)


def word_differences(primary: DataFrame, reference: DataFrame, floor: float = 20, max_similarity: float = 0.8, keep: list[str] = ()) -> DataFrame:
    """Words whose nearest reference word reads differently, with the columns ``keep`` of their boxes."""
    from papertrail.functions.arrow import similarity
    paired = nearest_words(primary.filter((F.trim("text") != "") & (F.col("conf") >= floor)), reference, keep=keep)
    changed = materialise(paired.withColumns({"__a": F.lower(F.trim("text")), "__b": F.lower(F.trim("rtext"))}).filter("__a <> __b"))
    # Pairs of readings repeat from page to page, so each is rated once.
    rated = changed.select("__a", "__b").distinct().withColumn("similarity", similarity(F.col("__a"), F.col("__b")))
    differing = rated.filter(F.col("similarity") < max_similarity)
    return materialise(changed.join(differing, ["__a", "__b"]).drop("__a", "__b"))


def numbered_notes(differences: DataFrame, width: int = 1024) -> DataFrame:
    """All differences of a case as notes, numbered in word order."""
    return row_numbers(differences, ["case_id"], [F.col("idx")], [F.floor(F.col("idx") / width)], out="note")
