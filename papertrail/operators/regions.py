"""Boxes on a page: overlap search, merging, typing and measuring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertrail import constants as C
from papertrail.functions import scalars as S
from papertrail.operators.components import connected_components
from papertrail.operators.skew import hot_keys, row_numbers, split_hot, top_k

BOX = ["x", "y", "width", "height"]
#: Boxes of a case that are drawn on its raster one by one.
DRAWN = 4096


def with_grid(boxes: DataFrame, keys: list[str], crowd: int = 64, finest: int = 256) -> DataFrame:
    """Attach the grid resolution of each key: one cell for up to ``crowd`` boxes,
    finer cells the more boxes a key holds (about 16 boxes per cell)."""
    counts = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    fine = F.pow(F.lit(2.0), F.ceil(F.log2(F.sqrt(F.col("__n") / 16))))
    grid = F.when(F.col("__n") <= crowd, 1).otherwise(F.least(F.lit(finest), fine)).cast("int")
    return boxes.join(counts.select(*keys, grid.alias("__g")), keys)


def overlapping_pairs(boxes: DataFrame, keys: list[str], order: str, carry: list[str]) -> DataFrame:
    """Pairs (a before b in ``order``) of intersecting boxes of one key.

    Boxes are copied into the grid cells they touch and met per (key, cell); a
    pair is kept only in the cell holding the lower corner of its intersection,
    so it appears once. Columns come back prefixed ``a_`` and ``b_``.
    """
    gridded = with_grid(boxes.select(*keys, order, *BOX, *carry), keys)

    def cells(start: Column, size: Column) -> Column:
        return F.sequence(F.floor(start * F.col("__g")), F.floor((start + size) * F.col("__g")))
    placed = (gridded.withColumn("__cx", F.explode(cells(F.col("x"), F.col("width"))))
              .withColumn("__cy", F.explode(cells(F.col("y"), F.col("height")))))
    at = [*keys, "__cx", "__cy"]
    payload = [order, *BOX, *carry]
    left = placed.select(*at, "__g", *[F.col(c).alias(f"a_{c}") for c in payload])
    right = placed.select(*at, *[F.col(c).alias(f"b_{c}") for c in payload])
    corner_x, corner_y = F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y")
    met = left.join(right, at).filter(
        (F.col(f"a_{order}") < F.col(f"b_{order}"))
        & (corner_x <= F.least(F.col("a_x") + F.col("a_width"), F.col("b_x") + F.col("b_width")))
        & (corner_y <= F.least(F.col("a_y") + F.col("a_height"), F.col("b_y") + F.col("b_height")))
        & (F.floor(corner_x * F.col("__g")) == F.col("__cx")) & (F.floor(corner_y * F.col("__g")) == F.col("__cy")))
    return met.drop("__g", "__cx", "__cy")


def _side(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}_{f}") for f in BOX]


def pair_iou() -> Column:
    return S.iou(*_side("a"), *_side("b"))


def cross_check(regions: DataFrame, min_score: float = 0.45, min_iou: float = 0.12) -> DataFrame:
    """Overlapping regions of different layers corroborate each other."""
    strong = regions.filter(F.col("score") > min_score)
    pairs = overlapping_pairs(strong, ["case_id"], "ord", ["layer", "score", "confidence"]).withColumn("iou", pair_iou())
    hits = pairs.filter((F.col("iou") > min_iou) & (F.col("a_layer") != F.col("b_layer")))
    first = F.col("a_score") >= F.col("b_score")
    confidence = F.least(F.lit(0.98), (F.col("a_confidence") + F.col("b_confidence")) / 2 + F.col("iou") * 0.3)
    return hits.select(
        "case_id", F.col("a_ord").alias("ord_a"), F.col("b_ord").alias("ord_b"), F.lit("XC-CORR").alias("code"),
        F.when(first, F.col("a_layer")).otherwise(F.col("b_layer")).alias("owner"),
        F.when(first, F.col("b_layer")).otherwise(F.col("a_layer")).alias("other"),
        F.when(F.col("iou") > 0.4, "critical").otherwise("high").alias("severity"), "iou",
        S.fix(confidence, 3).alias("confidence"))


def merge_regions(regions: DataFrame, crowd: int = 256) -> DataFrame:
    """Attach ``component``: the smallest ordinal of the cluster a region belongs to.

    Two regions join when IoU >= 0.18 or the centre of the later one lies in the
    earlier one; clusters are the connected components. The regions of a case with at
    most ``crowd`` of them are merged where they lie, those of other cases by
    ``_merge_crowded``. Empty boxes are dropped.
    """
    from papertrail.functions.arrow import merged_boxes
    solid = regions.filter((F.col("width") != 0) & (F.col("height") != 0))
    hot = hot_keys(solid, ["case_id"], crowd)
    crowded = None
    if hot is not None:
        solid, many = split_hot(solid, ["case_id"], hot)
        crowded = _merge_crowded(many)
    gathered = solid.groupBy("case_id").agg(F.collect_list(F.struct(*[c for c in solid.columns if c != "case_id"])).alias("member"))
    boxes = F.transform("member", lambda m: F.struct(m["ord"].cast("long").alias("ord"), *[m[c].cast("double").alias(c) for c in BOX]))
    each = gathered.withColumn("component", merged_boxes(boxes)).select("case_id", F.inline(F.arrays_zip("member", "component")))
    merged = each.select("case_id", "member.*", F.col("component").cast(regions.schema["ord"].dataType).alias("component"))
    return merged if crowded is None else merged.unionByName(crowded)


def _merge_crowded(solid: DataFrame) -> DataFrame:
    """``merge_regions`` of cases that no task takes whole. Copies of one box are
    collapsed first (they always belong together), so a pile of identical boxes
    costs one row in the pair search."""
    shapes = solid.groupBy("case_id", *BOX).agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    pairs = overlapping_pairs(shapes, ["case_id"], "first", ["last"])
    later_b = S.centre_in(*_side("b"), *_side("a"))
    later_a = S.centre_in(*_side("a"), *_side("b")) & (F.col("a_last") > F.col("b_first"))
    edges = pairs.filter((pair_iou() >= 0.18) | later_b | later_a).select(
        F.struct("case_id", F.col("a_first").alias("ord")).alias("a"),
        F.struct("case_id", F.col("b_first").alias("ord")).alias("b"))
    found = connected_components(edges).select(F.col("node.case_id").alias("case_id"), F.col("node.ord").alias("first"),
                                               F.col("component.ord").alias("component"))
    labelled = shapes.join(found, ["case_id", "first"], "left").select(
        "case_id", *BOX, F.coalesce("component", "first").alias("component"))
    return solid.join(labelled, ["case_id", *BOX])


def keyword_type() -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("technique", F.lit("")),
                               F.coalesce("notes", F.lit(""))))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for token, kind in C.REGION_KEYWORDS:
        out = out.when(text.contains(token), kind)
    return out.otherwise("unknown")


def with_fields(regions: DataFrame, fields: DataFrame) -> DataFrame:
    """Attach a case's identity fields as an array (one per field type, so it is
    short) instead of joining region by field."""
    gathered = fields.groupBy("case_id").agg(F.array_sort(F.collect_list(
        F.struct(F.col("ord"), "field_type", "bbox"))).alias("fields"))
    return regions.join(gathered, "case_id", "left")


def field_iou(field: Column) -> Column:
    box = field["bbox"]
    return S.iou(*[F.col(f) for f in BOX], *[box[f] for f in BOX])


def region_types(regions: DataFrame, fields: DataFrame) -> DataFrame:
    """First overlapping identity field decides, else the first keyword, else unknown."""
    hit = F.try_element_at(F.filter("fields", lambda f: field_iou(f) >= 0.12), F.lit(1))
    mapped = S.lookup(C.FIELD_REGION_TYPES, hit["field_type"])
    kind = F.when(hit.isNotNull(), F.coalesce(mapped, hit["field_type"])).otherwise(keyword_type())
    return with_fields(regions, fields).withColumn("region_type", kind).drop("fields")


def region_summary(members: DataFrame) -> DataFrame:
    """One row per merged region from typed members (``merge_regions`` output).

    Members are counted per (region, detector, type) first, so only these few
    combinations are gathered per region.
    """
    at = ["case_id", "component"]
    counted = members.groupBy(*at, "detector", "region_type").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"),
        F.max(F.col("y") + F.col("height")).alias("y1"), F.max("confidence").alias("top_confidence"),
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.max("score").alias("score"))
    gathered = counted.groupBy(*at).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.max("top_confidence").alias("top_confidence"), F.sum("n").alias("members"),
        F.collect_list(F.struct("detector", "region_type", "first", "score", "n")).alias("parts"))

    def per(field: str, row) -> Column:
        names = F.array_distinct(F.transform("parts", lambda p: p[field]))
        return F.transform(names, lambda name: row(name, F.filter("parts", lambda p: p[field].eqNullSafe(name))))
    found = F.array_sort(per("detector", lambda name, own: F.struct(
        F.array_min(F.transform(own, lambda p: p["first"])).alias("first"), name.alias("detector"),
        S.fix(F.array_max(F.transform(own, lambda p: p["score"])), 3).alias("score"))))
    kinds = per("region_type", lambda name, own: F.struct(
        (name != "unknown").alias("known"), F.aggregate(own, F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("n"),
        (-F.array_min(F.transform(own, lambda p: p["first"]))).alias("first"), name.alias("region_type")))
    joined = gathered.withColumns({"found": found, "region_type": F.array_max(kinds)["region_type"]})
    confidence = F.least(F.lit(0.98), F.col("top_confidence")
                         + F.least(F.lit(0.18), 0.06 * (F.size("found") - 1)))
    return joined.select(
        *at, S.fix("x0", 4).alias("x"), S.fix("y0", 4).alias("y"),
        S.fix(F.col("x1") - F.col("x0"), 4).alias("width"), S.fix(F.col("y1") - F.col("y0"), 4).alias("height"),
        "region_type", "members", F.transform("found", lambda d: d["detector"]).alias("detectors"),
        F.map_from_entries(F.transform("found", lambda d: F.struct(d["detector"], d["score"]))).alias("scores"),
        S.fix(confidence, 3).alias("confidence"))


def region_evidence(members: DataFrame) -> DataFrame:
    """Evidence lines of merged regions as rows (a region may have many)."""
    line = F.format_string("%s: %s (score %.2f)", F.col("detector"), F.col("label"), S.fix("score", 2))
    noted = F.when(F.trim(F.coalesce("notes", F.lit(""))) != "", F.concat(line, F.lit("; "), F.trim("notes")))
    return members.select("case_id", "component", "ord", F.coalesce(noted, line).alias("evidence"))


def numbered(rows: DataFrame, order: str, prefix: str, out: str = "region_id", width: int = 4096) -> DataFrame:
    """Running identifiers ``R-01``, ``R-02`` … per case in the given order."""
    counted = row_numbers(rows, ["case_id"], [F.col(order)], [F.floor(F.col(order) / width)])
    return counted.withColumn(out, F.format_string(f"{prefix}-%02d", F.col("rn"))).drop("rn")


def field_candidates(fields: DataFrame, findings: DataFrame) -> DataFrame:
    """Every identity field as a candidate region, scored by its first finding."""
    first = findings.groupBy("case_id", "field_type").agg(F.min_by(F.struct("confidence", "evidence"), "ord").alias("f"))
    joined = fields.join(first, ["case_id", "field_type"], "left")
    return joined.select(
        "case_id", "ord", F.lit("identity-ocr").alias("layer"), F.lit("identity-ocr").alias("detector"),
        F.concat(F.lit("Identity field: "), "field_type").alias("label"),
        F.coalesce("f.confidence", F.lit(0.0)).alias("score"), F.coalesce("f.confidence", "confidence").alias("confidence"),
        "bbox.x", "bbox.y", "bbox.width", "bbox.height", F.lit("identity OCR").alias("technique"),
        F.coalesce("f.evidence", F.concat(F.lit("OCR field: "), "raw_text")).alias("notes"))


def words_in_regions(regions: DataFrame, words: DataFrame, finest: int = 12) -> DataFrame:
    """Words whose corner lies in a region, as rows: case_id, region, idx, text.

    A region lives in the grid whose cells are about its size (level l cuts the page into 2^l by 2^l), so it covers two cells a side at
    most; a word asks the few levels that its case uses. Small regions of a crowded page thus meet the words around them only.
    """
    def span(start: Column, size: Column) -> Column:
        return F.sequence(F.floor(start * F.col("__n")), F.floor((start + size) * F.col("__n")))
    level = F.greatest(F.lit(0), F.least(F.lit(finest), F.floor(-F.log2(F.greatest("width", "height", F.lit(2.0 ** -finest))))))
    boxes = (regions.select("case_id", F.col("ord").alias("region"), *BOX).withColumn("__n", F.pow(F.lit(2.0), level).cast("long"))
             .withColumn("__cx", F.explode(span(F.col("x"), F.col("width"))))
             .withColumn("__cy", F.explode(span(F.col("y"), F.col("height")))))
    levels = boxes.select("case_id", "__n").distinct()
    points = words.select("case_id", "idx", "text", (F.col("left") / F.col("page_width")).alias("px"),
                          (F.col("top") / F.col("page_height")).alias("py")).join(levels, "case_id")
    points = points.withColumns({"__cx": F.floor(F.col("px") * F.col("__n")), "__cy": F.floor(F.col("py") * F.col("__n"))})
    inside = points.join(boxes, ["case_id", "__n", "__cx", "__cy"]).filter(
        F.col("px").between(F.col("x"), F.col("x") + F.col("width"))
        & F.col("py").between(F.col("y"), F.col("y") + F.col("height")))
    return inside.select("case_id", "region", "idx", "text")


def region_texts(inside: DataFrame) -> DataFrame:
    """Text of each region from its words (``words_in_regions`` output), in page order: case_id, region, words."""
    return inside.groupBy("case_id", "region").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda w: w["text"]), " ").alias("words"))


def region_position(regions: DataFrame) -> DataFrame:
    """Where on the card a changed region sits, and how far it is to be trusted."""
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    kind = (F.when((cx < 0.30) & (cy > 0.25) & (cy < 0.78), "portrait-region-difference")
            .when(cy > 0.78, "barcode-or-signature-region-difference").otherwise("local-aligned-difference"))
    return regions.withColumns({"change_type": kind, "trust": S.fix(
        F.least(F.lit(0.95), 0.55 + F.col("score") * 0.35), 3)})


def visible_regions(regions: DataFrame, layers: list[str]) -> DataFrame:
    """Regions of the active layers; an empty set shows all."""
    return regions.filter(F.col("layer").isin(layers)) if layers else regions


def mask_overlap(cases: DataFrame, predicted: DataFrame, truth: DataFrame, width: int, height: int, drawn: int = DRAWN) -> DataFrame:
    """IoU and Dice of the unions of predicted and true boxes on a pixel raster.

    Boxes of a case are drawn on its raster, many cases at a time. Those of a case with more than ``drawn`` boxes become
    horizontal slabs between its distinct y edges (at most ``height + 1``); inside a slab the union length is a running
    maximum over at most ``width`` start positions, so nothing grows with the number of boxes.
    """
    def pixels(boxes: DataFrame, side: str) -> DataFrame:
        def edge(value: Column, size: int) -> Column:
            return F.floor(value * size).cast("int")
        x0, x1 = edge(F.col("x"), width), edge(F.col("x") + F.col("width"), width)
        y0, y1 = edge(F.col("y"), height), edge(F.col("y") + F.col("height"), height)
        raw = boxes.select("case_id", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
        return raw.filter("x1 > x0 AND y1 > y0").select(
            "case_id", F.lit(side).alias("side"), F.greatest(F.lit(0), "x0").alias("x0"),
            F.least(F.lit(width), F.col("x1") + 1).alias("x1"), F.greatest(F.lit(0), "y0").alias("y0"),
            F.least(F.lit(height), F.col("y1") + 1).alias("y1")).filter("x1 > x0 AND y1 > y0")

    sides = pixels(predicted, "p").union(pixels(truth, "t"))
    hot = hot_keys(sides, ["case_id"], drawn)
    if hot is None:
        areas = _drawn_areas(sides, width, height)
    else:
        others, crowded = split_hot(sides, ["case_id"], hot)
        areas = _drawn_areas(others, width, height).unionByName(_slab_areas(crowded))
    joined = cases.select("case_id").join(areas, "case_id", "left").fillna(0, ["p", "t", "u"])
    shared = F.col("p") + F.col("t") - F.col("u")
    return joined.select(
        "case_id", F.col("p").alias("predicted_area"), F.col("t").alias("truth_area"), shared.alias("shared_area"),
        F.when(F.col("u") > 0, shared / F.col("u")).otherwise(1.0).alias("iou"),
        F.when(F.col("p") + F.col("t") > 0, 2 * shared / (F.col("p") + F.col("t"))).otherwise(1.0).alias("dice"))


def _drawn_areas(sides: DataFrame, width: int, height: int) -> DataFrame:
    from papertrail.functions.arrow import covered_areas
    box = F.struct((F.col("side") == "t").cast("int").alias("side"), "x0", "x1", "y0", "y1")
    gathered = sides.groupBy("case_id").agg(F.collect_list(box).alias("boxes"))
    return gathered.select("case_id", covered_areas(F.col("boxes"), width, height).alias("a")).select("case_id", "a.*")


def _slab_areas(sides: DataFrame) -> DataFrame:
    boxes = (sides.withColumn("side", F.explode(F.array("side", F.lit("u"))))
             .groupBy("case_id", "side", "y0", "y1", "x0").agg(F.max("x1").alias("x1")))
    at = ["case_id", "side"]
    edges = boxes.select(*at, F.explode(F.array("y0", "y1")).alias("e")).groupBy(*at).agg(
        F.array_sort(F.collect_set("e")).alias("edges"))
    first, last = (F.array_position("edges", F.col(y)).cast("int") for y in ("y0", "y1"))
    below = F.arrays_zip(F.slice("edges", first, last - first).alias("slab"), F.slice("edges", first + 1, last - first).alias("end"))
    slabs = (boxes.join(edges, at).select(*at, "x0", "x1", F.inline(below))
             .select(*at, "slab", (F.col("end") - F.col("slab")).alias("tall"), "x0", "x1")
             .groupBy(*at, "slab", "tall", "x0").agg(F.max("x1").alias("x1")))
    before = Window.partitionBy(*at, "slab").orderBy("x0").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("x1") - F.greatest(F.col("x0"), F.coalesce(F.max("x1").over(before), F.lit(0))))
    return slabs.select(*at, (fresh * F.col("tall")).alias("area")).groupBy("case_id").agg(
        *[F.sum(F.when(F.col("side") == s, F.col("area")).otherwise(0)).alias(s) for s in ("p", "t", "u")])
