"""Corpus integrity checks and the labelled perturbation generator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.constants import TAX_RATES


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def pairing_problems(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Offending names: forged entries without a mask file, masks nobody references,
    mask names that differ from the forged name."""
    forged = manifest.filter(F.col("manipulation") != "none").select("id", "forged_path", "mask_path")
    masks = files.filter(F.col("category") == "masks").select(F.col("path").alias("mask_path"))
    missing = forged.join(masks, "mask_path", "left_anti").select(F.lit("missing-mask").alias("problem"), F.col("id").alias("name"))
    orphan = masks.join(forged.select("mask_path"), "mask_path", "left_anti").select(
        F.lit("orphan-mask").alias("problem"), F.col("mask_path").alias("name"))
    renamed = forged.filter(file_name(F.col("mask_path")) != file_name(F.col("forged_path"))).select(
        F.lit("name-mismatch").alias("problem"), F.col("id").alias("name"))
    return missing.unionByName(orphan).unionByName(renamed)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side only, tagged with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def _entries(table: DataFrame, entries: list[tuple[str, Column, dict[str, Column]]]) -> DataFrame:
    """What each row says: per entry a space, a key in it and up to four numbers a … d (0 where not given)."""
    said = [F.struct(F.lit(space).alias("space"), key.cast("string").alias("key"),
                     *[values.get(c, F.lit(False)).cast("int").alias(c) for c in "abcd"]) for space, key, values in entries]
    return table.select(F.inline(F.array(*said)))


def validate_corpus(manifest: DataFrame, files: DataFrame, originals: int, forged: int, per_type: dict[str, int]) -> DataFrame:
    """(check, ok, problems) rows: counts, uniqueness, pairing, paths, null rules.

    Both tables are read once: each row says what it is, has or wants under keys (its id, its names, its paths), the entries are
    summed per key before they are shuffled, and one conditional aggregate over the sums decides all rules. A null path meets no file;
    null ids are one id.
    """
    genuine, no = F.col("manipulation") == "none", F.lit(None)
    filled = [F.col(c).isNotNull() for c in ("forged_path", "mask_path", "region_box")]
    any_filled, all_filled = reduce(lambda a, b: a | b, filled), reduce(lambda a, b: a & b, filled)
    renamed = F.coalesce(~genuine & (file_name(F.col("mask_path")) != file_name(F.col("forged_path"))), F.lit(False))
    yes = F.lit(True)
    by_manifest = _entries(manifest, [
        ("rows", no, {"a": genuine, "b": ~genuine, "c": (genuine & any_filled) | (~genuine & ~all_filled), "d": renamed}),
        ("type", F.col("doc_type"), {"a": yes}), ("id", F.col("id"), {"a": yes}),
        ("path", F.col("original_path"), {"a": F.col("original_path").isNotNull()}), ("path", F.col("forged_path"), {"a": F.col("forged_path").isNotNull()}),
        ("mask", F.col("mask_path"), {"a": ~genuine})])
    kind = F.col("category")
    by_file = _entries(files, [
        ("category", kind, {"a": yes}), ("path", F.col("path"), {"b": yes}), ("mask", F.col("path"), {"b": kind == "masks"}),
        ("name", file_name(F.col("path")), {"a": kind == "originals", "b": kind == "forged", "c": kind == "masks"})])
    sums = by_manifest.unionByName(by_file).groupBy("space", "key").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in "abcd"])
    a, b, c = F.col("a"), F.col("b"), F.col("c")

    def total(space: str, value: Column, where: Column | None = None) -> Column:
        at = F.col("space") == space if where is None else (F.col("space") == space) & where
        return F.coalesce(F.sum(F.when(at, value)), F.lit(0))

    def off(space: str, key: str, expected: int) -> Column:
        return F.abs(total(space, a, F.col("key") == key) - expected)
    met = F.col("key").isNotNull()
    problems = {
        "count/manifest": F.abs(total("rows", a) - originals) + F.abs(total("rows", b) - forged),
        **{f"count/type/{name}": off("type", name, n) for name, n in per_type.items()},
        "pairing/manifest_fields": total("rows", c), "count/originals": off("category", "originals", originals),
        "count/forged": off("category", "forged", forged), "count/masks": off("category", "masks", forged),
        "uniqueness/filenames": total("name", (a > 1).cast("int") + (b > 1).cast("int") + (c > 1).cast("int")),
        "uniqueness/no_original_name_collision": total("name", F.lit(1), (a > 0) & (b + c > 0)),
        "uniqueness/mask_names_match_forged": total("name", F.lit(1), (b > 0) != (c > 0)), "uniqueness/ids": total("id", a - 1),
        "pairing/mask_exists": total("mask", a, ~(met & (b > 0))), "pairing/no_orphan_masks": total("mask", b, ~(met & (a > 0))),
        "pairing/mask_name": total("rows", F.col("d")), "pairing/paths_exist": total("path", a, met & (b == 0))}
    decided = sums.agg(*[p.cast("bigint").alias(f"c{i}") for i, p in enumerate(problems.values())])
    rows = [F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("problems")) for i, name in enumerate(problems)]
    return decided.select(F.inline(F.array(*rows))).withColumn("ok", F.col("problems") == 0)


def boxes_close(a: Column, b: Column, tolerance: int = 2) -> Column:
    """All four edges within the tolerance."""
    return (F.size(a) == 4) & (F.size(b) == 4) & F.forall(F.zip_with(a, b, lambda p, q: F.abs(p - q) <= tolerance), lambda ok: ok)


def box_contains(outer: Column, inner: Column) -> Column:
    """Inner box lies in the outer one and both are non-empty."""
    solid = (outer[2] > outer[0]) & (outer[3] > outer[1]) & (inner[2] > inner[0]) & (inner[3] > inner[1])
    return solid & (inner[0] >= outer[0]) & (inner[1] >= outer[1]) & (inner[2] <= outer[2]) & (inner[3] <= outer[3])


def pilot_problems(manifest: DataFrame) -> DataFrame:
    """(case_id, problem) rows of a pilot manifest; bbox is [x, y, w, h]."""
    status, box, size = F.col("status"), F.col("bbox"), F.col("image_size")
    inside = ((box[0] >= 0) & (box[2] > 0) & (box[0] + box[2] <= size[0]) & (box[1] >= 0) & (box[3] > 0)
              & (box[1] + box[3] <= size[1]))
    complete = F.col("mask_path").isNotNull() & (F.size("fields_changed") > 0) & box.isNotNull()
    rules = F.array_compact(F.array(
        F.when(~F.coalesce(status, F.lit("")).isin("genuine", "manipulated"), "invalid-status"),
        F.when((status == "manipulated") & ~complete, "incomplete-manipulated"),
        F.when((status == "manipulated") & complete & ~inside, "region-outside-image"),
        F.when((status == "genuine") & (F.col("mask_path").isNotNull() | (F.size("fields_changed") > 0)), "genuine-claims-change")))
    own = manifest.select("case_id", F.explode(rules).alias("problem"))
    repeated = manifest.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "case_id", F.lit("duplicate-id").alias("problem"))
    return own.unionByName(repeated)


def pick(key: Column, salt: str, n: int) -> Column:
    """Deterministic choice 0 … n-1 from a key."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 6), 16, 10).cast("int") % n


def perturb(lines: DataFrame) -> DataFrame:
    """Invoice lines under each manipulation with one field altered and the truth kept.
    Columns key, qty, rate; tax rate is chosen per line. The four variants are an
    exploded constant array."""
    amount = F.round(F.col("qty") * F.col("rate"), 2)
    tax_rate = F.element_at(F.array(*[F.lit(r) for r in TAX_RATES]), pick(F.col("key"), "tax", len(TAX_RATES)) + 1)
    base = lines.withColumns({"amount": amount, "tax_rate": tax_rate})
    variants = base.withColumn("manipulation", F.explode(F.array(*[F.lit(m) for m in ("none", "text_replace", "copy_move", "whiteout")])))
    kind = F.col("manipulation")
    raised = F.col("amount") + 1000 * (1 + pick(F.col("key"), "digit", 9))
    printed = (F.when(kind == "text_replace", raised).when(kind == "copy_move", F.col("rate")).when(kind == "whiteout", None)
               .otherwise(F.col("amount")))
    return variants.select("key", "manipulation", "tax_rate", F.col("amount").alias("true_amount"), printed.alias("printed_amount"),
                           F.when(kind == "none", 0).otherwise(1).alias("label"),
                           F.when(kind != "none", "amount").alias("altered_field"))
