"""Evaluation against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papertrail import constants as C
from papertrail.functions import scalars as S


def eval_records(cases: DataFrame, reports: DataFrame, threshold: int = 50) -> DataFrame:
    """Prediction and error label per case (cases: truth; reports: risk)."""
    joined = cases.join(reports, "case_id").withColumn("predicted", F.coalesce("risk", F.lit(0)) >= threshold)
    error = (F.when(F.col("predicted") & ~F.col("truth"), "false-positive")
             .when(~F.col("predicted") & F.col("truth"), "false-negative"))
    return joined.withColumn("error", error)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def binary_metrics(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Confusion matrix and rates, 0 where a denominator is empty."""
    t, p = F.col("truth"), F.col("predicted")
    counts = records.groupBy(*(keys or [])).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    rated = counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)})
    both = F.col("precision") + F.col("recall")
    return rated.withColumns({"f1": _ratio(2 * F.col("precision") * F.col("recall"), both),
                              "fpr": _ratio(fp, fp + tn), "fnr": _ratio(fn, fn + tp)})


def auc(records: DataFrame, score: str = "risk", bucket: float = 1 / 128) -> DataFrame:
    """P(positive > negative) + half the ties, from counts per score value; NULL with a
    single class. Only bucket totals meet in one task."""
    counts = records.groupBy(score).agg(F.count_if("truth").alias("pos"), F.count_if(~F.col("truth")).alias("neg"))
    counts = counts.withColumn("b", F.floor(F.col(score) / bucket))
    totals = counts.groupBy("b").agg(F.sum("neg").alias("bn"))
    below = F.sum("bn").over(Window.partitionBy(F.lit(1)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    before = totals.select("b", F.coalesce(below, F.lit(0)).alias("under"))
    inside = F.sum("neg").over(Window.partitionBy("b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    wins = counts.withColumn("inner_under", F.coalesce(inside, F.lit(0))).join(before, "b")
    summed = wins.agg(F.sum(F.col("pos") * (F.col("under") + F.col("inner_under") + 0.5 * F.col("neg"))).alias("w"),
                      F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return summed.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).alias("auc"),
                         F.coalesce("p", F.lit(0)).alias("positives"), F.coalesce("n", F.lit(0)).alias("negatives"))


def metrics_by_group(records: DataFrame) -> DataFrame:
    """Metrics per manipulation; genuine cases with a manipulation are benign
    transformations, and a group with one class only reports insufficient cases."""
    group = F.when(~F.col("truth") & (F.col("manipulation") != "none"), "benign_transformations").otherwise(
        F.col("manipulation"))
    rated = binary_metrics(records.withColumn("group", group), ["group"])
    cases = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    enough = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0)
    return rated.select("group", cases.alias("cases"), F.when(enough, "rated").otherwise("insufficient_cases").alias("status"),
                        *[F.when(enough, F.col(c)).alias(c) for c in ("precision", "recall", "f1", "fpr", "fnr")])


def multiclass_metrics(records: DataFrame) -> DataFrame:
    """Precision, recall and support per class from the (truth, predicted) counts."""
    pairs = confusion_counts(records)
    rows = pairs.select(F.explode(F.array(
        F.struct(F.col("truth").alias("class"), "n", F.lit(True).alias("is_truth"), (F.col("truth") == F.col("predicted")).alias("hit")),
        F.struct(F.col("predicted").alias("class"), "n", F.lit(False).alias("is_truth"),
                 (F.col("truth") == F.col("predicted")).alias("hit")))).alias("r")).select("r.*")
    by_class = rows.groupBy("class").agg(
        F.coalesce(F.sum(F.when(F.col("is_truth"), F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(~F.col("is_truth"), F.col("n"))), F.lit(0)).alias("predicted"),
        F.coalesce(F.sum(F.when(F.col("is_truth") & F.col("hit"), F.col("n"))), F.lit(0)).alias("hits"))
    return by_class.select("class", "support", "predicted", _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
                           _ratio(F.col("hits"), F.col("support")).alias("recall"))


def confusion_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def failures(records: DataFrame) -> DataFrame:
    """Misclassified cases, labelled; kept as rows because the lists have no bound."""
    return records.filter(F.col("error").isNotNull())


def failure_cause(records: DataFrame) -> DataFrame:
    """Audit label of a misclassified case from its diagnostics."""
    miss = F.col("truth") & ~F.col("predicted")
    noisy = (F.col("reference") & (F.col("changed_regions") > 0) & (F.col("stable_regions") == 0)
             & ~F.col("direct_mismatch"))
    cause = (F.when(F.col("truth") == F.col("predicted"), None)
             .when(miss & ~F.col("reference"), "no-trusted-value")
             .when(miss & F.col("expected_field").isNotNull() & ~F.col("direct_mismatch"), "field-not-compared")
             .when(miss & (F.col("alignment_confidence") < 0.8), "alignment-too-low")
             .when(miss, "evidence-below-boundary")
             .when(noisy, "benign-difference-promoted").otherwise("other-signal-crossed-boundary"))
    return records.withColumn("cause", cause)


def pair_regression(original: DataFrame, manipulated: DataFrame) -> DataFrame:
    """Does the manipulated half of a pair score higher, on independent evidence?"""
    a = original.select("pair_id", F.col("risk").alias("original_risk"))
    b = manipulated.select("pair_id", F.col("risk").alias("manipulated_risk"), "active_families")
    return a.join(b, "pair_id").select(
        "pair_id", (F.col("manipulated_risk") - F.col("original_risk")).alias("delta"),
        (F.col("manipulated_risk") > F.col("original_risk")).alias("stronger"),
        (F.col("active_families") >= 2).alias("independent_evidence"))


def field_detected(cases: DataFrame, findings: DataFrame, differences: DataFrame) -> DataFrame:
    """Was the expected field found: by a mismatch finding first, else a field difference."""
    direct = findings.filter(F.col("type").isin("OCR_FIELD_MISMATCH", "REF-FIELD")).groupBy(
        "case_id", F.col("field_type").alias("expected_field")).agg(F.min_by("type", "ord").alias("found_type"))
    other = differences.select("case_id", F.col("field").alias("expected_field"), F.lit("REF-FIELD").alias("other")).distinct()
    joined = cases.join(direct, ["case_id", "expected_field"], "left").join(other, ["case_id", "expected_field"], "left")
    source = F.coalesce("found_type", "other")
    return joined.select("case_id", "expected_field", source.isNotNull().alias("detected"), source.alias("source"))


def category_coverage(cases: DataFrame) -> DataFrame:
    """Required evaluation categories with their case counts; 0 means missing."""
    spark = cases.sparkSession
    required = spark.createDataFrame(
        [(c, "authentic") for c in C.AUTHENTIC_CATEGORIES] + [(c, "manipulated") for c in C.MANIPULATED_CATEGORIES],
        "category string, kind string")
    counts = cases.groupBy("category").agg(F.count(F.lit(1)).alias("cases"))
    return required.join(counts, "category", "left").select(
        "category", "kind", F.coalesce("cases", F.lit(0)).alias("cases"), F.col("cases").isNull().alias("missing"))


def feature_summary(features: DataFrame, names: list[str]) -> DataFrame:
    """min / mean / max, valid and NaN counts per feature."""
    stacked = features.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in names]))
                              .alias("r")).select("r.*")
    valid = F.when(~F.isnan("v"), F.col("v"))
    return stacked.groupBy("feature").agg(F.min(valid).alias("lowest"), F.avg(valid).alias("mean"), F.max(valid).alias("highest"),
                                          F.count(valid).alias("valid"), F.count_if(F.isnan("v")).alias("nan_cells"))


def evaluation_document(records: DataFrame, dataset: str, mode: str) -> DataFrame:
    """One row with the JSON document of an evaluation: metrics, confusion matrix, metrics per manipulation, number of failures of
    both kinds. Only rows that are already sums meet in it (one per manipulation); cases and failures have no bound and
    are written beside it (``write_evaluation``).
    """
    rated, area = binary_metrics(records), auc(records)
    rates = rated.select(F.struct("precision", "recall", "f1", "fpr", "fnr").alias("metrics"), F.struct("tp", "tn", "fp", "fn").alias("confusion"),
                         (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("cases"), F.struct("fp", "fn").alias("failures"))
    by_type = metrics_by_group(records)
    types = by_type.agg(F.array_sort(F.collect_list(F.struct(*by_type.columns))).alias("by_manipulation"))
    # Three tables of one row each, put together by position in a union.
    parts = rates.unionByName(types, allowMissingColumns=True).unionByName(area.select(F.col("auc").alias("roc_auc")), allowMissingColumns=True)
    whole = parts.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("cases", "metrics", "roc_auc", "confusion", "by_manipulation", "failures")])
    return whole.select(F.to_json(F.struct(F.lit(dataset).alias("dataset"), F.lit(mode).alias("mode"), *whole.columns)).alias("document"))


EVALUATION_SCHEMA = ("dataset string, mode string, cases bigint, metrics struct<precision: double, recall: double, f1: double, fpr: double, fnr: double>, "
                     "roc_auc double, confusion struct<tp: bigint, tn: bigint, fp: bigint, fn: bigint>, by_manipulation array<struct<`group`: string, "
                     "cases: bigint, status: string, precision: double, recall: double, f1: double, fpr: double, fnr: double>>, "
                     "failures struct<fp: bigint, fn: bigint>")


def write_evaluation(records: DataFrame, folder: str, dataset: str, mode: str) -> None:
    """The document under ``folder/document``, all cases under ``folder/cases``, failures under ``folder/failures`` by kind; an
    existing evaluation is replaced."""
    evaluation_document(records, dataset, mode).write.mode("overwrite").text(f"{folder}/document")
    records.write.mode("overwrite").json(f"{folder}/cases")
    failures(records).write.mode("overwrite").partitionBy("error").json(f"{folder}/failures")


def read_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """The document as rows: section, name, value (NULL where a group has too few cases)."""
    document = spark.read.text(f"{folder}/document").select(F.from_json("value", EVALUATION_SCHEMA).alias("d")).select("d.*")

    def rows(section: str, struct: Column, names: list[str]) -> Column:
        return F.array(*[F.struct(F.lit(section).alias("section"), F.lit(n).alias("name"), struct[n].cast("double").alias("value")) for n in names])

    rates = ["precision", "recall", "f1", "fpr", "fnr"]
    groups = F.flatten(F.transform("by_manipulation", lambda g: F.transform(F.array(*[F.lit(n) for n in ("cases", *rates)]), lambda n: F.struct(
        g["group"].alias("section"), n.alias("name"), F.coalesce(*[F.when(n == c, g[c].cast("double")) for c in ("cases", *rates)]).alias("value")))))
    return document.select(F.inline(F.concat(
        rows("metrics", F.col("metrics"), rates), rows("confusion", F.col("confusion"), ["tp", "tn", "fp", "fn"]),
        rows("failures", F.col("failures"), ["fp", "fn"]),
        F.array(F.struct(F.lit("metrics").alias("section"), F.lit("roc_auc").alias("name"), F.col("roc_auc").alias("value")),
                F.struct(F.lit("metrics").alias("section"), F.lit("cases").alias("name"), F.col("cases").cast("double").alias("value"))), groups)))
