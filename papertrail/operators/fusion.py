"""Fusion of layer scores and findings to one risk per case.

``layers`` holds one row per (case_id, layer); the layer registry bounds a case to
a handful of rows, so a case's layers are gathered into one array and everything
else is array arithmetic on that row: one shuffle for the layers, one (map-side
combined) for the findings, none for the join of the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertrail import constants as C
from papertrail.functions import scalars as S



def _alert() -> Column:
    return F.col("severity").isin("high", "critical")


def gather_layers(layers: DataFrame) -> DataFrame:
    """One row per case with its layers (ordered by layer id) as an array."""
    item = F.struct("layer", "name", "weight", "score", "confidence", "status",
                    S.layer_family(F.col("layer")).alias("family"))
    return layers.groupBy("case_id").agg(F.array_sort(F.collect_list(item)).alias("layers"))


def finding_counts(findings: DataFrame) -> DataFrame:
    """Per case: findings per family, alerts, criticals and corroboration links."""
    family = S.finding_family(F.col("code"))
    per_family = [F.count_if(family == f).alias(f"__f{i}") for i, f in enumerate(C.FAMILY_WEIGHTS)]
    counted = findings.groupBy("case_id").agg(
        *per_family, F.count_if(_alert()).alias("alerts"),
        F.count_if(F.col("severity") == "critical").alias("criticals"),
        F.count_if(F.col("code").startswith("XC-")).alias("links"))
    counts = F.array(*[F.col(f"__f{i}") for i in range(len(per_family))])
    return counted.select("case_id", "alerts", "criticals", "links", counts.alias("family_findings"))


def _family(name: str, position: int) -> Column:
    """Evidence of one family: strongest member plus a diminishing share of the rest."""
    members = F.filter("layers", lambda m: (m["family"] == name) & (m["status"] != "skipped"))
    scores = F.reverse(F.array_sort(F.transform(members, lambda m: m["score"])))
    damped = F.transform(scores, lambda v, i: F.when(i == 0, v).otherwise(v * (0.12 / (i + 1))))
    strength = F.least(F.lit(1.0), F.aggregate(damped, F.lit(0.0), lambda a, v: a + v))
    found = F.coalesce(F.col("family_findings")[position], F.lit(0))
    lifted = F.least(F.lit(1.0), strength + F.least(F.lit(0.08), found * 0.01))
    score = F.when(F.size(members) > 0, lifted).otherwise(0.0)
    return F.struct(
        F.lit(name).alias("family"), F.lit(C.FAMILY_WEIGHTS[name]).alias("weight"), score.alias("score"),
        (score * C.FAMILY_WEIGHTS[name]).alias("contribution"),
        F.array_join(F.transform(members, lambda m: m["layer"]), ",").alias("members"),
        found.cast("bigint").alias("finding_count"),
        F.coalesce(F.array_max(F.transform(members, lambda m: m["confidence"])), F.lit(0.0)).alias("confidence"),
        F.aggregate(scores, F.lit(0.0), lambda a, v: a + v).alias("member_total"))


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v)


def _with_decision(evidence: DataFrame) -> DataFrame:
    """Risk, verdict, agreement and confidence from the family array."""
    active = F.filter("families", lambda f: f["score"] > 0)
    k = F.greatest(F.lit(1), F.size("active"))
    mean = _total(F.transform("active", lambda f: f["score"])) / k
    with_active = evidence.withColumns({
        "mass": _total(F.transform("families", lambda f: f["contribution"])), "active": active})
    with_mean = with_active.withColumn("__mean", mean)
    spread = F.sqrt(F.aggregate("active", F.lit(0.0), lambda a, f: a + F.pow(f["score"] - F.col("__mean"), 2.0)) / k)
    decided = with_mean.withColumns({"sigma": spread, "risk": S.risk_of(F.col("mass"))})
    decided = decided.withColumn("agreement", S.fix(F.greatest(F.lit(0.0), 1 - F.col("sigma") / 0.32), 3))
    mean_confidence = _total(F.transform("active", lambda f: f["confidence"])) / k
    confidence = (0.30 + mean_confidence * 0.26 + F.col("agreement") * 0.12
                  + F.size("active") / len(C.FAMILY_WEIGHTS) * 0.16
                  + F.least(F.lit(0.16), F.greatest(F.lit(0), F.size("active") - 1) * 0.04))
    return decided.withColumns({
        "verdict": S.verdict(F.col("risk")), "active_families": F.size("active"),
        "confidence": S.fix(F.least(F.lit(0.98), confidence), 3)}).drop("__mean", "active")


def fuse_cases(layers: DataFrame, findings: DataFrame) -> DataFrame:
    """Dependency-aware family fusion. One row per case with nested evidence."""
    gathered = gather_layers(layers).join(finding_counts(findings), "case_id", "left")
    families = F.array(*[_family(name, i) for i, name in enumerate(C.FAMILY_WEIGHTS)])
    evidence = gathered.withColumn("families", families).fillna(0, ["alerts", "criticals", "links"])
    return _with_decision(evidence)


def family_evidence(fused: DataFrame) -> DataFrame:
    """All six families of every case, in report order."""
    return fused.select("case_id", F.inline("families")).drop("confidence", "member_total")


def contributions(fused: DataFrame) -> DataFrame:
    """Mass of a family split over its members by share of their scores."""
    rows = fused.select("case_id", "families", F.inline("layers"))
    own = F.element_at(F.filter("families", lambda f: f["family"] == F.col("family")), 1)
    total = F.when(own["member_total"] == 0, 1.0).otherwise(own["member_total"])
    share = F.when(F.col("status") == "skipped", 0.0).otherwise(F.col("score") / total)
    return rows.select("case_id", "layer", "name", "status", "score", (own["weight"] * share).alias("weight"),
                       (own["contribution"] * share).alias("contribution"))


def contribution_array(fused: DataFrame) -> DataFrame:
    """The same split kept as an array on the case row, largest first."""
    def part(layer):
        own = F.element_at(F.filter("families", lambda f: f["family"] == layer["family"]), 1)
        total = F.when(own["member_total"] == 0, 1.0).otherwise(own["member_total"])
        share = F.when(layer["status"] == "skipped", 0.0).otherwise(layer["score"] / total)
        return F.struct((-S.fix(own["contribution"] * share, 6)).alias("neg"), layer["layer"].alias("layer"),
                        layer["name"].alias("name"))
    return fused.withColumn("contributors", F.array_sort(F.transform("layers", part)))


def top_contributors(fused: DataFrame, k: int = 3) -> DataFrame:
    """Largest ``k`` contributions per case; ties by layer id."""
    ranked = contribution_array(fused).select("case_id", F.posexplode(F.slice("contributors", 1, k)))
    return ranked.select("case_id", (F.col("pos") + 1).alias("rank"), "col.layer", "col.name",
                         (-F.col("col.neg")).alias("contribution"))


def rationale(fused: DataFrame) -> DataFrame:
    """Explanatory sentences of a fused case."""
    top = F.array_join(F.transform(F.slice("contributors", 1, 3), lambda t: F.format_string(
        "%s (%.1f%%)", t["name"], S.fix(-t["neg"] * 100, 1))), "; ")
    wording = (F.when(F.col("agreement") > 0.72, "layers are mutually consistent")
               .when(F.col("agreement") > 0.45, "partial disagreement, interpret with care")
               .otherwise("layers disagree sharply, which itself warrants manual review"))
    return contribution_array(fused).select(
        "case_id",
        F.format_string("Evidence mass %.3f across %d active families, risk %d/100.", S.fix(F.col("mass"), 3),
                        F.col("active_families"), F.col("risk")).alias("mass_line"),
        F.concat(F.lit("Dominant contributors: "), top, F.lit(".")).alias("driver_line"),
        F.format_string("Family agreement %.3f: %s.", F.col("agreement"), wording).alias("agreement_line"),
        F.format_string("%d high-or-critical finding(s) and %d corroboration link(s) recorded.", F.col("alerts"),
                        F.col("links")).alias("alert_line"))


def ablate(fused: DataFrame) -> DataFrame:
    """Risk of a case with each of its layers left out; a case row fans out to its
    own layers only, and each variant is fused again in place."""
    variants = fused.select("case_id", F.col("risk").alias("full_risk"), "family_findings", F.col("layers").alias("all"),
                            F.explode(F.filter("layers", lambda m: m["status"] != "skipped")).alias("out"))
    trimmed = variants.select("case_id", "full_risk", "family_findings", F.col("out.layer").alias("left_out"),
                              F.filter("all", lambda m: m["layer"] != F.col("out.layer")).alias("layers"))
    families = F.array(*[_family(name, i) for i, name in enumerate(C.FAMILY_WEIGHTS)])
    again = trimmed.withColumn("families", families)
    risk = S.risk_of(_total(F.transform("families", lambda f: f["contribution"])))
    return again.select("case_id", "left_out", "full_risk", risk.alias("risk_without"),
                        (F.col("full_risk") - risk).alias("delta"))


def fuse_pool(layers: DataFrame, findings: DataFrame) -> DataFrame:
    """Confidence-weighted opinion pool over the module weights."""
    live = F.col("status") != "skipped"
    raw = F.col("weight") * (0.55 + 0.45 * F.col("confidence"))
    moments = layers.groupBy("case_id").agg(
        F.sum(F.when(live, raw)).alias("raw_weight"), F.sum(F.when(live, raw * F.col("score"))).alias("raw_mass"),
        F.count_if(live).alias("executed"), F.count(F.lit(1)).alias("layer_count"),
        F.stddev_pop(F.when(live, F.col("score"))).alias("sigma"),
        F.avg(F.when(live, F.col("confidence"))).alias("mean_confidence"),
        F.sum(F.when(live, F.log2(F.greatest(F.lit(1e-6), 1 - F.abs(F.col("score") - 0.5) * 2)) * 0.06))
        .alias("log_mass"))
    joined = moments.join(finding_counts(findings), "case_id", "left").fillna(0)
    mass = F.when(F.col("executed") > 0, F.col("raw_mass") / F.col("raw_weight")).otherwise(0.0)
    agreement = S.fix(F.greatest(F.lit(0.0), 1 - F.col("sigma") / 0.32), 3)
    confidence = F.least(F.lit(0.98), 0.42 + F.col("mean_confidence") * 0.34 + agreement * 0.16
                         + F.col("executed") / F.col("layer_count") * 0.12 + F.col("criticals") * 0.04)
    risk = S.risk_of(mass)
    return joined.select("case_id", mass.alias("mass"), risk.alias("risk"), S.verdict(risk).alias("verdict"),
                         agreement.alias("agreement"), S.fix(confidence, 3).alias("confidence"),
                         S.fix(-F.col("log_mass"), 3).alias("entropy"), "executed", "alerts", "links")


def joint_failure(layers: DataFrame) -> DataFrame:
    """Signal-level and content-level failure in the same case."""
    def of(layer: str, value: str) -> Column:
        return F.max(F.when(F.col("layer") == layer, F.col(value)))
    wide = layers.filter(F.col("layer").isin("pixel", "semantic")).groupBy("case_id").agg(
        of("pixel", "score").alias("pixel"), of("semantic", "score").alias("semantic"),
        of("pixel", "confidence").alias("pc"), of("semantic", "confidence").alias("sc"))
    confidence = S.fix(F.least(F.lit(0.98), (F.col("pc") + F.col("sc")) / 2 + 0.12), 3)
    return wide.filter("pixel > 0.5 AND semantic > 0.5").select(
        "case_id", F.lit("XC-JOINT").alias("code"), F.lit("critical").alias("severity"),
        confidence.alias("confidence"), S.fix(F.col("pixel") * F.col("semantic"), 3).alias("joint"))


def corroborated(layers: DataFrame, min_score: float = 0.55) -> DataFrame:
    """For every layer: does another layer of the case reach ``min_score``?"""
    strong = layers.groupBy("case_id").agg(F.count_if(F.col("score") >= min_score).alias("strong"))
    own = (F.col("score") >= min_score).cast("int")
    return layers.join(strong, "case_id").select("case_id", "layer", "score",
                                                 (F.col("strong") - own > 0).alias("corroborated"))


def feature_vector(layers: DataFrame, word_confidence: DataFrame) -> DataFrame:
    """Classifier inputs per case, the noise metric looked up by its label."""
    def of(layer: str, value: Column) -> Column:
        return F.coalesce(F.max(F.when(F.col("layer") == layer, value)), F.lit(0.0))
    wide = layers.groupBy("case_id").agg(
        of("pixel", F.col("score")).alias("ela_score"), of("copy-move", F.col("score")).alias("copy_move_score"),
        of("pixel", S.metric_value(F.col("metrics"), "Noise divergence")).alias("noise_anomaly"),
        of("layout", F.col("score")).alias("text_inconsistency"))
    joined = wide.join(word_confidence, "case_id", "left")
    return joined.select("case_id", F.coalesce("mean_confidence", F.lit(0.0)).alias("ocr_confidence"), "ela_score",
                         "copy_move_score", "noise_anomaly", "text_inconsistency")


def gate_ml(predictions: DataFrame) -> DataFrame:
    """Classifier output counts only inside its validated document domains."""
    inside = F.col("domain").isin(*C.ML_DOMAINS)
    return predictions.select(
        "case_id", "domain", F.when(inside, S.clip(0.5 * F.col("probability"), 0, 0.5)).otherwise(0.0).alias("score"),
        F.when(inside, F.least(F.lit(0.5), F.col("confidence"))).otherwise(0.0).alias("confidence"),
        F.when(inside, S.layer_status(S.clip(0.5 * F.col("probability"), 0, 0.5))).otherwise("skipped").alias("status"))


def top_layers(layers: DataFrame, k: int = 6) -> DataFrame:
    """Highest scoring layers of a case (a case has at most one row per layer)."""
    ranked = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "layer"))
    return layers.withColumn("rank", ranked).filter(F.col("rank") <= k)


def apply_kinds(layers: DataFrame, facts: DataFrame) -> DataFrame:
    """Layers that do not apply to a case's container kind become skipped, score 0."""
    limits = {layer: kinds for layer, (_, _, _, kinds) in C.LAYERS.items() if kinds}
    barred = F.lit(False)
    for layer, kinds in limits.items():
        barred = barred | ((F.col("layer") == layer) & ~F.col("kind").isin(*kinds))
    joined = layers.join(facts.select("case_id", "kind"), "case_id")
    return joined.withColumns({
        "score": F.when(barred, 0.0).otherwise(F.col("score")),
        "confidence": F.when(barred, 0.0).otherwise(F.col("confidence")),
        "status": F.when(barred, "skipped").otherwise(F.col("status"))})


def report_recommendation(fused: DataFrame) -> DataFrame:
    """Verdict wording plus the strongest layer as primary driver when above 0.45."""
    worst = F.element_at(F.array_sort(F.transform("layers", lambda m: F.struct(
        (-m["score"]).alias("neg"), m["layer"].alias("layer"), m["name"].alias("name")))), 1)
    driver = F.when((F.col("verdict") != "authentic") & (-worst["neg"] > 0.45), F.lower(worst["name"]))
    return fused.select("case_id", "risk", "verdict", S.worker_recommendation(F.col("risk")).alias("recommendation"),
                        S.verdict_label(F.col("verdict")).alias("label"), driver.alias("primary_driver"))


def examiner_advice(fused: DataFrame, layers: DataFrame, floor: float = 0.45) -> DataFrame:
    """Five-tier advice per case; unless authentic, a sentence names the strongest layer that scores above ``floor`` with its
    ``summary``. Equal scores go by the registry's order, then by id; a missing summary leaves the name alone."""
    order = {name: i for i, name in enumerate(C.LAYERS)}
    place = F.coalesce(S.lookup(order, F.col("layer")), F.lit(len(order)))
    worst = layers.groupBy("case_id").agg(F.min_by(F.struct("name", "summary", "score"), F.struct(-F.col("score"), place, "layer")).alias("worst"))
    text = F.coalesce("worst.summary", F.lit(""))
    driver = F.concat(F.lit(" Primary driver: "), F.lower("worst.name"), F.lit(" — "), F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))
    named = (F.col("verdict") != "authentic") & (F.col("worst.score") > floor)
    return fused.select("case_id", "verdict").join(worst, "case_id", "left").select(
        "case_id", "verdict", F.concat(S.lookup(C.VERDICT_ADVICE, F.col("verdict")), F.when(named, driver).otherwise("")).alias("advice"))


def pipeline_trace(fused: DataFrame) -> DataFrame:
    """Step rows of a case with the state each step ends in."""
    executed = F.size(F.filter("layers", lambda m: m["status"] != "skipped"))
    alerting = F.size(F.filter("layers", lambda m: m["status"] == "alert"))
    risk_state = F.when(F.col("risk") >= 68, "alert").when(F.col("risk") >= 45, "warn").otherwise("ok")

    def step(number: int, key: str, status: Column, detail: Column) -> Column:
        return F.struct(F.lit(number).alias("step"), F.lit(key).alias("key"), status.alias("status"),
                        detail.alias("detail"))
    ok = F.lit("ok")
    mismatch = F.col("type_mismatch")
    steps = F.array(
        step(1, "upload", ok, F.format_string("%d bytes received", F.col("size_bytes"))),
        step(2, "validate", F.when(mismatch, "warn").otherwise("ok"),
             F.concat(F.lit("container resolved as "), F.col("kind"),
                      F.when(mismatch, " (MIME mismatch)").otherwise(""))),
        step(3, "extract", ok, F.format_string("%d word(s) recovered", F.col("word_count"))),
        step(4, "analyze", F.when(alerting > 0, "alert").otherwise("ok"),
             F.format_string("%d detector(s) executed, %d returned an alert", executed, alerting)),
        step(5, "crosscheck", F.when(F.col("links") > 0, "warn").otherwise("ok"),
             F.format_string("%d corroboration link(s)", F.col("links"))),
        step(6, "fuse", ok, F.lit("family fusion")),
        step(7, "risk", risk_state, F.format_string("Risk %d/100", F.col("risk"))),
        step(8, "explain", ok, F.format_string("%d alert finding(s) rendered", F.col("alerts"))))
    return fused.select("case_id", F.inline(steps))
