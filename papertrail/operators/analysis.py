"""One job from observation tables to fused, registered cases.

A detector names the tables and the results of other detectors that it reads, and returns layer, finding and region rows. The job
orders detectors by what they read, computes every table that several of them read once, hands later detectors the
results of earlier ones, gives a case without a result a neutral layer, and fuses what all of them found. Words are far more than
what is found on them, so they are not stored: ``pages`` is what one pass over them says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail import constants as C
from papertrail.functions import arrow
from papertrail.functions import scalars as S
from papertrail.operators import facts, fusion, ledger, reconcile, residuals, words
from papertrail.operators.skew import CROWD
from papertrail.session import materialise, stored

LAYERS = ["case_id", "layer", "name", "category", "weight", "score", "confidence", "status"]
FINDINGS = ["case_id", "layer", "ord", "code", "severity", "confidence", "metric"]
REGIONS = ["case_id", "layer", "ord", "label", "score", "confidence", "x0", "y0", "x1", "y1"]


@dataclass(frozen=True)
class Results:
    """What a detector returns: ``layers`` (case_id, score, confidence, optionally status), ``findings`` (case_id, code, severity,
    confidence, metric) and ``regions`` (case_id, label, score, confidence, x0, y0, x1, y1 in pixels), the last two with an
    ``ord`` where a case may have several rows, or None."""
    layers: DataFrame
    findings: DataFrame | None = None
    regions: DataFrame | None = None


@dataclass(frozen=True)
class Detector:
    """``reads`` lists table names, and ``layer:<id>`` for the layer rows of other detectors."""
    layer: str
    reads: tuple[str, ...]
    run: Callable[[dict[str, DataFrame]], Results]

    def after(self) -> set[str]:
        return {name.removeprefix("layer:") for name in self.reads if name.startswith("layer:")}


@dataclass(frozen=True)
class Analysis:
    layers: DataFrame
    findings: DataFrame
    regions: DataFrame
    fused: DataFrame
    cases: DataFrame


def ordered(detectors: Iterable[Detector]) -> list[Detector]:
    """Detectors so that each comes behind those it reads, otherwise in the given order."""
    waiting = list(detectors)
    names = [d.layer for d in waiting]
    if len(set(names)) < len(names):
        raise ValueError(f"layers with two detectors: {sorted({n for n in names if names.count(n) > 1})}")
    if unknown := {n for d in waiting for n in d.after()} - set(names):
        raise ValueError(f"layers without a detector: {sorted(unknown)}")
    done: list[Detector] = []
    while waiting:
        ready = next((d for d in waiting if d.after() <= {x.layer for x in done}), None)
        if ready is None:
            raise ValueError(f"detectors that wait for each other: {sorted(d.layer for d in waiting)}")
        waiting.remove(ready)
        done.append(ready)
    return done


def _layer_rows(cases: DataFrame, layer: str, found: DataFrame) -> DataFrame:
    """One row per case; neutral where the detector had nothing to say."""
    name, category, weight, _ = C.LAYERS.get(layer, (layer, "content", 0.0, None))
    has_status = "status" in found.columns
    joined = cases.select("case_id").join(found.select("case_id", "score", "confidence", *(["status"] if has_status else [])), "case_id", "left")
    score = S.fix(F.coalesce("score", F.lit(0.0)), 4)
    return joined.select("case_id", F.lit(layer).alias("layer"), F.lit(name).alias("name"), F.lit(category).alias("category"),
                         F.lit(weight).alias("weight"), score.alias("score"), S.fix(F.coalesce("confidence", F.lit(0.0)), 3).alias("confidence"),
                         S.layer_status(score, F.col("status") if has_status else None).alias("status"))


def _rows(layer: str, found: DataFrame, columns: list[str]) -> DataFrame:
    order = [] if "ord" in found.columns else [F.lit(None).cast("long").alias("ord")]
    return found.select("*", *order, F.lit(layer).alias("layer")).select(*columns)


def analyze_cases(cases: DataFrame, tables: dict[str, DataFrame], detectors: Iterable[Detector]) -> Analysis:
    """Run the detectors over all cases (``case_id``) and fuse their results.

    A case that no detector knows is neutral; results for ids that are no case are left out; an empty table gives empty results.
    """
    plan = ordered(detectors)
    cases = stored(cases.select("case_id").distinct())
    readers = [name for d in plan for name in d.reads if not name.startswith("layer:")]

    def table(name: str) -> DataFrame:
        if name == "pages" and name not in tables:
            return stored(read_pages(tables["words"]))
        return materialise(tables[name]) if readers.count(name) > 1 else tables[name]
    given = {name: table(name) for name in dict.fromkeys(readers)}
    layers, findings, regions = [], [], []
    for detector in plan:
        found = detector.run({name: given[name] for name in detector.reads})
        rows = stored(_layer_rows(cases, detector.layer, found.layers))
        given[f"layer:{detector.layer}"] = rows
        layers.append(rows)
        if found.findings is not None:
            findings.append(_rows(detector.layer, found.findings, FINDINGS).withColumn("ord", F.col("ord").cast("long")))
        if found.regions is not None:
            regions.append(_rows(detector.layer, found.regions, REGIONS).withColumn("ord", F.col("ord").cast("long")))
    if not layers or not findings or not regions:
        raise ValueError("a job needs a detector with findings and one with regions")
    all_layers = reduce(DataFrame.unionByName, layers)
    all_findings, all_regions = (stored(reduce(DataFrame.unionByName, parts).join(cases, "case_id", "left_semi")) for parts in (findings, regions))
    fused = fusion.fuse_cases(all_layers, all_findings)
    counts = all_findings.groupBy("case_id").agg(F.count(F.lit(1)).alias("findings"))
    boxes = all_regions.groupBy("case_id").agg(F.count(F.lit(1)).alias("regions"))
    scores = F.map_from_entries(F.transform("layers", lambda m: F.struct(m["layer"], m["score"])))
    register = fused.join(counts, "case_id", "left").join(boxes, "case_id", "left").fillna(0, ["findings", "regions"]).select(
        "case_id", "risk", "verdict", "confidence", "agreement", "active_families", "alerts", "findings", "regions", scores.alias("layer_scores"),
        S.worker_recommendation(F.col("risk")).alias("recommendation"))
    return Analysis(all_layers, all_findings, all_regions, fused, register)


# ----------------------------------------------------------------- detectors
def read_pages(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One pass over words: the breached checks of every page (``ledger.CHECK``) and, in rows of their own, the summary of its layout."""
    kept = tuple(f.name for f in arrow.LAYOUT_FIELDS)
    found, crowded = words.read_pages(rows, ledger.entry(), [arrow.checks_of(arrow.price_lists, arrow.mark_sheets), arrow.layout_of],
                                      [*arrow.CHECK_FIELDS, *arrow.LAYOUT_FIELDS], crowd)
    breached = F.expr("NOT ok AND strong")
    seen = words.pixels(ledger.check_rows(found, rows, kept), rows, arrow.SUMMARY_CORNERS).filter(F.col("words").isNotNull() | breached)
    if crowded is not None:
        seen = seen.unionByName(ledger.crowded_checks(crowded).filter(breached), allowMissingColumns=True)
        seen = seen.unionByName(words.crowded_layout(crowded), allowMissingColumns=True)
    return seen


def _semantic(t: dict[str, DataFrame]) -> Results:
    """Arithmetic of price lists and mark sheets."""
    checks = t["pages"].filter("words IS NULL").select(*ledger.CHECK)
    broken = ledger.breaches(checks)
    region = broken.select("case_id", "ord", F.lit("Arithmetic violation").alias("label"),
                           S.fix(F.least(F.lit(1.0), F.col("diff") / F.greatest(F.lit(1.0), "actual")), 4).alias("score"), "confidence", *ledger.BOX)
    return Results(reconcile.semantic_layer(checks), broken.withColumn("metric", S.fix("diff", 2)), region)


def _layout(t: dict[str, DataFrame]) -> Results:
    layer = words.layout_judged(t["pages"])
    live = layer.filter("confidence > 0")
    confidence = S.fix("confidence", 3).alias("confidence")
    finding = live.select("case_id", F.lit("LXT-DEV").alias("code"), S.severity_band(F.col("score")).alias("severity"), confidence,
                          F.col("deviants").cast("double").alias("metric"))
    region = live.select("case_id", F.lit("Layout deviation").alias("label"), S.fix("score", 4).alias("score"), confidence, "x0", "y0", "x1", "y1")
    return Results(layer, finding, region)


def _metadata(t: dict[str, DataFrame]) -> Results:
    layer = facts.metadata_layer(t["metadata"], ["case_id"])
    finding = layer.filter(F.size("issues") > 0).select(
        "case_id", F.lit("META-CONS").alias("code"), S.severity_band(F.col("score")).alias("severity"), S.fix("confidence", 3).alias("confidence"),
        F.size("issues").cast("double").alias("metric"))
    return Results(layer, finding)


def _compression(t: dict[str, DataFrame]) -> Results:
    layer = facts.compression_layer(t["facts"])
    finding = layer.filter("code IS NOT NULL").select("case_id", "code", "severity", S.fix("confidence", 3).alias("confidence"),
                                                     F.col("quality").cast("double").alias("metric"))
    return Results(layer, finding)


def corroborating(others: list[DataFrame], floor: float = 0.55) -> DataFrame:
    """Cases in which one of the given layers reaches ``floor``."""
    return reduce(DataFrame.unionByName, [o.select("case_id", "score") for o in others]).filter(F.col("score") >= floor).select("case_id").distinct()


def _residual(others: tuple[str, ...]) -> Callable[[dict[str, DataFrame]], Results]:
    """Residual hotspots: graver where an earlier layer speaks too."""
    def run(t: dict[str, DataFrame]) -> Results:
        scored = residuals.localization_score(t["residual_stats"]).withColumn("confidence", F.least(F.lit(0.86), 0.45 + F.col("stability") * 0.35))
        seen = corroborating([t[f"layer:{o}"] for o in others]).withColumn("seen", F.lit(True))
        severity = F.when(F.col("seen"), "high").otherwise("medium")
        confidence = S.fix(F.least(F.lit(0.88), 0.55 + F.col("stability") * 0.3), 3)
        finding = scored.filter("score > 0").join(seen, "case_id", "left").select(
            "case_id", F.lit("SRM-LOCAL").alias("code"), severity.alias("severity"), confidence.alias("confidence"), S.fix("p95", 4).alias("metric"))
        return Results(scored, finding)
    return run


SEMANTIC = Detector("semantic", ("pages",), _semantic)
LAYOUT = Detector("layout", ("pages",), _layout)
METADATA = Detector("metadata", ("metadata",), _metadata)
COMPRESSION = Detector("compression", ("facts",), _compression)


def residual_detector(others: tuple[str, ...] = ("semantic", "layout", "metadata", "compression")) -> Detector:
    return Detector("deep-tamper-srm", ("residual_stats", *(f"layer:{o}" for o in others)), _residual(others))


STANDARD = [residual_detector(), SEMANTIC, LAYOUT, METADATA, COMPRESSION]
