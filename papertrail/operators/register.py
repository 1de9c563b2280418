"""Case register: search, paging, statistics, deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LISTED = ["id", "case_code", "filename", "mime_type", "size_bytes", "sha256", "verdict", "risk_score", "confidence",
          "engine", "execution_mode", "reference_mode", "duration_ms", "created_at", "layer_scores"]
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def matching(cases: DataFrame, verdict: str | None = None, q: str | None = None) -> DataFrame:
    """Filters of the register; ``%`` and ``_`` in ``q`` act as wildcards. The report
    column is left out, so it is never read."""
    hits = cases.select(*[c for c in LISTED if c in cases.columns])
    if verdict and verdict != "all":
        hits = hits.filter(F.col("verdict") == verdict)
    if q:
        hits = hits.filter(F.col("filename").ilike(f"%{q}%"))
    return hits


def page(cases: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first; limit kept within 1 … 60."""
    ordered = cases.orderBy(F.desc("created_at"), "id")
    return ordered.offset(max(0, offset)).limit(min(60, max(1, limit)))


def search(cases: DataFrame, verdict: str | None = None, q: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    return page(matching(cases, verdict, q), limit, offset)


def recent(cases: DataFrame, n: int = 50) -> DataFrame:
    return cases.orderBy(F.desc("created_at"), "id").limit(n)


def case_by_id(cases: DataFrame, case_id: str) -> DataFrame:
    """Whole case by identifier; anything not shaped like a UUID finds nothing."""
    return cases.filter(F.lit(case_id).rlike(UUID) & (F.col("id") == case_id.lower()))


def statistics(cases: DataFrame) -> DataFrame:
    """Counts by risk and rounded means; "authentic" means risk below 45 here."""
    risk = F.col("risk_score")

    def rounded(col: str):
        return F.coalesce(F.round(F.avg(col)).cast("int"), F.lit(0))
    return cases.agg(F.count(F.lit(1)).alias("total"), F.count_if(risk >= 68).alias("forged"),
                     F.count_if((risk >= 45) & (risk < 68)).alias("suspicious"), F.count_if(risk < 45).alias("authentic"),
                     rounded("risk_score").alias("mean_risk"), rounded("duration_ms").alias("mean_duration"))


def delete_cases(tombstones: DataFrame, cases: DataFrame, findings: DataFrame, regions: DataFrame):
    """The three tables without the deleted cases (column ``id``)."""
    gone = tombstones.select(F.col("id").alias("case_id")).distinct()
    return (cases.join(gone, cases["id"] == gone["case_id"], "left_anti"),
            findings.join(gone, "case_id", "left_anti"), regions.join(gone, "case_id", "left_anti"))
