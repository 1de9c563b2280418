"""Intake of exhibits and their optional references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrail import constants as C


def read_exhibits(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as exhibits; sizes come from the listing, content only if used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("name"), F.col("length").alias("size_bytes"), "content",
                        F.lit(None).cast("string").alias("mime"))


def supported(mime: Column, name: Column) -> Column:
    hit = F.lit(False)
    for kind in C.SUPPORTED_TYPES:
        hit = hit | mime.contains(kind)
    return hit | name.rlike(C.SUPPORTED_NAME)


def intake(exhibits: DataFrame) -> DataFrame:
    """Accept or reject exhibits by size and declared type (columns name, mime, size_bytes)."""
    mime = F.when(F.coalesce(F.col("mime"), F.lit("")) == "", "application/octet-stream").otherwise(F.col("mime"))
    typed = exhibits.withColumn("mime", mime)
    status = (F.when(F.col("size_bytes") == 0, 400).when(F.col("size_bytes") > C.MAX_UPLOAD_BYTES, 413)
              .when(~supported(F.col("mime"), F.col("name")), 415).otherwise(200))
    reason = (F.when(F.col("status") == 400, "empty").when(F.col("status") == 413, "too-large")
              .when(F.col("status") == 415, "unsupported").otherwise("accepted"))
    return typed.withColumn("status", status).withColumn("reason", reason)


def pair_references(exhibits: DataFrame, references: DataFrame) -> DataFrame:
    """Attach usable references; an empty or oversized one is dropped silently."""
    usable = references.filter((F.col("size_bytes") > 0) & (F.col("size_bytes") <= C.MAX_UPLOAD_BYTES)).select(
        "case_id", F.col("name").alias("reference_name"))
    return exhibits.join(usable, "case_id", "left").withColumn(
        "mode", F.when(F.col("reference_name").isNotNull(), "reference-based").otherwise("reference-free"))
