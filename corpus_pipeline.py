"""From raw documents to packed training sequences.

Each stage takes what its predecessor kept, works on all of it, and is written as Parquet before the next one reads
it. All but the last return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from papertrail.llm import bagminhash, packing, rules, suffix
from papertrail.llm.common import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from the labels, does not reject.

    A null or empty text is scored by the statistics of an empty one; equal texts have equal scores, so copies stay or go
    together; repeated rows are judged once each; null ids take no part in learning, and without any label all documents stay.
    """
    return rules.accepted(docs, rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Of a group the smallest id stays, of equal ids the smallest hash of the text; null ids come after all others. Rows equal in id and
    text are one document; texts without words are in no group and all stay.
    """
    return bagminhash.without_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which benchmark windows cover less than a twentieth of the words.

    A null text, one without words, and every document where the benchmark is empty are clean; repeated rows are judged once each.
    """
    return suffix.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 tokens.

    A null or empty text is a piece with the end id alone; pieces of equal length go by document, start and checksum, so runs agree;
    repeated rows are packed once each; a null id stays null.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]

#: Trees, signatures and tokenizers are not expressible in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
