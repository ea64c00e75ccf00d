"""Stages of the corpus pipeline, each over all rows that the one before it kept.

Language identification drops what it rejects, near-deduplication keeps one
document of each group, decontamination drops documents with a benchmark window,
the secret scan replaces secrets by a mark, and packing makes windows of ids.

Defined results: a null or empty text has no language and goes in the first stage; rows
with a null id stay rows of their own, and of rows that are equal in id and text one
stays; all but the last stage return the columns they were given, whatever their names,
and every row that none of them drops; empty ``documents`` give no rows at every stage,
and an empty ``benchmark`` leaves every document in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontam, langid, queries, secrets, simhash
from plumbline.llm.common import discard, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.train(docs.where(~queries.held_out())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, queries.read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.redact(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.packed(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secret_scan), ("packing", pack)]
#: Language models, fingerprint groups and packing are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is a table of the shared folder, which goes once the next one stands."""
    docs, path = queries.read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        last, path = path, scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            discard(spark, last)
        # Spark deletes shuffle files and broadcasts of the stage once the driver has collected what refers to them
        spark.sparkContext._jvm.System.gc()
    return STAGES[-1][1](spark, docs, sf_dir)
