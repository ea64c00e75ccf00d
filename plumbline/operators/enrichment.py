"""Enrichments of records: what is pending, results by key, enriched texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T

PARTS = ("questions", "synopsis", "topics", "entities", "period")
KEY = ["item_id", "prompt_version", "enrichment_model", "source_hash"]


def source_hash(items: DataFrame) -> DataFrame:
    """Items (item_id, title, record) with the hash of the record, so that a new run touches only what changed."""
    return items.withColumn("source_hash", T.content_hash(F.col("record")))


def latest(store: DataFrame) -> DataFrame:
    """The last line of each key; ``line`` is the position in the store."""
    return store.withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("line")))).where("n = 1").drop("n", "line")


def pending(items: DataFrame, store: DataFrame, prompt_version: str, model: str) -> DataFrame:
    wanted = source_hash(items).withColumn("prompt_version", F.lit(prompt_version)).withColumn("enrichment_model", F.lit(model))
    return wanted.join(store.select(*KEY).distinct(), KEY, "left_anti")


def collect(results: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(succeeded, failed) of unordered results (custom_id, status, ...); ids nobody asked for are ignored."""
    known = results.join(items.select(F.col("item_id").alias("custom_id")), "custom_id", "left_semi")
    return known.where("status = 'succeeded'"), known.where("status <> 'succeeded'")


def enriched(docs: DataFrame, store: DataFrame, prompt_version: str, model: str, as_given: bool = False) -> DataFrame:
    """Documents (doc_id, title, text, ...) whose text is followed by their enrichment's, where there is one.

    ``as_given``: titles and synopses stand as they are, and a missing text counts as an empty one.
    """
    own = latest(store).where((F.col("prompt_version") == prompt_version) & (F.col("enrichment_model") == model))
    made = own.select(F.col("item_id").alias("doc_id"), F.struct(*PARTS).alias("__made")).dropDuplicates(["doc_id"])
    extra = T.enrichment_text(F.col("title"), *(F.col("__made")[part] for part in PARTS), as_given=as_given)
    text = F.coalesce("text", F.lit("")) if as_given else F.col("text")
    joined = docs.join(made, "doc_id", "left")
    return joined.withColumn("text", F.when(F.col("__made").isNull(), F.col("text")).otherwise(F.concat_ws("\n\n", text, extra))).drop("__made")


def rerank_prose(store: DataFrame, titles: DataFrame, as_given: bool = False) -> DataFrame:
    """(doc_id, prose): what a reranker reads of each item's last enrichment; the label lines are always there.

    ``as_given``: an empty title has its line too.
    """
    last = store.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("line")))).where("n = 1")
    named = last.join(titles.select(F.col("doc_id").alias("item_id"), "title"), "item_id", "left")
    full = lambda c: F.nullif(c, F.lit(""))
    listed = lambda label, c: F.concat(F.lit(label), F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", "))
    return named.select(F.col("item_id").alias("doc_id"), F.concat_ws("\n", F.coalesce("title", F.lit("")) if as_given else full(F.col("title")), full(F.array_join("questions", " ")), full(F.col("synopsis")), listed("Topics: ", F.col("topics")), listed("Related: ", F.col("entities"))).alias("prose"))


def fake(items: DataFrame, prompt_version: str, model: str) -> DataFrame:
    """A stand-in for a model: enrichments made from the record by rules."""
    words = T.title_terms(F.col("title"))
    return source_hash(items).select("item_id", F.lit(True).alias("recognised"), F.concat(F.lit("About "), T.lowered(F.col("title"))).alias("synopsis"), F.slice(words, 1, 2).alias("topics"), F.array().cast("array<string>").alias("entities"), F.array(F.concat(F.lit("What is "), "title", F.lit("?"))).alias("questions"), F.lit(None).cast("string").alias("period"), F.lit(prompt_version).alias("prompt_version"), F.lit(model).alias("enrichment_model"), "source_hash")
