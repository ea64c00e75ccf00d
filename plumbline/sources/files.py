"""Readers and writers of corpora, rankings, judgements and enrichment stores.

Files hold one JSON document or one JSON object a line. Lines are split among
tasks however large a file is; a single document is parsed by one task.
"""

from __future__ import annotations

import json
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import vectors as V

DOCUMENT = "doc_id string, title string, text string, url string, tags array<string>"
QUERY = "query string, relevant_doc_ids array<string>, grades map<string,int>, note string"
ENRICHMENT = "item_id string, recognised boolean, synopsis string, topics array<string>, entities array<string>, questions array<string>, period string, audience string, prompt_version string, enrichment_model string, source_hash string"


def _by_line(spark: SparkSession, path: str, field: str | None) -> bool:
    """Whether the files hold an object a line: the first line is a whole object, and not the one that holds the list."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    try:
        found = json.loads(first[0][0]) if first else None
    except ValueError:
        return False
    return isinstance(found, dict) and field not in found


def _items(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """Rows of a JSON list, of a list under ``field`` of one object, or of an object a line, with position and file."""
    if _by_line(spark, path, field):
        rows = spark.read.text(path).where(F.trim("value") != "").withColumn("pos", F.monotonically_increasing_id()).select("*", F.col("_metadata.file_path").alias("file"))
        return rows.select("file", "pos", F.from_json("value", schema).alias("x")).select("x.*", "pos", "file")
    # a list at the top gives an element a row, an object its list
    own = f"struct<{_nested(schema)}>"
    rows = spark.read.schema(f"{schema}, `{field}` array<{own}>").option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path")).withColumn("at", F.monotonically_increasing_id())
    names = [part.split(" ", 1)[0] for part in schema.split(", ")]
    single = F.array(F.struct(F.col("at").alias("pos"), F.struct(*names).alias("x")))
    listed = F.transform(F.col(field), lambda x, i: F.struct(i.cast("long").alias("pos"), x.alias("x")))
    return rows.select("file", F.inline(F.when(F.col(field).isNotNull(), listed).otherwise(single))).select("x.*", "pos", "file")


def _nested(schema: str) -> str:
    return ", ".join(f"{part.split(' ', 1)[0]}:{part.split(' ', 1)[1]}" for part in schema.split(", "))


def corpus(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Documents of one or more files; a document without id or text, or an id that occurs twice, is an error that names the files."""
    paths = [paths] if isinstance(paths, str) else paths
    docs = reduce(DataFrame.unionByName, [_items(spark, p, "documents", DOCUMENT) for p in paths])
    bare = F.col("doc_id").isNull() | F.col("text").isNull()
    seen = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(bare).alias("bare"), F.array_join(F.sort_array(F.collect_set("file")), ", ").alias("files"))
    faults = seen.where("n > 1 or bare").orderBy(F.desc("bare"), "doc_id").limit(1).collect()
    if faults and faults[0]["bare"]:
        raise ValueError(f"a document lacks doc_id or text: {faults[0]['files']}")
    if faults:
        raise ValueError(f"document {faults[0]['doc_id']} occurs twice: {faults[0]['files']}")
    return docs.drop("pos", "file")


def catalogue(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Records of several collections; the last of each id wins."""
    from plumbline.operators.catalogue import last_wins

    return last_wins([_items(spark, p, "documents", schema).drop("file") for p in paths])


def queries(spark: SparkSession, path: str) -> DataFrame:
    return _items(spark, path, "queries", QUERY).drop("file")


def write_queries(judged: DataFrame, path: str, provenance: dict[str, str] | None = None) -> None:
    """An evaluation set: (query, relevant_doc_ids, grades, note) an object a line, each with where it came from."""
    names = [part.split(" ", 1)[0] for part in QUERY.split(", ")]
    own = judged.select(*(F.col(n) if n in judged.columns else F.lit(None).alias(n) for n in names))
    if provenance:
        own = own.withColumn("provenance", F.create_map(*(F.lit(x) for pair in sorted(provenance.items()) for x in pair)))
    own.write.mode("overwrite").json(path)


def rankings(spark: SparkSession, path: str, lane: str) -> DataFrame:
    """(lane, query, doc_id, rank) of files {query: [ids]}, whole or in lines; a repeated id keeps its first place."""
    raw = spark.read.text(path) if _by_line(spark, path, None) else spark.read.text(path, wholetext=True)
    lists = raw.where(F.trim("value") != "").select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("query", "ids"))
    return lists.select(F.lit(lane).alias("lane"), "query", F.posexplode(F.array_distinct("ids")).alias("rank", "doc_id")).withColumn("rank", (F.col("rank") + 1).cast("long"))


def write_rankings(hits: DataFrame, path: str) -> None:
    """One line {query: [ids]} for each query."""
    ordered = hits.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ids"))
    ordered.select(F.to_json(F.create_map("query", "ids")).alias("value")).write.mode("overwrite").text(path)


def enrichments(spark: SparkSession, path: str) -> DataFrame:
    """An append-only store, blank lines skipped; ``line`` orders its rows as they were appended.

    Rows that ``append_enrichments`` wrote carry the time of their batch and their place in it. Lines from
    elsewhere have neither and go by file, and in a file by their place.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    rows = lines.select(F.from_json("value", f"{ENRICHMENT}, batch long, place long").alias("x"), "file", "block", "seq")
    foreign = F.col("x.batch").isNull()
    line = F.struct(
        F.coalesce("x.batch", F.lit(0)).alias("batch"),
        F.when(foreign, F.col("file")).otherwise("").alias("file"),
        F.when(foreign, F.col("block")).otherwise(0).alias("block"),
        F.coalesce("x.place", "seq").alias("place"),
    )
    return rows.select("x.*", line.alias("line")).drop("batch", "place")


def append_enrichments(rows: DataFrame, path: str) -> None:
    """Add rows after all that are there, in the order in which they come."""
    rows.withColumn("batch", F.lit(time.time_ns())).withColumn("place", F.monotonically_increasing_id()).write.mode("append").json(path)


def export_vectors(rows: DataFrame, path: str) -> None:
    """An offline bundle: 8-bit codes as base64 with their scale and the card's fields, an object a line, ``<`` escaped."""
    coded = rows.withColumn("__c", V.int8(F.col("vector"))).drop("vector")
    bundle = F.to_json(F.struct(*(F.col(c) for c in coded.columns if c != "__c"), V.packed_codes(F.col("__c.codes")).alias("codes"), F.col("__c.scale").alias("scale")))
    coded.select(escaped(bundle).alias("value")).write.mode("overwrite").text(path)


def escaped(text: Column) -> Column:
    """JSON that may stand inside a page: no ``<`` can open a tag."""
    return F.replace(text, F.lit("<"), F.lit("\\u003c"))
