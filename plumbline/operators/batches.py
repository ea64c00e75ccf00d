"""Enriching and judging through a batch service: requests, batches that are never paid for twice, results by key.

A client stands for the service: ``model``, ``preflight(request)``, ``submit(requests)``
(the batch's id), ``status(id)`` ("ended" once results are there) and ``results(id)``
(dicts with ``custom_id``, ``status`` and the fields of a success). Requests go out in
batches of ``size`` rows, read one partition at a time; the id of a batch is recorded
beside the store as soon as the service has given it, with the model and the prompt's
version, so that a run that dies while it waits is resumed by the next one instead of
being submitted again. Results go by key, in whatever order they come.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import enrichment
from plumbline.sources import files
from plumbline.tables import discard

#: Families of models that reject a hint of effort; fixed values.
NO_EFFORT = ("claude-haiku-4-5", "claude-sonnet-4-5", "claude-3")
RESULT = "custom_id string, status string, recognised boolean, synopsis string, topics array<string>, entities array<string>, questions array<string>, period string, audience string"
GRADE = "custom_id string, status string, grade int, why string"


class BatchClient(Protocol):
    model: str

    def preflight(self, request: dict) -> None: ...

    def submit(self, requests: list[dict]) -> str: ...

    def status(self, batch: str) -> str: ...

    def results(self, batch: str) -> Iterator[dict]: ...


@dataclass(frozen=True)
class Report:
    items: int
    succeeded: int
    skipped: int
    failed: list[str]


def takes_effort(model: str) -> bool:
    return not model.startswith(NO_EFFORT)


def request(custom_id: str, prompt: str, system: str, model: str, schema: dict | None = None, most_tokens: int = 1024) -> dict:
    """One request: the fixed instructions first, so that the service may keep them, then the item; low effort where the model takes it."""
    config: dict = {"format": {"type": "json_schema", "schema": schema or {}}}
    if takes_effort(model):
        config["effort"] = "low"
    return {"custom_id": custom_id, "model": model, "max_tokens": most_tokens, "system": system, "prompt": prompt, "output_config": config}


class InFlight:
    """The record of a batch on its way, beside a store."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.path = spark, f"{store.rstrip('/')}.inflight.json"

    def _file(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def write(self, **fields) -> None:
        fs, path = self._file()
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(fields).encode()))
        out.close()

    def read(self, **same) -> str | None:
        """The batch's id, if it was made with the same model and prompt."""
        fs, path = self._file()
        if not fs.exists(path):
            return None
        try:
            found = json.loads(self.spark.read.text(self.path, wholetext=True).first()[0])
        except (ValueError, TypeError):
            return None
        return found.get("batch") if all(found.get(k) == v for k, v in same.items()) else None

    def clear(self) -> None:
        discard(self.spark, self.path)


def awaited(client: BatchClient, batch: str, poll_seconds: float, most_seconds: float) -> list[dict]:
    """The results of a batch; a batch that takes too long is an error, its record stays for the next run."""
    until = time.monotonic() + most_seconds
    while client.status(batch) != "ended":
        if time.monotonic() >= until:
            raise TimeoutError(f"batch {batch} has not ended after {most_seconds} s; run again to take it up")
        time.sleep(poll_seconds)
    return list(client.results(batch))


def rows_of(results: list[dict], schema: str, spark: SparkSession) -> DataFrame:
    names = [part.split(" ", 1)[0] for part in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in results], schema)


def enrich(items: DataFrame, store: str, client: BatchClient, prompt_version: str, system: str = "", size: int = 1000, poll_seconds: float = 30.0, most_seconds: float = 86_400.0) -> Report:
    """Enrich the items (item_id, title, record) that the store lacks, and append what succeeds as it lands.

    A batch that an earlier run left in flight is collected first. One request is tried before any batch goes out.
    """
    spark = items.sparkSession
    flight, same = InFlight(spark, store), {"model": client.model, "prompt_version": prompt_version}
    total = items.count()
    failed: list[str] = []
    succeeded = 0

    def todo() -> DataFrame:
        fs, _ = flight._file()
        if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)):
            return enrichment.source_hash(items)
        return enrichment.pending(items, files.enrichments(spark, store), prompt_version, client.model).select("item_id", "title", "record", "source_hash")

    def collected(batch: str) -> None:
        nonlocal succeeded
        results = rows_of(awaited(client, batch, poll_seconds, most_seconds), RESULT, spark)
        good, bad = enrichment.collect(results, items)
        hashes = enrichment.source_hash(items).select("item_id", "source_hash")
        made = good.drop("status").withColumnRenamed("custom_id", "item_id").join(hashes, "item_id")
        made = made.withColumn("prompt_version", F.lit(prompt_version)).withColumn("enrichment_model", F.lit(client.model))
        # what is paid for is stored before anything else happens to it
        files.append_enrichments(made, store)
        flight.clear()
        succeeded += made.count()
        failed.extend(sorted(r.custom_id for r in bad.collect()))

    left = flight.read(**same)
    if left:
        collected(left)
    before = todo()
    skipped = total - before.count() - succeeded
    # what has just failed waits for the next run
    again = set(failed)
    rows = (request(r.item_id, f"{r.title}\n{r.record}", system, client.model) for r in before.toLocalIterator() if r.item_id not in again)
    checked = False
    while batch := list(islice(rows, size)):
        if not checked:
            client.preflight(batch[0])
            checked = True
        name = client.submit(batch)
        flight.write(batch=name, submitted=time.time(), **same)
        collected(name)
    return Report(total, succeeded, skipped, failed)


def judge(pairs: DataFrame, client: BatchClient, system: str = "", size: int = 1000, poll_seconds: float = 30.0, most_seconds: float = 86_400.0) -> tuple[DataFrame, list[str]]:
    """((query_id, doc_id, grade, why), keys that failed) of pairs (query_id, doc_id, query, prose); grades are 0, 1 or 2."""
    spark = pairs.sparkSession
    key = F.concat_ws("--", "query_id", "doc_id")
    rows = (request(r.key, f"Query: {r.query}\nRecord: {r.prose}", system, client.model) for r in pairs.select(key.alias("key"), "query", "prose").toLocalIterator())
    results: list[dict] = []
    while batch := list(islice(rows, size)):
        if not results:
            client.preflight(batch[0])
        results += awaited(client, client.submit(batch), poll_seconds, most_seconds)
    found = rows_of(results, GRADE, spark)
    fit = (F.col("status") == "succeeded") & F.col("grade").between(0, 2)
    known = pairs.select("query_id", "doc_id", key.alias("custom_id"))
    graded = known.join(found.where(fit), "custom_id").select("query_id", "doc_id", "grade", F.coalesce("why", F.lit("")).alias("why"))
    lost = known.join(found.where(fit), "custom_id", "left_anti").select("custom_id").orderBy("custom_id")
    return graded, [r.custom_id for r in lost.collect()]
