"""The chunk index as a table: what is new, upsert, statistics, guards, and its folder.

The folder holds data in buckets of the key's hash and numbered manifests. A manifest
names, for each bucket, the writes that make it up. It takes its name after its data
stand and its number is claimed, so a reader sees whole versions alone, a failed write
leaves nothing that matters, and of two writers one goes again. New keys are appended to their
buckets; only buckets in which a key is replaced, or that are made of many writes, are
written anew. Manifests but the last ``KEPT`` go, and with them data that none names.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions import text as T
from plumbline.functions import vectors as V
from plumbline.tables import discard

UPSERT_BATCH = 64
#: Buckets of a new index, versions that are kept, writes of which a bucket may be made.
BUCKETS, KEPT, WRITES = 32, 3, 8


class IndexMismatch(RuntimeError):
    """Vectors of another model than the one that asks."""


def duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys that occur more than once."""
    return docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def pending(chunks: DataFrame, index: DataFrame, by: tuple[str, ...] = ("content_hash",), force: bool = False) -> DataFrame:
    """Chunks whose hash the index lacks; ``by`` may add doc_id so that equal texts are indexed under each id."""
    return chunks if force else chunks.join(index.select(*by).distinct(), list(by), "left_anti")


def upsert(index: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows replace those of the same key, others are added."""
    return index.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def embed(chunks: DataFrame, dims: int = 16) -> DataFrame:
    """Chunks with vectors of the hash encoder, which needs no model."""
    return chunks.withColumn("embedding", V.hash_embedding(F.col("embed_text"), dims)).withColumn("model_id", F.lit(f"hash@{dims}")).withColumn("dims", F.lit(dims))


def report(chunks: DataFrame, new: DataFrame, limit: int) -> DataFrame:
    """Documents, chunks in all, embedded, skipped and longer than the encoder's limit."""
    total = chunks.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks_total"))
    done = new.agg(F.count("*").alias("chunks_embedded"), F.coalesce(F.sum((T.estimate_tokens(F.col("embed_text")) > limit).cast("long")), F.lit(0)).alias("truncated_chunks"))
    return total.crossJoin(done).select("documents", "chunks_total", "chunks_embedded", (F.col("chunks_total") - F.col("chunks_embedded")).alias("chunks_skipped"), "truncated_chunks")


def stats(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("chunk_count"), F.min("model_id").alias("model_id"), F.min("dims").alias("dimensions"))


def guard(index: DataFrame, model_id: str) -> None:
    """Raise unless the index has rows, and of this model alone."""
    found = [row[0] for row in index.select("model_id").distinct().limit(2).collect()]
    if not found:
        raise IndexMismatch("the index is empty")
    if found != [model_id]:
        raise IndexMismatch(f"the index holds {found}, not {model_id}")


def _files(spark: SparkSession, root: str):
    """(file system, path maker) of the folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the manifests, in order."""
    fs, path = _files(spark, root)
    folder = path(f"{root}/versions")
    return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")) if fs.exists(folder) else []


def _manifest(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{root}/versions/{version:06d}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, root: str, version: int, manifest: dict) -> bool:
    """Publish the manifest under its number; false if another writer has claimed it. Readers see it whole or not at all."""
    fs, path = _files(spark, root)
    try:
        fs.create(path(f"{root}/versions/{version:06d}.claim"), False).close()
    except Exception as error:
        if "exist" in str(error).lower():
            return False
        raise
    unnamed = path(f"{root}/versions/.{version:06d}.{uuid.uuid4().hex}")
    out = fs.create(unnamed, False)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    return fs.rename(unnamed, path(f"{root}/versions/{version:06d}.json"))


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, root: str, key: str, buckets: int) -> tuple[str, list[int]]:
    """(name of the write, buckets it has)."""
    name = uuid.uuid4().hex
    rows.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/data/{name}")
    fs, path = _files(rows.sparkSession, root)
    return name, sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path(f"{root}/data/{name}")) if s.getPath().getName().startswith("bucket="))


def _read(spark: SparkSession, root: str, manifest: dict, only: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    paths = [f"{root}/data/{name}/bucket={b}" for b, names in manifest["buckets"].items() for name in names if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def save(rows: DataFrame, root: str, key: str = "chunk_id", buckets: int = BUCKETS) -> int:
    """The rows as a new version that replaces all before; its number."""
    spark = rows.sparkSession
    name, have = _write(rows, root, key, buckets)
    manifest = {"key": key, "count": buckets, "schema": rows.schema.jsonValue(), "buckets": {str(b): [name] for b in have}}
    return _published(spark, root, lambda _: manifest)


def merge(rows: DataFrame, root: str, key: str = "chunk_id") -> int:
    """Upsert into the last version: new keys are appended, buckets with a replaced key are written anew; the new number."""
    spark = rows.sparkSession
    if not versions(spark, root):
        return save(rows, root, key)

    def make(last: int) -> dict:
        old = _manifest(spark, root, last)
        count, named = old["count"], {int(b): list(names) for b, names in old["buckets"].items()}
        current = _read(spark, root, old)
        both = rows.select(key).join(current.select(key), key, "left_semi")
        touched = {row[0] for row in both.select(_bucket(key, count).alias("b")).distinct().collect()}
        touched |= {b for b, names in named.items() if len(names) >= WRITES}
        columns = [f.name for f in StructType.fromJson(old["schema"])]
        fresh = rows.select(*columns)
        again = upsert(_read(spark, root, old, sorted(touched)), fresh.where(_bucket(key, count).isin(sorted(touched))), key) if touched else None
        added = fresh.where(~_bucket(key, count).isin(sorted(touched))) if touched else fresh
        name, have = _write(added if again is None else again.unionByName(added), root, key, count)
        for b in have:
            named[b] = [name] if b in touched else [*named.get(b, []), name]
        return old | {"buckets": {str(b): names for b, names in named.items()}}

    return _published(spark, root, make)


def _published(spark: SparkSession, root: str, make, patience: float = 30.0) -> int:
    """Commit what ``make`` builds on the last version; on the next one if another writer was first.

    A claim without a manifest after ``patience`` seconds is that of a writer that died; its number stays empty.
    """
    skipped = 0
    while True:
        last = (versions(spark, root) or [0])[-1]
        manifest, number = make(last), last + 1 + skipped
        if _commit(spark, root, number, manifest):
            _forget(spark, root)
            return number
        until = time.monotonic() + patience
        while time.monotonic() < until and (versions(spark, root) or [0])[-1] <= last:
            time.sleep(0.2)
        skipped = 0 if (versions(spark, root) or [0])[-1] > last else skipped + 1


def _forget(spark: SparkSession, root: str) -> None:
    """Delete old manifests and the writes that they alone name; a write that no manifest names may be still on its way."""
    known = versions(spark, root)
    named = {v: {name for names in _manifest(spark, root, v)["buckets"].values() for name in names} for v in known}
    live = set().union(*(named[v] for v in known[-KEPT:]))
    for version in known[:-KEPT]:
        for name in named[version] - live:
            discard(spark, f"{root}/data/{name}")
        for kind in ("json", "claim"):
            discard(spark, f"{root}/versions/{version:06d}.{kind}")


def load(spark: SparkSession, root: str) -> DataFrame:
    known = versions(spark, root)
    if not known:
        raise FileNotFoundError(root)
    return _read(spark, root, _manifest(spark, root, known[-1]))


def reset(spark: SparkSession, root: str) -> None:
    discard(spark, root)
