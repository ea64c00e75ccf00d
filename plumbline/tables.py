"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Paths that ``scratch`` has given out and nobody has deleted.
_PATHS: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    ``spark.checkpoint.dir`` names it on a cluster. Only where that is unset and
    the master is local, as in tests, is a folder of this machine taken; on any
    other master that would lose data, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = f"{shared_root(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    _PATHS.add(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table of the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` has made and nothing reads any more."""
    for table in tables:
        discard(table.sparkSession, table._scratch)


def clear(spark: SparkSession) -> None:
    """Delete whatever this process has put under the shared folder and not deleted, once all results that read it stand."""
    while _PATHS:
        discard(spark, next(iter(_PATHS)))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a file or folder."""
    _PATHS.discard(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path, and the path there, for Python code."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)
