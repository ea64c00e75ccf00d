"""Incremental ingest of a folder of documents as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import chunking, index
from plumbline.tables import dropped, written

DOCUMENT = "doc_id string, title string, text string, url string"


def start(spark: SparkSession, source: str, root: str, checkpoint: str, target: int = 450, overlap: int = 60) -> StreamingQuery:
    """New files are chunked, chunks whose text is indexed are skipped, the rest is embedded and upserted.

    Each micro-batch is merged into the index: new chunks are appended, only buckets in which a chunk is
    replaced are written anew. A batch that runs again finds its chunks indexed.
    """

    def ingest(batch: DataFrame, _: int) -> None:
        chunks = written(chunking.chunk(batch, target, overlap), "batch-chunks")
        new = index.pending(chunks, index.load(spark, root)) if index.versions(spark, root) else chunks
        index.merge(index.embed(new), root)
        dropped(chunks)

    stream = spark.readStream.schema(DOCUMENT).parquet(source)
    return stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
