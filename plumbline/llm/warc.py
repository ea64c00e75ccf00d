"""A deterministic sharded WARC writer and its reader.

Shards are ranges of record ids of about ``shard_bytes``, or of as much more as makes
``most_shards`` of them. Their bounds come from sums of bytes over equal-width cells of
the id range; cells that hold more than a shard are cut again, all in one job, until
none is left or each is a single id. The records of one id, or without an id, that are
more than a shard are dealt out to several by their payloads' digests. So shards depend
on the records alone. Each shard is one task, sorted by id; it appends compressed records to a file and begins another when the
compressed size reaches ``roll_bytes``. Headers are made anew: record ids are
name-based UUIDs, the date is a parameter, digests are computed from the bytes
written. A file takes its name ``shard-S-N.warc.gz`` when it is whole; a manifest
table, committed by Spark, lists files with sizes and digests, and readers take
only what it lists. The same records give the same files, byte for byte.

Of records with equal payloads of at least ``least_bytes``, that of the smallest
id is the response and the others are revisits that refer to it. Payload groups
are counted by digest with map-side combining; only their ids are shuffled by
digest, never the payloads, which move once, to their shard.

Defined results: a null payload counts as empty; records with a null id come first,
as responses, and never revisit or are referred to; of equal rows the first is the
response and the others revisit it (equal rows go to one task, whatever their number,
which holds one at a time); an empty table writes no file and reads
back no rows; a null URL becomes an empty one; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import storage
from plumbline.llm.common import batches, dropped, scratch, written

#: Cells of the id range at first, and of a cell that is cut again.
CELLS, CUT = 4096, 64
#: Shards at most.
MOST_SHARDS = 20_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 1 << 20

MANIFEST = "file string, shard long, records long, bytes long, sha256 string, first_id long, last_id long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"


class Shards:
    """Where records go: a shard for each cell of the id range, several for a single id that is too large for one."""

    def __init__(self, starts: list[int], first: list[int], parts: list[int], count: int):
        self.starts, self.first, self.parts = np.array(starts, np.int64), np.array(first, np.int64), np.array(parts, np.int64)
        self.count = count

    def of(self, page_id: Column, digest: Column) -> Column:
        starts, first, parts = self.starts, self.first, self.parts

        @F.pandas_udf("int")
        def shard(ids: pd.Series, none: pd.Series, digests: pd.Series) -> pd.Series:
            cell = _cells(starts, ids, none)
            return pd.Series((first[cell] + digests.to_numpy() % parts[cell]).astype(np.int32))

        return shard(F.coalesce(page_id, F.lit(0)), page_id.isNull(), F.xxhash64(digest))


def _cells(starts: np.ndarray, ids: pd.Series, none: pd.Series) -> np.ndarray:
    """The cell of each id, 0 for nulls: cell n holds the ids from ``starts[n - 1]`` on."""
    return np.where(none.to_numpy(), 0, np.searchsorted(starts, ids.to_numpy(), "right"))


def _cell_udf(starts: np.ndarray):
    @F.pandas_udf("int")
    def cell(ids: pd.Series, none: pd.Series) -> pd.Series:
        return pd.Series(_cells(starts, ids, none).astype(np.int32))

    return cell


def _shards(sizes: DataFrame, shard_bytes: int, most_shards: int) -> Shards:
    """The shards for the rows (page_id, bytes), from sums over cells that are cut until they fit."""
    low, high, total = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes")).first()
    shard_bytes = max(shard_bytes, -(-(total or 0) // most_shards))
    low, high = (0, 0) if low is None else (int(low), int(high))
    step = max(1, -(-(high - low + 1) // CELLS))
    starts = list(range(low, high + 1, step))
    while True:
        own = np.array(starts, np.int64)
        weights = dict(sizes.groupBy(_cell_udf(own)(F.coalesce("page_id", F.lit(0)), F.col("page_id").isNull()).alias("cell")).agg(F.sum("bytes")).collect())
        ends = [*starts[1:], high + 1]
        cut: list[int] = []
        for cell, (start, end) in enumerate(zip(starts, ends, strict=True), 1):
            fits = weights.get(cell, 0) <= shard_bytes
            cut += [start] if fits else range(start, end, max(1, -(-(end - start) // CUT)))
        if len(cut) == len(starts):
            break
        starts = cut
    # neighbouring cells share a shard while they fit; a single id that does not has shards of its own
    first, parts, shard, load = [0] * (len(starts) + 1), [1] * (len(starts) + 1), 0, 0
    for cell in range(len(starts) + 1):
        weight = weights.get(cell, 0)
        if load and load + weight > shard_bytes:
            shard, load = shard + 1, 0
        first[cell], parts[cell] = shard, max(1, -(-weight // shard_bytes))
        if parts[cell] > 1:
            shard, load = shard + parts[cell], 0
        else:
            load += weight
    return Shards(starts, first, parts, shard + (1 if load else 0) or 1)


def identity(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{page_id}:{digest}:{copy}')}>"


def record(page_id: int | None, url: str | None, body: bytes, digest: str, copy: int, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit has the headers of the response and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if revisit else http + body
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", identity(page_id, digest, copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        ("X-Url", base64.b64encode((url or "").encode("utf-8", "surrogatepass")).decode()),
        ("X-Payload-Length", str(len(body))),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", identity(refers_to, digest, 0)), ("X-Refers-To-Page", str(refers_to))]
    headers.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def _write(folder: str, roll_bytes: int, date: str, level: int):
    schema = pa.schema([("file", pa.string()), ("shard", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())])

    def compressed(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, bytes]]:
        """(shard, id, compressed record) in order; a note row (kind 0) precedes the pages that it concerns."""
        current, firsts, copies = None, {}, {}
        for batch in stream:
            for i in range(batch.num_rows):
                shard, page_id, kind, digest, first, url, html = (batch.column(c)[i].as_py() for c in range(7))
                if current != (shard, page_id):
                    current, firsts, copies = (shard, page_id), {}, {}
                if kind == 0:
                    firsts[digest] = first
                    continue
                body = (html or "").encode("utf-8", "surrogatepass")
                copy = copies[digest] = copies.get(digest, -1) + 1
                first = firsts.get(digest)
                revisit = first is not None and (first != page_id or copy > 0)
                squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = record(page_id, url, body, digest, copy, first, revisit, date)
                yield shard, page_id, squeeze.compress(data) + squeeze.flush()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = compressed(stream)
        pending = next(rows, None)
        done, at, number = [], None, 0
        while pending is not None:
            shard = pending[0]
            number = number + 1 if shard == at else 0
            at = shard
            name = f"shard-{shard:06d}-{number:04d}.warc.gz"
            digest, size, records, first_id = hashlib.sha256(), 0, 0, pending[1]
            with storage.committed(folder, name) as out:
                while pending is not None and pending[0] == shard and (not records or size < roll_bytes):
                    out.write(pending[2])
                    digest.update(pending[2])
                    size, records, last_id = size + len(pending[2]), records + 1, pending[1]
                    pending = next(rows, None)
            done.append((name, shard, records, size, digest.hexdigest(), first_id, last_id))
        yield from batches(iter(done), schema)

    return run


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, shard_bytes: int = 32 << 20, roll_bytes: int = 256 << 20, least_bytes: int = 100, date: str = DATE, level: int = 5, most_shards: int = MOST_SHARDS) -> str:
    """Write all records; the folder, whose ``_manifest`` table lists the files."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    html = F.coalesce("html", F.lit(""))
    facts = written(own.select("page_id", F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes")), "page-facts")
    long_enough = facts.where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    firsts = long_enough.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    firsts = written(firsts, "repeated-payloads")
    notes = long_enough.join(firsts, "digest").distinct()
    shards = _shards(facts.select("page_id", (F.col("bytes") + 512).alias("bytes")), shard_bytes, most_shards)
    none = F.lit(None).cast("string")
    rows = notes.select("page_id", F.lit(0).alias("kind"), "digest", "first", none.alias("url"), none.alias("html")).unionAll(
        own.select("page_id", F.lit(1).alias("kind"), F.sha2(html.cast("binary"), 256).alias("digest"), F.lit(None).cast("long").alias("first"), "url", "html")
    )
    dealt = rows.withColumn("shard", shards.of(F.col("page_id"), F.col("digest"))).repartitionById(shards.count, F.col("shard")).sortWithinPartitions("shard", "page_id", "kind", "digest", "url")
    dealt.select("shard", "page_id", "kind", "digest", "first", "url", "html").mapInArrow(_write(folder, roll_bytes, date, level), MANIFEST).write.parquet(f"{folder}/_manifest")
    dropped(facts, firsts)
    return folder


def members(source) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every gzip member of a file, read in blocks."""
    offset, inflate, parts, data = 0, zlib.decompressobj(31), [], source.read(BLOCK)
    used = 0
    while data:
        parts.append(inflate.decompress(data))
        if inflate.eof:
            used += len(data) - len(inflate.unused_data)
            yield offset, b"".join(parts)
            offset += used
            data, used, parts = inflate.unused_data or source.read(BLOCK), 0, []
            inflate = zlib.decompressobj(31)
        else:
            used += len(data)
            data = source.read(BLOCK)
    if parts:
        raise ValueError(f"the member at {offset} is cut off")


def parse(data: bytes) -> tuple:
    """(id, URL, payload bytes, payload digest, type, id referred to) of a record, its digests verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
        raise ValueError("damaged block")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        body = block.partition(b"\r\n\r\n")[2]
        if len(body) != size or hashlib.sha256(body).hexdigest() != digest:
            raise ValueError("damaged payload")
    number = lambda key: int(fields[key]) if key in fields else None
    return number("X-Page-Id"), base64.b64decode(fields["X-Url"]).decode("utf-8", "surrogatepass"), size, digest, fields["WARC-Type"], number("X-Refers-To-Page")


def _read(folder: str):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = storage.located(folder)

        def rows() -> Iterator[tuple]:
            for batch in stream:
                for name in batch.column(0).to_pylist():
                    with fs.open_input_file(f"{base}/{name}") as source:
                        for offset, data in members(source):
                            yield *parse(data), name, offset

        yield from batches(rows(), schema, lambda row: 256)

    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the files that the manifest lists."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    files = max(1, manifest.count())
    return manifest.select("file").repartition(files).mapInArrow(_read(folder), RECORDS)
