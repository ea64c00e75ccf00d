"""Media columns: payloads as lossless images in archives, read by a custom data source.

``store`` turns every text into bytes padded with zeros to a positive multiple of
64, encodes these as an 8-bit grey image of 64 samples a row (PNG, lossless) and
appends the image to an archive of its task, a ZIP file in the shared folder whose
name no other attempt of the task has. The ``_manifest`` table, committed by Spark,
lists the archives of the attempts that counted, with marks in their directories:
byte ranges whose entries hold about ``MARK`` bytes of images. What a lost or
speculative attempt leaves behind is in no manifest and is never read. Equal
payloads have equal bytes.

``MediaArchives`` is a Spark data source over such a folder. It plans partitions
from the manifest, each a byte range of one archive's directory. A partition reads
only its part of the directory, seeks to each member by its offset, checks its
checksum, tries it again from that offset if reading fails, whatever became of
others, and streams members through Arrow in batches of bounded size.

Defined results: null text counts as empty and is stored as 64 zeros; a null id
comes back null; repeated rows are members of their own; an empty table makes an
empty folder and no rows; other columns are ignored whatever their names. A text
is one member however long; a batch holds one member at least.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.llm import storage
from plumbline.llm.common import batches, pairs, scratch

ROW = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of compressed samples in one chunk of an image.
CHUNK = 1 << 20
#: Bytes after which a task begins another archive.
ROLL = 256 << 20
#: Bytes of images between two marks of a directory.
MARK = 4 << 20
LOCAL_HEADER = struct.Struct("<4sHHHHHLLLHH")
ENTRY = struct.Struct("<4sHHHHHHLLLHHHHHLL")

MANIFEST = "archive string, members long, bytes long, dir_start long, dir_end long"


def payload(text: str | None) -> tuple[bytes, int]:
    """(padded bytes, bytes before padding)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % ROW if raw else ROW), len(raw)


def encode(samples: bytes, n_bytes: int, level: int = 4) -> bytes:
    """A grey 8-bit PNG of 64 samples a row; a private chunk holds the bytes before padding."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    data = zlib.compress(lines.tobytes(), level)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))

    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, chunk(b"IHDR", head), chunk(b"unLg", struct.pack(">Q", n_bytes)), *(chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)), chunk(b"IEND", b"")])


def decode(image: bytes) -> tuple[bytes, int]:
    """(samples, bytes before padding) of an image that ``encode`` made."""
    if image[:8] != SIGNATURE:
        raise ValueError("not an image")
    at, parts, size, n_bytes = 8, [], None, 0
    while at < len(image):
        length = struct.unpack_from(">I", image, at)[0]
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + length]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", image, at + 8 + length)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"unLg":
            n_bytes = struct.unpack(">Q", body)[0]
        elif kind == b"IDAT":
            parts.append(body)
        at += length + 12
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes(), n_bytes


def features(samples: bytes) -> str:
    """Statistics of the samples as one string: size, mean, deviation, mean step, share of low bits, entropy."""
    own = np.frombuffer(samples, np.uint8)
    counts = np.bincount(own, minlength=256)
    share = counts[counts > 0] / len(own)
    steps = np.abs(np.diff(own.astype(np.int16)))
    return f"n={len(own)};mean={own.mean():.6f};std={own.std():.6f};step={steps.mean():.6f};odd={int((own & 1).sum())};entropy={-(share * np.log2(share)).sum():.6f}"


def _marks(archive: zipfile.ZipFile, mark: int) -> Iterator[tuple[int, int, int, int]]:
    """(members, bytes of images, start, end) of neighbouring byte ranges of the directory of a closed archive."""
    members = size = 0
    start = at = archive.start_dir
    for member in archive.infolist():
        # entries have no extra fields: archives stay below the sizes that need them
        at += ENTRY.size + len(member.filename) + len(member.comment)
        members, size = members + 1, size + member.compress_size
        if size >= mark:
            yield members, size, start, at
            start, members, size = at, 0, 0
    if members:
        yield members, size, start, at


def _writer(folder: str, roll: int, mark: int):
    schema = pa.schema([("archive", pa.string()), ("members", pa.int64()), ("bytes", pa.int64()), ("dir_start", pa.int64()), ("dir_end", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        rows = pairs(stream)
        pending = next(rows, None)
        number, done = 0, []
        while pending is not None:
            name = f"{attempt}-{number:04d}.zip"
            with storage.committed(folder, name) as out:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                    members = size = 0
                    while pending is not None and (not members or size < roll):
                        doc, text = pending
                        member = zipfile.ZipInfo(f"{members:08d}.png", (1980, 1, 1, 0, 0, 0))
                        member.comment = b"" if doc is None else b"=" + str(doc).encode()
                        image = encode(*payload(text))
                        archive.writestr(member, image)
                        members, size = members + 1, size + len(image)
                        pending = next(rows, None)
            done += [(name, *found) for found in _marks(archive, mark)]
            number += 1
        yield from batches(iter(done), schema)

    return run


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, roll: int = ROLL, mark: int = MARK) -> str:
    """Write every payload; the folder of the archives, in which ``_manifest`` lists them."""
    folder = folder or scratch(docs.sparkSession, "media")
    docs.select(id_col, text_col).mapInArrow(_writer(folder, roll, mark), MANIFEST).write.parquet(f"{folder}/_manifest")
    return folder


class Range(InputPartition):
    """Members of an archive whose directory entries lie in the bytes [start, end) of the file."""

    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MediaArchives(DataSource):
    """Option ``path``: the folder; ``range_bytes``: bytes of images in one partition; ``attempts`` per member."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "member_id string, archive string, offset long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_bytes", 16 << 20))
        self.attempts = int(options.get("attempts", 3))

    def partitions(self) -> list[Range]:
        """Neighbouring marks of an archive, as the manifest lists them, up to ``range_bytes`` of images."""
        fs, base = storage.located(self.folder)
        marks = []
        for name, _ in storage.listing(f"{self.folder}/_manifest", ".parquet"):
            with fs.open_input_file(f"{base}/_manifest/{name}") as source:
                table = pq.read_table(source, columns=["archive", "dir_start", "dir_end", "bytes"])
            marks += zip(*(c.to_pylist() for c in table.columns), strict=True)
        found: list[Range] = []
        load = 0
        for archive, start, end, size in sorted(marks):
            if found and found[-1].archive == archive and load + size <= self.range_bytes:
                found[-1].end = end
                load += size
            else:
                found.append(Range(archive, start, end))
                load = size
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, base = storage.located(self.folder)
        path = f"{base}/{partition.archive}"
        held = [None]

        def taken(offset: int, size: int) -> bytes:
            if held[0] is None:
                held[0] = fs.open_input_file(path)
            held[0].seek(offset)
            found = held[0].read(size)
            if len(found) != size:
                raise ValueError(f"{path} ends within the {size} bytes at {offset}")
            return found

        def attempt(action, what: str):
            """A fresh handle after an error."""

            def once():
                try:
                    return action()
                except storage.INPUT_ERRORS as error:
                    held[0] = None
                    raise ValueError(f"{what} of {path}: {error}") from error

            return storage.retried(once, self.attempts)

        def directory() -> list[tuple[str | None, int, int, int]]:
            """(id, offset, size, checksum) of each entry."""
            raw, at, entries = taken(partition.start, partition.end - partition.start), 0, []
            while at < len(raw):
                entry = ENTRY.unpack_from(raw, at)
                if entry[0] != b"PK\x01\x02":
                    raise ValueError("no directory entry where the manifest has one")
                at += ENTRY.size + entry[10] + entry[11]
                comment = raw[at : at + entry[12]]
                at += entry[12]
                entries.append((comment[1:].decode() if comment else None, entry[16], entry[8], entry[7]))
            return entries

        def member(offset: int, size: int, checksum: int) -> bytes:
            head = LOCAL_HEADER.unpack(taken(offset, LOCAL_HEADER.size))
            body = taken(offset + LOCAL_HEADER.size + head[9] + head[10], size)
            if head[0] != b"PK\x03\x04" or zlib.crc32(body) != checksum:
                raise ValueError("damaged member")
            return body

        def rows() -> Iterator[tuple]:
            for doc, offset, size, checksum in attempt(directory, f"directory at {partition.start}"):
                yield doc, partition.archive, offset, attempt(lambda: member(offset, size, checksum), f"member at {offset}")  # noqa: B023

        schema = pa.schema([("member_id", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary())])
        yield from batches(rows(), schema, lambda row: 128 + len(row[3]))


def load(spark, folder: str, range_bytes: int = 16 << 20, attempts: int = 3) -> DataFrame:
    """(member_id, archive, offset, media) of every member of the folder."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("path", folder).option("range_bytes", str(range_bytes)).option("attempts", str(attempts)).load()


def _measure(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("member_id", pa.string()), ("payload_bytes", pa.int64()), ("n_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def rows() -> Iterator[tuple]:
        for member, image in pairs(stream):
            samples, n_bytes = decode(image)
            yield member, len(samples), n_bytes, hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]), len(image), hashlib.sha256(image).hexdigest(), features(samples)

    yield from batches(rows(), schema, lambda row: 320)


def measured(members: DataFrame) -> DataFrame:
    """Digests and features of every member, from the stored bytes."""
    return members.select("member_id", "media").mapInArrow(_measure, "member_id string, payload_bytes long, n_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
