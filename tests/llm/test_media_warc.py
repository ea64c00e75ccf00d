"""Round trips through archives and files, and the defined cases."""

import hashlib
import zipfile
import zlib

import pytest

from plumbline.llm import common, media, storage, warc

TEXTS = [None, "", "a", "x" * 64, "x" * 65, "Äöü\x00", "tail\x00\x00", "long " * 300_000, "x" * 64]


def test_image_round_trip():
    for text in TEXTS:
        samples, n = media.payload(text)
        assert len(samples) % 64 == 0 and samples
        assert media.decode(media.encode(samples, n)) == (samples, n)
        assert samples[:n] == (text or "").encode()


def test_damaged_image():
    image = bytearray(media.encode(*media.payload("some text")))
    image[-20] ^= 1
    with pytest.raises(ValueError):
        media.decode(bytes(image))


def test_archives(spark):
    rows = [(i if i else None, t, "n", b"m") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, media binary").repartition(2)
    folder = media.store(df, roll=100)
    archives = storage.listing(folder, ".zip")
    assert len(archives) > 2
    whole = media.load(spark, folder)
    split = media.load(spark, folder, range_bytes=200)
    assert sorted(map(str, whole.collect())) == sorted(map(str, split.collect()))
    found = {r.member_id: r for r in media.measured(split).collect()}
    assert len(found) == len(rows)
    for doc, text, *_ in rows:
        samples, n = media.payload(text)
        r = found[None if doc is None else str(doc)]
        image = media.encode(samples, n)
        assert (r.n_bytes, r.payload_bytes) == (n, len(samples))
        assert r.payload_sha256 == hashlib.sha256(samples).hexdigest()
        assert r.tail_crc32 == zlib.crc32(samples[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())


class Flaky:
    """A file system whose reads at given offsets fail so many times; it notes where reads began."""

    def __init__(self, fs, failing):
        self.fs, self.failing, self.seen = fs, failing, []

    def open_input_file(self, path):
        source, outer = self.fs.open_input_file(path), self

        class File:
            def seek(self, at):
                source.seek(at)

            def read(self, size):
                at = source.tell()
                outer.seen.append(at)
                if outer.failing.get(at, 0):
                    outer.failing[at] -= 1
                    raise OSError("connection lost")
                return source.read(size)

        return File()


def test_members_are_retried_by_offset(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text number {i} " * 20) for i in range(12)], "doc_id long, text string").coalesce(1)
    folder = media.store(df)
    want = {r.member_id: (r.offset, r.media) for r in media.load(spark, folder).collect()}
    reader = media.MediaReader({"path": folder})
    (part,) = reader.partitions()
    located = storage.located

    def read(failing):
        flaky = []

        def through(uri):
            fs, base = located(uri)
            flaky.append(Flaky(fs, failing))
            return flaky[0], base

        monkeypatch.setattr(storage, "located", through)
        try:
            rows = [r for batch in reader.read(part) for r in batch.to_pylist()]
        finally:
            monkeypatch.setattr(storage, "located", located)
        return rows, flaky[0].seen

    bad = want["5"][0]
    rows, seen = read({bad: 2, part.start: 1})
    assert {r["member_id"]: (r["offset"], r["media"]) for r in rows} == want
    # the bad member alone was read again, from its own offset
    assert seen.count(bad) == 3 and seen.count(part.start) == 2 and seen.count(want["4"][0]) == seen.count(want["6"][0]) == 1
    with pytest.raises(ValueError, match=f"member at {bad}"):
        read({bad: 3})


def test_only_archives_of_the_manifest_are_read(spark):
    df = spark.createDataFrame([(i, f"row {i}") for i in range(6)], "doc_id long, text string").repartition(2)
    folder = media.store(df)
    fs, base = storage.located(folder)
    name = storage.listing(folder, ".zip")[0][0]
    # what a lost or speculative attempt leaves behind: a whole archive and a torn one
    whole = fs.open_input_file(f"{base}/{name}").read()
    for left, data in (("part-000000-other-0000.zip", whole), ("part-000009-torn-0000.zip", whole[:40])):
        with fs.open_output_stream(f"{base}/{left}") as out:
            out.write(data)
    assert sorted(int(r.member_id) for r in media.load(spark, folder).collect()) == list(range(6))
    # a damaged archive of the manifest is an error, never a missing row
    with fs.open_output_stream(f"{base}/{name}") as out:
        out.write(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="of .*zip"):
        media.load(spark, folder).collect()


def test_directories_are_cut_into_ranges(spark):
    df = spark.createDataFrame([(i, "x" * 2000 + str(i)) for i in range(300)], "doc_id long, text string").coalesce(1)
    folder = media.store(df, mark=1000)
    parts = media.MediaReader({"path": folder, "range_bytes": "5000"}).partitions()
    assert len(parts) > 3 and all(a.end == b.start for a, b in zip(parts, parts[1:]))
    found = media.load(spark, folder, range_bytes=5000)
    assert found.rdd.getNumPartitions() == len(parts) and sorted(int(r.member_id) for r in found.collect()) == list(range(300))


def test_shared_folder_is_never_local_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Inner:
                    @staticmethod
                    def getCheckpointDir():
                        class Nothing:
                            @staticmethod
                            def isDefined():
                                return False

                            @staticmethod
                            def get():
                                raise AssertionError

                        return Nothing

                return Inner

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_root(Session)


def test_tables_are_dropped(spark):
    table = common.written(spark.range(3), "numbers")
    folder, path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, table._scratch
    fs = folder(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert table.count() == 3 and fs.exists(folder(path))
    common.dropped(table)
    assert not fs.exists(folder(path))


def test_retries():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("lost")
        return 7

    assert storage.retried(flaky, 3) == 7
    with pytest.raises(OSError):
        calls.clear()
        storage.retried(flaky, 2)
    torn = iter([zipfile.BadZipFile("no directory"), zlib.error("cut off"), None])

    def damaged():
        error = next(torn)
        if error:
            raise error
        return 8

    assert storage.retried(damaged, 3) == 8


def test_empty_archives(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert media.load(spark, media.store(df)).count() == 0


def page_rows():
    same = "<html>" + "same " * 50 + "</html>"
    return (
        [(i, f"http://x/{i}", same, "z") for i in (9, 3, 7, 1000)]
        + [(i, None, "short", "z") for i in (1, 2)]
        + [(4, "http://x/ü\r\nX: y", "Änderung " * 40, "z"), (5, "u", None, "z"), (6, "u", "", "z"), (None, "u", same, "z")]
        + [(8, "u", same, "z"), (8, "u", same, "z"), (3, "v", same, "z"), (1 << 60, "far", "x" * 3_000_000, "z")]
    )


def test_warc_roles_and_bytes(spark):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string, kind string")
    folder = warc.write(df.repartition(3), shard_bytes=5000, roll_bytes=700)
    found = warc.read(spark, folder).collect()
    assert len(found) == len(page_rows())
    for r in found:
        body = next((h or "").encode() for p, u, h, _ in page_rows() if p == r.page_id and (u or "") == r.url)
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
    same = sorted((r.page_id or -1, r.record_type, r.refers_to or 0) for r in found if r.payload_bytes == 263)
    assert same == [(-1, "response", 0), (3, "response", 0), (3, "revisit", 3), (7, "revisit", 3), (8, "revisit", 3), (8, "revisit", 3), (9, "revisit", 3), (1000, "revisit", 3)]
    assert all(r.record_type == "response" for r in found if r.payload_bytes != 263)
    manifest = spark.read.parquet(folder + "/_manifest").collect()
    assert sum(m.records for m in manifest) == len(found) and len(manifest) > 3
    again = warc.write(df.repartition(5), shard_bytes=5000, roll_bytes=700)
    key = lambda m: (m.file, m.sha256, m.bytes, m.records)
    assert sorted(map(key, manifest)) == sorted(map(key, spark.read.parquet(again + "/_manifest").collect()))


def test_warc_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(spark, warc.write(df)).count() == 0


def test_shards_of_clustered_and_hot_ids(spark):
    """Ids in dense clusters far apart, one id and missing ids with a third of all bytes each: no shard outgrows the rest."""
    rows = [(base + i, 700) for base in (-(1 << 62), 0, 1 << 40, (1 << 62) + 5) for i in range(300)]
    rows += [(77, 700)] * 0 + [(1 << 41, 400 + i % 7) for i in range(900)] + [(None, 350 + i % 5) for i in range(900)]
    pages = [(i, f"u{n}", f"{n:06d}" + "x" * size) for n, (i, size) in enumerate(rows)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = warc.write(df.repartition(3), shard_bytes=60_000, level=1)
    manifest = spark.read.parquet(folder + "/_manifest").collect()
    sizes = {}
    for m in manifest:
        sizes[m.shard] = sizes.get(m.shard, 0) + m.records
    assert len(sizes) >= 40 and max(sizes.values()) <= 130
    found = warc.read(spark, folder).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.url) for r in found) == sorted((i is None, i or 0, u) for i, u, _ in pages)
    assert all(r.record_type == "response" for r in found)
    again = warc.write(df.repartition(5), shard_bytes=60_000, level=1)
    key = lambda m: (m.file, m.sha256, m.bytes, m.records)
    assert sorted(map(key, manifest)) == sorted(map(key, spark.read.parquet(again + "/_manifest").collect()))
    few = spark.read.parquet(warc.write(df, shard_bytes=1, most_shards=5, level=1) + "/_manifest").select("shard").distinct().count()
    assert few <= 12
