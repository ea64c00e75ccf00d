"""Benchmark decontamination with an Aho-Corasick automaton over word windows.

Texts are normalised byte by byte: A-Z are lowered and every other ASCII byte
that is no letter or digit becomes a space. That keeps offsets: byte n of the
normalised text is byte n of the text's UTF-8. Each distinct word of the items gets
a code of the same few letters, from an alphabet of its own for each place, and all
other words share a code that no window has. So a document becomes a short string in
which matches begin and end at words, and the automaton runs over it once. Its patterns
are the windows of consecutive item words. A document word is hit if it lies inside
any occurrence of any window.

The items are a stated query set. Those of at most ``max_bytes`` of text form one
automaton, which a worker process builds once and keeps for its later tasks; a
larger set is cut into blocks of that size, and texts are gathered up to ``HELD``
bytes and scanned block by block, so that one automaton stands at a time.

Defined results: null and empty texts have no words and are clean; an item
without words has no window; repeated items each count under their own id; a
repeated document row is scanned once for each row; an empty item table leaves
every document clean; other columns are ignored whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import batches, kept, pairs

#: A-Z to a-z, ASCII letters and digits and all bytes of other characters to themselves, the rest to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: Letters of the alphabet for one place of a code.
ALPHABET = 128
#: Bytes of texts that are gathered while several automata take turns.
HELD = 32 << 20
#: Bytes of items in one automaton: some 300,000 windows.
MAX_BYTES = 2 << 20
#: Automata that a worker process keeps.
KEPT = 2

SCHEMA = "doc_id {id}, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows(item: list, size: int) -> Iterator[list]:
    """The item's windows of words; an item of fewer words is one window."""
    for i in range(max(1, len(item) - size + 1) if item else 0):
        yield item[i : i + size]


class Automaton:
    """One Aho-Corasick automaton over the windows of (item id, text) rows."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        import ahocorasick

        texts = [(item_id, words(text)) for item_id, text in items]
        known = sorted({word for _, item in texts for word in item})
        self.width = 1
        while ALPHABET**self.width <= len(known):
            self.width += 1
        self.codes = {word: self._code(number) for number, word in enumerate(known, 1)}
        self.other = self._code(0)
        found: dict[str, tuple[int, set[str]]] = {}
        for item_id, item in texts:
            for window in windows(item, size):
                found.setdefault(self.spelled(window), (len(window), set()))[1].add(item_id)
        self.machine = ahocorasick.Automaton()
        for window, value in found.items():
            self.machine.add_word(window, value)
        if found:
            self.machine.make_automaton()
        self.empty = not found

    def _code(self, number: int) -> str:
        """The number's digits, each place with letters of its own."""
        return "".join(chr(place * ALPHABET + number // ALPHABET**place % ALPHABET) for place in range(self.width))

    def spelled(self, own: list[bytes]) -> str:
        get, other = self.codes.get, self.other
        return "".join([get(word, other) for word in own])

    def scan(self, own: list[bytes]) -> list[tuple[int, int, set[str]]]:
        """(place of the first word, words, item ids) of every occurrence of a window."""
        if self.empty:
            return []
        width = self.width
        return [((last + 1) // width - n, n, ids) for last, (n, ids) in self.machine.iter(self.spelled(own))]


_BUILT: dict[str, Automaton] = {}


def built(name: str, block, size: int) -> Automaton:
    """The automaton of a broadcast block, built once for each worker process and name."""
    if name not in _BUILT:
        while len(_BUILT) >= KEPT:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[name] = Automaton(block.value, size)
    return _BUILT[name]


def spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets, in the text as it came, of each run of hit words."""
    kept = np.frombuffer(text.translate(FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], kept, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    # bytes that begin a character, counted up to each offset
    begun = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    runs = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return [(int(begun[starts[a]]), int(begun[ends[b - 1]])) for a, b in zip(runs[::2], runs[1::2], strict=True)]


def gathered(stream: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple]]:
    """Rows (document, text's bytes) in lists of about ``limit`` bytes, one row at least."""
    part, load = [], 0
    for doc, text in pairs(stream):
        raw = (text or "").encode("utf-8", "surrogatepass")
        part.append((doc, raw))
        load += len(raw)
        if load >= limit:
            yield part
            part, load = [], 0
    if part:
        yield part


def scanner(blocks: list[tuple[str, object]], size: int, id_type: pa.DataType):
    """``blocks``: a name and a broadcast list of (item id, text) each."""
    schema = pa.schema([("doc_id", id_type), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in gathered(stream, HELD if len(blocks) > 1 else 1):
                found: list[list] = [[] for _ in part]
                sizes = [0] * len(part)
                for name, block in blocks:
                    machine = built(name, block, size)
                    for at, (_, raw) in enumerate(part):
                        own = raw.translate(FOLD).split()
                        sizes[at] = len(own)
                        found[at] += machine.scan(own)
                for (doc, raw), n, hits in zip(part, sizes, found, strict=True):
                    if not hits:
                        yield doc, n, 0, [], []
                        continue
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, [h[0] for h in hits], 1)
                    np.add.at(cover, [h[0] + h[1] for h in hits], -1)
                    hit = np.cumsum(cover[:-1]) > 0
                    ids = sorted(set().union(*(h[2] for h in hits)))
                    yield doc, n, int(hit.sum()), ids, [{"start": a, "end": b} for a, b in spans(raw, hit)]

        yield from batches(rows(), schema, lambda row: 64 + 16 * len(row[3]) + 16 * len(row[4]))

    return run


def item_blocks(items: DataFrame, id_col: str, text_col: str, max_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of at most ``max_bytes`` of text (one item at least), read one partition at a time."""
    block, load = [], 0
    for item_id, text in items.selectExpr(f"cast(`{id_col}` as string)", f"`{text_col}`").toLocalIterator():
        weight = len((text or "").encode())
        if block and load + weight > max_bytes:
            yield block
            block, load = [], 0
        block.append((item_id or "", text))
        load += weight
    yield block


def _shared(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, max_bytes: int) -> list[tuple[str, object]]:
    context = docs.sparkSession.sparkContext
    return [(uuid.uuid4().hex, context.broadcast(block)) for block in item_blocks(items, id_col, text_col, max_bytes)]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Words, hit words, hit items (sorted as strings) and hit spans (character offsets) of every document."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    run = scanner(_shared(docs, items, item_col, item_text_col, max_bytes), size, to_arrow_type(kind))
    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA.format(id=kind.simpleString()))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows without a hit, with all columns as they came."""

    def judge(name, block):
        def begin():
            machine = built(name, block, size)
            return lambda text: not machine.scan(words(text))

        return begin

    for name, block in _shared(docs, items, item_col, item_text_col, max_bytes):
        docs = kept(docs, text_col, judge(name, block))
    return docs
