"""Sum-of-squares packing of tokenised documents into windows.

``pack`` tokenises every document, ends it with a terminator id, cuts off whole
windows and places the tail by the sum-of-squares rule: of the open fill levels
that still hold the tail, take the one that leaves the smallest sum, over all
levels, of the squared number of windows at that level. The state is one level
array for each task, so that the operator is a single pass without a shuffle;
a hot source or a group of copies is spread as the scan spreads it.

Few windows may stand open: a sixteenth of those closed so far, eight at least and
``max_open`` at most. Once that many are open no new one is opened. A tail that
fits into an open window goes where the rule says; one that is longer than every
room is cut: its beginning fills the window whose closing leaves the smallest sum
of squares, and its rest is placed by the rule again. So the share of ids that the
rule does not place stays small in short tasks as well.

At the end of a task the open windows are drained: their pieces are laid end to
end and cut anew at the window size, and what is left over is cut at powers of
two. No id is dropped and no sequence needs padding beyond its power of two.

Defined results: null text counts as empty and yields the terminator alone; a
null id is kept; repeated rows are packed once each; an empty table yields no
rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from plumbline.llm.common import batches, pairs

#: A space between two other characters: the pre-tokeniser always cuts before it.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters of text that are encoded at once.
SEGMENT = 1 << 19
#: The classes of all characters below this one are the same in every Unicode version.
SETTLED = 0x250
#: Windows that may be open: at least so many, and one for so many closed ones.
LEAST_OPEN, CLOSED_FOR_OPEN = 8, 16

SCHEMA = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


class Encoder:
    """Ids of a byte-level BPE vocabulary.

    The tokenizer file is the authority. Texts of settled characters go through
    the rank file of the same vocabulary, which gives the same ids several times
    faster; any other text, and any that holds an added token of the file, goes
    through the tokenizer file itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str | None):
        self.tokenizer_path = tokenizer_path
        self.slow = None
        self.fast = None
        with open(tokenizer_path, encoding="utf-8") as file:
            added = json.load(file).get("added_tokens") or []
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        # an added token that takes white space with it, or holds some, may reach over a cut
        self.reaching = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") or re.search(r"\s", t["content"]) for t in added)
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _reference(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.tokenizer_path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        parts = []
        holds = self.added.search if self.added else lambda _: None
        for segment in [text] if self.reaching and holds(text) else segments(text):
            settled = self.fast is not None and (segment.isascii() or ord(max(segment)) < SETTLED) and not holds(segment)
            parts.append(np.array(self.fast.encode_ordinary(segment) if settled else self._reference(segment), "<u4"))
        return np.concatenate(parts) if parts else np.empty(0, "<u4")


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """The text in pieces that encode to the same ids as the whole."""
    at = 0
    while len(text) - at > size:
        cut = SAFE_CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:]


class Packer:
    """Online sum-of-squares bin packing with one level array."""

    def __init__(self, window: int, max_open: int):
        self.window, self.max_open = window, max_open
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window)]
        self.n_open = self.closed = 0
        # ids that came in, and those of them that a drain placed
        self.placed = self.drained = 0

    def level(self, length: int, fresh: bool = True) -> int:
        """The fill level that takes a piece of this length at the least sum of squares, the fullest of equals.

        0 stands for a new window; without ``fresh`` that is the answer only if no open window has room.
        """
        room = self.window - length
        at = np.flatnonzero(self.count[: room + 1])
        if not len(at):
            return 0
        rise = np.where(at == room, 1, 2 * self.count[at + length] + 2) - 2 * self.count[at]
        best = len(at) - 1 - int(np.argmin(rise[::-1]))
        if fresh and length < self.window and rise[best] > 2 * self.count[length] + 1:
            return 0
        return int(at[best])

    def crowded(self) -> int:
        """The level whose window closes at the least sum of squares, the fullest of equals."""
        return self.window - int(np.argmax(self.count[::-1]))

    def _take(self, level: int) -> list[tuple]:
        if not level:
            return []
        self.count[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _put(self, level: int, pieces: list[tuple]) -> None:
        self.open[level].append(pieces)
        self.count[level] += 1
        self.n_open += 1

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        self.closed += 1
        return pieces

    def add(self, piece: tuple) -> Iterator[list[tuple]]:
        """Place (document, start, ids, document's length); yields the windows that close."""
        doc, start, ids, total = piece
        self.placed += len(ids)
        while len(ids) < self.window:
            fresh = self.n_open < min(max(LEAST_OPEN, self.closed // CLOSED_FOR_OPEN), self.max_open)
            level = self.level(len(ids), fresh)
            if level or fresh:
                pieces, filled = [*self._take(level), (doc, start, ids, total)], level + len(ids)
                if filled == self.window:
                    yield self._close(pieces)
                else:
                    self._put(filled, pieces)
                return
            # longer than every room, and no window may be opened: the beginning closes one
            level = self.crowded()
            cut = self.window - level
            yield self._close([*self._take(level), (doc, start, ids[:cut], total)])
            start, ids = start + cut, ids[cut:]
        yield self._close([(doc, start, ids, total)])

    def drain(self) -> Iterator[list[tuple]]:
        """Close all open windows by cutting their pieces anew: whole windows first, powers of two for the rest."""
        stream = [piece for level in reversed(self.open) for pieces in level for piece in pieces]
        self.open = [[] for _ in range(self.window)]
        self.count[:] = 0
        self.n_open = 0
        rest = sum(len(p[2]) for p in stream)
        self.drained += rest
        target, pieces, filled = self.window, [], 0
        for doc, start, ids, total in stream:
            while len(ids):
                if not filled and rest < self.window:
                    target = 1 << (rest.bit_length() - 1)
                take = min(target - filled, len(ids))
                pieces.append((doc, start, ids[:take], total))
                filled += take
                rest -= take
                start, ids = start + take, ids[take:]
                if filled == target:
                    yield self._close(pieces)
                    pieces, filled = [], 0


def packer(window: int, terminator: int, max_open: int, encoder: Callable[[], Encoder], id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packing = encoder(), Packer(window, max_open)
        base = TaskContext.get().partitionId() << 40
        end = np.array([terminator], "<u4")

        def windows() -> Iterator[list[tuple]]:
            for doc, text in pairs(stream):
                ids = np.concatenate([encode.ids(text or ""), end])
                for start in range(0, len(ids), window):
                    yield from packing.add((doc, start, ids[start : start + window], len(ids)))
            yield from packing.drain()

        def rows() -> Iterator[tuple]:
            for number, pieces in enumerate(windows()):
                offset, held = 0, sum(len(p[2]) for p in pieces)
                for doc, start, ids, total in pieces:
                    yield doc, start, len(ids), ids.tobytes(), total, base + number, offset, held
                    offset += len(ids)

        yield from batches(rows(), schema, lambda row: 96 + len(row[3]))

    return run


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, terminator: int = 0, max_open: int = 512) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit) and their place.

    A row is one piece: ``start`` ids of its document precede it, it holds
    ``length`` ids and stands at ``offset`` of sequence ``sequence_id``, which
    holds ``sequence_tokens`` ids: the window or a smaller power of two.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    run = packer(window, terminator, max_open, lambda: Encoder(tokenizer_path, ranks_path, pattern), to_arrow_type(kind))
    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA.format(id=kind.simpleString()))
