"""Token counts of a unigram tokenizer by count-only Viterbi.

The vocabulary is a list of pieces with scores. A text is cut before every space
(each cut keeps its space as the word mark, and a text that begins with none
gets one), and each word is segmented into the pieces of the highest total
score. Nothing is segmented in fact: an Aho-Corasick automaton over the pieces
enumerates the matches by their end, and dynamic programming carries only the
best score and its number of pieces.

Tie rules are those of the public unigram implementation: candidates for an end
come in the order of their start, and a later one wins only if its score is
strictly higher, so the longest last piece wins ties. A character without a
piece of its own may stand alone at the lowest score less ``UNKNOWN_PENALTY``;
with byte pieces it counts one piece for each byte, otherwise a run of such
characters counts one piece.

Words repeat, so each worker keeps the counts of the words it has met; when it holds
``cache_words`` of them it forgets the half that it met first, so that frequent words
are soon back without all others going. Counts don't depend on it.

Defined results: null and empty texts count 0 with score 0; repeated rows are
counted once each; an empty table yields no rows; other columns are ignored
whatever their names. A word of any length is one pass over its characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import batches, pairs

MARK = "▁"
#: Fixed values of the unigram format: what a missing character costs below the lowest score.
UNKNOWN_PENALTY = 10.0

SCHEMA = "doc_id {id}, n_words long, n_tokens long, n_unknown_bytes long, score double"


def vocabulary(model_path: str) -> tuple[list[tuple[str, float]], bool]:
    """The normal pieces of a tokenizer model with their scores, and whether it has all byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain], sum(map(model.is_byte, ids)) == 256


class Counter:
    """Counts of words under one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool, cache_words: int = 400_000):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        if len(self.machine):
            self.machine.make_automaton()
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        # a line end that is in no piece stands alone; with whole scores, sums are exact and the word may be cut there
        self.cut_lines = byte_fallback and all(float(s).is_integer() for _, s in pieces) and not any("\n" in p for p, _ in pieces)
        self.cache_words = cache_words
        self.marked: dict[str, tuple[int, int, float]] = {}
        self.bare: dict[str, tuple[int, int, float]] = {}

    def viterbi(self, text: str) -> tuple[int, int, float]:
        """(pieces, bytes of characters without a piece, score) of the best segmentation."""
        n = len(text)
        best, count, lost = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        open_run = [False] * (n + 1)
        reached, single = [False] * (n + 1), [False] * (n + 1)
        reached[0] = True
        done = 0

        def settle(end: int) -> None:
            start = end - 1
            score = best[start] + self.unknown
            if not single[end] and (not reached[end] or score > best[end]):
                width = len(text[start].encode("utf-8", "surrogatepass"))
                best[end], reached[end], open_run[end] = score, True, True
                lost[end] = lost[start] + width
                count[end] = count[start] + (width if self.byte_fallback else not open_run[start])

        for last, (length, score) in self.machine.iter(text) if len(self.machine) else ():
            end = last + 1
            while done < last:
                done += 1
                settle(done)
            start = end - length
            score += best[start]
            single[end] |= length == 1
            if not reached[end] or score > best[end]:
                best[end], count[end], lost[end], reached[end], open_run[end] = score, count[start] + 1, lost[start], True, False
        while done < n:
            done += 1
            settle(done)
        return count[n], lost[n], best[n]

    def _halve(self, memory: dict) -> None:
        if len(memory) >= self.cache_words:
            for word in list(islice(memory, (len(memory) + 1) // 2)):
                del memory[word]

    def _bare(self, part: str) -> tuple[int, int, float]:
        found = self.bare.get(part)
        if found is None:
            self._halve(self.bare)
            found = self.bare[part] = self.viterbi(part)
        return found

    def word(self, word: str) -> tuple[int, int, float]:
        if self.cut_lines and "\n" in word:
            first, *rest = word.split("\n")
            found = [self.marked.get(first) or self._keep(first), *map(self._bare, rest)]
            lines = len(rest)
            return sum(f[0] for f in found) + lines, sum(f[1] for f in found) + lines, sum(f[2] for f in found) + lines * self.unknown
        return self._keep(word)

    def _keep(self, word: str) -> tuple[int, int, float]:
        self._halve(self.marked)
        found = self.marked[word] = self.viterbi(MARK + word)
        return found

    def text(self, text: str | None) -> tuple[int, int, int, float]:
        """(words, pieces, bytes without a piece, score) of a whole text."""
        if not text:
            return 0, 0, 0, 0.0
        text = text.replace(MARK, " ")
        own = (text[1:] if text[0] == " " else text).split(" ")
        tokens, lost, score = 0, 0, 0.0
        get = self.marked.get
        for word in own:
            found = get(word) or self.word(word)
            tokens += found[0]
            lost += found[1]
            score += found[2]
        return len(own), tokens, lost, score


@lru_cache(1)
def shared_counter(model_path: str) -> Counter:
    """One for each worker process, so that its memory of words outlives a task."""
    return Counter(*vocabulary(model_path))


def counter(model_path: str, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown_bytes", pa.int64()), ("score", pa.float64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared_counter(model_path)
        yield from batches(((doc, *count.text(text)) for doc, text in pairs(stream)), schema)

    return run


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, pieces, bytes without a piece and best score of every whole text."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    return docs.select(id_col, text_col).mapInArrow(counter(model_path, to_arrow_type(kind)), SCHEMA.format(id=kind.simpleString()))
