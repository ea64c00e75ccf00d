"""Chunks of documents: paragraphs packed greedily to a token target, with overlap.

Packing carries state from paragraph to paragraph, which array functions can only
do in quadratic time for long texts; one pass over Arrow batches is linear.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "chunk_id string, doc_id string, title string, ordinal int, text string, embed_text string, content_hash string, url string"
PARAGRAPH = re.compile(r"\n\s*\n")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
BATCH = 2_000


def size(text: str) -> int:
    return int(len(text.split()) * 1.3)


def spans(weights: list[int], target: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring units of at most ``target`` in all, each range beginning with the end of the last.

    Sums so far turn both questions into searches: how far a range reaches, and how
    far back the next one begins. A range has one new unit at least, whatever its
    weight; what is repeated weighs at most ``overlap``, or is one unit, and is never
    a whole range.
    """
    total = np.concatenate(([0], np.cumsum(weights)))
    found, start, end = [], 0, 0
    while end < len(weights):
        reach = int(np.searchsorted(total, total[start] + target, "right")) - 1
        end = max(end + 1, reach)
        found.append((start, end))
        if overlap > 0:
            back = int(np.searchsorted(total, total[end] - overlap, "left"))
            start = max(start + 1, min(back, end - 1))
        else:
            start = end
    return found


def units(text: str, target: int) -> list[str]:
    """Paragraphs; one over the target gives way to ranges of its sentences."""
    found = []
    for paragraph in filter(None, map(str.strip, PARAGRAPH.split(text))):
        parts = [s for s in map(str.strip, SENTENCE.split(paragraph)) if s] if size(paragraph) > target else []
        found += [" ".join(parts[a:b]) for a, b in spans(list(map(size, parts)), target, 0)] or [paragraph]
    return found


def split(text: str, target: int, overlap: int) -> list[str]:
    """The texts of a document's chunks."""
    own = units(text, target)
    return ["\n\n".join(own[a:b]) for a, b in spans(list(map(size, own)), target, overlap)]


def chunk(docs: DataFrame, target: int = 450, overlap: int = 60) -> DataFrame:
    """Chunks of (doc_id, title, text, url) rows; a text without words has none."""
    if target <= 0 or overlap >= target:
        raise ValueError("the target must be positive and greater than the overlap")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for doc_id, title, text, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for n, part in enumerate(split(text or "", target, overlap)):
                    whole = f"{title}\n\n{part}"
                    rows.append((f"{doc_id}:{n}", doc_id, title, n, part, whole, hashlib.sha256(whole.encode()).hexdigest()[:16], url))
                if len(rows) >= BATCH:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.int32() if n == "ordinal" else pa.string() for n in names]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    url = "url" if "url" in docs.columns else "cast(null as string) as url"
    return docs.selectExpr("cast(doc_id as string) as doc_id", "coalesce(title, '') as title", "text", url).mapInArrow(run, SCHEMA)
