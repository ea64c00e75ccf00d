"""Which texts contain which of a stated set of strings, in one pass over the texts.

A join on ``contains`` compares every text with every string. Here one automaton
over the strings runs over each text once. A worker process builds it once; a set
of more than ``max_bytes`` is cut into blocks of that size, one pass each, so that
neither a broadcast nor an automaton grows with the set.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of strings in one automaton.
MAX_BYTES = 4 << 20
_BUILT: dict[str, tuple] = {}


def _automaton(name: str, block):
    """(automaton, its ids by string) of a broadcast block; the last one stays in the worker."""
    if name not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        machine, ids = ahocorasick.Automaton(), {}
        for key, needle in block.value:
            ids.setdefault(needle, []).append(key)
        for needle in ids:
            machine.add_word(needle, needle)
        if ids:
            machine.make_automaton()
        _BUILT[name] = machine, ids
    return _BUILT[name]


def _blocks(needles: DataFrame, max_bytes: int) -> Iterator[list[tuple[str, str]]]:
    block, load = [], 0
    for key, needle in needles.toLocalIterator():
        weight = len(needle.encode("utf-8", "surrogatepass"))
        if block and load + weight > max_bytes:
            yield block
            block, load = [], 0
        block.append((key, needle))
        load += weight
    if block:
        yield block


def containing(docs: DataFrame, needles: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(key, doc_id) of every text of (doc_id, text) that contains a string of (key, needle); null and empty strings match nothing."""
    context = docs.sparkSession.sparkContext
    wanted = needles.select(F.col("key").cast("string"), "needle").where("needle <> ''")
    blocks = [(uuid.uuid4().hex, context.broadcast(block)) for block in _blocks(wanted, max_bytes)]
    schema = pa.schema([("key", pa.string()), ("doc_id", pa.string())])

    def search(name, block):
        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine, ids = _automaton(name, block)
            for batch in stream:
                keys, found = [], []
                for at in range(batch.num_rows):
                    text = batch.column(1)[at].as_py()
                    if text:
                        own = [key for needle in {n for _, n in machine.iter(text)} for key in ids[needle]]
                        keys += own
                        found += [batch.column(0)[at].as_py()] * len(own)
                yield pa.record_batch([pa.array(keys, pa.string()), pa.array(found, pa.string())], schema=schema)

        return run

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    passes = [rows.mapInArrow(search(name, block), "key string, doc_id string") for name, block in blocks]
    return reduce(DataFrame.unionAll, passes) if passes else docs.sparkSession.createDataFrame([], "key string, doc_id string")
