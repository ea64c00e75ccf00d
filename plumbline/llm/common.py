"""What the corpus operators share: the shared folder, materialised stages and Arrow batching."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.tables import clear, discard, dropped, scratch, shared_root, written  # noqa: F401  the operators take them from here

#: Bytes of output after which an operator hands an Arrow batch on.
BATCH_BYTES = 4 << 20


def free(columns: list[str], *stems: str) -> list[str]:
    """A name for each stem that clashes with no column."""
    taken = {c.lower() for c in columns}
    return [next(n for n in (f"__{stem}{i}" for i in range(len(taken) + 1)) if n not in taken) for stem in stems]


def batches(rows: Iterator[tuple], schema: pa.Schema, weigh=lambda row: 64, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of about ``limit`` bytes as ``weigh`` counts them."""
    columns: list[list] = [[] for _ in schema]
    load = 0
    for row in rows:
        for column, value in zip(columns, row, strict=True):
            column.append(value)
        load += weigh(row)
        if load >= limit:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            columns, load = [[] for _ in schema], 0
    if columns[0]:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pairs(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(first column, second column) of every row; one value at a time becomes a Python object."""
    for batch in stream:
        left, right = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            yield left[i].as_py(), right[i].as_py()


def kept(docs: DataFrame, text_col: str, judge: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows whose text the task's judge keeps, with all columns as they came; no join and no shuffle."""
    at = docs.columns.index(text_col)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = judge()
        for batch in stream:
            texts = batch.column(at)
            yield batch.filter(pa.array([keep(texts[i].as_py()) for i in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
