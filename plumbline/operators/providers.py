"""Encoders, rerankers and judges from outside: what they must offer, and how Spark runs them.

A provider is made once in each Python worker by a factory, so that a model is
loaded where it is used; texts reach it in batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts in one call of a provider; fixed value.
BATCH = 64


class EmbeddingProvider(Protocol):
    model_id: str
    dimensions: int
    max_input_tokens: int

    def embed_documents(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


class HashProvider:
    """Digest bytes less 128 at unit length; a stand-in that needs no model."""

    max_input_tokens = 512

    def __init__(self, dimensions: int = 16):
        self.dimensions, self.model_id = dimensions, f"hash@{dimensions}"

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        raw = np.array([list(hashlib.sha256(t.encode()).digest()[: self.dimensions]) for t in texts], float).reshape(-1, self.dimensions) - 128
        return raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_documents([text])[0]


#: Factories by name; callers may add their own.
PROVIDERS: dict[str, Callable[[], EmbeddingProvider]] = {"hash": HashProvider}


def provider(name: str) -> EmbeddingProvider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}, not one of {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name]()


def embed(chunks: DataFrame, factory: Callable[[], EmbeddingProvider], text_col: str = "embed_text") -> DataFrame:
    """``chunks`` with ``embedding``, ``model_id`` and ``dims``; vectors of unit length."""

    def run(stream):
        own = factory()
        for pdf in stream:
            texts = pdf[text_col].fillna("").tolist()
            parts = [np.asarray(own.embed_documents(texts[i : i + BATCH]), np.float32) for i in range(0, len(texts), BATCH)]
            vectors = np.concatenate(parts) if parts else np.empty((0, own.dimensions), np.float32)
            vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            yield pdf.assign(embedding=list(vectors), model_id=own.model_id, dims=own.dimensions)

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInPandas(run, f"{columns}, embedding array<float>, model_id string, dims int")


def second_scores(pairs: DataFrame, factory: Callable[[], Callable[[str, list[str]], list[float]]]) -> DataFrame:
    """(query_id, doc_id, second) of a reranker over (query_id, query, doc_id, prose); rows without prose get none."""

    def run(stream):
        score = factory()
        for pdf in stream:
            for query, group in pdf.groupby("query", sort=False):
                yield group.assign(second=[float(s) for s in score(query, group["prose"].tolist())])[["query_id", "doc_id", "second"]]

    return pairs.where(F.coalesce("prose", F.lit("")) != "").mapInPandas(run, "query_id string, doc_id string, second double")
