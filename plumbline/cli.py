"""Command line and Python interface: ingest, search, compare, evaluate, enrich, stats over files and an index folder."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import settings
from plumbline.functions import text as T
from plumbline.operators import batches, chunking, enrichment, index, metrics, providers
from plumbline.operators import ranking as R
from plumbline.sources import files
from plumbline.tables import dropped, written

MODES = ("keyword", "semantic", "hybrid")
#: Longest question that is answered, and most results; fixed values.
QUESTION, MOST = 1000, 50


def bounded(question: str | None = None, mode: str | None = None, top_k: int | None = None) -> None:
    """Raise for what a request may not ask, before any plan is built."""
    if question is not None and not 1 <= len(question) <= QUESTION:
        raise ValueError(f"a query has from 1 to {QUESTION} characters")
    if mode is not None and mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, not one of {', '.join(MODES)}")
    if top_k is not None and not 1 <= top_k <= MOST:
        raise ValueError(f"top_k must be from 1 to {MOST}")


class Searcher:
    """Keyword, semantic and hybrid search over an index of chunks; answers are unevaluated frames.

    Chunks are ranked; ``doc_id`` of the answer is the chunk's id and ``document`` its document. The postings of
    all terms are made once for each version of the index and kept as a table, until ``close``.
    """

    def __init__(self, spark: SparkSession, root: str, dims: int = 16, provider: Callable[[], providers.EmbeddingProvider] | None = None):
        self.spark, self.root = spark, root
        self.provider = provider or (lambda: providers.HashProvider(dims))
        self.model_id = self.provider().model_id
        self._terms: tuple[int, DataFrame, DataFrame] | None = None

    def chunks(self) -> DataFrame:
        return index.load(self.spark, self.root)

    def stats(self) -> DataFrame:
        return index.stats(self.chunks())

    def postings(self) -> DataFrame:
        """The postings of the index's current version, a row for each chunk."""
        version = (index.versions(self.spark, self.root) or [0])[-1]
        if self._terms is None or self._terms[0] != version:
            self.close()
            made = R.indexed(self.chunks().select(F.col("chunk_id").alias("doc_id"), "title", "text"))
            self._terms = version, made, R.by_term(made)
        return self._terms[1]

    def terms(self) -> DataFrame:
        """The postings, a row for each term of a chunk."""
        self.postings()
        return self._terms[2]

    def close(self) -> None:
        if self._terms is not None:
            dropped(self._terms[1])
            self._terms = None

    def search(self, queries: DataFrame, mode: str = "hybrid", top_k: int = 10) -> DataFrame:
        bounded(mode=mode, top_k=top_k)
        rows = self.chunks()
        depth = top_k * 4 if mode == "hybrid" else top_k
        lanes = []
        if mode != "semantic":
            lanes.append(R.bm25(queries, rows, depth, index=self.postings()))
        if mode != "keyword":
            index.guard(rows, self.model_id)
            asked = providers.embed(queries.select("query_id", F.col("query").alias("embed_text")), self.provider)
            lanes.append(R.cosine(asked.select("query_id", F.col("embedding").alias("vector")), rows.select(F.col("chunk_id").alias("doc_id"), F.col("embedding").alias("vector")), depth))
        hits = R.rrf(lanes, top_k) if mode == "hybrid" else lanes[0]
        shown = rows.select(F.col("chunk_id").alias("doc_id"), F.col("doc_id").alias("document"), "title", T.snippet(F.col("text")).alias("snippet"))
        return hits.join(shown, "doc_id").withColumn("mode", F.lit(mode))

    def compare(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        found = [self.search(queries, mode, top_k) for mode in MODES]
        return found[0].unionByName(found[1]).unionByName(found[2])


def ingest(spark: SparkSession, corpus: list[str], root: str, target: int = 450, overlap: int = 60, force: bool = False, provider: Callable[[], providers.EmbeddingProvider] | None = None) -> DataFrame:
    """Chunk the documents of files, skip what is indexed, embed, merge; the report."""
    return ingest_documents(files.corpus(spark, corpus), root, target, overlap, force, provider)


def ingest_documents(docs: DataFrame, root: str, target: int = 450, overlap: int = 60, force: bool = False, provider: Callable[[], providers.EmbeddingProvider] | None = None) -> DataFrame:
    spark = docs.sparkSession
    make = provider or providers.HashProvider
    # chunks and vectors are made once, whatever reads them
    chunks = written(chunking.chunk(docs, target, overlap), "chunks")
    old = index.load(spark, root) if index.versions(spark, root) else None
    if old is not None:
        index.guard(old, make().model_id)
    new = written(providers.embed(index.pending(chunks, old, force=force) if old is not None else chunks, make), "embedded")
    done = index.report(chunks, new, make().max_input_tokens).toPandas()
    index.merge(new, root)
    dropped(chunks, new)
    return spark.createDataFrame(done)


def evaluate(spark: SparkSession, searcher: Searcher, path: str, top_k: int = 10) -> DataFrame:
    """Mean metrics of every mode over judged queries."""
    judged = files.queries(spark, path)
    asked = judged.select(F.col("query").alias("query_id"), "query")
    relevant = judged.select(F.col("query").alias("query_id"), F.explode("relevant_doc_ids").alias("doc_id"))
    found = [searcher.search(asked, mode, top_k) for mode in MODES]
    hits = found[0].unionByName(found[1]).unionByName(found[2])
    hits = hits.select("mode", "query_id", F.col("document").alias("doc_id"), "rank")
    best = hits.groupBy("mode", "query_id", "doc_id").agg(F.min("rank").alias("score"))
    ranked = R.ranked(best, keys=("mode", "query_id"), order=("score", "doc_id"))
    return metrics.means(metrics.per_query(asked, ranked, relevant, ("mode",)), ("mode",))


def enrich(spark: SparkSession, corpus: list[str], store: str, client: batches.BatchClient, prompt_version: str = "1", output: str | None = None) -> batches.Report:
    """Enrich the documents of files through a batch service; ``output``: write the enriched documents there."""
    docs = files.corpus(spark, corpus)
    done = batches.enrich(docs.select(F.col("doc_id").alias("item_id"), "title", F.col("text").alias("record")), store, client, prompt_version)
    if output:
        enrichment.enriched(docs, files.enrichments(spark, store), prompt_version, client.model).write.mode("overwrite").json(output)
    return done


def named(what: str):
    """The object that ``module:name`` names."""
    module, _, name = what.partition(":")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as error:
        raise ValueError(f"{what!r} does not name an object as module:name ({error})") from None


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "search", "compare", "evaluate", "enrich", "stats"):
        own = commands.add_parser(name)
        if name != "enrich":
            own.add_argument("--index", required=True)
            own.add_argument("--provider", default="hash", help="a registered encoder, or module:name of a factory")
        if name in ("ingest", "enrich"):
            own.add_argument("--corpus", nargs="+", required=True)
        if name == "ingest":
            own.add_argument("--force", action="store_true")
        if name in ("search", "compare"):
            own.add_argument("query")
            own.add_argument("--top-k", type=int)
        if name == "search":
            own.add_argument("--mode", choices=MODES, default="hybrid")
        if name == "evaluate":
            own.add_argument("--queries", required=True)
        if name == "enrich":
            own.add_argument("--store", required=True)
            own.add_argument("--client", required=True, help="module:name of a factory of batch clients")
            own.add_argument("--output")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    try:
        if args.command == "enrich":
            print(enrich(spark, args.corpus, args.store, named(args.client)(), output=args.output))
            return 0
        make = providers.PROVIDERS[args.provider] if args.provider in providers.PROVIDERS else named(args.provider) if ":" in args.provider else lambda: providers.provider(args.provider)
        searcher = Searcher(spark, args.index, provider=make)
        if args.command == "ingest":
            out = ingest(spark, args.corpus, args.index, settings.integer("PLUMBLINE_CHUNK_TOKENS", 450), settings.integer("PLUMBLINE_CHUNK_OVERLAP", 60), args.force, make)
        elif args.command == "stats":
            out = searcher.stats()
        elif args.command == "evaluate":
            out = evaluate(spark, searcher, args.queries)
        else:
            top_k = args.top_k if args.top_k is not None else settings.integer("PLUMBLINE_TOP_K", 5)
            bounded(args.query, top_k=top_k)
            asked = spark.createDataFrame([("q", args.query)], "query_id string, query string")
            out = searcher.search(asked, args.mode, top_k) if args.command == "search" else searcher.compare(asked, top_k)
        out.show(100, truncate=False)
    except (ValueError, FileNotFoundError, index.IndexMismatch) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
