"""Every registered query of the retrieval engine, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import base, rank_queries, text_queries, tool_queries  # noqa: F401  the modules register their queries


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["R1_rrf"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
