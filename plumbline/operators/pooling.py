"""Judgement pools: union of lanes, reuse of grades, simulation of missing ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the digest of the parts: the same on every engine and in every run."""
    digest = F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def pool(lanes: DataFrame, depth: int = 20, seed: int = 17) -> DataFrame:
    """(query_id, doc_id, lanes, place): the union of the lanes' first hits; ``place`` shuffles by a seeded digest."""
    top = lanes.where(F.col("rank") <= depth).groupBy("query_id", "doc_id").agg(F.count("*").alias("n_lanes"))
    return top.withColumn("place", F.round(uniform(F.lit(str(seed)), F.col("query_id"), F.col("doc_id")), 9))


def unique_to_lane(lanes: DataFrame, depth: int = 20) -> DataFrame:
    """(lane, only_here): hits that no other lane has."""
    top = lanes.where(F.col("rank") <= depth)
    alone = top.groupBy("query_id", "doc_id").agg(F.count("*").alias("n"), F.min("lane").alias("lane")).where("n = 1")
    return top.select("lane").distinct().join(alone.groupBy("lane").agg(F.count("*").alias("k")), "lane", "left").select("lane", F.coalesce("k", F.lit(0)).cast("long").alias("only_here"))


def split(pooled: DataFrame, grades: DataFrame) -> DataFrame:
    """The pool with the grade that (query, document) already has; null: still to judge."""
    return pooled.join(grades.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left")


def keep_judged(pooled: DataFrame, grades: DataFrame) -> DataFrame:
    """The pool and every judged pair that it lost, marked as restored; a pool only grows."""
    lost = grades.select("query_id", "doc_id").join(pooled, ["query_id", "doc_id"], "left_anti")
    return pooled.select("query_id", "doc_id", F.lit(False).alias("restored")).unionAll(lost.withColumn("restored", F.lit(True)))


def recall_with(queries: DataFrame, hits: DataFrame, relevant: DataFrame, extra: DataFrame, depth: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean recall at ``depth`` if ``extra`` rows were relevant too; over all queries."""
    rel = relevant.select("query_id", "doc_id").unionAll(extra.select("query_id", "doc_id")).distinct()
    sizes = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    found = hits.where(F.col("rank") <= depth).join(rel, ["query_id", "doc_id"], "left_semi").groupBy(*keys, "query_id").agg(F.count("*").alias("hits"))
    every = queries.select("query_id").distinct()
    if keys:
        every = every.crossJoin(F.broadcast(hits.select(*keys).distinct()))
    rows = every.join(sizes, "query_id", "left").join(found, [*keys, "query_id"], "left")
    return rows.groupBy(*keys).agg(F.round(F.avg(F.coalesce(F.col("hits") / F.col("n_rel"), F.lit(0.0))), 6).alias("recall"))


def reused(pooled: DataFrame, evaluation: DataFrame, judgements: DataFrame) -> DataFrame:
    """The pool with grades that are already there, by query and document, and the judge's reason.

    ``evaluation``: (query_id, pos, doc_id, grade); ``judgements``: (key, why) of the run that made it, whose keys are
    ``q<place of the query>--<document>``. Grades never go by place, as queries may have been reordered since.
    """
    key = F.concat(F.lit("q"), F.col("pos").cast("string"), F.lit("--"), F.col("doc_id"))
    known = evaluation.withColumn("key", key).join(judgements.select("key", "why"), "key", "left").select("query_id", "doc_id", "grade", F.coalesce("why", F.lit("")).alias("why"))
    return pooled.join(known, ["query_id", "doc_id"], "left")


def monte_carlo(queries: DataFrame, hits: DataFrame, relevant: DataFrame, unjudged: DataFrame, rates: list[float], trials: int, depth: int = 10, first: str | None = None) -> DataFrame:
    """(lane, rate, recall, beat): mean over trials in which each unjudged pair is relevant with the given rate.

    All trials of all rates are one job: trials and rates are rows, and each pair's draw is a digest of pair and
    trial. Rates 0 and 1 are exact and need one trial. ``beat``: trials in which some lane beats ``first``.
    """
    spark = hits.sparkSession
    runs = spark.range(trials).select(F.col("id").alias("trial")).crossJoin(spark.createDataFrame([(r,) for r in rates], "rate double")).where("trial = 0 or rate not in (0, 1)")
    # base and extra do not overlap, so hits and sizes are counts of either side and no pair is copied for each trial that changes nothing
    base = relevant.select("query_id", "doc_id").distinct()
    found_base = hits.where(F.col("rank") <= depth).join(base, ["query_id", "doc_id"], "left_semi").groupBy("lane", "query_id").agg(F.count("*").alias("h"))
    extra = unjudged.select("query_id", "doc_id").distinct().join(base, ["query_id", "doc_id"], "left_anti")
    drawn = extra.crossJoin(F.broadcast(runs)).where(uniform(F.col("trial").cast("string"), F.col("query_id"), F.col("doc_id")) < F.col("rate"))
    sizes_extra = drawn.groupBy("trial", "rate", "query_id").agg(F.count("*").alias("n"))
    found_extra = drawn.join(hits.where(F.col("rank") <= depth).select("lane", "query_id", "doc_id"), ["query_id", "doc_id"]).groupBy("lane", "trial", "rate", "query_id").agg(F.count("*").alias("h"))
    sizes = base.groupBy("query_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(runs)).select("trial", "rate", "query_id", "n").unionByName(sizes_extra)
    sizes = sizes.groupBy("trial", "rate", "query_id").agg(F.sum("n").alias("n"))
    found = found_base.crossJoin(F.broadcast(runs)).select("lane", "trial", "rate", "query_id", "h").unionByName(found_extra)
    found = found.groupBy("lane", "trial", "rate", "query_id").agg(F.sum("h").alias("h"))
    total = queries.select("query_id").distinct().agg(F.count("*").alias("n_queries"))
    parts = found.join(sizes, ["trial", "rate", "query_id"]).groupBy("lane", "rate", "trial").agg(F.sum(F.col("h") / F.col("n")).alias("s"))
    every = hits.select("lane").distinct().crossJoin(F.broadcast(runs))
    rows = every.join(parts, ["lane", "rate", "trial"], "left").crossJoin(total).select("lane", "rate", "trial", (F.coalesce("s", F.lit(0.0)) / F.col("n_queries")).alias("recall"))
    w = Window.partitionBy("rate", "trial")
    own = F.max(F.when(F.col("lane") == F.lit(first), F.round("recall", 9))).over(w)
    rows = rows.withColumn("beaten", F.coalesce(F.max(F.when(F.col("lane") != F.lit(first), F.round("recall", 9))).over(w) > own, F.lit(False)))
    return rows.groupBy("lane", "rate").agg(F.round(F.avg("recall"), 6).alias("recall"), F.count(F.when(F.col("beaten"), 1)).alias("beat"))
