"""Where to cut a ranking: rules over (query_id, doc_id, score, rank) as windows over the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F




def fixed(hits: DataFrame, k: int) -> DataFrame:
    return hits.where(F.col("rank") <= k)


def floor(hits: DataFrame, least: float) -> DataFrame:
    return hits.where(F.col("score") >= least)


def relative(hits: DataFrame, share: float) -> DataFrame:
    return hits.withColumn("best", F.max("score").over(Window.partitionBy("query_id"))).where(F.col("score") >= share * F.col("best")).drop("best")


def largest_gap(hits: DataFrame, within: int | None = 50) -> DataFrame:
    """Up to the biggest drop between neighbours, the later one of equals; a single hit stays."""
    drop = F.round(F.col("score") - F.lead("score").over(Window.partitionBy("query_id").orderBy("rank")), 9)
    gaps = hits.withColumn("gap", drop)
    seen = F.col("gap").isNotNull() & (F.lit(True) if within is None else F.col("rank") < within)
    # max of (gap, rank): the later rank wins ties
    at = F.max(F.when(seen, F.struct("gap", "rank"))).over(Window.partitionBy("query_id"))
    return gaps.withColumn("cut", F.coalesce(at["rank"], F.lit(1))).where(F.col("rank") <= F.col("cut")).drop("gap", "cut")


def fraction_of_top(hits: DataFrame, alpha: float) -> DataFrame:
    """Scores of at least alpha of the best; one at least."""
    return hits.withColumn("top", F.max("score").over(Window.partitionBy("query_id"))).where((F.col("score") >= alpha * F.col("top")) | (F.col("rank") == 1)).drop("top")


def share_of_spread(hits: DataFrame, beta: float) -> DataFrame:
    """Scores within beta of the way from the best to the worst; a flat list stays whole."""
    top, bottom = F.max("score").over(Window.partitionBy("query_id")), F.min("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("top", top).withColumn("bottom", bottom).where((F.col("top") == F.col("bottom")) | (F.col("score") >= F.col("top") - beta * (F.col("top") - F.col("bottom"))) | (F.col("rank") == 1)).drop("top", "bottom")


#: Cut strategies by name; fixed values.
STRATEGIES = (
    ("floor 0.15", lambda h: floor(h, 0.15)),
    ("relative 0.90", lambda h: relative(h, 0.90)),
    ("relative 0.85", lambda h: relative(h, 0.85)),
    ("largest gap", largest_gap),
    ("top 5", lambda h: fixed(h, 5)),
    ("top 10", lambda h: fixed(h, 10)),
    ("top 15", lambda h: fixed(h, 15)),
    ("top 20", lambda h: fixed(h, 20)),
)
#: Break rules by name; fixed values.
BREAKS = (
    ("fraction 0.98", lambda h: fraction_of_top(h, 0.98)),
    ("fraction 0.95", lambda h: fraction_of_top(h, 0.95)),
    ("fraction 0.92", lambda h: fraction_of_top(h, 0.92)),
    ("fraction 0.90", lambda h: fraction_of_top(h, 0.90)),
    ("spread 0.25", lambda h: share_of_spread(h, 0.25)),
    ("spread 0.50", lambda h: share_of_spread(h, 0.50)),
    ("largest gap", lambda h: largest_gap(h, None)),
    ("fixed 5", lambda h: fixed(h, 5)),
    ("fixed 10", lambda h: fixed(h, 10)),
)


def named(hits: DataFrame, rules) -> DataFrame:
    """The kept hits of every rule, with its name."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [rule(hits).withColumn("rule", F.lit(name)) for name, rule in rules])
