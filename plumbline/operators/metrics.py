"""Ranking metrics over hits (query_id, doc_id, rank) and relevant rows (query_id, doc_id).

Averages run over all given queries: one without hits or without relevant rows counts 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def per_query(queries: DataFrame, hits: DataFrame, relevant: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """recall@5, recall@10, mrr@10 and ndcg@10 of every query; ``keys``: further columns of hits, e.g. a lane."""
    rel = relevant.select("query_id", "doc_id").distinct().withColumn("rel", F.lit(1))
    sizes = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    marked = hits.join(rel, ["query_id", "doc_id"], "left").where("rel = 1")
    rank = F.col("rank")
    found = marked.groupBy(*keys, "query_id").agg(
        F.count(F.when(rank <= 5, 1)).alias("in5"),
        F.count(F.when(rank <= 10, 1)).alias("in10"),
        F.min(F.when(rank <= 10, rank)).alias("first"),
        F.sum(F.when(rank <= 10, discount(rank))).alias("dcg"),
    )
    every = queries.select("query_id").distinct()
    if keys:
        every = every.crossJoin(F.broadcast(hits.select(*keys).distinct()))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_rel"), F.lit(10)), F.lit(1)).cast("int")), F.lit(0.0), lambda acc, i: acc + discount(i.cast("double")))
    joined = every.join(sizes, "query_id", "left").join(found, [*keys, "query_id"], "left")
    some = F.col("n_rel").isNotNull()
    part = lambda c: F.coalesce(F.when(some, c), F.lit(0.0))
    return joined.select(
        *keys,
        "query_id",
        part(F.col("in5") / F.col("n_rel")).alias("recall_5"),
        part(F.col("in10") / F.col("n_rel")).alias("recall_10"),
        part(1 / F.col("first")).alias("mrr_10"),
        part(F.col("dcg") / ideal).alias("ndcg_10"),
    )


def means(metrics: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    named = ("recall_5", "recall_10", "mrr_10", "ndcg_10")
    return metrics.groupBy(*keys).agg(*(F.round(F.avg(c), 6).alias(c) for c in named), F.count("*").alias("queries"))


def verdict(coverage: Column) -> Column:
    """What a judged share allows to say."""
    return F.when(coverage >= 0.9, "comparable").when(coverage >= 0.75, "caution").otherwise("not comparable")


def set_quality(queries: DataFrame, kept: DataFrame, relevant: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Mean precision and recall of kept sets, F1 of these means, median size; nothing kept counts 0 and 0."""
    rel = relevant.select("query_id", "doc_id").distinct().withColumn("rel", F.lit(1))
    sizes = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    counts = kept.join(rel, ["query_id", "doc_id"], "left").groupBy(*keys, "query_id").agg(F.count("*").alias("size"), F.count("rel").alias("hits"))
    every = queries.select("query_id").distinct().crossJoin(F.broadcast(kept.select(*keys).distinct()))
    rows = every.join(counts, [*keys, "query_id"], "left").join(sizes, "query_id", "left")
    rows = rows.select(*keys, F.coalesce("size", F.lit(0)).alias("size"), F.coalesce(F.col("hits") / F.col("size"), F.lit(0.0)).alias("p"), F.coalesce(F.col("hits") / F.col("n_rel"), F.lit(0.0)).alias("r"))
    out = rows.groupBy(*keys).agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.percentile("size", 0.5).alias("median_size"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.select(*keys, F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"), "median_size")


def min_max(score: Column, by=("query_id",)) -> Column:
    """Scaled to 0..1 within the query; a flat list becomes zeros."""
    w = Window.partitionBy(*by)
    low, span = F.min(score).over(w), F.max(score).over(w) - F.min(score).over(w)
    return F.when(span > 1e-9, (score - low) / span).otherwise(0.0)


def z_score(score: Column, by=("query_id",)) -> Column:
    """Standardised within the query by the population deviation; a flat list becomes zeros."""
    w = Window.partitionBy(*by)
    deviation = F.stddev_pop(score).over(w)
    return F.when(deviation > 1e-9, (score - F.avg(score).over(w)) / deviation).otherwise(0.0)


def leave_one_out(grid: DataFrame) -> DataFrame:
    """(query_id, w, held): for each query the best weight on the others, the least of equals, and its value there.

    ``grid``: (w, query_id, value) for every weight and query.
    """
    by_w = Window.partitionBy("w")
    others = grid.withColumn("rest", F.round((F.sum("value").over(by_w) - F.col("value")) / (F.count("*").over(by_w) - 1), 9))
    pick = Window.partitionBy("query_id").orderBy(F.desc("rest"), "w")
    return others.withColumn("n", F.row_number().over(pick)).where("n = 1").select("query_id", "w", F.col("value").alias("held"))


#: Share of a lane's control queries that must stay perfect for it to count; fixed value.
CONTROLS_KEPT = 0.999


def score_rankings(queries: DataFrame, hits: DataFrame, relevant: DataFrame, grades: DataFrame, events: DataFrame, key: str = "lane") -> DataFrame:
    """One row for each engine: means over the queries it answered, how far judgements cover them, controls, intrusion.

    ``queries``: (query_id, control); ``grades``: every judged (query_id, doc_id); ``events``: doc_id of event records.
    A document that an engine repeats keeps its first place. Queries that an engine lacks are counted and left out.
    """
    first = Window.partitionBy(key, "query_id", "doc_id").orderBy("rank")
    once = hits.withColumn("n", F.row_number().over(first)).where("n = 1")
    once = once.withColumn("rank", F.row_number().over(Window.partitionBy(key, "query_id").orderBy("rank")).cast("long")).select(key, "query_id", "doc_id", "rank")
    have = once.select(key, "query_id").distinct()
    grid = queries.select("query_id", "control").crossJoin(hits.select(key).distinct())
    missing = grid.join(have.withColumn("h", F.lit(1)), [key, "query_id"], "left").groupBy(key).agg(F.count(F.when(F.col("h").isNull(), 1)).alias("missing"))
    rows = per_query(queries, once, relevant, (key,)).join(have, [key, "query_id"], "left_semi").join(queries.select("query_id", "control"), "query_id")
    top = once.where("rank <= 10").join(grades.select("query_id", "doc_id").distinct().withColumn("j", F.lit(1)), ["query_id", "doc_id"], "left")
    top = top.join(events.select("doc_id").distinct().withColumn("e", F.lit(1)), "doc_id", "left").join(queries.select("query_id", "control"), "query_id")
    judged = top.groupBy(key).agg((F.count("j") / F.count("*")).alias("share"), F.countDistinct(F.when(F.col("control") & F.col("e").isNotNull(), F.col("query_id"))).alias("intruded"))
    means_of = rows.groupBy(key).agg(
        F.count("*").alias("queries"),
        *(F.round(F.avg(c), 6).alias(c) for c in ("ndcg_10", "recall_5", "mrr_10")),
        F.round(F.coalesce(F.avg(F.when(F.col("control"), F.col("ndcg_10"))), F.lit(0.0)), 6).alias("controls"),
        F.count(F.when(F.col("control"), 1)).alias("control_count"),
    )
    out = means_of.join(missing, key).join(judged, key)
    return out.select(key, "queries", "missing", "ndcg_10", "recall_5", "mrr_10", F.round("share", 6).alias("coverage"), verdict(F.col("share")).alias("verdict"), "controls", "control_count", "intruded")


def assessed(quality: DataFrame, order: DataFrame, pool_depth: int) -> DataFrame:
    """``set_quality`` rows with what they allow to say; ``order``: (rule, place, fixed), the rules in order and which are fixed cuts.

    A rule whose median size exceeds the pool's depth is blind. The best F1 of the others is marked, the first of
    equals; ``climbing`` says that F1 only rises along the fixed cuts up to the deepest one, which is the best.
    """
    rows = quality.join(order, "rule").withColumn("blind", F.col("median_size") > pool_depth)
    seen = rows.where("not blind")
    # a handful of rules: one row of them, in order
    listed = seen.agg(F.sort_array(F.collect_list(F.struct("place", "rule", "f1", "fixed"))).alias("all"))
    top = F.array_max(F.transform("all", lambda x: x["f1"]))
    best = F.get(F.filter("all", lambda x: x["f1"] == top), 0)["rule"]
    sweep = F.filter("all", lambda x: x["fixed"])
    rising = F.forall(F.sequence(F.lit(0), F.greatest(F.size(sweep) - 2, F.lit(0))), lambda i: (i + 1 >= F.size(sweep)) | (F.get(sweep, i)["f1"] <= F.get(sweep, i + 1)["f1"]))
    last = F.get(sweep, F.size(sweep) - 1)["rule"]
    verdicts = listed.select(best.alias("best_rule"), ((F.size(sweep) > 0) & rising & (last == best)).alias("climbing"))
    return rows.crossJoin(verdicts).select("rule", "f1", "median_size", "blind", (~F.col("blind") & (F.col("rule") == F.col("best_rule"))).alias("best"), F.coalesce("climbing", F.lit(False)).alias("climbing"))


def break_quality(kept: DataFrame, judged: DataFrame) -> DataFrame:
    """For each rule: mean size, share of good hits above and below the break, the lift between them, good hits missed.

    ``kept``: (rule, query_id, rank) above the break; ``judged``: (query_id, rank, good) of all hits.
    """
    cut = kept.groupBy("rule", "query_id").agg(F.max("rank").alias("cut"))
    above = F.col("rank") <= F.col("cut")
    good = F.col("good")
    rows = cut.join(judged, "query_id").groupBy("rule", "query_id").agg(
        F.count(F.when(above, 1)).alias("size"),
        F.avg(F.when(above, good)).alias("above"),
        F.avg(F.when(~above, good)).alias("below"),
        (F.coalesce(F.sum(F.when(~above, good)), F.lit(0)) / F.greatest(F.sum("good"), F.lit(1))).alias("missed"),
    )
    # queries without anything below the break have no say in the share below
    below = F.coalesce(F.avg("below"), F.lit(0.0))
    return rows.groupBy("rule").agg(F.round(F.avg("size"), 6).alias("size"), F.round(F.avg("above"), 6).alias("above"), F.round(below, 6).alias("below"), F.round(F.avg("above") - below, 6).alias("lift"), F.round(F.avg("missed"), 6).alias("missed"))


def headroom(per: DataFrame, controls: DataFrame, ceiling: DataFrame, base: str, key: str = "lane", listed: int = 8) -> DataFrame:
    """Each arm against the base: its share of the way to the ceiling, whether its controls hold, what it gains and loses.

    ``per``: (arm, query_id, ndcg_10); ``controls``: query_id; ``ceiling``: one row (c). Among arms that keep their
    controls the best is marked; ``gained`` lists the queries with the largest gains.
    """
    marked = per.join(controls.select("query_id").distinct().withColumn("k", F.lit(1)), "query_id", "left")
    arms = marked.groupBy(key).agg(F.avg("ndcg_10").alias("v"), F.coalesce(F.avg(F.when(F.col("k") == 1, F.col("ndcg_10"))), F.lit(0.0)).alias("controls"))
    own = per.where(F.col(key) == base).select("query_id", F.col("ndcg_10").alias("was"))
    moved = per.join(own, "query_id").withColumn("d", F.round(F.col("ndcg_10") - F.col("was"), 9))
    sides = moved.groupBy(key).agg(
        F.count(F.when(F.col("d") > 0, 1)).alias("gains"),
        F.count(F.when(F.col("d") < 0, 1)).alias("losses"),
        F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.when(F.col("d") > 0, F.struct("d", "query_id"))), asc=False), 1, listed), lambda x: x["query_id"]), ",").alias("gained"),
    )
    start = arms.where(F.col(key) == base).select(F.col("v").alias("b")).crossJoin(ceiling)
    rows = arms.join(sides, key).crossJoin(start).withColumn("eligible", (F.col("controls") >= CONTROLS_KEPT) & (F.col(key) != base))
    top = rows.where("eligible").agg(F.max("v").alias("top"))
    share = F.when(F.col("c") > F.col("b"), (F.col("v") - F.col("b")) / (F.col("c") - F.col("b"))).otherwise(0.0)
    return rows.crossJoin(top).select(key, F.round("v", 6).alias("ndcg_10"), F.round(share, 6).alias("share"), F.round("controls", 6).alias("controls"), "eligible", F.coalesce(F.col("eligible") & (F.col("v") == F.col("top")), F.lit(False)).alias("best"), "gains", "losses", "gained")


def hit_rates(wanted: DataFrame, hits: DataFrame, key: str = "lane") -> DataFrame:
    """For each lane: how many queries have one of their wanted (query_id, doc_id) at rank 1, and in the first five."""
    best = hits.join(wanted.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").groupBy(key, "query_id").agg(F.min("rank").alias("best"))
    every = wanted.select("query_id").distinct().crossJoin(hits.select(key).distinct())
    return every.join(best, [key, "query_id"], "left").groupBy(key).agg(F.count("*").alias("named"), F.count(F.when(F.col("best") == 1, 1)).alias("at_first"), F.count(F.when(F.col("best") <= 5, 1)).alias("in_five"))
