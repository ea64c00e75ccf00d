"""Catalogue results: facets, filters, explanations, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T

#: Facets in the order in which they are shown; fixed values.
FACETS = (
    ("record_type", "Books / Events"),
    ("availability", "Availability"),
    ("format", "Format"),
    ("fiction", "Fiction / Non-fiction"),
    ("decade", "Publication date"),
    ("location", "Location"),
    ("language", "Language"),
)


def facet_values(columns: list[str]) -> dict[str, Column]:
    """An array of values for each facet; nothing for what a record lacks."""
    have = {c.lower() for c in columns}
    col = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    present = lambda *values: F.filter(F.array(*values), lambda v: v.isNotNull() & (v != ""))
    return {
        "record_type": F.array(F.when(col("record_type", "string") == "event", "Events").otherwise("Books")),
        "availability": present(F.when(col("available", "int") > 0, "Available now"), F.when(col("format", "string") == "eAudiobook", "Available online")),
        "format": present(col("format", "string")),
        "fiction": F.array(F.when(col("fiction", "boolean"), "Fiction").otherwise("Non-fiction")),
        "decade": present(T.decade(col("year", "string"))),
        "location": present(col("location", "string")),
        "language": present(col("language", "string")),
    }


def facets(pool: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(facet_key, facet_label, value, count, facet_order, value_order) in one pass over the unfiltered pool."""
    values = facet_values(pool.columns)

    def labelled(n: int, key: str, label: str) -> Column:
        return F.transform(values[key], lambda v: F.struct(F.lit(n).alias("facet_order"), F.lit(key).alias("facet_key"), F.lit(label).alias("facet_label"), v.alias("value")))

    rows = F.flatten(F.array(*(labelled(n, key, label) for n, (key, label) in enumerate(FACETS, 1))))
    counted = pool.select(*by, F.inline(rows)).groupBy(*by, "facet_order", "facet_key", "facet_label", "value").agg(F.count("*").alias("count"))
    window = Window.partitionBy(*by, "facet_order").orderBy(F.desc("count"), "value")
    return counted.withColumn("value_order", F.row_number().over(window).cast("long"))


def matching(columns: list[str], filters: dict[str, list[str]]) -> Column:
    """All facets must match, any value of a facet will do; unknown facets and empty lists are ignored."""
    values, keep = facet_values(columns), F.lit(True)
    for key, wanted in filters.items():
        if key in values and wanted:
            keep = keep & F.arrays_overlap(values[key], T.literals(wanted))
    return keep


def missing_terms(query: Column, *fields: Column) -> Column:
    """Distinct query tokens, in order, that no field has."""
    return F.array_except(T.tokens(query), T.tokens(F.concat_ws(" ", *fields)))


def closest_headings(records: DataFrame, headings: DataFrame, queries: DataFrame, n: int = 2) -> DataFrame:
    """(query_id, doc_id, closest): the n own subjects nearest to the query, first subjects first on ties.

    ``records``: (query_id, doc_id, subjects); ``headings``: (subject, vector), each embedded once;
    ``queries``: (query_id, vector).
    """
    from plumbline.functions import vectors as V

    own = records.select("query_id", "doc_id", F.posexplode("subjects").alias("pos", "subject"))
    scored = own.join(headings, "subject").join(queries.select("query_id", F.col("vector").alias("qv")), "query_id").withColumn("sim", F.round(V.dot(F.col("vector"), F.col("qv")), 6))
    top = scored.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("sim"), "pos"))).where(F.col("n") <= n)
    return top.groupBy("query_id", "doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "subject"))), lambda x: x["subject"]).alias("closest"))


#: Card fields and what stands for a missing value; fixed values.
CARD_TEXT = ("doc_id", "title", "author", "author_dates", "year", "publisher", "format", "language", "location", "blurb", "cover", "text", "series_id", "audience", "when", "booking", "cost")


def cards(hits: DataFrame) -> DataFrame:
    """Display fields of ranked records, scores to four places."""
    have = set(hits.columns)
    text = [(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in CARD_TEXT]
    number = lambda c: (F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in have else F.lit(0).cast("long")).alias(c)
    return hits.select("rank", *text, number("available"), number("copies"), number("repeats"), (F.coalesce("subjects", F.array().cast("array<string>")) if "subjects" in have else F.array().cast("array<string>")).alias("subjects"), F.bround(F.col("score"), 4).alias("score"))


def last_wins(files: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """One record for each key of several collections: that of the last file, and in it the last position ``pos``."""
    from functools import reduce

    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("file_no", F.lit(i)) for i, df in enumerate(files)])
    window = Window.partitionBy(key).orderBy(F.desc("file_no"), F.desc("pos"))
    return union.withColumn("n", F.row_number().over(window)).where("n = 1").drop("n", "file_no", "pos")


def integrity(records: DataFrame) -> DataFrame:
    """One row about records (doc_id, title, text, author, subjects, fiction): what is empty or missing, repeated ids, words, the split."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    words = lambda c: F.size(T.whitespace_words(F.coalesce(F.col(c), F.lit(""))))
    rows = records.withColumn("w", (words("text") + words("title")).cast("long"))
    count = lambda condition, name: F.count(F.when(condition, 1)).alias(name)
    counts = rows.agg(
        F.count("*").alias("records"),
        count(blank(F.col("title")), "empty_title"),
        count(F.coalesce(F.size("subjects"), F.lit(0)) <= 0, "no_subjects"),
        count(blank(F.col("text")), "empty_text"),
        F.min("w").alias("words_min"),
        F.max("w").alias("words_max"),
        count(F.coalesce("author", F.lit("")) == "", "missing_author"),
        count(F.col("fiction"), "fiction"),
        count(~F.col("fiction"), "non_fiction"),
    )
    twice = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("duplicate_ids"))
    # the upper median by counts of sizes: as many rows as there are sizes, not records
    sizes = rows.groupBy("w").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(Window.orderBy("w")))
    median = sizes.crossJoin(rows.agg(F.count("*").alias("total"))).where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("w").alias("words_median"))
    return counts.crossJoin(twice).crossJoin(median)
