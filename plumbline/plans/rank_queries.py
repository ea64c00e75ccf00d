"""Queries of retrieval, catalogue results, metrics, pooling and tuning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions import vectors as V
from plumbline.operators import catalogue as C
from plumbline.operators import cuts, metrics, pooling
from plumbline.operators import ranking as R
from plumbline.plans.base import bm25, docs, grades, lanes, queries, query, records, relevant, tok, vector_queries, vectors
from plumbline.session import table




def six(column: str):
    return F.round(column, 6).alias(column)


# keyword ranking


ALL_TERMS = "SELECT doc_id, term, sum(x) AS tf FROM (SELECT doc_id, unnest(tt) AS term, 5.0::DOUBLE AS x FROM dt UNION ALL SELECT doc_id, unnest(bt), 1.0::DOUBLE FROM dt) GROUP BY ALL"


@query("K1_weighted_tf", "dt", f"SELECT term, count(*) AS docs, round(sum(tf), 6) AS weight FROM ({ALL_TERMS}) GROUP BY term")
def k1(spark, sf):
    return R.postings(docs(spark, sf), 5.0).groupBy("term").agg(F.count("*").alias("docs"), F.round(F.sum("tf"), 6).alias("weight"))


@query("K2_avgdl", "dt", "SELECT round(avg(len(tt) + len(bt)), 6) AS avgdl, count(*) AS n FROM dt")
def k2(spark, sf):
    return R.lengths(docs(spark, sf)).agg(F.round(F.avg("dl"), 6).alias("avgdl"), F.count("*").alias("n"))


@query("K3_df", "dt", "SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_concat(tt, bt)) AS term FROM dt) GROUP BY term")
def k3(spark, sf):
    return R.postings(docs(spark, sf)).groupBy("term").agg(F.count("*").alias("df"))


@query("K4_idf", "dt", f"SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT term, count(*) AS df FROM ({ALL_TERMS}) GROUP BY term), (SELECT count(*) AS n FROM dt)")
def k4(spark, sf):
    d = docs(spark, sf)
    df = R.postings(d).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(d.agg(F.count("*").alias("n"))).select("term", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query("K5_bm25_topk", "bm", "SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 10")
def k5(spark, sf):
    return bm25(spark, sf, 10)


@query("K7_stopword_query", "bm", "SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 10 AND query_id = (SELECT min(CAST(item_id AS VARCHAR)) FROM benchmark)")
def k7(spark, sf):
    empty = spark.createDataFrame([("s", "the of and"), ("e", ""), ("n", None)], "query_id string, query string")
    first = queries(spark, sf).orderBy("query_id").limit(1)
    return R.bm25(empty.unionByName(first), docs(spark, sf), 10)


@query("K10_title_weight_sweep", "bm bm5 rel", """SELECT weight, count(*) AS hits, count(r.doc_id) AS relevant FROM (
 SELECT 1.0::DOUBLE AS weight, *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm UNION ALL
 SELECT 5.0::DOUBLE, *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) FROM bm5) h LEFT JOIN rel r USING (query_id, doc_id) WHERE rank <= 10 GROUP BY weight""")
def k10(spark, sf):
    rel = relevant(spark, sf).withColumn("r", F.lit(1))
    swept = reduce(DataFrame.unionByName, [bm25(spark, sf, 10, w).withColumn("weight", F.lit(w)) for w in (1.0, 5.0)])
    return swept.join(rel, ["query_id", "doc_id"], "left").groupBy("weight").agg(F.count("*").alias("hits"), F.count("r").alias("relevant"))


@query("K11_query_signals", "bmtop q dt", f"""SELECT query_id, len(t)::BIGINT AS terms, coalesce(round(s1, 6), 0.0) AS top, CASE WHEN s1 IS NULL THEN 0.0 WHEN s2 IS NULL THEN 1.0 ELSE round((s1 - s2) / s1, 6) END AS dominance,
 CASE WHEN s1 IS NULL OR len(t) = 0 THEN 0.0 ELSE round(len(list_filter(t, lambda x: list_contains(h, x))) / len(t), 6) END AS coverage
FROM (SELECT query_id, {tok('query')} AS t FROM q)
LEFT JOIN (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS s1, max(score) FILTER (WHERE rank = 2) AS s2, max(doc_id) FILTER (WHERE rank = 1) AS doc_id FROM bmtop GROUP BY query_id) USING (query_id)
LEFT JOIN (SELECT doc_id, list_concat(tt, bt) AS h FROM dt) USING (doc_id)""")
def k11(spark, sf):
    best = bm25(spark, sf, 2).groupBy("query_id").agg(*(F.max(F.when(F.col("rank") == n, F.col(c))).alias(a) for n, c, a in ((1, "score", "s1"), (2, "score", "s2"), (1, "doc_id", "doc_id"))))
    own = queries(spark, sf).select("query_id", T.tokens(F.col("query")).alias("t")).join(best, "query_id", "left")
    # only the best documents' words are taken
    chosen = docs(spark, sf).join(best.select("doc_id").distinct(), "doc_id")
    held = own.join(chosen.select("doc_id", F.concat(T.tokens(F.col("title")), T.tokens(F.col("text"))).alias("h")), "doc_id", "left")
    none = F.col("s1").isNull()
    inside = F.size(F.filter("t", lambda x: F.array_contains("h", x)))
    return held.select(
        "query_id",
        F.size("t").cast("long").alias("terms"),
        F.coalesce(F.round("s1", 6), F.lit(0.0)).alias("top"),
        F.when(none, 0.0).when(F.col("s2").isNull(), 1.0).otherwise(F.round((F.col("s1") - F.col("s2")) / F.col("s1"), 6)).alias("dominance"),
        F.when(none | (F.size("t") == 0), 0.0).otherwise(F.round(inside / F.nullif(F.size("t"), F.lit(0)), 6)).alias("coverage"),
    )


# vector ranking

TOP5 = "SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs) WHERE rank <= 5"


@query("V7_cosine_topk", "vs", TOP5)
def v7(spark, sf):
    return R.cosine(vector_queries(spark, sf), vectors(spark, sf).select("doc_id", "vector"), 5)


@query("V12_batch_topk", "vs", TOP5)
def v12(spark, sf):
    every = vectors(spark, sf).select("doc_id", "vector")
    return R.cosine(vector_queries(spark, sf), every, 5, block=64, chunk=1000)


@query("V10_int8_topk", "v vq", """SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
 SELECT query_id, doc_id, round(s / 127 * list_sum(list_transform(list_zip(vq.vector, c.vector), lambda p: p[1]::DOUBLE * round_even(p[2]::DOUBLE / s * 127, 0))), 6) AS score
 FROM vq, (SELECT doc_id, vector, list_max(list_transform(vector, lambda x: abs(x::DOUBLE))) AS s FROM v) c)) WHERE rank <= 5""")
def v10(spark, sf):
    coded = vectors(spark, sf).select("doc_id", V.int8(F.col("vector")).alias("c"))
    return R.cosine(vector_queries(spark, sf), coded.select("doc_id", F.col("c.codes").alias("vector"), F.col("c.scale").alias("factor")), 5)


@query("V11_nearest_labels", "v vq", """SELECT query_id, doc_id, array_to_string(list(label ORDER BY n), ',') AS closest FROM (
 SELECT query_id, doc_id, label, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY sim DESC, pos) AS n FROM (
 SELECT query_id, r.doc_id AS doc_id, s.pos AS pos, s.label AS label, round(list_sum(list_transform(list_zip(vq.vector, c.vector), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS sim
 FROM vq, (SELECT doc_id, label FROM v) r, (SELECT unnest([0, 1, 2]) AS k) ks, LATERAL (SELECT k AS pos, CAST((r.label + k * 3) % 10 AS VARCHAR) AS label) s
 JOIN (SELECT CAST(label AS VARCHAR) AS label, min_by(vector, length(doc_id) * 1000000 + doc_id::INT) AS vector FROM v GROUP BY label) c ON c.label = s.label)) WHERE n <= 2 GROUP BY query_id, doc_id""")
def v11(spark, sf):
    every = vectors(spark, sf)
    heads = every.groupBy(F.col("label").cast("string").alias("subject")).agg(F.min_by("vector", F.length("doc_id") * 1000000 + F.col("doc_id").cast("int")).alias("vector"))
    subjects = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: ((F.col("label") + k * 3) % 10).cast("string"))
    rows = every.select("doc_id", subjects.alias("subjects"))
    asked = vector_queries(spark, sf)
    # records with the same subjects have the same answer: ranked once for each list of subjects, then dealt to all records
    kinds = rows.select("subjects").distinct().withColumn("doc_id", F.array_join("subjects", ","))
    found = C.closest_headings(kinds.crossJoin(asked.select("query_id")), heads, asked)
    found = found.select("query_id", F.col("doc_id").alias("kind"), F.array_join("closest", ",").alias("closest"))
    return rows.select("doc_id", F.array_join("subjects", ",").alias("kind")).join(found, "kind").select("query_id", "doc_id", "closest")


# fusion, order, pages

FUSED = """fused AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, min((CASE lane WHEN 'bm25' THEN 0 WHEN 'tf' THEN 1 ELSE 2 END) * 1000 + rank) AS first FROM lanes GROUP BY query_id, doc_id)"""


@query("R1_rrf", "lanes", f"SELECT * FROM (WITH {FUSED} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rank FROM fused) WHERE rank <= 10")
def r1(spark, sf):
    every = lanes(spark, sf)
    return R.rrf([every.where(F.col("lane") == name) for name in ("bm25", "tf", "title")], 10)


#: Embeddings stand in for documents' vectors by id, and for the passages' by the same id.
@query("R2_hybrid", "bm v", """SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rank FROM (
 SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, min(lane * 1000 + rank) AS first FROM (
 SELECT 0 AS lane, query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm UNION ALL
 SELECT 1, query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) FROM (
  SELECT a.doc_id AS query_id, v.doc_id AS doc_id, round(list_sum(list_transform(list_zip(a.vector, v.vector), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS score
  FROM v a JOIN (SELECT CAST(item_id AS VARCHAR) AS query_id FROM benchmark) b ON a.doc_id = b.query_id, v)) WHERE rank <= 40 GROUP BY query_id, doc_id)) WHERE rank <= 10""")
def r2(spark, sf):
    every = vectors(spark, sf).select("doc_id", "vector")
    asked = queries(spark, sf).select("query_id").join(every.withColumnRenamed("doc_id", "query_id"), "query_id")
    return R.rrf([bm25(spark, sf, 40), R.cosine(asked, every, 40)], 10)


@query("R4_compare", "lanes", "SELECT lane AS mode, count(*) AS results, round(sum(score), 4) AS total FROM lanes WHERE rank <= 5 GROUP BY lane")
def r4(spark, sf):
    return lanes(spark, sf).where("rank <= 5").groupBy(F.col("lane").alias("mode")).agg(F.count("*").alias("results"), F.round(F.sum("score"), 4).alias("total"))


@query("R5_collapse_docs", "bmtop d", "SELECT query_id, source, doc_id, repeats, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT query_id, source, doc_id, rank, count(*) OVER (PARTITION BY query_id, source) AS repeats, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM bmtop JOIN d USING (doc_id)) WHERE n = 1")
def r5(spark, sf):
    hits = bm25(spark, sf).join(docs(spark, sf).select("doc_id", "source"), "doc_id")
    return R.collapse(hits, "source").select("query_id", "source", "doc_id", "repeats", "rank")


@query("R6_series_collapse", "bmtop rec", "SELECT query_id, doc_id, repeats, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT query_id, doc_id, rank, count(*) OVER (PARTITION BY query_id, coalesce(series_id, doc_id)) AS repeats, row_number() OVER (PARTITION BY query_id, coalesce(series_id, doc_id) ORDER BY rank) AS n FROM bmtop JOIN rec USING (doc_id)) WHERE n = 1")
def r6(spark, sf):
    hits = bm25(spark, sf).join(records(spark, sf).select("doc_id", "series_id"), "doc_id").withColumn("series", F.coalesce("series_id", "doc_id"))
    return R.collapse(hits, "series").select("query_id", "doc_id", "repeats", "rank")


R7 = """WITH s AS (SELECT h.*, CASE WHEN n_chars % 3 <> 0 THEN (n_chars % 97)::DOUBLE END AS second FROM bmtop h JOIN d USING (doc_id)),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS slot, row_number() OVER (PARTITION BY query_id ORDER BY second DESC, rank) AS turn FROM s WHERE second IS NOT NULL)
SELECT a.query_id AS query_id, a.doc_id AS doc_id, a.score AS score, b.rank AS rank FROM m a JOIN m b ON a.query_id = b.query_id AND a.turn = b.slot UNION ALL SELECT query_id, doc_id, score, rank FROM s WHERE second IS NULL"""


@query("R7_rerank_slots", "bmtop d", R7)
def r7(spark, sf):
    second = docs(spark, sf).where("n_chars % 3 <> 0").select("doc_id", (F.col("n_chars") % 97).cast("double").alias("second"))
    hits = bm25(spark, sf)
    return R.rerank(hits, hits.select("query_id", "doc_id").join(second, "doc_id"))




def named(spark, sf):
    """(queries, catalogue): part names and supplier names to ask for."""
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")
    catalogue = part.join(supplier, F.col("p_partkey") == F.col("s_suppkey"), "left").select(F.col("p_partkey").cast("string").alias("doc_id"), F.col("p_name").alias("title"), F.coalesce("s_name", F.lit("")).alias("author"))
    asked = catalogue.where("author <> ''").select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id").cast("int") % 2 == 0, F.col("title")).otherwise(F.concat(F.lit("books by "), "author")).alias("query"))
    return asked, catalogue


CAT = f"""cat AS (SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_name AS title, coalesce(s_name, '') AS author FROM part LEFT JOIN supplier ON p_partkey = s_suppkey),
asked AS (SELECT doc_id AS query_id, CASE WHEN doc_id::INT % 2 = 0 THEN title ELSE concat('books by ', author) END AS query FROM cat WHERE author <> ''),
ct AS (SELECT doc_id, array_to_string({tok('title')}, ' ') AS t, array_to_string({tok('author')}, ' ') AS a FROM cat),
askt AS (SELECT query_id, {tok('query')} AS qt FROM asked),
exact AS (SELECT query_id, doc_id, CASE WHEN t <> '' AND t = array_to_string(qt, ' ') THEN 1 WHEN a <> '' AND contains(concat(' ', array_to_string(qt, ' '), ' '), concat(' ', a, ' ')) THEN 2
 WHEN t <> '' AND len(qt) >= 3 AND len(list_filter(range(1, len(qt) - 1), lambda i: contains(t, array_to_string(list_slice(qt, i, i + 2), ' ')))) > 0 THEN 3 END AS reason_order FROM askt, ct WHERE len(qt) > 0)"""


@query("R8_exact_find", "", f"WITH {CAT} SELECT query_id, doc_id, (['title', 'author', 'phrase'])[reason_order] AS reason FROM exact WHERE reason_order IS NOT NULL")
def r8(spark, sf):
    return R.exact_matches(*named(spark, sf)).select("query_id", "doc_id", "reason")


R9 = f"""{CAT}, hits AS (SELECT query_id, CAST(query_id::BIGINT + (k * 7) % 10 - 4 AS VARCHAR) AS doc_id, 1.0 / k AS score, k AS rank FROM asked, range(1, 6) x(k)),
lifted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reason_order, doc_id) AS lift FROM exact WHERE reason_order IS NOT NULL),
promoted AS (SELECT query_id, doc_id, round(coalesce(score, 0), 6) AS score, reason, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lift <= 3 THEN lift ELSE 4 END, rank) AS rank FROM (
 SELECT coalesce(h.query_id, l.query_id) AS query_id, coalesce(h.doc_id, l.doc_id) AS doc_id, score, rank, lift, (['title', 'author', 'phrase'])[reason_order] AS reason FROM hits h FULL JOIN lifted l ON h.query_id = l.query_id AND h.doc_id = l.doc_id) WHERE rank IS NOT NULL OR lift <= 3)"""


@query("R9_promote", "", f"WITH {R9} SELECT * FROM promoted")
def r9(spark, sf):
    asked, catalogue = named(spark, sf)
    hits = near_hits(asked)
    return R.promote(hits, R.exact_promoted(hits, asked, catalogue)).withColumn("score", F.round("score", 6))


def near_hits(asked):
    """Five ranked records near the one that each query was made from."""
    ranked = asked.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    near = (F.col("query_id").cast("long") + F.col("k") * 7 % 10 - 4).cast("string")
    return ranked.select("query_id", near.alias("doc_id"), (1.0 / F.col("k")).alias("score"), F.col("k").cast("long").alias("rank"))


@query("R13_promote_within", "", f"""WITH {CAT}, hits AS (SELECT query_id, CAST(query_id::BIGINT + (k * 7) % 10 - 4 AS VARCHAR) AS doc_id, 1.0 / k AS score, k AS rank FROM asked, range(1, 6) x(k)),
lifted AS (SELECT query_id, doc_id, (['title', 'author', 'phrase'])[reason_order] AS reason, row_number() OVER (PARTITION BY query_id ORDER BY reason_order, doc_id) AS lift FROM exact JOIN (SELECT query_id, doc_id FROM hits) USING (query_id, doc_id) WHERE reason_order IS NOT NULL)
SELECT query_id, doc_id, round(score, 6) AS score, reason, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lift <= 3 THEN lift ELSE 4 END, rank) AS rank FROM hits LEFT JOIN lifted USING (query_id, doc_id)""")
def r13(spark, sf):
    asked, catalogue = named(spark, sf)
    hits = near_hits(asked)
    return R.promote_within(hits, R.exact_within(hits, asked, catalogue)).withColumn("score", F.round("score", 6))


@query("R10_pool_filter_cut_page", "bm rec", """SELECT query_id, doc_id, rank, total FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS total FROM (
 SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) JOIN rec USING (doc_id)
 WHERE rank <= 200 AND language IN ('en', 'de') AND available > 0) WHERE rank <= 20) WHERE rank BETWEEN 11 AND 20""")
def r10(spark, sf):
    hits = bm25(spark, sf, R.POOL).join(records(spark, sf), "doc_id")
    keep = C.matching(hits.columns, {"language": ["en", "de"], "availability": ["Available now"], "unknown": ["x"], "format": []})
    return R.pool_filter_cut_page(hits, keep, page=2).select("query_id", "doc_id", "rank", "total")




@query("R14_R17_cut_strategies", "bmtop", """WITH g AS (SELECT *, max(score) OVER w AS best, round(score - lead(score) OVER (PARTITION BY query_id ORDER BY rank), 9) AS gap FROM bmtop WINDOW w AS (PARTITION BY query_id)),
c AS (SELECT query_id, coalesce(max_by(rank, gap * 1000000000 + rank) FILTER (WHERE gap IS NOT NULL AND rank < 50), 1) AS cut FROM g GROUP BY query_id)
SELECT rule, query_id, count(*) AS kept FROM (
 SELECT 'floor 0.15' AS rule, query_id FROM g WHERE score >= 0.15 UNION ALL SELECT 'relative 0.90', query_id FROM g WHERE score >= 0.90 * best UNION ALL SELECT 'relative 0.85', query_id FROM g WHERE score >= 0.85 * best
 UNION ALL SELECT 'largest gap', query_id FROM g JOIN c USING (query_id) WHERE rank <= cut UNION ALL SELECT 'top 5', query_id FROM g WHERE rank <= 5 UNION ALL SELECT 'top 10', query_id FROM g WHERE rank <= 10
 UNION ALL SELECT 'top 15', query_id FROM g WHERE rank <= 15 UNION ALL SELECT 'top 20', query_id FROM g WHERE rank <= 20) GROUP BY rule, query_id""")
def r14(spark, sf):
    return cuts.named(bm25(spark, sf), cuts.STRATEGIES).groupBy("rule", "query_id").agg(F.count("*").alias("kept"))


BREAKS = """WITH g AS (SELECT *, max(score) OVER w AS top, min(score) OVER w AS bottom, round(score - lead(score) OVER (PARTITION BY query_id ORDER BY rank), 9) AS gap FROM bmtop WINDOW w AS (PARTITION BY query_id)),
c AS (SELECT query_id, coalesce(max_by(rank, gap * 1000000000 + rank) FILTER (WHERE gap IS NOT NULL), 1) AS cut FROM g GROUP BY query_id),
kept AS (SELECT concat('fraction ', a) AS rule, query_id, doc_id, rank FROM g, (SELECT unnest(['0.98', '0.95', '0.92', '0.90']) AS a) WHERE score >= a::DOUBLE * top OR rank = 1
 UNION ALL SELECT concat('spread ', b), query_id, doc_id, rank FROM g, (SELECT unnest(['0.25', '0.50']) AS b) WHERE top = bottom OR score >= top - b::DOUBLE * (top - bottom) OR rank = 1
 UNION ALL SELECT 'largest gap', query_id, doc_id, rank FROM g JOIN c USING (query_id) WHERE rank <= cut
 UNION ALL SELECT concat('fixed ', k), query_id, doc_id, rank FROM g, (SELECT unnest([5, 10]) AS k) WHERE rank <= k)"""


@query("R18_R20_breaks", "bmtop", BREAKS + " SELECT rule, query_id, count(*) AS kept FROM kept GROUP BY rule, query_id")
def r18(spark, sf):
    return cuts.named(bm25(spark, sf), cuts.BREAKS).groupBy("rule", "query_id").agg(F.count("*").alias("kept"))


@query("R11_oracle_order", "bmtop rel", "SELECT h.query_id AS query_id, h.doc_id AS doc_id, row_number() OVER (PARTITION BY h.query_id ORDER BY (r.doc_id IS NULL)::INT, rank) AS rank FROM bmtop h LEFT JOIN rel r ON r.query_id = h.query_id AND r.doc_id = h.doc_id")
def r11(spark, sf):
    rel = relevant(spark, sf).withColumn("r", F.lit(0))
    marked = bm25(spark, sf).join(rel, ["query_id", "doc_id"], "left")
    return marked.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("r", F.lit(1)), "rank")).cast("long").alias("rank"))


@query("R12_permutation_guard", "bmtop d", f"""WITH r7 AS ({R7}), kept AS (SELECT query_id, doc_id FROM r7 WHERE rank <= 18)
SELECT (SELECT count(*) FROM (SELECT query_id, doc_id FROM bmtop EXCEPT ALL SELECT query_id, doc_id FROM r7)) AS lost, (SELECT count(*) FROM (SELECT query_id, doc_id FROM r7 EXCEPT ALL SELECT query_id, doc_id FROM bmtop)) AS invented,
 (SELECT count(*) FROM (SELECT query_id, doc_id FROM bmtop EXCEPT ALL SELECT query_id, doc_id FROM kept)) AS lost_by_cut""")
def r12(spark, sf):
    before, after = bm25(spark, sf).select("query_id", "doc_id"), r7(spark, sf)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    whole, cut = after.select("query_id", "doc_id"), after.where("rank <= 18").select("query_id", "doc_id")
    return count(before.exceptAll(whole), "lost").crossJoin(count(whole.exceptAll(before), "invented")).crossJoin(count(before.exceptAll(cut), "lost_by_cut"))


@query("R21_known_items", "d", """WITH chosen AS (SELECT doc_id, title FROM d WHERE title <> '' AND NOT starts_with(title, '[') ORDER BY sha256(concat('known', doc_id)), doc_id LIMIT 30),
damaged AS (SELECT doc_id, string_split(title, ' ') AS w FROM d WHERE title <> '' AND NOT starts_with(title, '[') ORDER BY sha256(concat('damaged', doc_id)), doc_id LIMIT 15),
authors AS (SELECT DISTINCT source FROM d WHERE source <> '' ORDER BY sha256(concat('author', source)), source LIMIT 3)
SELECT 'title' AS kind, lower(title) AS query, doc_id AS answers, 1::BIGINT AS n FROM chosen
UNION ALL SELECT 'author', lower(source), min(doc_id), count(DISTINCT doc_id) FROM d JOIN authors USING (source) GROUP BY source
UNION ALL SELECT 'dropped', lower(array_to_string(list_filter(w, lambda x, i: i <> CAST(concat('0x', substr(sha256(concat('drop', doc_id)), 1, 6)) AS INT) % len(w) + 1), ' ')), doc_id, 1 FROM damaged WHERE len(w) >= 3""")
def r21(spark, sf):
    """Questions whose answers are known because they were made from records: titles, authors, titles with a word dropped."""
    d = docs(spark, sf)
    usable = d.where("title <> '' and not startswith(title, '[')").select("doc_id", "title")
    seeded = lambda rows, seed, column, n: rows.withColumn("h", F.sha2(F.concat(F.lit(seed), column).cast("binary"), 256)).orderBy("h", column).limit(n).drop("h")
    titles = seeded(usable, "known", "doc_id", 30).select(F.lit("title").alias("kind"), F.lower("title").alias("query"), F.col("doc_id").alias("answers"), F.lit(1).cast("long").alias("n"))
    names = seeded(d.where("source <> ''").select("source").distinct(), "author", "source", 3)
    authors = d.join(names, "source").groupBy("source").agg(F.min("doc_id").alias("answers"), F.countDistinct("doc_id").alias("n")).select(F.lit("author").alias("kind"), F.lower("source").alias("query"), "answers", "n")
    damaged = seeded(usable, "damaged", "doc_id", 15).withColumn("w", F.split("title", " ")).where(F.size("w") >= 3)
    gone = F.conv(F.substring(F.sha2(F.concat(F.lit("drop"), "doc_id").cast("binary"), 256), 1, 6), 16, 10).cast("int") % F.size("w")
    dropped = damaged.withColumn("gone", gone).select(F.lit("dropped").alias("kind"), F.lower(F.array_join(F.filter("w", lambda x, i: i != F.col("gone")), " ")).alias("query"), F.col("doc_id").alias("answers"), F.lit(1).cast("long").alias("n"))
    return titles.unionAll(authors).unionAll(dropped)


@query("R22_router", "mq bmtop q dt", f"""SELECT query_id, round(CASE WHEN coverage >= 1.0 THEN k ELSE s END, 6) AS routed, round(greatest(k, s), 6) AS oracle FROM (
 SELECT query_id, max(ndcg_10) FILTER (WHERE lane = 'bm25') AS k, max(ndcg_10) FILTER (WHERE lane = 'tf') AS s FROM mq GROUP BY query_id) JOIN (
 SELECT query_id, CASE WHEN h IS NULL OR len(t) = 0 THEN 0.0 ELSE len(list_filter(t, lambda x: list_contains(h, x))) / len(t) END AS coverage FROM (SELECT query_id, {tok('query')} AS t FROM q)
 LEFT JOIN (SELECT query_id, doc_id FROM bmtop WHERE rank = 1) USING (query_id) LEFT JOIN (SELECT doc_id, list_concat(tt, bt) AS h FROM dt) USING (doc_id)) USING (query_id)""")
def r22(spark, sf):
    per = metrics.per_query(queries(spark, sf), lanes(spark, sf), relevant(spark, sf), ("lane",))
    both = per.groupBy("query_id").pivot("lane", ["bm25", "tf"]).agg(F.first("ndcg_10"))
    signals = k11(spark, sf).select("query_id", "coverage")
    return both.join(signals, "query_id").select("query_id", F.round(F.when(F.col("coverage") >= 1.0, F.col("bm25")).otherwise(F.col("tf")), 6).alias("routed"), F.round(F.greatest("bm25", "tf"), 6).alias("oracle"))


# catalogue

FACET_ROWS = """SELECT query_id, 1 AS o, 'record_type' AS k, CASE WHEN record_type = 'event' THEN 'Events' ELSE 'Books' END AS value FROM p
 UNION ALL SELECT query_id, 2, 'availability', 'Available now' FROM p WHERE available > 0 UNION ALL SELECT query_id, 2, 'availability', 'Available online' FROM p WHERE format = 'eAudiobook'
 UNION ALL SELECT query_id, 3, 'format', format FROM p WHERE format <> '' UNION ALL SELECT query_id, 4, 'fiction', CASE WHEN fiction THEN 'Fiction' ELSE 'Non-fiction' END FROM p
 UNION ALL SELECT query_id, 5, 'decade', concat(substr(year, 1, 3), '0s') FROM p WHERE regexp_matches(substr(year, 1, 3), '^\\d+$') UNION ALL SELECT query_id, 6, 'location', location FROM p WHERE location <> '' UNION ALL SELECT query_id, 7, 'language', language FROM p WHERE language <> ''""".replace("\\\\", "\\")


@query("A2_facets", "bmtop rec", f"SELECT query_id, k AS facet_key, value, count, row_number() OVER (PARTITION BY query_id, o ORDER BY count DESC, value) AS value_order FROM (SELECT query_id, o, k, value, count(*) AS count FROM (WITH p AS (SELECT * FROM bmtop JOIN rec USING (doc_id)) {FACET_ROWS}) GROUP BY ALL)")
def a2(spark, sf):
    return C.facets(bm25(spark, sf).join(records(spark, sf), "doc_id"), ("query_id",)).select("query_id", "facet_key", "value", "count", "value_order")


@query("A3_filter", "rec", "SELECT doc_id FROM rec WHERE (available > 0 OR format = 'eAudiobook') AND language IN ('fr', 'es') AND regexp_matches(year, '^19[5-9]')")
def a3(spark, sf):
    r = records(spark, sf)
    wanted = {"availability": ["Available now", "Available online"], "language": ["fr", "es"], "decade": ["1950s", "1960s", "1970s", "1980s", "1990s"], "nothing": ["x"]}
    return r.where(C.matching(r.columns, wanted)).select("doc_id")


@query("A6_cards", "bmtop rec", "SELECT query_id, rank, doc_id, title, author, year, format, language, location, available::BIGINT AS available, (n // 100 + (n % 100 > 50 OR (n % 100 = 50 AND (n // 100) % 2 = 1))::INT) / 10000.0 AS score FROM (SELECT *, round(score * 1000000)::BIGINT AS n FROM bmtop) JOIN rec USING (doc_id)")
def a6(spark, sf):
    hits = bm25(spark, sf).join(records(spark, sf), "doc_id")
    fields = ("rank", "doc_id", "title", "author", "year", "format", "language", "location", "available", "score")
    return C.cards(hits.withColumn("audience", F.col("query_id"))).select(F.col("audience").alias("query_id"), *fields)


@query("A7_missing_terms", "bmtop rec q", f"SELECT query_id, doc_id, array_to_string(list_filter(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN list_position(t, t[i]) = i AND NOT list_contains(h, t[i]) THEN t[i] END), lambda x: x IS NOT NULL), ' ') AS missing FROM (SELECT query_id, doc_id, {tok('query')} AS t, list_concat(list_concat({tok('title')}, {tok('author')}), {tok('text')}) AS h FROM bmtop JOIN rec USING (doc_id) JOIN q USING (query_id))")
def a7(spark, sf):
    hits = bm25(spark, sf).join(records(spark, sf), "doc_id").join(queries(spark, sf), "query_id")
    return hits.select("query_id", "doc_id", F.array_join(C.missing_terms(F.col("query"), F.col("title"), F.col("author"), F.col("text")), " ").alias("missing"))


@query("A8_envelope", "bmtop", "SELECT query_id, count(*) AS total, CASE WHEN count(*) > 10 THEN 11 ELSE 0 END::BIGINT AS first, CASE WHEN count(*) > 10 THEN least(count(*), 20) ELSE 0 END::BIGINT AS last FROM bmtop GROUP BY query_id")
def a8(spark, sf):
    n = F.count("*")
    return bm25(spark, sf).groupBy("query_id").agg(n.alias("total"), F.when(n > 10, 11).otherwise(0).cast("long").alias("first"), F.when(n > 10, F.least(n, F.lit(20))).otherwise(0).cast("long").alias("last"))


@query("A12_reach", "bmtop rec", "SELECT query_id, count(*) FILTER (WHERE record_type = 'event') AS events, min(rank) FILTER (WHERE record_type = 'event') AS best_rank, min_by(title, rank) FILTER (WHERE record_type = 'event') AS best_title FROM bmtop JOIN rec USING (doc_id) GROUP BY query_id")
def a12(spark, sf):
    hits = bm25(spark, sf).join(records(spark, sf), "doc_id").withColumn("e", F.col("record_type") == "event")
    return reach(hits).select("query_id", "events", "best_rank", "best_title")


def reach(hits):
    """For each query: events among its hits, the best one's rank and title."""
    return hits.groupBy("query_id").agg(F.count(F.when(F.col("e"), 1)).alias("events"), F.min(F.when(F.col("e"), F.col("rank"))).alias("best_rank"), F.min_by("title", F.when(F.col("e"), F.col("rank"))).alias("best_title"))


CONTROL = "substr(sha256(concat('control', query_id)), 1, 1) < '4'"


def controls(spark, sf):
    """(query_id, control): a quarter of the queries, by digest, stand for known-item controls."""
    return queries(spark, sf).select("query_id", (F.substring(F.sha2(F.concat(F.lit("control"), "query_id").cast("binary"), 256), 1, 1) < "4").alias("control"))


@query("A12_reach_totals", "bmtop rec q", f"""SELECT count(*) AS queries, count(*) FILTER (WHERE events > 0) AS reached, coalesce(sum(events), 0)::BIGINT AS event_hits, count(*) * 20 AS slots, count(*) FILTER (WHERE events > 0) / count(*) >= 0.6 AS passed,
 count(*) FILTER (WHERE {CONTROL}) AS known_items, count(*) FILTER (WHERE {CONTROL} AND events > 0) AS intruded FROM (SELECT query_id, coalesce(events, 0) AS events FROM q LEFT JOIN (SELECT query_id, count(*) FILTER (WHERE record_type = 'event') AS events FROM bmtop JOIN rec USING (doc_id) GROUP BY query_id) USING (query_id))""")
def a12_totals(spark, sf):
    hits = bm25(spark, sf).join(records(spark, sf), "doc_id").withColumn("e", F.col("record_type") == "event")
    rows = controls(spark, sf).join(reach(hits).select("query_id", "events"), "query_id", "left").withColumn("some", F.coalesce("events", F.lit(0)) > 0)
    n, got = F.count("*"), F.count(F.when(F.col("some"), 1))
    return rows.agg(n.alias("queries"), got.alias("reached"), F.coalesce(F.sum("events"), F.lit(0)).alias("event_hits"), (n * 20).alias("slots"), (got / n >= 0.6).alias("passed"), F.count(F.when(F.col("control"), 1)).alias("known_items"), F.count(F.when(F.col("control") & F.col("some"), 1)).alias("intruded"))


@query("P14_filter_before_after", "bm rec q", """WITH pool AS (SELECT query_id, language, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) JOIN rec USING (doc_id) WHERE rank <= 200),
counted AS (SELECT query_id, language, coalesce(a, 0) AS a, least(coalesce(k, 0), 20) AS b FROM q CROSS JOIN (SELECT DISTINCT language FROM rec WHERE language <> '') LEFT JOIN (SELECT query_id, language, count(*) AS k, count(*) FILTER (WHERE rank <= 20) AS a FROM pool GROUP BY ALL) USING (query_id, language))
SELECT language, sum(a)::BIGINT AS after_cut, sum(b)::BIGINT AS before_cut, round(avg((a < 3)::INT), 6) AS few_after, round(avg((b < 3)::INT), 6) AS few_before, round(avg((a = 0)::INT), 6) AS none_after, round(avg((b = 0)::INT), 6) AS none_before FROM counted GROUP BY language""")
def p14(spark, sf):
    """What a filter leaves of a result if it comes after the cut, and if it comes before: sums, shares of few and of none."""
    rec = records(spark, sf).select("doc_id", "language")
    pool = bm25(spark, sf, R.POOL).join(rec, "doc_id")
    sizes = pool.groupBy("query_id", "language").agg(F.least(F.count("*"), F.lit(R.CUT)).alias("before"), F.count(F.when(F.col("rank") <= R.CUT, 1)).alias("after"))
    grid = queries(spark, sf).select("query_id").crossJoin(rec.where("language <> ''").select("language").distinct())
    rows = grid.join(sizes, ["query_id", "language"], "left").fillna(0, ["before", "after"])
    share = lambda condition: F.round(F.avg(condition.cast("int")), 6)
    return rows.groupBy("language").agg(
        F.sum("after").alias("after_cut"), F.sum("before").alias("before_cut"),
        share(F.col("after") < 3).alias("few_after"), share(F.col("before") < 3).alias("few_before"),
        share(F.col("after") == 0).alias("none_after"), share(F.col("before") == 0).alias("none_before"),
    )


# metrics


def measured(spark, sf):
    return metrics.per_query(queries(spark, sf), lanes(spark, sf), relevant(spark, sf), ("lane",))


for _name, _metric in (("E1_recall", "recall_5"), ("E2_mrr", "mrr_10"), ("E3_ndcg", "ndcg_10")):
    query(_name, "mq", f"SELECT lane, query_id, round({_metric}, 6) AS {_metric} FROM mq")(lambda spark, sf, m=_metric: measured(spark, sf).select("lane", "query_id", six(m)))


@query("E4_mode_metrics", "mq", "SELECT lane, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(mrr_10), 6) AS mrr_10, round(avg(ndcg_10), 6) AS ndcg_10, count(*) AS queries FROM mq GROUP BY lane")
def e4(spark, sf):
    return metrics.means(measured(spark, sf), ("lane",))


PIVOT = "SELECT query_id, round(max(ndcg_10) FILTER (WHERE lane = 'bm25'), 3) AS bm25, round(max(ndcg_10) FILTER (WHERE lane = 'tf'), 3) AS tf, round(max(ndcg_10) FILTER (WHERE lane = 'title'), 3) AS title FROM mq GROUP BY query_id"


@query("E5_pivot", "mq", PIVOT)
def e5(spark, sf):
    wide = measured(spark, sf).groupBy("query_id").pivot("lane", ["bm25", "tf", "title"]).agg(F.first("ndcg_10"))
    return wide.select("query_id", *(F.round(c, 3).alias(c) for c in ("bm25", "tf", "title")))


ANSWERED = "lane <> 'title' OR substr(sha256(concat('missing', query_id)), 1, 1) >= '4'"


@query("E6_score_rankings", "lanes grades mq rec", f"""WITH answered AS (SELECT * FROM lanes WHERE {ANSWERED}), have AS (SELECT DISTINCT lane, query_id FROM answered),
scored AS (SELECT lane, count(*) AS queries, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(recall_5), 6) AS recall_5, round(avg(mrr_10), 6) AS mrr_10, round(coalesce(avg(ndcg_10) FILTER (WHERE {CONTROL}), 0), 6) AS controls, count(*) FILTER (WHERE {CONTROL}) AS control_count FROM mq JOIN have USING (lane, query_id) GROUP BY lane),
judged AS (SELECT lane, count(g.doc_id) / count(*) AS share, count(DISTINCT CASE WHEN {CONTROL.replace('query_id', 'l.query_id')} AND r.record_type = 'event' THEN l.query_id END) AS intruded FROM answered l LEFT JOIN grades g ON g.query_id = l.query_id AND g.doc_id = l.doc_id LEFT JOIN rec r ON r.doc_id = l.doc_id WHERE rank <= 10 GROUP BY lane)
SELECT lane, queries, (SELECT count(*) FROM benchmark) - (SELECT count(*) FROM have h WHERE h.lane = scored.lane) AS missing, ndcg_10, recall_5, mrr_10, round(share, 6) AS coverage, CASE WHEN share >= 0.9 THEN 'comparable' WHEN share >= 0.75 THEN 'caution' ELSE 'not comparable' END AS verdict, controls, control_count, intruded FROM scored JOIN judged USING (lane)""")
def e6(spark, sf):
    answered = lanes(spark, sf).where((F.col("lane") != "title") | (F.substring(F.sha2(F.concat(F.lit("missing"), "query_id").cast("binary"), 256), 1, 1) >= "4"))
    twice = answered.unionByName(answered.where("rank = 1").withColumn("rank", F.col("rank") + 50))
    events = records(spark, sf).where("record_type = 'event'").select("doc_id")
    return metrics.score_rankings(controls(spark, sf), twice, relevant(spark, sf), grades(spark, sf), events)


@query("E8_weakest", "mq", "SELECT query_id, round(ndcg_10, 6) AS ndcg_10 FROM mq WHERE lane = 'bm25' ORDER BY ndcg_10, query_id LIMIT 5")
def e8(spark, sf):
    return measured(spark, sf).where("lane = 'bm25'").select("query_id", six("ndcg_10")).orderBy("ndcg_10", "query_id").limit(5)


@query("E9_f1", "lanes rel q", """SELECT lane, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, median_size FROM (
 SELECT lane, avg(coalesce(h / k, 0.0)) AS p, avg(coalesce(h / n_rel, 0.0)) AS r, median(coalesce(k, 0))::DOUBLE AS median_size FROM (SELECT DISTINCT lane FROM lanes) CROSS JOIN q
 LEFT JOIN (SELECT lane, query_id, count(*) AS k, count(r.doc_id) AS h FROM lanes LEFT JOIN rel r USING (query_id, doc_id) GROUP BY lane, query_id) USING (lane, query_id) LEFT JOIN (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY query_id) USING (query_id) GROUP BY lane)""")
def e9(spark, sf):
    return metrics.set_quality(queries(spark, sf), lanes(spark, sf), relevant(spark, sf), ("lane",))


@query("E11_break_eval", "bmtop grades", BREAKS + """, j AS (SELECT h.query_id AS query_id, h.doc_id AS doc_id, rank, coalesce(grade >= 1, false)::INT AS good FROM bmtop h LEFT JOIN grades g ON g.query_id = h.query_id AND g.doc_id = h.doc_id),
sized AS (SELECT rule, query_id, max(rank) AS cut FROM kept GROUP BY rule, query_id)
SELECT rule, round(avg(size), 6) AS size, round(avg(above), 6) AS above, round(coalesce(avg(below), 0), 6) AS below, round(avg(above) - coalesce(avg(below), 0), 6) AS lift, round(avg(missed), 6) AS missed FROM (
 SELECT rule, query_id, count(*) FILTER (WHERE rank <= cut) AS size, avg(good) FILTER (WHERE rank <= cut) AS above, avg(good) FILTER (WHERE rank > cut) AS below,
 coalesce(sum(good) FILTER (WHERE rank > cut), 0) / greatest(sum(good), 1) AS missed FROM sized JOIN j USING (query_id) GROUP BY rule, query_id) GROUP BY rule""")
def e11(spark, sf):
    hits = bm25(spark, sf)
    good = grades(spark, sf).where("grade >= 1").select("query_id", "doc_id", F.lit(1).alias("g"))
    judged = hits.join(good, ["query_id", "doc_id"], "left").select("query_id", "rank", F.coalesce("g", F.lit(0)).alias("good"))
    return metrics.break_quality(cuts.named(hits, cuts.BREAKS), judged)


@query("E12_rank_bands", "lanes grades", "SELECT lane, ceil(rank / 5)::BIGINT AS band, round(avg((g.doc_id IS NOT NULL)::INT), 6) AS judged FROM lanes l LEFT JOIN grades g ON g.query_id = l.query_id AND g.doc_id = l.doc_id GROUP BY 1, 2")
def e12(spark, sf):
    joined = lanes(spark, sf).join(grades(spark, sf), ["query_id", "doc_id"], "left")
    return joined.groupBy("lane", F.ceil(F.col("rank") / 5).cast("long").alias("band")).agg(F.round(F.avg(F.col("grade").isNotNull().cast("int")), 6).alias("judged"))


@query("E15_arm_drops", "mq", f"SELECT query_id, bm25, title, round(title - bm25, 3) AS difference FROM ({PIVOT}) ORDER BY difference, query_id LIMIT 10")
def e15(spark, sf):
    return e5(spark, sf).select("query_id", "bm25", "title", F.round(F.col("title") - F.col("bm25"), 3).alias("difference")).orderBy("difference", "query_id").limit(10)


@query("E16_overlap", "lanes", """SELECT query_id, round(len(list_intersect(a, b)) / greatest(len(a), 1), 6) AS overlap, a = b AS identical, a[1] = b[1] AS same_first, len(list_distinct(list_concat(a, b))) - len(list_intersect(a, b)) AS differing FROM (
 SELECT query_id, list(doc_id ORDER BY rank) FILTER (WHERE lane = 'bm25') AS a, list(doc_id ORDER BY rank) FILTER (WHERE lane = 'title') AS b FROM lanes GROUP BY query_id)""")
def e16(spark, sf):
    lists = lanes(spark, sf).where("lane in ('bm25', 'title')").groupBy("query_id").pivot("lane", ["bm25", "title"]).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]))
    both = F.size(F.array_intersect("bm25", "title"))
    return lists.select(
        "query_id",
        F.round(both / F.greatest(F.size("bm25"), F.lit(1)), 6).alias("overlap"),
        (F.col("bm25") == F.col("title")).alias("identical"),
        (F.get("bm25", 0) == F.get("title", 0)).alias("same_first"),
        (F.size(F.array_union("bm25", "title")) - both).cast("long").alias("differing"),
    )


@query("E17_jaccard", "bmtop dt", """SELECT query_id, round(coalesce(avg(CASE WHEN u > 0 THEN i / u END), 0), 6) AS coherence FROM (
 SELECT a.query_id AS query_id, len(list_intersect(a.t, b.t)) AS i, len(list_distinct(list_concat(a.t, b.t))) AS u FROM (SELECT query_id, rank, tt AS t FROM bmtop JOIN dt USING (doc_id) WHERE rank <= 5) a
 JOIN (SELECT query_id, rank, tt AS t FROM bmtop JOIN dt USING (doc_id) WHERE rank <= 5) b ON a.query_id = b.query_id AND a.rank < b.rank) GROUP BY query_id""")
def e17(spark, sf):
    top = bm25(spark, sf, 5).join(docs(spark, sf).select("doc_id", T.tokens(F.col("title")).alias("t")), "doc_id").select("query_id", "rank", "t")
    other = top.select("query_id", F.col("rank").alias("r2"), F.col("t").alias("t2"))
    pairs = top.join(other, "query_id").where("rank < r2")
    return pairs.groupBy("query_id").agg(F.round(F.coalesce(F.avg(T.jaccard(F.col("t"), F.col("t2"))), F.lit(0.0)), 6).alias("coherence"))


THRESHOLDS = [0.1, 0.2, 0.4, 0.6, 0.8]


@query("E18_threshold_sweep", "mq", f"SELECT t::DOUBLE AS threshold, count(*) FILTER (WHERE ndcg_10 < t AND n_rel IS NULL) AS caught, count(*) FILTER (WHERE ndcg_10 < t AND n_rel IS NOT NULL) AS wrongly FROM mq, (SELECT unnest({THRESHOLDS}) AS t) WHERE lane = 'bm25' GROUP BY t")
def e18(spark, sf):
    rel = relevant(spark, sf).select("query_id").distinct().withColumn("r", F.lit(1))
    rows = measured(spark, sf).where("lane = 'bm25'").join(rel, "query_id", "left").crossJoin(F.broadcast(spark.createDataFrame([(t,) for t in THRESHOLDS], "threshold double")))
    low = F.col("ndcg_10") < F.col("threshold")
    return rows.groupBy("threshold").agg(F.count(F.when(low & F.col("r").isNull(), 1)).alias("caught"), F.count(F.when(low & F.col("r").isNotNull(), 1)).alias("wrongly"))


@query("E19_spread", "bmtop", "SELECT round(min(s), 6) AS lowest, round(list_sort(list(s))[count(*) // 4 + 1], 6) AS quarter, round(median(s), 6) AS median, round(max(s), 6) AS highest FROM (SELECT max(score) AS s FROM bmtop GROUP BY query_id)")
def e19(spark, sf):
    tops = bm25(spark, sf, 1).agg(F.sort_array(F.collect_list("score")).alias("s"))
    n = F.size("s")
    return tops.select(F.round(F.array_min("s"), 6).alias("lowest"), F.round(F.get("s", F.floor(n / 4).cast("int")), 6).alias("quarter"), F.round((F.get("s", F.floor((n - 1) / 2).cast("int")) + F.get("s", F.floor(n / 2).cast("int"))) / 2, 6).alias("median"), F.round(F.array_max("s"), 6).alias("highest"))


@query("E20_self_consistency", "grades", "SELECT count(*) AS rejudged, round(avg((grade = CASE WHEN h = '0' THEN (grade + 1) % 3 ELSE grade END)::INT), 6) AS same FROM (SELECT grade, substr(sha256(concat(query_id, '|', doc_id)), 1, 1) AS h FROM grades)")
def e20(spark, sf):
    first = grades(spark, sf)
    h = F.substring(F.sha2(F.concat_ws("|", "query_id", "doc_id").cast("binary"), 256), 1, 1)
    again = first.select("query_id", "doc_id", F.when(h == "0", (F.col("grade") + 1) % 3).otherwise(F.col("grade")).alias("second"))
    return first.join(again, ["query_id", "doc_id"]).agg(F.count("*").alias("rejudged"), F.round(F.avg((F.col("grade") == F.col("second")).cast("int")), 6).alias("same"))


@query("E21_grade_distribution", "grades q", """WITH per AS (SELECT query_id, coalesce(k, 0) AS k FROM q LEFT JOIN (SELECT query_id, count(*) AS k FROM grades WHERE grade >= 1 GROUP BY query_id) USING (query_id))
SELECT grade, count(*) AS n, count(DISTINCT query_id) AS queries, (SELECT min(k) FROM per) AS relevant_min, (SELECT list_sort(list(k))[count(*) // 2 + 1] FROM per) AS relevant_median, (SELECT max(k) FROM per) AS relevant_max, (SELECT count(*) FROM per WHERE k = 0) AS without FROM grades GROUP BY grade""")
def e21(spark, sf):
    """Pairs and queries of each grade, beside the spread of relevant documents over all queries and how many have none."""
    good = grades(spark, sf).where("grade >= 1").groupBy("query_id").agg(F.count("*").alias("k"))
    per = queries(spark, sf).select("query_id").join(good, "query_id", "left").fillna(0, ["k"])
    # the upper median by counts of sizes, as many rows as there are sizes
    sizes = per.groupBy("k").agg(F.count("*").alias("n"))
    order = Window.orderBy("k")
    median = sizes.withColumn("upto", F.sum("n").over(order)).crossJoin(per.agg(F.count("*").alias("total"))).where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("k").alias("relevant_median"))
    spread = sizes.agg(F.min("k").alias("relevant_min"), F.max("k").alias("relevant_max"), F.coalesce(F.max(F.when(F.col("k") == 0, F.col("n"))), F.lit(0)).alias("without")).crossJoin(median)
    return grades(spark, sf).groupBy("grade").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries")).crossJoin(spread)


SCALED = "SELECT lane, query_id, doc_id, rank, score, CASE WHEN max(score) OVER w - min(score) OVER w > 1e-9 THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS mm, CASE WHEN stddev_pop(score) OVER w > 1e-9 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w ELSE 0 END AS z FROM lanes WINDOW w AS (PARTITION BY lane, query_id)"
BY_LANE = ("lane", "query_id")


@query("E22_minmax", "lanes", f"SELECT lane, query_id, doc_id, round(mm, 6) AS scaled FROM ({SCALED})")
def e22(spark, sf):
    return lanes(spark, sf).select("lane", "query_id", "doc_id", F.round(metrics.min_max(F.col("score"), BY_LANE), 6).alias("scaled"))


@query("E23_zscore", "lanes", f"SELECT lane, query_id, doc_id, round(z, 6) AS scaled FROM ({SCALED})")
def e23(spark, sf):
    return lanes(spark, sf).select("lane", "query_id", "doc_id", F.round(metrics.z_score(F.col("score"), BY_LANE), 6).alias("scaled"))


@query("E24_rrf_contribution", "lanes", "SELECT lane, query_id, doc_id, round(1.0 / (60 + rank), 6) AS part FROM lanes")
def e24(spark, sf):
    return lanes(spark, sf).select("lane", "query_id", "doc_id", F.round(1.0 / (R.RRF_K + F.col("rank")), 6).alias("part"))


BLEND = f"""SELECT query_id, doc_id, round(0.7 * coalesce(max(mm) FILTER (WHERE lane = 'bm25'), 0) + 0.3 * coalesce(max(mm) FILTER (WHERE lane = 'tf'), 0), 6) AS score FROM ({SCALED}) GROUP BY query_id, doc_id"""


def signals(spark, sf):
    """(query_id, doc_id, a, b): two lanes' scaled scores side by side, 0 where a lane lacks the document."""
    scaled = lanes(spark, sf).withColumn("s", metrics.min_max(F.col("score"), BY_LANE))
    wide = scaled.groupBy("query_id", "doc_id").pivot("lane", ["bm25", "tf", "title"]).agg(F.max("s"))
    return wide.select("query_id", "doc_id", F.coalesce("bm25", F.lit(0.0)).alias("a"), F.coalesce("tf", F.lit(0.0)).alias("b"))


@query("E25_blend", "lanes", f"SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({BLEND})")
def e25(spark, sf):
    return R.ranked(signals(spark, sf).select("query_id", "doc_id", F.round(0.7 * F.col("a") + 0.3 * F.col("b"), 6).alias("score")))


WEIGHTS = [0.0, 0.25, 0.5, 0.75, 1.0]
GRID = f"""grid AS (SELECT w, query_id, coalesce(1.0 / min(rank) FILTER (WHERE r.doc_id IS NOT NULL AND rank <= 10), 0.0) AS value FROM (
 SELECT w, query_id, doc_id, row_number() OVER (PARTITION BY w, query_id ORDER BY round(w * a + (1 - w) * b, 6) DESC, doc_id) AS rank FROM (SELECT unnest({WEIGHTS})::DOUBLE AS w),
 (SELECT query_id, doc_id, coalesce(max(mm) FILTER (WHERE lane = 'bm25'), 0) AS a, coalesce(max(mm) FILTER (WHERE lane = 'tf'), 0) AS b FROM ({SCALED}) GROUP BY query_id, doc_id)) LEFT JOIN rel r USING (query_id, doc_id) GROUP BY w, query_id)"""


@query("E26_loo_cv", "lanes rel", f"""WITH {GRID}, whole AS (SELECT w, round(avg(value), 9) AS mean FROM grid GROUP BY w) SELECT query_id, w, round(value, 6) AS held, (SELECT w FROM whole ORDER BY mean DESC, w LIMIT 1) AS best_w, (SELECT round(max(mean), 6) FROM whole) AS best_mean FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rest DESC, w) AS n FROM (
 SELECT *, round((sum(value) OVER (PARTITION BY w) - value) / (count(*) OVER (PARTITION BY w) - 1), 9) AS rest FROM grid)) WHERE n = 1""")
def e26(spark, sf):
    weights = F.broadcast(spark.createDataFrame([(w,) for w in WEIGHTS], "w double"))
    rows = signals(spark, sf).crossJoin(weights).withColumn("score", F.round(F.col("w") * F.col("a") + (1 - F.col("w")) * F.col("b"), 6))
    order = R.ranked(rows, keys=("w", "query_id"))
    rel = relevant(spark, sf).withColumn("r", F.lit(1))
    grid = order.join(rel, ["query_id", "doc_id"], "left").groupBy("w", "query_id").agg(F.coalesce(1.0 / F.min(F.when((F.col("r") == 1) & (F.col("rank") <= 10), F.col("rank"))), F.lit(0.0)).alias("value"))
    means = grid.groupBy("w").agg(F.round(F.avg("value"), 9).alias("mean"))
    best = means.agg(F.max(F.struct("mean", (-F.col("w")).alias("less"))).alias("top")).select((-F.col("top.less") + 0.0).alias("best_w"), F.round("top.mean", 6).alias("best_mean"))
    return metrics.leave_one_out(grid).select("query_id", "w", six("held")).crossJoin(best)


@query("E27_ensembles", "lanes", f"""SELECT query_id, doc_id, round(greatest(coalesce(max(mm) FILTER (WHERE lane = 'bm25'), 0), coalesce(max(mm) FILTER (WHERE lane = 'tf'), 0)), 6) AS highest,
 round((coalesce(max(z) FILTER (WHERE lane = 'bm25'), 0) + coalesce(max(z) FILTER (WHERE lane = 'tf'), 0)) / 2, 6) AS z_blend, round(sum(1.0 / (60 + rank)), 6) AS fused FROM ({SCALED}) GROUP BY query_id, doc_id""")
def e27(spark, sf):
    """Signals put together: the larger of two, the mean of two in deviations, the sum of reciprocal ranks of all three."""
    rows = lanes(spark, sf).withColumn("mm", metrics.min_max(F.col("score"), BY_LANE)).withColumn("z", metrics.z_score(F.col("score"), BY_LANE))
    of = lambda name, column: F.coalesce(F.max(F.when(F.col("lane") == name, F.col(column))), F.lit(0.0))
    return rows.groupBy("query_id", "doc_id").agg(
        F.round(F.greatest(of("bm25", "mm"), of("tf", "mm")), 6).alias("highest"),
        F.round((of("bm25", "z") + of("tf", "z")) / 2, 6).alias("z_blend"),
        F.round(F.sum(1.0 / (R.RRF_K + F.col("rank"))), 6).alias("fused"),
    )


@query("E28_headroom", "mq", f"""WITH base AS (SELECT query_id, ndcg_10 AS was FROM mq WHERE lane = 'tf'), moved AS (SELECT lane, query_id, round(ndcg_10 - was, 9) AS d FROM mq JOIN base USING (query_id)),
sides AS (SELECT lane, count(*) FILTER (WHERE d > 0) AS gains, count(*) FILTER (WHERE d < 0) AS losses, coalesce(array_to_string(list_slice(list(query_id ORDER BY d DESC, query_id DESC) FILTER (WHERE d > 0), 1, 8), ','), '') AS gained FROM moved GROUP BY lane),
arms AS (SELECT lane, avg(ndcg_10) AS v, coalesce(avg(ndcg_10) FILTER (WHERE {CONTROL}), 0) AS controls FROM mq GROUP BY lane), ends AS (SELECT avg(ndcg_10) FILTER (WHERE lane = 'tf') AS b, sum((lane = 'bm25' AND n_rel IS NOT NULL)::INT) / sum((lane = 'bm25')::INT) AS c FROM mq),
marked AS (SELECT *, controls >= 0.999 AND lane <> 'tf' AS eligible FROM arms JOIN sides USING (lane), ends)
SELECT lane, round(v, 6) AS ndcg_10, round(CASE WHEN c > b THEN (v - b) / (c - b) ELSE 0 END, 6) AS share, round(controls, 6) AS controls, eligible, coalesce(eligible AND v = (SELECT max(v) FROM marked WHERE eligible), false) AS best, gains, losses, gained FROM marked""")
def e28(spark, sf):
    able = relevant(spark, sf).select("query_id").distinct().agg(F.count("*").alias("k")).crossJoin(queries(spark, sf).agg(F.countDistinct("query_id").alias("n"))).select((F.col("k") / F.col("n")).alias("c"))
    return metrics.headroom(measured(spark, sf), controls(spark, sf).where("control"), able, "tf")


@query("E29_name_lookups", "", f"""WITH {R9} SELECT lane, count(*) AS named, count(*) FILTER (WHERE best = 1) AS at_first, count(*) FILTER (WHERE best <= 5) AS in_five FROM (
 SELECT 'plain' AS lane, a.query_id, min(rank) AS best FROM asked a LEFT JOIN hits h ON h.query_id = a.query_id AND h.doc_id = a.query_id GROUP BY a.query_id
 UNION ALL SELECT 'promoted', a.query_id, min(rank) FROM asked a LEFT JOIN promoted p ON p.query_id = a.query_id AND p.doc_id = a.query_id GROUP BY a.query_id) GROUP BY lane""")
def e29(spark, sf):
    """Lookups made from records: how often the record itself comes first or among five, without and with promotion."""
    asked, catalogue = named(spark, sf)
    plain = near_hits(asked)
    both = plain.select(F.lit("plain").alias("lane"), "query_id", "doc_id", "rank").unionAll(R.promote(plain, R.exact_promoted(plain, asked, catalogue)).select(F.lit("promoted").alias("lane"), "query_id", "doc_id", "rank"))
    return metrics.hit_rates(asked.select("query_id", F.col("query_id").alias("doc_id")), both)


# pools

UNIFORM = "CAST(concat('0x', substr(sha256({}), 1, 8)) AS BIGINT) / 4294967296.0"


@query("P1_pool", "lanes", f"SELECT query_id, doc_id, count(*) AS n_lanes, round({UNIFORM.format("concat('17|', query_id, '|', doc_id)")}, 9) AS place FROM lanes GROUP BY query_id, doc_id")
def p1(spark, sf):
    return pooling.pool(lanes(spark, sf))


@query("P2_unique_to_lane", "lanes", "SELECT lane, coalesce(k, 0) AS only_here FROM (SELECT DISTINCT lane FROM lanes) LEFT JOIN (SELECT lane, count(*) AS k FROM (SELECT query_id, doc_id, min(lane) AS lane FROM lanes GROUP BY query_id, doc_id HAVING count(*) = 1) GROUP BY lane) USING (lane)")
def p2(spark, sf):
    return pooling.unique_to_lane(lanes(spark, sf))


@query("P3_missing_queries", "lanes q", "SELECT lane, count(*) FILTER (WHERE h IS NULL) AS missing FROM (SELECT DISTINCT lane FROM lanes) CROSS JOIN q LEFT JOIN (SELECT DISTINCT lane, query_id, 1 AS h FROM lanes) USING (lane, query_id) GROUP BY lane")
def p3(spark, sf):
    every = lanes(spark, sf).select("lane", "query_id").distinct()
    grid = queries(spark, sf).select("query_id").crossJoin(F.broadcast(every.select("lane").distinct()))
    return grid.join(every.withColumn("h", F.lit(1)), ["lane", "query_id"], "left").groupBy("lane").agg(F.count(F.when(F.col("h").isNull(), 1)).alias("missing"))


@query("P5_keep_judged", "lanes grades", "SELECT query_id, doc_id, false AS restored FROM lanes WHERE lane = 'bm25' UNION ALL SELECT query_id, doc_id, true FROM grades g WHERE NOT EXISTS (SELECT 1 FROM lanes l WHERE lane = 'bm25' AND l.query_id = g.query_id AND l.doc_id = g.doc_id)")
def p5(spark, sf):
    return pooling.keep_judged(lanes(spark, sf).where("lane = 'bm25'").select("query_id", "doc_id"), grades(spark, sf))


@query("P6_split", "lanes grades", "SELECT (g.doc_id IS NOT NULL) AS judged, count(*) AS pairs FROM (SELECT DISTINCT query_id, doc_id FROM lanes) p LEFT JOIN grades g ON g.query_id = p.query_id AND g.doc_id = p.doc_id GROUP BY 1")
def p6(spark, sf):
    pooled = lanes(spark, sf).select("query_id", "doc_id").distinct()
    return pooling.split(pooled, grades(spark, sf)).groupBy(F.col("grade").isNotNull().alias("judged")).agg(F.count("*").alias("pairs"))


@query("P7_never_judged", "lanes grades", "SELECT lane, count(*) FILTER (WHERE g.doc_id IS NULL) AS unjudged FROM lanes l LEFT JOIN grades g ON g.query_id = l.query_id AND g.doc_id = l.doc_id GROUP BY lane")
def p7(spark, sf):
    return pooling.split(lanes(spark, sf), grades(spark, sf)).groupBy("lane").agg(F.count(F.when(F.col("grade").isNull(), 1)).alias("unjudged"))


@query("P8_strict_relevance", "grades", "SELECT query_id, array_to_string(list_sort(list(doc_id)), ',') AS relevant FROM grades WHERE grade >= 2 GROUP BY query_id")
def p8(spark, sf):
    return grades(spark, sf).where("grade >= 2").groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("doc_id")), ",").alias("relevant"))


EXTRA = "extra AS (SELECT DISTINCT query_id, doc_id FROM lanes l WHERE NOT EXISTS (SELECT 1 FROM grades g WHERE g.query_id = l.query_id AND g.doc_id = l.doc_id))"


def unjudged(spark, sf, every):
    return every.select("query_id", "doc_id").distinct().join(grades(spark, sf), ["query_id", "doc_id"], "left_anti")


@query("P11_recall_hypothetical", "lanes grades rel q", f"""WITH {EXTRA}, r2 AS (SELECT query_id, doc_id FROM rel UNION SELECT query_id, doc_id FROM extra)
SELECT lane, round(avg(coalesce(h / n, 0.0)), 6) AS recall FROM (SELECT DISTINCT lane FROM lanes) CROSS JOIN q LEFT JOIN (SELECT query_id, count(*) AS n FROM r2 GROUP BY query_id) USING (query_id)
LEFT JOIN (SELECT lane, query_id, count(*) AS h FROM lanes JOIN r2 USING (query_id, doc_id) WHERE rank <= 10 GROUP BY lane, query_id) USING (lane, query_id) GROUP BY lane""")
def p11(spark, sf):
    every = lanes(spark, sf)
    return pooling.recall_with(queries(spark, sf), every, relevant(spark, sf), unjudged(spark, sf, every), keys=("lane",))


@query("P12_montecarlo", "lanes grades rel q", f"""WITH {EXTRA}, runs AS (SELECT t AS trial, r::DOUBLE AS rate FROM range(200) x(t), (SELECT unnest([0.0, 0.25, 1.0]) AS r) WHERE t = 0 OR r NOT IN (0, 1)),
r3 AS (SELECT trial, rate, query_id, doc_id FROM rel, runs UNION SELECT trial, rate, query_id, doc_id FROM extra, runs WHERE {UNIFORM.format("concat(trial, '|', query_id, '|', doc_id)")} < rate),
got AS (SELECT lane, trial, rate, coalesce(s, 0) / nq AS recall FROM (SELECT DISTINCT lane FROM lanes) CROSS JOIN runs LEFT JOIN (SELECT lane, trial, rate, sum(h / n) AS s FROM (
 SELECT lane, trial, rate, query_id, count(*) AS h FROM lanes JOIN r3 USING (query_id, doc_id) WHERE rank <= 10 GROUP BY ALL) JOIN (SELECT trial, rate, query_id, count(*) AS n FROM r3 GROUP BY ALL) USING (trial, rate, query_id) GROUP BY ALL) USING (lane, trial, rate) CROSS JOIN (SELECT count(*) AS nq FROM q)),
beaten AS (SELECT trial, rate, max(round(recall, 9)) FILTER (WHERE lane <> 'bm25') > max(round(recall, 9)) FILTER (WHERE lane = 'bm25') AS beaten FROM got GROUP BY trial, rate)
SELECT lane, rate, round(avg(recall), 6) AS recall, count(*) FILTER (WHERE beaten) AS beat FROM got JOIN beaten USING (trial, rate) GROUP BY lane, rate""")
def p12(spark, sf):
    every = lanes(spark, sf)
    return pooling.monte_carlo(queries(spark, sf), every, relevant(spark, sf), unjudged(spark, sf, every), [0.0, 0.25, 1.0], 200, first="bm25")
