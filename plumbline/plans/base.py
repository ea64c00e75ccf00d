"""The test tables in the roles of the engine's entities, as frames and as SQL.

Documents are the corpus, benchmark passages the queries, a document that contains
a passage is relevant to it, labels give the grades of pooled pairs, and three
keyword lanes are the engines that are compared.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import ranking as R
from plumbline.operators.matching import containing
from plumbline.session import table
from plumbline.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LANES = (("bm25", 1.0), ("tf", None), ("title", 5.0))
DEPTH = 20

#: Catalogue fields of a document, in SQL that both engines read.
RECORD = """doc_id, title, text, source AS author, lang AS language, source AS location, n_chars,
 CASE lang WHEN 'en' THEN 'eAudiobook' WHEN 'de' THEN 'Book' ELSE 'Large print' END AS format,
 CAST(1900 + n_chars % 120 AS STRING) AS year, n_chars % 2 = 0 AS fiction, CAST(n_chars % 4 AS INT) AS available,
 CASE WHEN n_chars % 10 = 0 THEN 'event' END AS record_type,
 CASE WHEN n_chars % 5 = 0 THEN concat(source, '-', lang) END AS series_id"""


def query(name: str, names: str = "", select: str | None = None):
    """Register a query; ``names``: the shared relations that its SQL ``select`` reads."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            # shared relations are made once for each call
            _MADE.clear()
            try:
                return f(spark, sf)
            finally:
                _MADE.clear()

        QUERIES[name] = run
        if select:
            SQL[name] = with_(names.split(), select)
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    # the SQL's blanks, and no more of the text than the title needs
    words = F.split("text", r"[ \t\n\f\r]+", 9)
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.array_join(F.slice(words, 1, 8), " ").alias("title"), "text", "source", "lang", "n_chars")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


def records(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).selectExpr(*split_columns(RECORD))


def split_columns(text: str) -> list[str]:
    """The items of a select list; commas inside brackets don't count."""
    parts, level, start = [], 0, 0
    for i, c in enumerate(text):
        level += (c == "(") - (c == ")")
        if c == "," and not level:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


#: Relations that the query at hand has made.
_MADE: dict[str, DataFrame] = {}


def once(make: Callable[[SparkSession, str], DataFrame]):
    """A relation that one query may name often: made once, as a table of the shared folder."""

    @wraps(make)
    def made(spark: SparkSession, sf: str) -> DataFrame:
        if make.__name__ not in _MADE:
            _MADE[make.__name__] = written(make(spark, sf), make.__name__)
        return _MADE[make.__name__]

    return made


def index(spark: SparkSession, sf: str) -> DataFrame:
    """The postings of the queries' terms, from one pass over the documents."""
    if "index" not in _MADE:
        _MADE["index"] = R.indexed(docs(spark, sf), R.query_terms(queries(spark, sf)))
    return _MADE["index"]


def bm25(spark: SparkSession, sf: str, k: int = DEPTH, weight: float = 1.0) -> DataFrame:
    """(query_id, doc_id, score, rank): a table, as a query may name it often and joins should know how small it is."""
    name = f"bm25-{k}-{weight}"
    if name not in _MADE:
        _MADE[name] = written(R.bm25(queries(spark, sf), docs(spark, sf), k, weight, index(spark, sf)), "bm25")
    return _MADE[name]


@once
def lanes(spark: SparkSession, sf: str) -> DataFrame:
    """(lane, query_id, doc_id, score, rank): the first 20 of each lane."""
    return R.lanes(queries(spark, sf), index(spark, sf), dict(LANES), DEPTH)


@once
def relevant(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, doc_id) where the document contains the passage: the stated query set against all rows."""
    found = containing(docs(spark, sf), queries(spark, sf).select(F.col("query_id").alias("key"), F.col("query").alias("needle")))
    return found.select(F.col("key").alias("query_id"), "doc_id")


@once
def grades(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, doc_id, grade) of pooled pairs that labels judge: 2 contains the passage, 1 good, 0 other."""
    pooled = lanes(spark, sf).select("query_id", "doc_id").distinct()
    labels = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), "quality", "toxic")
    rel = relevant(spark, sf).withColumn("rel", F.lit(1))
    joined = pooled.join(labels, "doc_id").join(rel, ["query_id", "doc_id"], "left")
    return joined.select("query_id", "doc_id", F.when(F.col("rel") == 1, 2).when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0).alias("grade"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 100 asks."""
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tok(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[a-z0-9]+'), lambda t: t NOT IN ({quoted(T.STOPWORDS)}))"


def scored(weight: float) -> str:
    return f"""SELECT query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM (SELECT doc_id, {weight} * len(tt) + len(bt) AS dl FROM dt)
JOIN (SELECT doc_id, term, sum(x) AS tf FROM ttf{'' if weight == 1 else '5'} GROUP BY ALL) USING (doc_id)
JOIN qt USING (term) JOIN df USING (term),
(SELECT avg({weight} * len(tt) + len(bt)) AS avgdl, count(*) AS n FROM dt) GROUP BY query_id, doc_id"""


def top(relation: str, k: int = DEPTH) -> str:
    return f"SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {relation}) WHERE rank <= {k}"


#: Shared relations: what each reads, and its SQL.
RELATIONS = {
    "d": ("", r"SELECT CAST(doc_id AS VARCHAR) AS doc_id, array_to_string(list_slice(regexp_split_to_array(text, '\s+'), 1, 8), ' ') AS title, text, source, lang, n_chars FROM documents"),
    "q": ("", "SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark"),
    "rec": ("d", f"SELECT {RECORD} FROM d"),
    "qt": ("q", f"SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tok('query')}) AS term FROM q) GROUP BY ALL"),
    "dt": ("d", f"SELECT doc_id, {tok('title')} AS tt, {tok('text')} AS bt FROM d"),
    "ttf": ("dt qt", "SELECT * FROM (SELECT doc_id, unnest(tt) AS term, 1.0::DOUBLE AS x FROM dt UNION ALL SELECT doc_id, unnest(bt), 1.0::DOUBLE FROM dt) WHERE term IN (SELECT term FROM qt)"),
    "ttf5": ("dt qt", "SELECT * FROM (SELECT doc_id, unnest(tt) AS term, 5.0::DOUBLE AS x FROM dt UNION ALL SELECT doc_id, unnest(bt), 1.0::DOUBLE FROM dt) WHERE term IN (SELECT term FROM qt)"),
    "df": ("ttf", "SELECT term, count(DISTINCT doc_id) AS df FROM ttf GROUP BY term"),
    "bm": ("ttf df dt qt", scored(1.0)),
    "bm5": ("ttf5 df dt qt", scored(5.0)),
    "tfs": ("ttf dt qt", "SELECT query_id, doc_id, round(sum(times * tf / dl), 6) AS score FROM (SELECT doc_id, term, sum(x) AS tf FROM ttf GROUP BY ALL) JOIN qt USING (term) JOIN (SELECT doc_id, CAST(len(tt) + len(bt) AS DOUBLE) AS dl FROM dt) USING (doc_id) GROUP BY query_id, doc_id"),
    "bmtop": ("bm", top("bm")),
    "lanes": ("bm bm5 tfs", f"SELECT 'bm25' AS lane, * FROM ({top('bm')}) UNION ALL SELECT 'tf', * FROM ({top('tfs')}) UNION ALL SELECT 'title', * FROM ({top('bm5')})"),
    "rel": ("d q", "SELECT query_id, doc_id FROM d JOIN q ON q.query <> '' AND contains(d.text, q.query)"),
    "grades": ("lanes rel", "SELECT p.query_id AS query_id, p.doc_id AS doc_id, CASE WHEN r.doc_id IS NOT NULL THEN 2 WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS grade FROM (SELECT DISTINCT query_id, doc_id FROM lanes) p JOIN (SELECT CAST(doc_id AS VARCHAR) AS doc_id, quality, toxic FROM labels) l ON l.doc_id = p.doc_id LEFT JOIN rel r ON r.query_id = p.query_id AND r.doc_id = p.doc_id"),
    "v": ("", "SELECT CAST(vec_id AS VARCHAR) AS doc_id, embedding AS vector, label FROM embeddings"),
    "vq": ("", "SELECT CAST(vec_id AS VARCHAR) AS query_id, embedding AS vector, label FROM embeddings WHERE vec_id % 100 = 0"),
    "vs": ("v vq", "SELECT query_id, doc_id, round(list_sum(list_transform(list_zip(vq.vector, v.vector), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS score FROM vq, v"),
    "mq": ("lanes rel q", """SELECT lane, query_id, n_rel, coalesce(i5 / n_rel, 0.0) AS recall_5, coalesce(i10 / n_rel, 0.0) AS recall_10, coalesce(1 / f, 0.0) AS mrr_10,
 coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, CAST(least(n_rel, 10) AS BIGINT) + 1) t(i)), 0.0) AS ndcg_10
FROM (SELECT DISTINCT lane FROM lanes) CROSS JOIN q
LEFT JOIN (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY query_id) USING (query_id)
LEFT JOIN (SELECT lane, query_id, count(*) FILTER (WHERE rank <= 5) AS i5, count(*) FILTER (WHERE rank <= 10) AS i10, min(rank) FILTER (WHERE rank <= 10) AS f,
  sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 10) AS dcg FROM lanes JOIN rel USING (query_id, doc_id) GROUP BY lane, query_id) USING (lane, query_id)"""),
}


def with_(names: list[str], select: str) -> str:
    """``select`` after the shared relations it reads, each once and after what it reads itself."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for other in RELATIONS[name][0].split():
                need(other)
            order.append(name)

    for name in names:
        need(name)
    own = ",\n".join(f"{name} AS ({RELATIONS[name][1]})" for name in order)
    if order and select.startswith("WITH "):
        return f"WITH {own},\n{select.removeprefix('WITH ')}"
    return f"WITH {own}\n{select}" if order else select
