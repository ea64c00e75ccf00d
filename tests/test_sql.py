"""Queries on small odd tables, against their SQL."""

import random

import duckdb
import pytest

from plumbline.operators import ranking as R
from plumbline.plans import registry

ODD = ["", " ", "\n\nAlpha beta  gamma delta", "one two ", "tab\tend\x0bof line", "İstanbul ΟΔΟΣ ΣΑΣ", None, "plain words that are longer than the eight that a title takes"]


def documents(spark, texts):
    rows = [(i, text, ("en", "de", "fr", "es")[i % 4], f"src{i % 3}", n) for n in (4, 5) for i, text in enumerate(texts, 1000 * n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def both(spark, folder, name, **tables):
    """(rows of the query, rows of its SQL), each in order."""
    base = duckdb.connect()
    for key, table in tables.items():
        table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{key}.parquet")
        base.execute(f"CREATE VIEW {key} AS SELECT * FROM read_parquet('{folder}/{key}.parquet/*.parquet')")
    found = registry.queries()[name](spark, str(folder))
    want = base.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, found.collect()), key=str), sorted(want, key=str)


@pytest.mark.parametrize("name", ["S8_enriched_prose", "T27_enrichment_text", "T28_enriched_docs"])
def test_odd_titles(spark, tmp_path, name):
    found, want = both(spark, tmp_path, name, documents=documents(spark, ODD))
    assert found == want


def most_rows(df) -> int:
    """The most rows that a step of the plan put out."""
    df.collect()
    nodes, most = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            nodes.append(node.plan())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
    return most


def names(spark, n):
    """Parts of two names, each of which has a supplier of three names."""
    part = spark.range(n).selectExpr("id AS p_partkey", "CASE WHEN id % 7 < 4 THEN 'red bolt' ELSE 'hot ring' END AS p_name")
    return part, spark.range(n).selectExpr("id AS s_suppkey", "concat('Supplier#', id % 3) AS s_name")


@pytest.mark.parametrize("name", ["E29_name_lookups", "R9_promote", "R13_promote_within"])
def test_promotion_meets_no_pairs(spark, tmp_path, name):
    part, supplier = names(spark, 400)
    found, want = both(spark, tmp_path, name, part=part, supplier=supplier)
    assert found == want
    # about 200 * 200 + 200 * 133 pairs match
    assert most_rows(registry.queries()[name](spark, str(tmp_path))) < 20_000


def test_exact_matches_of_rules(spark):
    rng = random.Random(3)
    some = lambda low, high, words="abc": " ".join(rng.choice(words) for _ in range(rng.randint(low, high)))
    cat = [(f"d{i}", some(0, 5), some(0, 2), rng.randrange(9)) for i in range(80)]
    cat.append(cat[5])
    cat += [(f"e{i}", "x" + some(2, 3) + "x", "", 0) for i in range(9)]
    asked = [(f"q{i}", some(0, 6)) for i in range(40)] + [("none", None)]

    def rule(query, title, author):
        q, t, a = query.split(), " ".join(title.split()), " ".join(author.split())
        if t and t == " ".join(q):
            return 1
        if a and f" {a} " in f" {' '.join(q)} ":
            return 2
        if t and any(" ".join(q[i : i + 3]) in t for i in range(len(q) - 2)):
            return 3

    words = lambda s: "".join(c if c != "a" else "k" for c in s)  # noqa: E731 (a is a stopword)
    cat, asked = [(d, words(t), words(a), p) for d, t, a, p in cat], [(q, s and words(s)) for q, s in asked]
    want = {(q, d, rule(s, t, a)) for q, s in asked if s for d, t, a, _ in cat if rule(s, t, a)}
    queries = spark.createDataFrame(asked, "query_id string, query string")
    plain = spark.createDataFrame(cat, "doc_id string, title string, author string, pos int")
    hits = spark.createDataFrame([(q, f"d{d}", 1.0, r) for q, _ in asked for r, d in enumerate(rng.sample(range(90), 6), 1)], "query_id string, doc_id string, score double, rank long")
    pairs = lambda df: {(r.query_id, r.doc_id, r.reason_order) for r in df.collect()}
    for catalogue, limit in ((plain, 3), (plain.drop("pos"), 1)):
        every = R.exact_matches(queries, catalogue)
        assert pairs(every) == want and {r for _, _, r in want} == {1, 2, 3}
        ids = {(r.query_id, r.doc_id) for r in hits.collect()}
        assert pairs(R.exact_within(hits, queries, catalogue)) == {x for x in want if x[:2] in ids}
        rows = [sorted(map(tuple, R.promote(hits, m, limit).collect()), key=str) for m in (every.distinct(), R.exact_promoted(hits, queries, catalogue, limit))]
        assert rows[0] == rows[1]


def texts(spark, n, words=("sail", "rope", "mast", "deck", "hull", "keel")):
    rng = random.Random(n)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), ("en", "de", "fr")[i % 3], f"src{i % 4}", 10 + i % 17) for i in range(n)]
    # equal texts have equal scores, so that ids decide
    rows += [(n + i, "sail rope " * 9, "en", "src0", 12) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def passages(spark, n):
    rng = random.Random(7)
    words = ("sail", "rope", "mast", "deck", "hull", "keel", "the", "unheard")
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, ""), (n + 1, None)], "item_id long, text string")


def labels(spark, n):
    return spark.createDataFrame([(i, i % 2, i % 5 == 0) for i in range(0, n, 2)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "CAST(toxic AS INT) AS toxic")


def test_lanes_hand_on_no_pairs(spark, monkeypatch):
    docs = texts(spark, 600).selectExpr("CAST(doc_id AS STRING) AS doc_id", "substr(text, 1, 30) AS title", "text").repartition(2)
    asked = passages(spark, 30).selectExpr("CAST(item_id AS STRING) AS query_id", "text AS query")
    index = R.indexed(docs, R.query_terms(asked))
    make = lambda: R.lanes(asked, index, {"bm25": 1.0, "tf": None, "title": 5.0}, 5)
    # about 600 * 30 pairs share a term; a task hands on 5 * 30 in each lane
    assert most_rows(make()) < 3_000
    once = sorted(map(tuple, make().collect()))
    assert len(once) == 3 * 5 * len({r[1] for r in once})
    # more passes, smaller matrices: the same
    monkeypatch.setattr(R, "BLOCK", 7)
    monkeypatch.setattr(R, "CELLS", 1)
    assert sorted(map(tuple, make().collect())) == once


@pytest.mark.parametrize("name", ["P1_pool", "U2_catalogue_search", "R22_router", "R10_pool_filter_cut_page", "P14_filter_before_after", "E13_arm_measures", "S6_ranking_rows", "E11_break_eval", "E12_rank_bands", "E18_threshold_sweep", "E6_score_rankings", "R12_permutation_guard", "E10_best_strategy", "E26_loo_cv", "E24_rrf_contribution", "E1_recall"])
def test_lanes_as_in_sql(spark, tmp_path, name):
    found, want = both(spark, tmp_path, name, documents=texts(spark, 300), benchmark=passages(spark, 20), labels=labels(spark, 300))
    assert found == want
