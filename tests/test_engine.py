"""Operators on small literal frames, against values worked out by hand."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline import cli, session
from plumbline.functions import text as T
from plumbline.functions import vectors as V
from plumbline.operators import catalogue as C
from plumbline.operators import chunking, cuts, enrichment, index, metrics, pooling
from plumbline.operators import ranking as R
from plumbline.sources import files
from plumbline.streaming import ingest as stream


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], names)
    return df.select(column.alias("x")).first()["x"]


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, doc_id string, score double, rank long")


def test_few_splits_are_dealt_out(spark, tmp_path, monkeypatch):
    for name, n in (("wide", 200_000), ("tiny", 100)):
        spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    wide, tiny = (session.table(spark, str(tmp_path), name) for name in ("wide", "tiny"))
    assert wide.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert min(r["count"] for r in wide.groupBy(F.spark_partition_id()).count().collect()) > 5_000
    assert wide.agg(F.sum("id")).first()[0] == sum(range(200_000)) and tiny.rdd.getNumPartitions() == 1
    # a table that is large beside the cores is read as its files are split
    monkeypatch.setattr(session, "MOST_DEALT", 600 << 10)
    plain = session.table(spark, str(tmp_path), "wide")
    assert "Repartition" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_text(spark):
    assert one(spark, T.tokens(F.col("t")), t="The Ship, THAT sank! é2") == ["ship", "sank", "2"]
    assert one(spark, T.sentences(F.col("t")), t="One. Two!  Three") == ["One.", "Two!", "Three"]
    assert one(spark, T.paragraphs(F.col("t")), t=" a\n \n b\n\n") == ["a", "b"]
    assert one(spark, T.estimate_tokens(F.col("t")), t="a b  c\n") == 3
    assert one(spark, T.runs(T.tokens(F.col("t")), 3), t="secret life bees hive") == ["secret life bees", "life bees hive"]
    assert one(spark, T.runs(T.tokens(F.col("t")), 3), t="bees") == []
    assert one(spark, T.stem(F.col("t")), t="gardening") == "garden"
    assert one(spark, T.clean_subjects(F.col("t")), t=["Cats", "cats ", "641.5", "x" * 61, "nyt:top", "Dogs"]) == ["Cats", "Dogs"]
    assert one(spark, T.snippet(F.col("t"), 12), t="alpha beta gamma") == "alpha ..."
    assert one(spark, T.decade(F.col("t")), t="1987") == "1980s"
    assert one(spark, T.record_text(F.lit(""), F.lit("1990"), F.lit(None).cast("string"), F.array(F.lit("a"), F.lit("b"))), t=1) == "Author: [unknown]\nPublished: 1990\nSubjects: a; b"


def test_chunking(spark):
    assert chunking.split("", 10, 2) == []
    text = "\n\n".join(f"p{i} " + "w " * 6 for i in range(6))
    parts = chunking.split(text, 20, 9)
    assert len(parts) > 2 and parts[1].startswith(parts[0].split("\n\n")[-1])
    long = " ".join(f"Sentence number {i} here." for i in range(50))
    assert all(chunking.size(p) <= 20 for p in chunking.split(long, 20, 0))
    df = spark.createDataFrame([(1, "T", text), (2, None, None)], "doc_id int, title string, text string")
    rows = chunking.chunk(df, 20, 9).collect()
    assert [r.chunk_id for r in rows] == [f"1:{i}" for i in range(len(parts))]
    with pytest.raises(ValueError):
        chunking.chunk(df, 10, 10)


def test_bm25(spark):
    docs = spark.createDataFrame([("a", "Yeast", "Yeast makes carbon dioxide in dough."), ("b", "Hastings", "The battle of 1066."), ("c", "", "")], "doc_id string, title string, text string")
    asked = spark.createDataFrame([("1", "carbon dioxide dough"), ("2", "nothing shared"), ("3", "the of")], "query_id string, query string")
    found = R.bm25(asked, docs, 5).collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in found] == [("1", "a", 1)]
    twice = R.bm25(spark.createDataFrame([("1", "carbon"), ("2", "carbon carbon")], "query_id string, query string"), docs, 5)
    score = {r.query_id: r.score for r in twice.collect()}
    assert abs(score["2"] - 2 * score["1"]) < 2e-6


def test_vectors(spark):
    rows = spark.createDataFrame([("d0", [1.0, 0.0, 0.0]), ("d1", [0.0, 1.0, 0.0]), ("d2", [0.6, 0.8, 0.0])], "doc_id string, vector array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, vector array<double>")
    want = [("d0", 1.0, 1), ("d2", 0.6, 2), ("d1", 0.0, 3)]
    assert [(r.doc_id, r.score, r["rank"]) for r in R.cosine(asked, rows, 9).orderBy("rank").collect()] == want
    rng = random.Random(5)
    many = [(f"d{i}", [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(300)]
    asks = many[::7]
    found = R.cosine(spark.createDataFrame(asks, "query_id string, vector array<double>"), spark.createDataFrame(many, "doc_id string, vector array<double>").repartition(3), 6, block=5, chunk=40)
    brute = sorted((q, i, d, s) for q, v in asks for i, (s, d) in enumerate(sorted((round(-sum(a * b for a, b in zip(v, w)), 6), d) for d, w in many)[:6], 1))
    assert sorted((r.query_id, r["rank"], r.doc_id, -r.score) for r in found.collect()) == brute
    assert one(spark, V.normalise(F.array(F.lit(0.0), F.lit(0.0))), t=1) == [0.0, 0.0]
    code = one(spark, V.int8(F.array(F.lit(-0.5), F.lit(0.25))), t=1)
    assert code.codes == [-127, 64]


def test_fusion(spark):
    lane = lambda ids: hits(spark, [("q", d, 1.0, i + 1) for i, d in enumerate(ids)])
    order = lambda *lists: [r.doc_id for r in R.rrf([lane(x) for x in lists]).orderBy("rank").collect()]
    assert order("ab", "cb")[0] == "b"
    assert order("abc", "cba") == ["a", "c", "b"]
    assert R.rrf([lane("a"), lane("a")]).first().score == round(2 / 61, 6)


def test_rerank_keeps_slots(spark):
    ranked = hits(spark, [("q", d, 9.0 - i, i + 1) for i, d in enumerate("abcde")])
    scores = spark.createDataFrame([("q", "a", 0.1), ("q", "c", 0.9), ("q", "e", 5.0)], "query_id string, doc_id string, second double")
    found = R.rerank(ranked, scores, 4).orderBy("rank").collect()
    assert [r.doc_id for r in found] == ["c", "b", "a", "d", "e"]
    assert {r.doc_id: r.score for r in found}["c"] == 7.0


def test_exact_and_promote(spark):
    cat = spark.createDataFrame([("1", "The Secret Life of Bees", "Sue Monk Kidd"), ("2", "The Secret Life of Mermaids", "A B"), ("3", "Joy of Cooking", "Irma Rombauer"), ("4", "Joy of Cooking Today", "Sue Monk Kidd")], "doc_id string, title string, author string")
    asked = spark.createDataFrame([("t", "secret life of bees"), ("a", "books by sue monk kidd"), ("p", "about joy cooking today ok"), ("n", "monk"), ("s", "the of")], "query_id string, query string")
    found = {(r.query_id, r.doc_id): r.reason for r in R.exact_matches(asked, cat).collect()}
    assert found == {("t", "1"): "title", ("a", "1"): "author", ("a", "4"): "author", ("p", "4"): "phrase"}
    ranked = hits(spark, [("a", "2", 0.9, 1), ("a", "4", 0.5, 2)])
    rows = R.promote(ranked, R.exact_matches(asked.where("query_id = 'a'"), cat), 1).orderBy("rank").collect()
    assert [(r.doc_id, r.score, r.reason) for r in rows] == [("1", 0.0, "author"), ("2", 0.9, None), ("4", 0.5, "author")]


def test_collapse_filter_cut_page(spark):
    rows = hits(spark, [("q", str(i), 1.0 - i / 300, i + 1) for i in range(250)]).withColumn("series", F.when(F.col("rank") <= 4, "s").otherwise(F.col("doc_id")))
    first = R.collapse(rows, "series").orderBy("rank").collect()
    assert (first[0].repeats, first[0]["rank"], first[1].doc_id, first[1]["rank"]) == (4, 1, "4", 2)
    page = R.pool_filter_cut_page(rows, F.col("rank") % 2 == 0, page=2).collect()
    assert sorted(r["rank"] for r in page) == list(range(11, 21)) and page[0].total == 20
    late = R.pool_filter_cut_page(rows, F.col("rank") > 195)
    assert late.count() == 5


def test_facets(spark):
    rows = spark.createDataFrame([("1", "eAudiobook", "1987", True, 1, None, "A", "en"), ("2", "Book", "x", False, 0, "event", "A", ""), ("3", "Book", None, None, 2, None, None, "en")], "doc_id string, format string, year string, fiction boolean, available int, record_type string, location string, language string")
    found = {(r.facet_key, r.value): (r["count"], r.value_order) for r in C.facets(rows).collect()}
    assert found[("format", "Book")] == (2, 1) and found[("availability", "Available online")] == (1, 2)
    assert found[("record_type", "Events")] == (1, 2) and ("language", "") not in found and found[("fiction", "Non-fiction")] == (2, 1)
    keep = lambda f: sorted(r.doc_id for r in rows.where(C.matching(rows.columns, f)).collect())
    assert keep({"format": ["Book", "eAudiobook"], "language": ["en"]}) == ["1", "3"]
    assert keep({"nope": ["x"], "format": []}) == ["1", "2", "3"]
    assert one(spark, C.missing_terms(F.col("q"), F.col("t")), q="cycling handbook handbook", t="Cycling") == ["handbook"]


def test_cuts(spark):
    rows = hits(spark, [("q", str(i), s, i + 1) for i, s in enumerate([1.0, 0.95, 0.6, 0.25])] + [("o", "x", 0.1, 1), ("f", "x", 0.5, 1), ("f", "y", 0.5, 2)])
    kept = lambda df: {q: sum(1 for r in df.collect() if r.query_id == q) for q in "qof"}
    assert kept(cuts.largest_gap(rows)) == {"q": 3, "o": 1, "f": 1}  # equal gaps of 0.35: the later one
    assert kept(cuts.relative(rows, 0.9)) == {"q": 2, "o": 1, "f": 2}
    assert kept(cuts.floor(rows, 0.15)) == {"q": 4, "o": 0, "f": 2}
    assert kept(cuts.share_of_spread(rows, 0.5)) == {"q": 2, "o": 1, "f": 2}
    assert kept(cuts.fraction_of_top(rows, 0.98)) == {"q": 1, "o": 1, "f": 2}


def test_metrics(spark):
    asked = spark.createDataFrame([("q",), ("none",), ("empty",)], "query_id string")
    rel = spark.createDataFrame([("q", "a"), ("q", "d"), ("empty", "z")], "query_id string, doc_id string")
    rows = {r.query_id: r for r in metrics.per_query(asked, hits(spark, [("q", "x", 1.0, 1), ("q", "a", 0.5, 2), ("none", "a", 1.0, 1)]), rel).collect()}
    assert rows["q"].recall_5 == 0.5 and rows["q"].mrr_10 == 0.5 and rows["none"].ndcg_10 == 0.0 and rows["empty"].mrr_10 == 0.0
    perfect = metrics.per_query(asked, hits(spark, [("q", "a", 1.0, 1), ("q", "d", 0.5, 2)]), rel).where("query_id = 'q'").first()
    assert abs(perfect.ndcg_10 - 1) < 1e-12
    grid = spark.createDataFrame([(0.0, "a", 1.0), (0.0, "b", 0.0), (1.0, "a", 0.0), (1.0, "b", 1.0)], "w double, query_id string, value double")
    assert {r.query_id: (r.w, r.held) for r in metrics.leave_one_out(grid).collect()} == {"a": (1.0, 0.0), "b": (0.0, 0.0)}


def test_pools(spark):
    lanes = hits(spark, [("q", "a", 1.0, 1), ("q", "b", 0.5, 2)]).withColumn("lane", F.lit("x")).unionByName(hits(spark, [("q", "b", 1.0, 1)]).withColumn("lane", F.lit("y")))
    assert {r.lane: r.only_here for r in pooling.unique_to_lane(lanes).collect()} == {"x": 1, "y": 0}
    graded = spark.createDataFrame([("q", "a", 2), ("q", "gone", 0)], "query_id string, doc_id string, grade int")
    pooled = pooling.pool(lanes)
    assert pooled.count() == 2
    assert {(r.doc_id, r.restored) for r in pooling.keep_judged(pooled, graded).collect()} == {("a", False), ("b", False), ("gone", True)}
    asked = spark.createDataFrame([("q",), ("w",)], "query_id string")
    rel, extra = graded.where("grade > 1"), spark.createDataFrame([("q", "b")], "query_id string, doc_id string")
    found = {(r.lane, r.rate): r.recall for r in pooling.monte_carlo(asked, lanes, rel, extra, [0.0, 1.0], 3).collect()}
    assert found == {("x", 0.0): 0.5, ("y", 0.0): 0.0, ("x", 1.0): 0.5, ("y", 1.0): 0.25}
    assert {r.lane: r.recall for r in pooling.recall_with(asked, lanes, rel, extra, keys=("lane",)).collect()} == {"x": 0.5, "y": 0.25}


def test_enrichment(spark):
    items = spark.createDataFrame([("1", "Bee Keeping Basics", "r"), ("2", "Other Thing Here", "r")], "item_id string, title string, record string")
    made = enrichment.fake(items.where("item_id = '1'"), "v1", "m").withColumn("line", F.lit(0))
    assert [r.item_id for r in enrichment.pending(items, made, "v1", "m").collect()] == ["2"]
    assert enrichment.pending(items, made, "v2", "m").count() == 2
    changed = items.withColumn("record", F.concat("record", F.lit("!")))
    assert enrichment.pending(changed, made, "v1", "m").count() == 2
    docs = spark.createDataFrame([("1", "Bee", "body"), ("2", "x", "body")], "doc_id string, title string, text string")
    texts = {r.doc_id: r.text for r in enrichment.enriched(docs, made, "v1", "m").collect()}
    assert texts["2"] == "body" and texts["1"].startswith("body\n\nBee\n\nWhat is Bee Keeping Basics?\n\nAbout bee")


def corpus_file(path, ids, body="Yeast makes carbon dioxide in dough."):
    path.write_text(json.dumps({"documents": [{"doc_id": i, "title": f"Title {i}", "text": f"{body} {i}"} for i in ids]}))
    return str(path)


def test_sources(spark, tmp_path):
    a, b = corpus_file(tmp_path / "a.json", ["1", "2"]), corpus_file(tmp_path / "b.json", ["2", "3"])
    assert files.corpus(spark, a).count() == 2
    with pytest.raises(ValueError, match="document 2 occurs twice"):
        files.corpus(spark, [a, b])
    assert {r.doc_id: r.text[-1] for r in files.catalogue(spark, [a, b], "doc_id string, text string").collect()} == {"1": "1", "2": "2", "3": "3"}
    (tmp_path / "lines.jsonl").write_text("\n".join(json.dumps({"doc_id": str(i), "title": "T", "text": f"t{i}"}) for i in range(30)))
    assert {r.doc_id: r.text for r in files.corpus(spark, str(tmp_path / "lines.jsonl")).collect()} == {str(i): f"t{i}" for i in range(30)}
    (tmp_path / "list.json").write_text(json.dumps([{"doc_id": "7", "text": "a"}, {"doc_id": "8", "text": "b"}], indent=1))
    assert {r.doc_id: r.text for r in files.corpus(spark, [str(tmp_path / "list.json"), a]).collect()}["8"] == "b"
    (tmp_path / "bare.json").write_text(json.dumps({"documents": [{"doc_id": "7"}]}))
    with pytest.raises(ValueError, match="lacks doc_id or text.*bare.json"):
        files.corpus(spark, str(tmp_path / "bare.json"))
    (tmp_path / "r.json").write_text(json.dumps({"q": ["x", "y", "x"]}))
    files.write_rankings(spark.createDataFrame([("q", "b", 2), ("q", "a", 1), ("p", "c", 1)], "query string, doc_id string, rank long"), str(tmp_path / "ranks"))
    assert sorted((r.query, r.doc_id, r["rank"]) for r in files.rankings(spark, str(tmp_path / "ranks"), "l").collect()) == [("p", "c", 1), ("q", "a", 1), ("q", "b", 2)]
    (tmp_path / "pretty.json").write_text(json.dumps({"q": ["x", "y"]}, indent=2))
    assert files.rankings(spark, str(tmp_path / "pretty.json"), "l").count() == 2
    assert [(r.doc_id, r["rank"]) for r in files.rankings(spark, str(tmp_path / "r.json"), "l").collect()] == [("x", 1), ("y", 2)]


def test_ingest_search_evaluate(spark, tmp_path):
    root = str(tmp_path / "index")
    a = corpus_file(tmp_path / "a.json", ["1", "2"])
    first = cli.ingest(spark, [a], root).first()
    assert (first.documents, first.chunks_embedded, first.chunks_skipped) == (2, 2, 0)
    b = corpus_file(tmp_path / "b.json", ["2", "3"])
    again = cli.ingest(spark, [b], root).first()
    assert (again.chunks_embedded, again.chunks_skipped) == (1, 1)
    assert index.stats(index.load(spark, root)).first().chunk_count == 3
    searcher = cli.Searcher(spark, root)
    asked = spark.createDataFrame([("q", "carbon dioxide 3")], "query_id string, query string")
    assert searcher.search(asked, "keyword", 1).first().document == "3"
    assert searcher.compare(asked, 2).groupBy("mode").count().count() == 3
    with pytest.raises(ValueError):
        searcher.search(asked, "psychic")
    with pytest.raises(index.IndexMismatch):
        cli.Searcher(spark, root, 8).search(asked, "semantic")
    from plumbline.plans import service

    status, body = service.health(searcher)
    assert status == 200 and body["data"]["index"]["chunk_count"] == 3 and body["data"]["modes"] == list(cli.MODES)
    status, body = service.search(searcher, "carbon dioxide 3", "keyword", 1)
    assert status == 200 and [r["document"] for r in body["data"]["results"]] == ["3"]
    assert set(service.compare(searcher, "carbon 3", 2)[1]["data"]["modes"]) == set(cli.MODES)
    assert service.search(searcher, "")[0] == 400 and service.search(searcher, "x" * 1001)[0] == 400 and service.search(searcher, "x", "keyword", 51)[0] == 400
    assert service.search(cli.Searcher(spark, root, 8), "x", "semantic")[0] == 409 and service.health(cli.Searcher(spark, root + "none"))[0] == 409
    records = index.load(spark, root).select("doc_id", "title", "text", F.lit("A").alias("author"), F.lit(None).cast("string").alias("series_id"), F.lit("en").alias("language"))
    status, body = service.search_catalogue(searcher, records, "carbon dioxide 3", "keyword", service.CatalogueRequest(per_page=2))
    assert status == 200 and body["data"]["total"] == 3 and len(body["data"]["results"]) == 2 and {f["value"] for f in body["data"]["facets"] if f["facet_key"] == "language"} == {"en"}
    kept = searcher.terms()
    assert searcher.terms() is kept and kept.where("term = 'carbon'").count() == 3
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"query": "carbon dioxide 3", "relevant_doc_ids": ["3"], "note": ""}]}))
    scores = {r["mode"]: r.mrr_10 for r in cli.evaluate(spark, searcher, str(tmp_path / "q.json")).collect()}
    assert scores["keyword"] == 1.0 and set(scores) == set(cli.MODES)
    index.reset(spark, root)
    with pytest.raises(FileNotFoundError):
        searcher.chunks()


def test_index_survives_failed_and_rival_writes(spark, tmp_path):
    root = str(tmp_path / "index")
    rows = lambda pairs: spark.createDataFrame(pairs, "chunk_id string, text string")
    assert index.save(rows([("a", "1"), ("b", "1")]), root) == 1
    broken = spark.range(4).select(F.col("id").cast("string").alias("chunk_id"), F.raise_error(F.lit("lost")).cast("string").alias("text"))
    for write in (index.save, index.merge):
        with pytest.raises(Exception, match="lost"):
            write(broken, root)
    assert index.versions(spark, root) == [1] and index.load(spark, root).count() == 2
    assert index.merge(rows([("b", "2"), ("c", "2")]), root) == 2
    state = lambda: sorted(map(tuple, index.load(spark, root).collect()))
    assert state() == [("a", "1"), ("b", "2"), ("c", "2")]
    # a writer that died between claim and manifest: its number stays empty
    (tmp_path / "index" / "versions" / "000003.claim").write_text("")
    original = index._published.__defaults__
    index._published.__defaults__ = (0.5,)
    try:
        assert index.merge(rows([("d", "3")]), root) == 4
    finally:
        index._published.__defaults__ = original
    assert state() == [("a", "1"), ("b", "2"), ("c", "2"), ("d", "3")]
    # many small merges: buckets are written anew now and then, old versions and their data go
    for i in range(12):
        index.merge(rows([("d", str(i)), (f"n{i}", "x")]), root)
    assert len(index.versions(spark, root)) == index.KEPT and len(state()) == 16 and ("d", "11") in state()
    writes = {p.name for p in (tmp_path / "index" / "data").iterdir()}
    named = {n for v in index.versions(spark, root) for names in index._manifest(spark, root, v)["buckets"].values() for n in names}
    assert named <= writes and len(writes - named) <= 2


def test_enrichment_store_keeps_the_order_of_its_writes(spark, tmp_path):
    store = str(tmp_path / "store")
    items = spark.createDataFrame([(str(i), f"Title Number {i}", "r") for i in range(40)], "item_id string, title string, record string")
    made = enrichment.fake(items, "v1", "m")
    for synopsis in ("OLD " + "long " * 400, "NEW", "NEWER " + "x" * 3000, "LAST"):
        files.append_enrichments(made.withColumn("synopsis", F.lit(synopsis)).repartition(3), store)
    rows = enrichment.latest(files.enrichments(spark, store)).collect()
    assert len(rows) == 40 and {r.synopsis for r in rows} == {"LAST"}
    # a file from elsewhere: blank lines are skipped, later lines win, whatever their sizes
    line = lambda text: json.dumps({"item_id": "1", "synopsis": text, "prompt_version": "v", "enrichment_model": "m", "source_hash": "h"})
    (tmp_path / "plain.jsonl").write_text(line("first " * 500) + "\n\n" + line("second") + "\n" + line("third " * 900) + "\n  \n" + line("fourth") + "\n")
    assert [r.synopsis for r in enrichment.latest(files.enrichments(spark, str(tmp_path / "plain.jsonl"))).collect()] == ["fourth"]


class Service:
    """A batch service in memory; ``dies``: waiting fails that often."""

    model = "fake-model"

    def __init__(self, dies=0, failing=()):
        self.dies, self.failing, self.sent, self.tried = dies, set(failing), {}, []

    def preflight(self, request):
        self.tried.append(request["custom_id"])
        if self.dies < 0:
            raise ValueError("bad shape")

    def submit(self, requests):
        self.sent[f"b{len(self.sent)}"] = requests
        return f"b{len(self.sent) - 1}"

    def status(self, batch):
        if self.dies > 0:
            self.dies -= 1
            raise ConnectionError("poller died")
        return "ended"

    def results(self, batch):
        for r in reversed(self.sent[batch]):
            ok = r["custom_id"] not in self.failing
            yield {"custom_id": r["custom_id"], "status": "succeeded" if ok else "errored", "recognised": True, "synopsis": "S " + r["custom_id"], "topics": ["t"], "grade": 2 if ok else None, "why": "w"}
        yield {"custom_id": "nobody asked", "status": "succeeded", "synopsis": "x"}


def test_batches_are_never_paid_for_twice(spark, tmp_path):
    from plumbline.operators import batches

    store = str(tmp_path / "store")
    items = spark.createDataFrame([(str(i), f"T{i}", f"r{i}") for i in range(5)], "item_id string, title string, record string")
    service = Service(dies=-1)
    with pytest.raises(ValueError, match="bad shape"):
        batches.enrich(items, store, service, "v1", poll_seconds=0)
    assert not service.sent
    service = Service(dies=1, failing={"3"})
    with pytest.raises(ConnectionError):
        batches.enrich(items, store, service, "v1", size=3, poll_seconds=0)
    done = batches.enrich(items, store, service, "v1", size=3, poll_seconds=0)
    # the batch that was on its way is collected, not sent again
    assert len(service.sent) == 2 and sorted(r["custom_id"] for b in service.sent.values() for r in b) == list("01234")
    assert (done.items, done.succeeded, done.failed, done.skipped) == (5, 4, ["3"], 0)
    again = batches.enrich(items, store, Service(), "v1", poll_seconds=0)
    assert (again.succeeded, again.skipped, again.failed) == (1, 4, [])
    assert {r.item_id: r.synopsis for r in enrichment.latest(files.enrichments(spark, store)).collect()} == {str(i): f"S {i}" for i in range(5)}
    # a record of another prompt is no batch of this one
    batches.InFlight(spark, store).write(batch="b9", model="fake-model", prompt_version="v0")
    assert batches.enrich(items, store, Service(), "v2", poll_seconds=0).succeeded == 5
    assert batches.request("x", "p", "s", "claude-opus-5")["output_config"]["effort"] == "low" and "effort" not in batches.request("x", "p", "s", "claude-haiku-4-5")["output_config"]
    pairs = spark.createDataFrame([("q", str(i), "query", "prose") for i in range(4)], "query_id string, doc_id string, query string, prose string")
    graded, lost = batches.judge(pairs, Service(failing={"q--2"}), size=3, poll_seconds=0)
    assert sorted(map(tuple, graded.collect())) == [("q", d, 2, "w") for d in "013"] and lost == ["q--2"]


def test_odds_and_ends(spark, monkeypatch, tmp_path):
    from plumbline import settings

    monkeypatch.setenv("PLUMBLINE_TEST", " 12 ")
    assert settings.integer("PLUMBLINE_TEST", 3) == 12 and settings.integer("PLUMBLINE_NONE", 3) == 3
    monkeypatch.setenv("PLUMBLINE_TEST", "many")
    with pytest.raises(ValueError, match="PLUMBLINE_TEST"):
        settings.integer("PLUMBLINE_TEST", 3)
    assert one(spark, T.display_date(F.to_date(F.col("t"))), t="2026-03-03") == "Tuesday 3 March 2026"
    assert one(spark, T.url_id(F.col("t")), t=" Bee keeping/ü") == "bee_keeping%2F%C3%BC"
    assert one(spark, T.html_escaped(F.col("t")), t="<a & 'b'>") == "&lt;a &amp; &#x27;b&#x27;&gt;"
    codes = [-127, 0, 1, 127, -1]
    packed = spark.createDataFrame([(codes,), ([],)], "c array<tinyint>").select(V.packed_codes(F.col("c")).alias("p"))
    assert packed.first().p == base64.b64encode(bytes(c & 255 for c in codes)).decode()
    assert [r[0] for r in packed.select(V.unpacked_codes(F.col("p"))).collect()] == [codes, []]
    rows = spark.createDataFrame([("1", "A <b> title", [0.5, -1.0])], "doc_id string, title string, vector array<double>")
    files.export_vectors(rows, str(tmp_path / "bundle"))
    line = spark.read.text(str(tmp_path / "bundle")).first()[0]
    assert "<" not in line and json.loads(line)["title"] == "A <b> title" and base64.b64decode(json.loads(line)["codes"]) == bytes([64, 129])
    judged = spark.createDataFrame([("bees", ["1"], {"1": 2}, "control: x")], "query string, relevant_doc_ids array<string>, grades map<string,int>, note string")
    files.write_queries(judged, str(tmp_path / "eval"), {"judge": "none"})
    back = files.queries(spark, str(tmp_path / "eval")).first()
    assert (back.query, back.relevant_doc_ids, back.grades, back.note) == ("bees", ["1"], {"1": 2}, "control: x")


def test_clear_leaves_nothing(spark):
    from plumbline import tables
    from plumbline.plans import registry

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = registry.queries()["S6_ranking_rows"](spark, "/root/testdata/sf0.001")
    assert found.count() > 0
    made = set(tables._PATHS)
    fs = path(next(iter(made))).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert any(fs.exists(path(p)) for p in made)
    tables.clear(spark)
    assert not tables._PATHS and not any(fs.exists(path(p)) for p in made)


def test_containing(spark):
    from plumbline.operators.matching import containing

    docs = spark.createDataFrame([("1", "abcabc xyz"), ("2", ""), ("3", None), ("4", "Bc"), ("5", "𝔸bc")], "doc_id string, text string")
    needles = spark.createDataFrame([("a", "abc"), ("b", "bc"), ("c", ""), ("d", None), ("e", "bc"), ("f", "c x")], "key string, needle string")
    want = [("a", "1"), ("b", "1"), ("b", "5"), ("e", "1"), ("e", "5"), ("f", "1")]
    for most in (1 << 20, 3):
        assert sorted(map(tuple, containing(docs, needles, most).collect())) == want
    assert containing(docs, needles.limit(0)).count() == 0


def test_streaming_ingest(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "index")
    rows = lambda ids: spark.createDataFrame([(i, f"T{i}", f"Some text {i}.", None) for i in ids], "doc_id string, title string, text string, url string")
    rows("12").coalesce(1).write.parquet(str(source))
    for ids, total in (("", 2), ("13", 3)):
        if ids:
            rows(ids).coalesce(1).write.mode("append").parquet(str(source))
        stream.start(spark, str(source), root, str(tmp_path / "checkpoint")).awaitTermination()
        assert index.load(spark, root).count() == total


def test_providers(spark):
    from plumbline.operators import providers

    rows = spark.createDataFrame([("1", "some text"), ("2", "")], "chunk_id string, embed_text string")
    by_python = {r.chunk_id: r.embedding for r in providers.embed(rows, providers.PROVIDERS["hash"]).collect()}
    by_sql = {r.chunk_id: r.embedding for r in index.embed(rows).collect()}
    assert all(abs(a - b) < 1e-6 for k in by_sql for a, b in zip(by_python[k], by_sql[k]))
    with pytest.raises(ValueError):
        providers.provider("none")
    pairs = spark.createDataFrame([("q", "two words", "a", "two words"), ("q", "two words", "b", "words"), ("q", "two words", "c", None)], "query_id string, query string, doc_id string, prose string")
    overlap = lambda: lambda query, texts: [len(set(query.split()) & set(t.split())) for t in texts]
    assert {r.doc_id: r.second for r in providers.second_scores(pairs, overlap).collect()} == {"a": 2.0, "b": 1.0}


def test_catalogue_search(spark):
    from plumbline.plans import service

    rec = spark.createDataFrame([(str(i), f"Title {i}", "body cycling", "Ann Author" if i == 9 else "", "s" if i in (2, 3) else None, "Book", "en" if i % 2 else "de") for i in range(1, 10)], "doc_id string, title string, text string, author string, series_id string, format string, language string")
    asked = spark.createDataFrame([("q", "by ann author cycling handbook")], "query_id string, query string")
    ranked = hits(spark, [("q", str(i), 1.0 - i / 10, i) for i in range(1, 9)])
    page = service.catalogue_search(asked, ranked, rec, service.CatalogueRequest(per_page=3))
    rows = page.cards.orderBy("rank").collect()
    assert [(r.doc_id, r.reason) for r in rows] == [("9", "author"), ("1", None), ("2", None)]
    assert rows[0].score == 0.0 and rows[2].repeats == 2 and rows[0].total == 8 and rows[1].missing_terms == "ann author handbook"
    counts = {(f.facet_key, f.value): f["count"] for f in page.facets.collect()}
    assert counts[("language", "en")] == 4 and counts[("language", "de")] == 4
    only = service.catalogue_search(asked, ranked, rec, service.CatalogueRequest(blend=False, filters={"language": ["de"]})).cards
    assert sorted(r.doc_id for r in only.collect()) == ["2", "4", "6", "8"]
    with pytest.raises(ValueError):
        service.CatalogueRequest(page=0)


def test_every_sql_has_a_query():
    from plumbline.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) >= 110


def test_nearest_labels_of_every_record(spark):
    from plumbline.plans import rank_queries
    from plumbline.plans.base import vector_queries, vectors

    sf = "/root/testdata/sf0.001"
    every, asked = vectors(spark, sf).collect(), vector_queries(spark, sf).collect()
    heads = {}
    for r in sorted(every, key=lambda r: len(r.doc_id) * 1000000 + int(r.doc_id)):
        heads.setdefault(str(r.label), r.vector)
    want = {}
    for q in asked:
        sims = {label: round(sum(float(a) * float(b) for a, b in zip(q.vector, v)), 6) for label, v in heads.items()}
        for r in every:
            own = [(-sims[s], pos, s) for pos, s in enumerate(str((r.label + k * 3) % 10) for k in range(3)) if s in sims]
            want[q.query_id, r.doc_id] = ",".join(s for _, _, s in sorted(own)[:2])
    found = rank_queries.v11(spark, sf).collect()
    assert len(found) == len(want) == len(every) * len(asked)
    assert {(r.query_id, r.doc_id): r.closest for r in found} == want
