"""Graph, retrieval, metric and state operators on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from grafonda.operators import graph, metrics, resolution, retrieval, state
from grafonda.operators.components import connected_components
from grafonda.sources import graph_tables, readers


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_fusion(spark):
    make = lambda *ids: spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(ids)], "query_id string, doc string, rank int")
    fused = {r["doc"]: r for r in retrieval.fuse({"bm25": make("c1", "c2"), "vector": make("c3", "c2"), "graph": make("c1", "c3")}).collect()}
    assert abs(fused["c1"]["score"] - (0.4 / 61 + 0.2 / 61)) < 1e-8
    assert abs(fused["c2"]["score"] - (0.4 / 62 + 0.4 / 62)) < 1e-8
    assert abs(fused["c3"]["score"] - (0.4 / 61 + 0.2 / 62)) < 1e-8
    assert set(fused["c1"]["channel_scores"]) == {"bm25", "graph"}
    twice = spark.createDataFrame([("q", "a", 1), ("q", "a", 3)], "query_id string, doc string, rank int")
    assert abs(retrieval.fuse({"bm25": twice}).first()["score"] - 0.4 / 61) < 1e-8
    assert abs(retrieval.fuse({"bm25": twice}, duplicates="last").first()["score"] - 0.4 / 63) < 1e-8


def test_rerank_keeps_one(spark):
    c = spark.createDataFrame([("q", "a", 0.05), ("q", "b", 0.02), ("r", "a", 0.5), ("r", "b", 0.05)], "query_id string, doc string, s double")
    assert rows(retrieval.rerank(c, F.col("s")), "query_id", "doc") == [("q", "a"), ("r", "a")]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)]
    got = dict(rows(connected_components(spark.createDataFrame(chain, "src long, dst long")), "node", "component"))
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and len(got) == 43
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_shortest_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d")], "src string, dst string")
    got = {r["node"]: (r["length"], r["path"]) for r in graph.shortest_paths(spark.createDataFrame([("a",)], "node string"), e, 3).collect()}
    assert got["d"] == (2, "a > x > d") and got["c"][0] == 2 and got["a"][0] == 0
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    got = {r["node"]: r["length"] for r in graph.shortest_paths(spark.createDataFrame([("a",)], "node string"), e, 9).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert {r["node"] for r in graph.shortest_paths(spark.createDataFrame([("a",)], "node string"), e, 9, "d").collect()} == {"a", "b", "c", "d"}


def test_walks(spark):
    m = spark.createDataFrame([("c1", "e"), ("c2", "e"), ("c3", "e"), ("c4", "e"), ("c1", "f"), ("c1", "g"), ("c4", "g")], "chunk_id string, entity string")
    c = spark.createDataFrame([("c1", "p1"), ("c2", "p1"), ("c3", "p2"), ("c4", "p2")], "chunk_id string, page_id string")
    # one walk for every pair of pages, through the smallest chunks; g is mentioned twice only and leads nowhere
    assert rows(graph.three_hop_walks(m, c), "page1", "entity1", "entity2", "page2", "chunk1", "chunk3") == [("p1", "f", "e", "p2", "c1", "c3"), ("p1", "g", "e", "p2", "c1", "c3"), ("p2", "g", "e", "p1", "c4", "c1")]
    drawn = graph.sampled(m, 3, "chunk_id", "entity")
    assert rows(drawn, "chunk_id", "entity") == rows(graph.sampled(m.repartition(7), 3, "chunk_id", "entity"), "chunk_id", "entity")
    assert graph.shuffled(m, "chunk_id", "entity").count() == 7
    assert rows(graph.broken_walks(m), "entity", "chunk_id") == [("f", "c1")]


def test_label_propagation(spark):
    edges = [("a", "b", 5), ("b", "c", 5), ("a", "c", 5), ("x", "y", 5), ("y", "z", 5), ("x", "z", 5), ("c", "x", 1)]
    labels = dict(rows(graph.label_propagation(spark.createDataFrame(edges, "a string, b string, weight long")), "node", "label"))
    assert labels["a"] == labels["b"] == labels["c"] != labels["x"] == labels["y"] == labels["z"]


def test_metrics(spark):
    d = spark.createDataFrame([(["a", "b", "c"], ["c", "z"])], "r array<string>, g array<string>")
    r = d.select(metrics.reciprocal_rank(F.col("r"), F.col("g")).alias("rr"), metrics.hit(F.col("r"), F.col("g"), 2).alias("h2"), metrics.ndcg(F.col("r"), F.col("g")).alias("n")).first()
    assert abs(r["rr"] - 1 / 3) < 1e-9 and not r["h2"] and 0 < r["n"] < 1
    q = spark.createDataFrame([("Hà Nội là thủ đô", ["hà nội", "Huế"])], "p string, g array<string>")
    r = q.select(metrics.exact_match(F.col("p"), F.col("g")).alias("em"), metrics.token_f1(F.col("p"), F.col("g")).alias("f")).first()
    assert not r["em"] and abs(r["f"] - 2 * (2 / 5) * 1 / (2 / 5 + 1)) < 1e-9
    o = spark.createDataFrame([(['[{"chunk_id": "1"}]', "Error x", '{"chunk_id": "2"}'],), ([],)], "o array<string>")
    got = [x["s"]["score"] for x in o.select(metrics.sufficiency(F.col("o")).alias("s")).collect()]
    assert got == [round(2 / 3 + 0.2, 6), 0.0]


def test_resolution(spark):
    m = spark.createDataFrame([(1, "Hà Nội", "Unknown"), (2, "Ha Noi", "Location"), (3, "Thăng Long", "Unknown"), (4, "Huế", "Unknown"), (5, " ", "Person")], "ord int, name string, type string")
    got = {r["canonical_name"]: r for r in resolution.resolve(m).collect()}
    assert set(got) == {"Hà Nội", "Huế"} and got["Hà Nội"]["entity_type"] == "Location" and got["Hà Nội"]["aliases"] == ["Ha Noi", "Thăng Long"]


def test_bio(spark):
    t = spark.createDataFrame([("d", i, w, g) for i, (w, g) in enumerate([("Lê", "B-PER"), ("Lợi", "I-PER"), ("ở", "O"), ("Huế", "I-LOC"), ("Hà", "B-LOC")])], "doc string, pos int, word string, tag string")
    assert rows(resolution.bio_spans(t), "pos", "name", "type") == [(0, "Lê Lợi", "Person"), (3, "Huế", "Location"), (4, "Hà", "Location")]


def test_rate_limit():
    ok, log = state.allowed([0, 10, 20, 65, 70], 2, 60)
    assert ok == [True, True, False, True, True] and log == [65, 70]


def test_majority(spark):
    a = spark.createDataFrame([("q", 1, "Hà Nội.", 1), ("q", 2, "hà nội", 3), ("q", 3, "Huế", 9), ("r", 1, "Thành phố Huế", 1), ("r", 2, "Thành phố Huế, Việt Nam", 0)], "question_id string, ord int, answer string, citations int")
    assert rows(state.majority(a), "question_id", "answer", "votes") == [("q", "hà nội", 2), ("r", "Thành phố Huế", 2)]


def test_jobs(spark):
    now = dt.datetime(2024, 1, 2, 12)
    j = spark.createDataFrame([("a", "running", now), ("b", "completed", now), ("c", "completed", now - dt.timedelta(days=3))], "job_id string, status string, started_at timestamp")
    got = dict(rows(state.restored(j, F.lit(now)), "job_id", "status"))
    assert got == {"a": "interrupted", "b": "completed"}
    assert rows(state.upserted(j, j.where("job_id = 'a'").withColumn("status", F.lit("x")), "job_id"), "job_id", "status")[0] == ("a", "x")


def test_sources(spark, tmp_path):
    dump = tmp_path / "d.xml"
    dump.write_text("<mediawiki><page><title>Huế</title><ns>0</ns><id>1</id><revision><text bytes='3'>Một thành phố</text></revision></page><page><title>Tập tin:x</title><ns>6</ns><id>2</id><revision><text bytes='1'>y</text></revision></page></mediawiki>")
    assert rows(readers.wiki_dump(spark, str(dump)), "id", "title", "text") == [("1", "Huế", "Một thành phố")]
    assert readers.page_in_dump(spark, str(dump), " tập tin:X ").first()["id"] == "2"
    graph_tables.convert_dump(readers.wiki_dump(spark, str(dump)), str(tmp_path / "clean"), str(tmp_path / "raw"))
    raw = readers.articles(spark, str(tmp_path / "raw"))
    assert raw.first()["url"] == "https://vi.wikipedia.org/wiki/Hu%E1%BA%BF"
    assert readers.article_by_title(raw, "huế").first()["id"] == "1"


def test_graph_build(spark, tmp_path):
    text = "[[Bob Kahn]] and Vint Cerf built the net. " + "Vint Cerf worked with Bob Kahn on many things. " * 8
    a = spark.createDataFrame([("Vint Cerf", "u1", text)], "title string, url string, text string")
    g = graph_tables.build_graph(a)
    assert {r["name"] for r in g["entities"].collect()} >= {"Vint Cerf", "Bob Kahn"}
    assert g["links"].count() == 1 and g["pages"].count() == 2 and g["mentions"].count() >= 2
    graph_tables.write_graph(g, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/chunks")).count() == g["chunks"].count()


def test_qa_round_trip(spark, tmp_path):
    qa = spark.createDataFrame([("1", "Q?", "A", "w", 2, "bridge", ["c"], ["p"])], "id string, question string, answer string, walk_id string, hops int, question_type string, evidence_chunk_ids array<string>, source_pages array<string>")
    graph_tables.write_qa(qa, str(tmp_path / "qa"))
    r = readers.qa_set(spark, str(tmp_path / "qa")).first()
    assert r["metadata"]["evidence_chunk_ids"] == ["c"] and r["question"] == "Q?"


def test_communities_source(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"community_id": "community_00042", "summary": "s"}\n{"community_id": "7"}\n{"community_id": "x"}\n')
    assert rows(readers.community_summaries(spark, str(tmp_path / "c.jsonl")), "community") == [(7,), (42,)]


def test_neighbourhood(spark):
    m = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "b"), ("c2", "c"), ("c3", "c"), ("c3", "d")], "chunk_id string, entity string")
    got = graph.neighbourhood(spark.createDataFrame([("a",), ("zz",)], "entity string"), m, 2)
    assert rows(got, "centre", "hop", "entity") == [("a", 1, "b"), ("a", 2, "c")]
    assert rows(graph.neighbourhood_chunks(got, m, 1), "chunk_id", "n") == [("c2", 2)]


def test_numbered(spark):
    got = graph.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")), "v").collect()
    assert all(r["v"] == r["place"] for r in got) and len(got) == 1000


def test_temporal_and_gold(spark):
    e = spark.createDataFrame([("x", 1, 1990), ("x", 2, 1995), ("x", 3, 1999), ("y", 4, 1990)], "centre string, node int, year int")
    assert rows(graph.temporal_neighbour(e, ">", 1990), "centre", "node") == [("x", 2)]
    assert rows(graph.temporal_neighbour(e, "<", 1999), "centre", "node") == [("x", 2), ("y", 4)]
    r = spark.createDataFrame([("a", "R", "b"), ("b", "S", "c"), ("a", "R", "d")], "src string, rel_type string, dst string")
    assert rows(graph.gold_answers(r, {"two": ("R", "S")}, {"both": "R"}), "reasoning", "entity", "answer") == [("both", "b & d", "a"), ("two", "a", "c")]


def test_vector_search(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8))
    rows_ = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0]), (904, [float("nan")] * 8), (905, [None] + [1.0] * 7)]
    df = spark.createDataFrame(rows_, "doc int, embedding array<float>").repartition(3)
    q = df.where("doc < 5").select(F.col("doc").alias("query_id"), "embedding")
    got = {(r["query_id"], r["rank"]): r["doc"] for r in retrieval.vector_search(q, df, 4).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for i in range(5):
        assert [got[i, r] for r in range(1, 5)] == np.argsort(-(unit @ unit[i]))[:4].tolist()
    assert retrieval.vector_search(q.limit(0), df, 4).count() == 0 and retrieval.vector_search(q, df.limit(0), 4).count() == 0


def test_index_reads_asked_terms(spark):
    docs = spark.createDataFrame([(f"d{i}", f"word{i} common") for i in range(50)], "doc string, text string")
    from grafonda.session import materialise

    index = materialise(retrieval.index_of(docs), "postings", "bucket")
    q = spark.createDataFrame([("q", "word7")], "query_id string, question string")
    hits = retrieval.bm25(q, index, retrieval.corpus_size(docs, F.col("text")))
    assert rows(hits, "doc") == [("d7",)]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters:")[1][:120] and "term" in plan.split("PushedFilters:")[1][:120]


def test_fallback_and_widening(spark):
    a = spark.createDataFrame([("q", "x", 1.0)], "query_id string, doc string, score double")
    b = spark.createDataFrame([("q", "y", 1.0), ("r", "z", 1.0), ("q", "x", 2.0)], "query_id string, doc string, score double")
    assert rows(retrieval.else_from(a, b), "query_id", "doc") == [("q", "x"), ("r", "z")]
    assert rows(retrieval.widen(a, b), "query_id", "doc") == [("q", "x"), ("q", "y"), ("r", "z")]
    import pytest

    assert retrieval.require(a, "doc") is a
    with pytest.raises(ValueError, match="nothing"):
        retrieval.require(a, "nothing")


def test_triples_and_noise(spark):
    t = spark.createDataFrame([("A", "PART_OF", "B", 0.5), ("A", "PART_OF", "B", 0.9), ("A", "PART_OF", "?", 1.0)], "subject string, relation string, object string, confidence double")
    e = spark.createDataFrame([("1", "A"), ("2", "B")], "entity_id string, name string")
    assert rows(resolution.resolved_triples(t, e), "src", "rel_type", "dst", "confidence") == [("1", "PART_OF", "2", 0.9)]
    n = spark.createDataFrame([("x", None), ("12 %", "Unknown"), ("1984", "Work"), ("huế", "Unknown")], "entity string, label string")
    assert rows(resolution.without_noise(n), "entity") == [("1984",), ("huế",)]


def test_backfill(spark):
    c = spark.createDataFrame([("p", 0, "c0", "Bob Kahn came. Then left"), ("p", 1, "c1", "we saw bob kahn"), ("q", 0, "c2", "bob kahn")], "page_id string, seq int, chunk_id string, text string")
    assert ("c1", "Bob Kahn") in rows(resolution.backfilled(c), "chunk_id", "name") and all(r[0] != "c2" for r in rows(resolution.backfilled(c), "chunk_id", "name"))


def test_quality(spark):
    from grafonda.operators import quality

    m = spark.createDataFrame([("12,000 người", ["12000"]), ("Huế", ["cố đô huế"]), ("a, b, c", ["B", "C"]), ("x", ["y"]), ("x", []), (None, ["y"])], "e string, v array<string>")
    assert [r[0] for r in m.select(quality.answer_matches(F.col("e"), F.col("v"))).collect()] == [True, True, True, False, False, False]
    a = spark.createDataFrame([("k", True, False), ("k", False, False), ("k", True, True), ("j", None, True)], "k string, c boolean, f boolean")
    assert rows(quality.accuracy_by(a, "k", F.col("c"), F.col("f")), "k", "n", "errors", "correct", "accuracy") == [("j", 1, 1, 0, 0.0), ("k", 3, 1, 1, 0.5)]
    w = spark.createDataFrame([("một câu hỏi?", "một câu hỏi khác?"), ("một câu hỏi?", "một câu hỏi?"), ("một câu hỏi?", "ngắn"), ("ab", "dài hơn ba lần"), ("x", None)], "o string, r string")
    assert [r[0] for r in w.select(quality.valid_rewrite(F.col("o"), F.col("r"))).collect()] == [True, False, False, False, False]
    s = spark.createDataFrame([("j", 1, "running"), ("j", 2, "cancelling"), ("j", 3, "running"), ("j", 4, "cancelled"), ("j", 5, "failed"), ("k", 1, "failed")], "job string, t int, s string")
    assert rows(quality.job_states(s, "job", "s", [F.col("t")]).fillna("-"), "job", "status", "ignored") == [("j", "cancelled", 2), ("k", "-", 1)]
    assert quality.compiles(spark, "select 1") and not quality.compiles(spark, "select nothing_there") and not quality.compiles(spark, "selec 1")
    assert quality.compile_rate(s, F.col("s") == "failed").first()["compiled"] == 2
    assert spark.range(1).select(quality.token_cost(F.lit(1_000_000), F.lit(500_000)), quality.efficiency(F.lit(0)), quality.efficiency(F.lit(4))).first()[:] == (2.8, 0.0, 0.25)


def test_duplicate_groups(spark):
    from difflib import SequenceMatcher

    from grafonda.operators import quality

    names = sorted({f"{a} {b}" for a in ("lê văn", "lê vân", "trần thị", "công ty") for b in ("an", "ân", "anh", "bình", "binh", "cường")})
    df = spark.createDataFrame([(n, "Person" if i % 2 else "Work") for i, n in enumerate(names)], "name string, label string")
    seen, want = set(), []
    for i, a in enumerate(names):
        if i in seen:
            continue
        group = [j for j in range(i + 1, min(i + 50, len(names))) if j not in seen and SequenceMatcher(None, a, names[j]).ratio() >= 0.85]
        seen.update(group)
        if group:
            seen.add(i)
            want.append((a, 1 + len(group)))
    assert rows(quality.duplicate_groups(df), "canonical", "n") == sorted(want)


def test_sinks(spark, tmp_path):
    g = {"pages": spark.createDataFrame([("p", "T"), ("p", "U")], "page_id string, title string"), "links": spark.createDataFrame([("a", "b"), ("a", None)], "src string, dst string")}
    assert rows(graph_tables.constraint_report(g), "table_name", "n", "keys", "nulls", "unique") == [("links", 2, 2, 1, False), ("pages", 2, 1, 0, False)]
    up = graph_tables.upsert_graph({"pages": g["pages"].limit(1)}, {"pages": spark.createDataFrame([("p", "V"), ("q", "W")], "page_id string, title string"), "links": g["links"]})
    assert rows(up["pages"], "page_id", "title") == [("p", "V"), ("q", "W")] and up["links"].count() == 2
    graph_tables.write_communities(spark.createDataFrame([(42, "s", 3, ["a"])], "community int, summary string, member_count int, top_entities array<string>"), str(tmp_path / "c"))
    assert rows(readers.community_summaries(spark, str(tmp_path / "c")), "community", "summary") == [(42, "s")]
    graph_tables.write_plain(spark.createDataFrame([("1", "Huế", None, "cố đô")], "id string, title string, url string, text string"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t"), wholetext=True).first()[0].startswith("# Huế\nid: 1\nurl: \n\ncố đô")
    p = spark.createDataFrame([("x", "a", "T", "u", 0, "Lê Lợi gặp Nguyễn Trãi.")], "paragraph_id string, article_id string, title string, url string, paragraph_index int, text string")
    made = graph_tables.paragraph_graph(p)
    assert rows(made["entities"], "name") == [("Lê Lợi",), ("Nguyễn Trãi",)] and made["mentions"].count() == 2
    raw = spark.createDataFrame([("2", "HUẾ", "b"), ("1", "Huế", "a")], "id string, title string, text string")
    assert rows(readers.with_raw_text(p.select(F.lit("huế").alias("title")), raw), "raw_text") == [("a",)]
    (tmp_path / "s.json").write_text('{"n": 3}')
    (tmp_path / "bad.json").write_text("[1")
    assert [readers.json_store(spark, str(tmp_path / n), "n int").first()["n"] for n in ("s.json", "bad.json", "none.json")] == [3, None, None]
    v = spark.createDataFrame([([1.0, 2.0],), ([],), (None,)], "embedding array<double>")
    assert graph_tables.vector_dimension(v) == 2
