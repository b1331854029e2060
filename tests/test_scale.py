"""Plans whose exchanges must not grow with pairs of rows."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grafonda.operators import graph, resolution
from grafonda.plans import catalogue, kg

TABLES = "/root/testdata/sf0.001"


def last_join(spark, name):
    """The join nearest to the result of a query, as the optimizer writes it."""
    plan = catalogue.queries()[name](spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()
    return next(line for line in plan.splitlines() if "Join" in line)


def test_crossed_deals_out_values_with_many_rows(spark):
    left = spark.createDataFrame([("hot", i) for i in range(60)] + [("cold", 1), ("left", 2)], "k string, a int")
    right = spark.createDataFrame([("hot", i) for i in range(40)] + [("cold", 3), ("right", 4)], "k string, b int")
    got = graph.crossed(left, right, "k", tile=8)
    assert Counter(map(tuple, got.select("k", "a", "b").collect())) == Counter([("hot", i, j) for i in range(60) for j in range(40)] + [("cold", 1, 3)])
    assert got.where("k = 'hot'").select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_questions_of_walks_join_nothing_to_pairs(spark):
    assert "_i#" in last_join(spark, "qa_from_walks")


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_answers_of_walks_join_nothing_to_pairs(spark):
    assert "_i#" in last_join(spark, "qa_answers")


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_questions_of_three_chunk_walks_join_nothing_to_pairs(spark):
    assert "_i#" in last_join(spark, "qa_from_walks_3hop")


def test_two_hops_travel_as_bits(spark):
    # a chain of 200 names, all of them centres, and a hub that 70 names share a chunk with
    met = [(f"c{i}", f"e{i + d}") for i in range(200) for d in (0, 1)] + [("hub", f"e{i}") for i in range(0, 140, 2)]
    m, c = spark.createDataFrame(met, "chunk_id string, entity string"), spark.createDataFrame([(f"e{i}",) for i in range(200)] + [("none",), (None,)], "entity string")
    near = {}
    for chunk, e in met:
        for other, f in met:
            if chunk == other and e != f:
                near.setdefault(e, set()).add(f)
    want = {(f"e{i}", 1, f) for i in range(200) for f in near[f"e{i}"]}
    want |= {(f"e{i}", 2, g) for i in range(200) for f in near[f"e{i}"] for g in near[f] - near[f"e{i}"] - {f"e{i}"}}
    got = graph.neighbourhood(c, m, 2).select("centre", "hop", "entity")
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert "bit_or" in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_documents_of_communities_are_drawn_before_questions_meet_them(spark):
    plan = catalogue.queries()["community_channel"](spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number()" in line and "chunk_id" in line and "community" in line]
    assert windows and not any("query_id" in line for line in windows)


def test_names_meet_only_texts_that_hold_what_is_around_a_blank(spark):
    low = {"a": "the old town bridge\nby  the river", "b": "bold town bri", "c": "x 𝒜bc def 𝒜", "d": "abc abc abc abd", "e": "", "f": None}
    names = ["old town bridge", "old town", "town bri", "bridge\nby", "by the", "the river", "𝒜bc def", "abc abd", "abc abc", "c d", "bold", "town", " ", "zzz zzz"]
    chunks = spark.createDataFrame([(k, p, t) for k, t in low.items() for p in ("p", None)] + [("g", "q", "the old town bridge")], "chunk_id string, page_id string, low string")
    on = spark.createDataFrame([("p", n) for n in names] + [(None, "old town"), ("q", "old town")], "page_id string, entity string")
    got = resolution.contained(chunks, on)
    assert Counter(map(tuple, got.collect())) == Counter([(k, n) for k, t in low.items() if t for n in names if n in t] + [("g", "old town")])


def test_pairs_of_blocks_are_those_of_all_rows_of_a_name(spark):
    met = [("hot", f"p{i}", c) for i in range(60) for c in range(1 + i % 3)] + [("cold", f"p{i}", 0) for i in range(3)] + [("one", "p1", 0), ("one", "p1", 1), ("left", "p1", 0), ("left", "p2", 0), (None, "p1", 0)]
    names = spark.createDataFrame([("hot", 60, 3600), ("cold", 3, 9), ("one", 2, 4), ("none", 9, 81)], "entity string, n long, pairs long")
    side = lambda n: F.transform("at", lambda x: F.struct(x["page_id"].alias(f"page{n}"), x["low"].alias(f"low{n}"), x["c"].alias(f"c{n}"), F.lit(n).alias(f"x{n}")))
    got = graph.paired(spark.createDataFrame(met, "entity string, page_id string, c int"), names, {"c": F.max("c")}, side(1), side(2), tile=8)
    want = [(f"p{i}", i % 3, f"p{j}", j % 3) for i in range(60) for j in range(60) if i != j] + [(f"p{i}", 0, f"p{j}", 0) for i in range(3) for j in range(3) if i != j]
    assert Counter(map(tuple, got.select("page1", "c1", "page2", "c2").collect())) == Counter(want)
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def reused(spark, name):
    """What the exchanges that a query reads twice carry, as run."""
    df = catalogue.queries()[name](spark, TABLES)
    df.collect()
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "ReusedExchange" in line]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_passages_are_exchanged_once_for_both_ends_of_walks(spark):
    assert any(" s#" in line for line in reused(spark, "qa_answers"))


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_names_of_chunks_are_exchanged_once_for_both_ends_of_walks(spark):
    assert any(" names#" in line for line in reused(spark, "qa_from_walks_3hop"))


def test_passages_of_chunks_given_more_than_once(spark, tmp_path):
    long, texts = "x" * 300, ["", " ", "   a  b ", None]
    texts += [long + "b", long + "a", "  " + long + "b", "  " + long + "a", " " * 301, " " * 400 + "z", "y" * 299 + "  z", "é" * 299 + " z", "\t" + long]
    rows = [(f"c{a}_{b}", page, 1, None, t) for a in range(len(texts)) for b in range(len(texts)) for page, t in (("p2", texts[a]), ("p2", texts[b]), (None, "null page"))]
    spark.createDataFrame(rows, "chunk_id string, page_id string, seq int, section string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([("p2", "t", None, None, None)], "id string, title string, url string, summary string, crawled_at timestamp").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(r[0], n) for r in rows for n in ("A", " a", "b")] + [("lost", "a")], "chunk_id string, text string").write.parquet(f"{tmp_path}/ner_mentions.parquet")
    got = {r["chunk_id"]: r for r in kg.gathered(spark, str(tmp_path), text=True).collect()}
    want = {r["chunk_id"]: r["s"] for r in kg.chunks(spark, str(tmp_path)).select("chunk_id", F.trim(F.substring(F.trim("text"), 1, 300)).alias("s")).collect()}
    assert {k: r["s"] for k, r in got.items()} == want | {"lost": None}
    assert all(sorted(r["names"]) == (["a"] if k == "lost" else ["a", "b"]) and r["page_id"] == (None if k == "lost" else "p2") for k, r in got.items())
