"""The tool surface over a small graph."""

import pytest
from pyspark.sql import functions as F

from grafonda.plans import tools


@pytest.fixture(scope="module")
def kg(spark):
    make = spark.createDataFrame
    return tools.KnowledgeGraph(
        spark,
        make([("p1", "Huế", "u1", "cố đô"), ("p2", "Hà Nội", "u2", "thủ đô")], "page_id string, title string, url string, summary string"),
        make([("c1", "p1", 0, "Huế là cố đô của nhà Nguyễn"), ("c2", "p1", 1, "Sông Hương chảy qua Huế"), ("c3", "p2", 0, "Hà Nội là thủ đô")], "chunk_id string, page_id string, seq int, text string"),
        make([("huế", "Location"), ("hà nội", "Location"), ("nhà nguyễn", "Organization")], "entity string, label string"),
        make([("c1", "huế"), ("c1", "nhà nguyễn"), ("c2", "huế"), ("c3", "hà nội")], "chunk_id string, entity string"),
        make([("p1", "p2")], "src string, dst string"),
        make([("huế", "PART_OF", "việt nam"), ("hà nội", "PART_OF", "việt nam")], "src string, rel_type string, dst string"),
        make([("huế", 0, "miền trung"), ("hà nội", 1, None)], "entity string, community int, summary string"),
    )


def test_search_and_answer(spark, kg):
    q = spark.createDataFrame([("q", "Sông Hương ở Huế"), ("none", "xyz")], "query_id string, question string")
    best = kg.search(q).where("rank = 1").first()
    assert best["doc"] == "c2" and best["title"] == "Huế" and set(best["channel_scores"]) == {"bm25", "graph", "community"}
    got = {r["query_id"]: r for r in kg.answer(q).collect()}
    assert got["q"]["answer"].startswith("Sông Hương") and got["q"]["citations"][0]["chunk_id"] == "c2"
    assert got["none"]["answer"].startswith("Không tìm thấy")


def test_lookups(kg):
    assert kg.explore("việt nam").count() == 2
    assert kg.path("huế", "hà nội").first()["path"] == "huế > việt nam > hà nội"
    assert kg.community("huế").first()["summary"] == "miền trung" and kg.community("hà nội").first()["summary"] == ""
    assert {r["item"]: r["n"] for r in kg.stats().collect()}["chunks"] == 3
    assert kg.entity_types().first()["label"] == "Location"
    assert [r["chunk_id"] for r in kg.trace("c1").collect()] == ["c1", "c2"]
    assert kg.passage("c3").first()["title"] == "Hà Nội"


def test_query_guard(spark, kg):
    kg.chunks.createOrReplaceTempView("kg_chunks")
    rows, more = kg.query("select chunk_id from kg_chunks order by chunk_id", 2)
    assert rows.count() == 2 and more
    for good in ("with x as (select 1 a) select a from x where a = (select max(a) from x)", "select 'create' as status", "values (1), (2)", "select explode(array(1, 2)) as c union all select 3 order by c limit 1"):
        assert tools.is_query(spark, good), good
    for bad in (
        "drop table x", "select 1; select 2", "create table t as select 1", "replace table t as select 1", "cache table t as select 1", "analyze table t compute statistics", "refresh table t", "insert into t select 1",
        "with x as (select 1) insert into t select * from x", "from a insert into b select *", "set x = 1", "show tables", "merge into a using b on a.i = b.i when matched then delete", "", "nonsense",
    ):
        assert not tools.is_query(spark, bad), bad
        with pytest.raises(ValueError):
            kg.query(bad)


def test_embedding_goes_on(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string")
    done = spark.createDataFrame([("a", [9.0])], "chunk_id string, embedding array<float>")
    got = {r["chunk_id"]: r["embedding"] for r in tools.embedded(rows, dim=4, done=done).collect()}
    assert got["a"] == [9.0] and len(got["b"]) == 4


def test_embedding_and_table_function(spark):
    e = spark.createDataFrame([("sông hương",), (None,)], "t string").select(tools.hashed_embedding(8)("t").alias("v")).collect()
    assert len(e[0]["v"]) == 8 and abs(sum(x * x for x in e[0]["v"]) - 1) < 1e-5 and not any(e[1]["v"])
    tools.register_chunker(spark)
    got = spark.sql("select c.section, c.chunk from values ('== A ==\nxin chào', 'T') as t(text, title), lateral structured_chunks(t.text, t.title) c").collect()
    assert [(r["section"], r["chunk"]) for r in got] == [("A", "xin chào")]
