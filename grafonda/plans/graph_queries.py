"""Graph patterns over the knowledge graph and over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from grafonda.functions import lexicon as L
from grafonda.functions.text import collapse, filled
from grafonda.operators import graph
from grafonda.operators.components import connected_components
from grafonda.plans import kg
from grafonda.plans.kg import community_cte, query, with_kg
from grafonda.session import materialise, table


@query(with_kg("SELECT 'pages' AS item, count(*) AS n FROM pg UNION ALL SELECT 'chunks', count(*) FROM ch UNION ALL SELECT 'entities', count(*) FROM en UNION ALL SELECT 'mentions', count(*) FROM mn UNION ALL SELECT 'links', count(*) FROM lk"))
def graph_stats(spark, sf):
    parts = {"pages": kg.pages, "chunks": kg.chunks, "entities": kg.entities, "mentions": kg.mentions, "links": kg.links}
    rows = [f(spark, sf).agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n") for name, f in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out


@query(with_kg("SELECT label, count(*) AS n FROM en GROUP BY label ORDER BY n DESC, label"))
def entity_type_counts(spark, sf):
    return kg.entities(spark, sf).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


@query(with_kg("SELECT a.entity AS a, b.entity AS b, count(*) AS weight FROM mn a JOIN mn b ON a.chunk_id = b.chunk_id AND a.entity < b.entity GROUP BY 1, 2"))
def cooccurrence(spark, sf):
    return graph.cooccurrence(kg.mentions(spark, sf))


@query("SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS weight FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2")
def cooccurrence_orders(spark, sf):
    m = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity")).distinct()
    return graph.cooccurrence(m, 2)


_PE = "pe AS (SELECT DISTINCT ch.page_id, mn.entity FROM mn JOIN ch ON ch.chunk_id = mn.chunk_id WHERE ch.page_id IS NOT NULL)"


def _page_entity(spark, sf):
    return kg.mentions(spark, sf).join(kg.chunks(spark, sf).select("chunk_id", "page_id"), "chunk_id").where("page_id is not null").select("page_id", "entity").distinct()


@query(with_kg("SELECT a.page_id AS page1, b.page_id AS page2, count(*) AS shared FROM pe a JOIN pe b ON a.entity = b.entity AND a.page_id < b.page_id WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.src = a.page_id AND lk.dst = b.page_id) GROUP BY 1, 2 HAVING count(*) >= 2", _PE))
def link_candidates(spark, sf):
    return graph.link_candidates(_page_entity(spark, sf), kg.links(spark, sf), 2)


_LINK_CANDIDATES = "lc AS (SELECT a.page_id AS page1, b.page_id AS page2, count(*) AS shared FROM pe a JOIN pe b ON a.entity = b.entity AND a.page_id < b.page_id WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.src = a.page_id AND lk.dst = b.page_id) GROUP BY 1, 2 HAVING count(*) >= 2)"


@query(with_kg("""SELECT lp.page_id, pg.title, e.entities, l.linked FROM (SELECT page1 AS page_id FROM lc UNION SELECT page2 FROM lc) lp JOIN pg ON pg.page_id = lp.page_id
  LEFT JOIN (SELECT page_id, array_to_string(list(entity ORDER BY entity)[1:20], ', ') AS entities FROM pe GROUP BY 1) e ON e.page_id = lp.page_id
  LEFT JOIN (SELECT src, array_to_string(list(title ORDER BY title)[1:5], ', ') AS linked FROM (SELECT DISTINCT lk.src, pg.title FROM lk JOIN pg ON pg.page_id = lk.dst) GROUP BY 1) l ON l.src = lp.page_id""", _PE, _LINK_CANDIDATES))
def link_context(spark, sf):
    """Up to 20 entities and 5 linked titles of every page that is in a candidate pair: what a judge of the pair reads."""
    pe, links, pages = materialise(_page_entity(spark, sf), "page_entity"), kg.links(spark, sf), kg.pages(spark, sf)
    pairs = graph.link_candidates(pe, links, 2)
    wanted = pairs.select(F.col("page1").alias("page_id")).union(pairs.select("page2")).distinct()
    ents = pe.groupBy("page_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("entity")), 1, 20), ", ").alias("entities"))
    named = links.join(pages.select(F.col("page_id").alias("dst"), "title"), "dst")
    tos = named.groupBy(F.col("src").alias("page_id")).agg(F.array_join(F.slice(F.array_sort(F.collect_set("title")), 1, 5), ", ").alias("linked"))
    return wanted.join(pages.select("page_id", "title"), "page_id").join(ents, "page_id", "left").join(tos, "page_id", "left").select("page_id", "title", "entities", "linked")


@query(with_kg("SELECT src, dst, 'LINKS_TO' AS rel_type, false AS predicted FROM lk UNION ALL SELECT page1, page2, 'LINKS_TO', true FROM lc WHERE shared >= 3", _PE, _LINK_CANDIDATES))
def link_accept(spark, sf):
    """The links and, as predicted ones, the candidates that a judge accepts; here those with three names in common or more."""
    pairs = graph.link_candidates(_page_entity(spark, sf), kg.links(spark, sf), 2)
    return graph.accepted_links(kg.links(spark, sf), pairs, F.col("shared") >= 3)


_CENTRES = "ce AS (SELECT DISTINCT lower(trim(regexp_replace(canonical_name, '[\\s\\p{Z}]+', ' ', 'g'))) AS entity FROM resolved_entities )"


def _centres(spark, sf):
    """The names of the registry, of every type."""
    return table(spark, sf, "resolved_entities").select(F.lower(collapse(F.col("canonical_name"))).alias("entity")).where("entity <> ''").distinct()


@query(with_kg("SELECT DISTINCT a.entity AS centre, 1 AS hop, b.entity FROM ce JOIN mn a ON a.entity = ce.entity JOIN mn b ON a.chunk_id = b.chunk_id AND a.entity <> b.entity", _CENTRES))
def neighborhood_1hop(spark, sf):
    return graph.neighbourhood(_centres(spark, sf), kg.mentions(spark, sf), 1)


@query(with_kg(
    """, h1 AS (SELECT DISTINCT a.entity AS centre, b.entity FROM ce JOIN mn a ON a.entity = ce.entity JOIN mn b ON a.chunk_id = b.chunk_id AND a.entity <> b.entity),
    pr AS (SELECT DISTINCT a.entity AS x, b.entity AS y FROM mn a JOIN mn b ON a.chunk_id = b.chunk_id AND a.entity <> b.entity)
    SELECT centre, 1 AS hop, entity FROM h1 UNION ALL
    SELECT DISTINCT h1.centre, 2, pr.y FROM h1 JOIN pr ON pr.x = h1.entity WHERE pr.y <> h1.centre AND NOT EXISTS (SELECT 1 FROM h1 z WHERE z.centre = h1.centre AND z.entity = pr.y)""", _CENTRES))
def neighborhood_2hop(spark, sf):
    return graph.neighbourhood(_centres(spark, sf), kg.mentions(spark, sf), 2)


@query(with_kg("""SELECT centre, chunk_id, n, rank FROM (SELECT h.centre, mn.chunk_id, count(*) AS n, row_number() OVER (PARTITION BY h.centre ORDER BY count(*) DESC, mn.chunk_id) AS rank FROM (
  SELECT DISTINCT a.entity AS centre, b.entity FROM ce JOIN mn a ON a.entity = ce.entity JOIN mn b ON a.chunk_id = b.chunk_id AND a.entity <> b.entity) h JOIN mn ON mn.entity = h.entity GROUP BY 1, 2) WHERE rank <= 10""", _CENTRES))
def neighborhood_chunks(spark, sf):
    """The 10 chunks that mention most of a centre's neighbours."""
    m = kg.mentions(spark, sf)
    return graph.neighbourhood_chunks(graph.neighbourhood(_centres(spark, sf), m, 1), m)


_RELATIONS = """rel AS (
  SELECT 'N' || n_nationkey AS src, 'LOCATED_IN' AS rel_type, 'R' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'LOCATED_IN', 'N' || s_nationkey FROM supplier
  UNION ALL SELECT 'C' || c_custkey, 'BORN_IN', 'N' || c_nationkey FROM customer
  UNION ALL SELECT DISTINCT 'P' || l_partkey, 'CREATED_BY', 'S' || l_suppkey FROM lineitem)"""


def _relations(spark, sf):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        table(spark, sf, "nation").select(tag("N", "n_nationkey").alias("src"), F.lit("LOCATED_IN").alias("rel_type"), tag("R", "n_regionkey").alias("dst")),
        table(spark, sf, "supplier").select(tag("S", "s_suppkey").alias("src"), F.lit("LOCATED_IN").alias("rel_type"), tag("N", "s_nationkey").alias("dst")),
        table(spark, sf, "customer").select(tag("C", "c_custkey").alias("src"), F.lit("BORN_IN").alias("rel_type"), tag("N", "c_nationkey").alias("dst")),
        table(spark, sf, "lineitem").select(tag("P", "l_partkey").alias("src"), F.lit("CREATED_BY").alias("rel_type"), tag("S", "l_suppkey").alias("dst")).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("WITH " + _RELATIONS + " SELECT src AS centre, rel_type, dst AS neighbour, true AS forward FROM rel WHERE starts_with(src, 'N') UNION ALL SELECT dst, rel_type, src, false FROM rel WHERE starts_with(dst, 'N')")
def explore_entity(spark, sf):
    centres = table(spark, sf, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("entity"))
    return graph.any_relation(centres, _relations(spark, sf))


@query("WITH RECURSIVE " + _RELATIONS + """, e AS (SELECT src, dst FROM rel UNION SELECT dst, src FROM rel),
  reach AS (SELECT 'R0' AS node, 0 AS length UNION SELECT e.dst, reach.length + 1 FROM reach JOIN e ON e.src = reach.node WHERE reach.length < 4)
  SELECT node, min(length) AS length FROM reach GROUP BY node""")
def shortest_path(spark, sf):
    start = spark.createDataFrame([("R0",)], "node string")
    return graph.shortest_paths(start, _relations(spark, sf), 4).select("node", "length")


_GRAPH_EDGES = """he AS (SELECT DISTINCT src, dst FROM (
  SELECT 'p:' || page_id AS src, 'c:' || chunk_id AS dst FROM ch WHERE page_id IS NOT NULL UNION ALL SELECT 'c:' || chunk_id, 'e:' || entity FROM mn UNION ALL SELECT 'p:' || src, 'p:' || dst FROM lk))"""


def _graph_edges(spark, sf):
    """HAS_CHUNK, MENTIONS and LINKS_TO as one set of edges between tagged nodes."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c))
    ch, mn, lk = kg.chunks(spark, sf).where("page_id is not null"), kg.mentions(spark, sf), kg.links(spark, sf)
    return ch.select(tag("p:", "page_id").alias("src"), tag("c:", "chunk_id").alias("dst")).unionAll(mn.select(tag("c:", "chunk_id"), tag("e:", "entity"))).unionAll(lk.select(tag("p:", "src"), tag("p:", "dst"))).distinct()


@query(with_kg(""", b AS MATERIALIZED (SELECT src, dst FROM he UNION SELECT dst, src FROM he),
  p0 AS (SELECT min('p:' || page_id) AS source FROM ch), v0 AS MATERIALIZED (SELECT source AS node, 0 AS length, source AS path FROM p0),
  v1 AS MATERIALIZED (SELECT b.dst AS node, 1 AS length, min(v0.path || ' > ' || b.dst) AS path FROM v0 JOIN b ON b.src = v0.node WHERE b.dst NOT IN (SELECT node FROM v0) GROUP BY 1),
  s1 AS MATERIALIZED (SELECT * FROM v0 UNION ALL SELECT * FROM v1),
  v2 AS MATERIALIZED (SELECT b.dst AS node, 2 AS length, min(v1.path || ' > ' || b.dst) AS path FROM v1 JOIN b ON b.src = v1.node WHERE b.dst NOT IN (SELECT node FROM s1) GROUP BY 1),
  s2 AS MATERIALIZED (SELECT * FROM s1 UNION ALL SELECT * FROM v2),
  v3 AS MATERIALIZED (SELECT b.dst AS node, 3 AS length, min(v2.path || ' > ' || b.dst) AS path FROM v2 JOIN b ON b.src = v2.node WHERE b.dst NOT IN (SELECT node FROM s2) GROUP BY 1),
  s3 AS MATERIALIZED (SELECT * FROM s2 UNION ALL SELECT * FROM v3),
  v4 AS (SELECT b.dst AS node, 4 AS length, min(v3.path || ' > ' || b.dst) AS path FROM v3 JOIN b ON b.src = v3.node WHERE b.dst NOT IN (SELECT node FROM s3) GROUP BY 1)
  SELECT node, length, path FROM s3 UNION ALL SELECT * FROM v4""", _GRAPH_EDGES))
def shortest_path_graph(spark, sf):
    """Shortest paths over pages, chunks and names of any relation, from the first page, with the path itself."""
    edges = _graph_edges(spark, sf)
    start = kg.chunks(spark, sf).agg(F.min(F.concat(F.lit("p:"), F.col("page_id"))).alias("node"))
    return graph.shortest_paths(start, edges, 4).select("node", "length", "path")


@query("WITH t AS (SELECT src AS page_id FROM (" + with_kg("SELECT * FROM lk") + ")) SELECT page_id, count(*) AS out_degree FROM t GROUP BY page_id ORDER BY out_degree DESC, page_id LIMIT 20")
def degree_top(spark, sf):
    return kg.links(spark, sf).groupBy(F.col("src").alias("page_id")).agg(F.count("*").alias("out_degree")).orderBy(F.desc("out_degree"), "page_id").limit(20)


@query(with_kg("SELECT pg.page_id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM pg LEFT JOIN (SELECT src, count(*) AS n FROM lk GROUP BY 1) o ON o.src = pg.page_id LEFT JOIN (SELECT dst, count(*) AS n FROM lk GROUP BY 1) i ON i.dst = pg.page_id"))
def degrees(spark, sf):
    links = kg.links(spark, sf)
    both = links.select(F.col("src").alias("page_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(links.select("dst", F.lit(0), F.lit(1)))
    summed = both.groupBy("page_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return kg.pages(spark, sf).select("page_id").join(summed, "page_id", "left").fillna(0, ["out_degree", "in_degree"])


@query(with_kg("SELECT DISTINCT a.src AS page1, b.dst AS page2 FROM lk a JOIN lk b ON a.dst = b.src WHERE a.src <> b.dst"))
def two_step_reach(spark, sf):
    links = kg.links(spark, sf)
    return links.select(F.col("src").alias("page1"), F.col("dst").alias("m")).join(links.select(F.col("src").alias("m"), F.col("dst").alias("page2")), "m").where("page1 <> page2").select("page1", "page2").distinct()


@query(with_kg("SELECT page_id, n FROM (SELECT ch.page_id, count(DISTINCT mn.entity) AS n FROM mn JOIN ch ON ch.chunk_id = mn.chunk_id WHERE ch.page_id IS NOT NULL GROUP BY 1) ORDER BY n DESC, page_id LIMIT 10"))
def page_argmax(spark, sf):
    return _page_entity(spark, sf).groupBy("page_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "page_id").limit(10)


@query(with_kg("SELECT 'chunks without page' AS check_name, count(*) AS n FROM ch WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.page_id = ch.page_id) UNION ALL SELECT 'mentions without chunk', count(*) FROM mn WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.chunk_id = mn.chunk_id) UNION ALL SELECT 'chunks without mention', count(*) FROM ch WHERE NOT EXISTS (SELECT 1 FROM mn WHERE mn.chunk_id = ch.chunk_id)"))
def orphan_check(spark, sf):
    ch, mn, pg = kg.chunks(spark, sf).select("chunk_id", "page_id"), kg.mentions(spark, sf), kg.pages(spark, sf)
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n")
    return (
        count(ch.join(pg, "page_id", "left_anti"), "chunks without page")
        .unionAll(count(mn.join(ch, "chunk_id", "left_anti"), "mentions without chunk"))
        .unionAll(count(ch.join(mn, "chunk_id", "left_anti"), "chunks without mention"))
    )


@query("""SELECT count(*) AS n_rows, count(DISTINCT chunk_id) AS chunks, count(*) FILTER (WHERE len(embedding) = 64) AS embedded, round(count(*) FILTER (WHERE len(embedding) = 64) * 1.0 / count(*), 6) AS coverage, count(*) FILTER (WHERE len(embedding) = 64) >= 0.95 * count(*) AS enough FROM chunks""")
def ingest_verify(spark, sf):
    df = table(spark, sf, "chunks")
    n = F.count_if(F.size("embedding") == 64)
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct("chunk_id").alias("chunks"), n.alias("embedded"), F.round(n / F.count("*"), 6).alias("coverage"), (n >= 0.95 * F.count("*")).alias("enough"))


@query(with_kg("""SELECT c.chunk_id, pg.title, pg.url, s.chunk_id AS sibling_id, s.seq AS sibling_seq FROM ch c LEFT JOIN pg ON pg.page_id = c.page_id LEFT JOIN ch s ON s.page_id = c.page_id AND s.chunk_id <> c.chunk_id AND abs(s.seq - c.seq) <= 1"""))
def source_trace(spark, sf):
    """Every chunk with its page and the chunks next to it; the band is met through its three sequence numbers, not by comparing."""
    ch = kg.chunks(spark, sf).select("chunk_id", "page_id", "seq")
    near = ch.select(F.col("chunk_id").alias("sibling_id"), "page_id", F.col("seq").alias("sibling_seq"), F.explode(F.array(F.col("seq") - 1, F.col("seq"), F.col("seq") + 1)).alias("seq"))
    left = ch.join(near, ["page_id", "seq"], "left").where("sibling_id is null or sibling_id <> chunk_id")
    # a chunk whose only neighbour in the band is itself keeps a row without a sibling
    alone = ch.join(left.select("chunk_id"), "chunk_id", "left_anti").withColumns({"sibling_id": F.lit(None).cast("string"), "sibling_seq": F.lit(None).cast("int")})
    full = left.select("chunk_id", "page_id", "sibling_id", "sibling_seq").unionByName(alone.select("chunk_id", "page_id", "sibling_id", "sibling_seq"))
    return full.join(kg.pages(spark, sf).select("page_id", "title", "url"), "page_id", "left").select("chunk_id", "title", "url", "sibling_id", "sibling_seq")


@query(with_kg("SELECT a.page_id AS page1, a.entity, b.page_id AS page2, a.chunk AS chunk1, b.chunk AS chunk2 FROM pc a JOIN pc b ON a.entity = b.entity AND a.page_id <> b.page_id", "pc AS (SELECT ch.page_id, mn.entity, min(mn.chunk_id) AS chunk FROM mn JOIN ch ON ch.chunk_id = mn.chunk_id WHERE ch.page_id IS NOT NULL GROUP BY 1, 2)"))
def walks_2hop(spark, sf):
    return graph.two_hop_walks(kg.mentions(spark, sf), kg.chunks(spark, sf).where("page_id is not null"))


_WALKS3 = (
    "w3a AS MATERIALIZED (SELECT ch.page_id AS page1, a.entity AS entity1, b.entity AS entity2, min(a.chunk_id) AS chunk1 FROM mn a JOIN ch ON ch.chunk_id = a.chunk_id JOIN mn b ON b.chunk_id = a.chunk_id AND b.entity <> a.entity WHERE ch.page_id IS NOT NULL GROUP BY 1, 2, 3)",
    "w3 AS (SELECT w.page1, w.entity1, w.entity2, ch.page_id AS page2, min(w.chunk1) AS chunk1, min(c.chunk_id) AS chunk3 FROM w3a w JOIN mn c ON c.entity = w.entity2 JOIN ch ON ch.chunk_id = c.chunk_id WHERE ch.page_id <> w.page1 AND w.entity2 IN (SELECT entity FROM mn GROUP BY 1 HAVING count(*) >= 3) GROUP BY 1, 2, 3, 4)",
)


@query(with_kg("SELECT * FROM w3", *_WALKS3))
def walks_3hop(spark, sf):
    return graph.three_hop_walks(kg.mentions(spark, sf), kg.chunks(spark, sf).where("page_id is not null"))


@query(with_kg("SELECT page1, entity1, entity2, page2 FROM w3 ORDER BY md5(page1 || '|' || entity1 || '|' || entity2 || '|' || page2), page1, entity1, entity2, page2 LIMIT 3000", *_WALKS3))
def walks_3hop_sample(spark, sf):
    """The walks as the generator draws them: 3000, the same on every plan."""
    key = ("page1", "entity1", "entity2", "page2")
    return graph.sampled(graph.three_hop_walks(kg.mentions(spark, sf), kg.chunks(spark, sf).where("page_id is not null")).select(*key), 3000, *key)


@query(with_kg("SELECT entity, chunk_id FROM (SELECT entity, min(chunk_id) AS chunk_id FROM mn GROUP BY entity HAVING count(*) = 1) ORDER BY md5(entity), entity"))
def walks_broken_shuffled(spark, sf):
    return graph.shuffled(graph.broken_walks(kg.mentions(spark, sf)), "entity")


_PICK3 = "[" + ", ".join("'" + q + "'" for q in L.THREE_HOP_QUESTIONS) + "][(('0x' || substr(md5(walk_key), 1, 6))::BIGINT % 3) + 1]"


@query(with_kg("SELECT walk_key, replace(replace(replace(replace(" + _PICK3 + ", '{entity1}', entity1), '{entity2}', entity2), '{page1}', t1), '{page2}', t2) AS question FROM (SELECT w3.page1 || '|' || entity1 || '|' || entity2 || '|' || w3.page2 AS walk_key, entity1, entity2, a.title AS t1, b.title AS t2 FROM w3 JOIN pg a ON a.page_id = w3.page1 JOIN pg b ON b.page_id = w3.page2)", *_WALKS3))
def qa_from_walks_3hop(spark, sf):
    """A question for every three-chunk walk, its template drawn by the digest of the walk's key and filled as far as the first page goes before pages meet."""
    chunks = materialise(kg.gathered(spark, sf).drop("chunk_id"), "gathered")
    rows = chunks.where("page_id is not null").select(F.explode("names").alias("entity"), "page_id", "title", "names")
    # of a name: all chunks that mention it, those with a page, and how many other names these mention
    counts = F.count("*").alias("deg"), F.count("page_id").alias("n"), F.sum(F.when(F.col("page_id").isNotNull(), F.size("names") - 1)).alias("others")
    counted = chunks.select(F.explode("names").alias("entity"), "page_id", "names").groupBy("entity").agg(*counts).where("deg >= 3 and n > 1")
    names = materialise(counted.select("entity", "n", (F.col("n") * F.col("others")).alias("pairs")), "names")
    once = {"title": F.min("title"), "names": F.array_distinct(F.flatten(F.collect_list("names")))}
    templates = F.array(*map(F.lit, L.THREE_HOP_QUESTIONS))

    def begins(x):
        asked = lambda e: F.transform(templates, lambda t: filled(t, entity1=e, entity2=F.col("entity"), page1=x["title"]))
        walk = lambda e: F.struct(x["page_id"].alias("page1"), x["low"].alias("low1"), F.concat(x["page_id"], F.lit("|"), e, F.lit("|"), F.col("entity"), F.lit("|")).alias("key"), asked(e).alias("asked"))
        return F.transform(F.filter(x["names"], lambda e: e != F.col("entity")), walk)

    right = F.transform("at", lambda x: F.struct(x["page_id"].alias("page2"), x["low"].alias("low2"), x["title"].alias("t2")))
    key = F.concat("key", "page2")
    pick = F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("bigint") % len(L.THREE_HOP_QUESTIONS)
    return graph.paired(rows, names, once, F.flatten(F.transform("at", begins)), right, 1024).select(key.alias("walk_key"), filled(F.get("asked", pick.cast("int")), page2=F.col("t2")).alias("question"))


@query(with_kg("SELECT entity, min(chunk_id) AS chunk_id FROM mn GROUP BY entity HAVING count(*) = 1"))
def walks_broken(spark, sf):
    return graph.broken_walks(kg.mentions(spark, sf))


def _walk_questions(spark, sf, text=False):
    """Walks with their question and, if asked for, answer: all that a page tells of a name travels with it, and templates are filled as far as one page goes before pages meet."""
    once = {"r": F.min(F.struct("chunk_id", "title", *(["s"] if text else [])))}
    chunks = materialise(kg.gathered(spark, sf, text).where("page_id is not null"), "gathered")
    rows = chunks.select(F.explode("names").alias("entity"), "page_id", "chunk_id", "title", *(["s"] if text else []))
    counted = rows.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").withColumn("pairs", F.col("n") * F.col("n"))
    kinds = F.create_map(*[x for k, v in L.TWO_HOP_QUESTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    options = F.coalesce(F.try_element_at(kinds, F.col("label")), F.array(*map(F.lit, L.TWO_HOP_QUESTIONS["Person"])))
    names = materialise(counted.join(kg.entities(spark, sf), "entity").withColumn("options", options).drop("label"), "names")
    passage = lambda x: [F.concat(x["r"]["s"], F.lit(" ")).alias("s1")] if text else []
    left = F.transform("at", lambda x: F.struct(x["page_id"].alias("page1"), x["low"].alias("low1"), F.concat(x["page_id"], F.lit("|"), F.col("entity"), F.lit("|")).alias("key"), F.transform("options", lambda t: filled(t, entity=F.col("entity"), page1=x["r"]["title"])).alias("asked"), *passage(x)))
    right = F.transform("at", lambda x: F.struct(x["page_id"].alias("page2"), x["low"].alias("low2"), x["r"]["title"].alias("t2"), *([x["r"]["s"].alias("s2")] if text else [])))
    key = F.concat("key", "page2")
    pick = F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("bigint") % F.size("asked")
    answer = [F.concat("s1", "s2").alias("answer")] if text else []
    return graph.paired(rows, names, once, left, right).select(key.alias("walk_key"), filled(F.get("asked", pick.cast("int")), page2=F.col("t2")).alias("question"), *answer)


def _case_templates() -> str:
    lit = lambda v: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in v) + "]"
    return "CASE label " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in L.TWO_HOP_QUESTIONS.items()) + f" ELSE {lit(L.TWO_HOP_QUESTIONS['Person'])} END"


_QUESTIONS = (
    "pc AS (SELECT ch.page_id, mn.entity, min(mn.chunk_id) AS chunk FROM mn JOIN ch ON ch.chunk_id = mn.chunk_id WHERE ch.page_id IS NOT NULL GROUP BY 1, 2)",
    "wq AS (SELECT a.page_id || '|' || a.entity || '|' || b.page_id AS walk_key, a.entity, p1.title AS t1, p2.title AS t2, a.chunk AS chunk1, b.chunk AS chunk2, " + _case_templates() + " AS options FROM pc a JOIN pc b ON a.entity = b.entity AND a.page_id <> b.page_id JOIN pg p1 ON p1.page_id = a.page_id JOIN pg p2 ON p2.page_id = b.page_id JOIN en ON en.entity = a.entity)",
    "wqq AS (SELECT walk_key, chunk1, chunk2, replace(replace(replace(options[(('0x' || substr(md5(walk_key), 1, 6))::BIGINT % len(options)) + 1], '{entity}', entity), '{page1}', t1), '{page2}', t2) AS question FROM wq)",
)


@query(with_kg("SELECT walk_key, question FROM wqq", *_QUESTIONS))
def qa_from_walks(spark, sf):
    return _walk_questions(spark, sf)


@query(with_kg("SELECT walk_key, question, trim(substr(trim(a.text), 1, 300)) || ' ' || trim(substr(trim(b.text), 1, 300)) AS answer FROM wqq JOIN ch a ON a.chunk_id = chunk1 JOIN ch b ON b.chunk_id = chunk2", *_QUESTIONS))
def qa_answers(spark, sf):
    return _walk_questions(spark, sf, text=True)


@query(with_kg("SELECT entity, replace(replace(replace(['" + "', '".join(L.UNANSWERABLE_QUESTIONS) + "'][(('0x' || substr(md5(entity), 1, 6))::BIGINT % 3) + 1], '{page1}', pg.title), '{fake_page}', replace('" + L.FAKE_PAGE + "', '{entity}', entity)), '{entity}', entity) AS question, '" + L.NO_ANSWER + "' AS answer FROM (SELECT entity, min(chunk_id) AS chunk_id FROM mn GROUP BY entity HAVING count(*) = 1) w JOIN ch ON ch.chunk_id = w.chunk_id JOIN pg ON pg.page_id = ch.page_id"))
def qa_unanswerable(spark, sf):
    walks = graph.broken_walks(kg.mentions(spark, sf)).join(kg.chunks(spark, sf).select("chunk_id", "page_id"), "chunk_id").join(kg.pages(spark, sf).select("page_id", "title"), "page_id")
    pick = F.conv(F.substring(F.md5("entity"), 1, 6), 16, 10).cast("bigint") % 3
    template = F.get(F.array(*map(F.lit, L.UNANSWERABLE_QUESTIONS)), pick.cast("int"))
    fake = F.replace(F.lit(L.FAKE_PAGE), F.lit("{entity}"), F.col("entity"))
    return walks.select("entity", filled(template, page1=F.col("title"), fake_page=fake, entity=F.col("entity")).alias("question"), F.lit(L.NO_ANSWER).alias("answer"))


@query("WITH " + _RELATIONS + " SELECT a.src AS a, b.dst AS c FROM rel a JOIN rel b ON a.dst = b.src WHERE a.rel_type = 'BORN_IN' AND b.rel_type = 'LOCATED_IN'")
def gold_bridge_2hop(spark, sf):
    r = _relations(spark, sf)
    one, two = r.where("rel_type = 'BORN_IN'").select(F.col("src").alias("a"), F.col("dst").alias("m")), r.where("rel_type = 'LOCATED_IN'").select(F.col("src").alias("m"), F.col("dst").alias("c"))
    return one.join(two, "m").select("a", "c")


@query("WITH " + _RELATIONS + " SELECT DISTINCT a.src AS a, c.dst AS d FROM rel a JOIN rel b ON a.dst = b.src JOIN rel c ON b.dst = c.src WHERE a.rel_type = 'CREATED_BY' AND b.rel_type = 'LOCATED_IN' AND c.rel_type = 'LOCATED_IN'")
def gold_bridge_3hop(spark, sf):
    r = _relations(spark, sf)
    located = r.where("rel_type = 'LOCATED_IN'")
    one = r.where("rel_type = 'CREATED_BY'").select(F.col("src").alias("a"), F.col("dst").alias("m"))
    return one.join(located.select(F.col("src").alias("m"), F.col("dst").alias("n")), "m").join(located.select(F.col("src").alias("n"), F.col("dst").alias("d")), "n").select("a", "d").distinct()


@query("SELECT a.l_suppkey AS x, b.l_suppkey AS y, count(DISTINCT a.l_partkey) AS common FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")
def gold_intersection(spark, sf):
    ps = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return ps.select(F.col("l_suppkey").alias("x"), "l_partkey").join(ps.select(F.col("l_suppkey").alias("y"), "l_partkey"), "l_partkey").where("x < y").groupBy("x", "y").agg(F.count("*").alias("common"))


@query("""SELECT centre, op, node AS answer, year FROM (
  SELECT o_custkey AS centre, op, o_orderkey AS node, year(o_orderdate) AS year, row_number() OVER (PARTITION BY o_custkey, op ORDER BY CASE WHEN op IN ('>', '>=') THEN year(o_orderdate) ELSE -year(o_orderdate) END, o_orderkey) AS r
  FROM orders, unnest(['>', '>=', '<', '<=', '=']) AS u(op)
  WHERE CASE op WHEN '>' THEN year(o_orderdate) > 1996 WHEN '>=' THEN year(o_orderdate) >= 1996 WHEN '<' THEN year(o_orderdate) < 1996 WHEN '<=' THEN year(o_orderdate) <= 1996 ELSE year(o_orderdate) = 1996 END) WHERE r = 1""")
def gold_temporal(spark, sf):
    """The event next to 1996 of every customer, for each way to compare years."""
    events = table(spark, sf, "orders").select(F.col("o_custkey").alias("centre"), F.col("o_orderkey").alias("node"), F.year("o_orderdate").alias("year"))
    out = None
    for op in (">", ">=", "<", "<=", "="):
        rows = graph.temporal_neighbour(events, op, 1996).select("centre", F.lit(op).alias("op"), F.col("node").alias("answer"), "year")
        out = rows if out is None else out.unionAll(rows)
    return out


@query("WITH " + _RELATIONS + """, k AS (SELECT * FROM (VALUES ('bridge_2hop', 'BORN_IN,LOCATED_IN'), ('bridge_3hop', 'CREATED_BY,LOCATED_IN,LOCATED_IN')) AS t(reasoning, path))
  SELECT k.reasoning, a.src AS entity, b.dst AS answer FROM k JOIN rel a ON a.rel_type = 'BORN_IN' JOIN rel b ON b.src = a.dst AND b.rel_type = 'LOCATED_IN' WHERE k.reasoning = 'bridge_2hop'
  UNION SELECT k.reasoning, a.src, c.dst FROM k JOIN rel a ON a.rel_type = 'CREATED_BY' JOIN rel b ON b.src = a.dst AND b.rel_type = 'LOCATED_IN' JOIN rel c ON c.src = b.dst AND c.rel_type = 'LOCATED_IN' WHERE k.reasoning = 'bridge_3hop'
  UNION SELECT 'intersection', a.dst || ' & ' || b.dst, a.src FROM rel a JOIN rel b ON a.src = b.src AND a.dst < b.dst WHERE a.rel_type = 'CREATED_BY' AND b.rel_type = 'CREATED_BY'""")
def gold_generated(spark, sf):
    """Questions of each reasoning type made from relation paths, with their answers."""
    r = _relations(spark, sf)
    return graph.gold_answers(r, {"bridge_2hop": ("BORN_IN", "LOCATED_IN"), "bridge_3hop": ("CREATED_BY", "LOCATED_IN", "LOCATED_IN")}, {"intersection": "CREATED_BY"})


@query("SELECT n_name AS nation, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery, CASE WHEN count(*) FILTER (WHERE c_mktsegment = 'BUILDING') > count_if(c_mktsegment = 'MACHINERY') THEN 'BUILDING' ELSE 'MACHINERY' END AS winner FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def gold_comparison(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"), F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("machinery"))
    return c.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), "building", "machinery", F.when(F.col("building") > F.col("machinery"), "BUILDING").otherwise("MACHINERY").alias("winner"))


@query("WITH RECURSIVE t AS (SELECT DISTINCT a, b FROM (" + with_kg("SELECT src AS a, dst AS b FROM lk UNION SELECT dst, src FROM lk") + ")), r AS (SELECT DISTINCT a AS node, a AS root FROM t UNION SELECT t.b, r.root FROM r JOIN t ON t.a = r.node) SELECT node, min(root) AS component FROM r GROUP BY node")
def components(spark, sf):
    return connected_components(kg.links(spark, sf))


@query(with_kg("SELECT entity, community FROM co", *community_cte()))
def communities(spark, sf):
    return kg.communities(spark, sf)


_COMMUNITY_ROWS = (
    "cr AS (SELECT co.community, co.entity, en.label, row_number() OVER (PARTITION BY co.community ORDER BY co.entity) AS i FROM co JOIN en ON en.entity = co.entity)",
    "cn AS (SELECT community, count(*) AS member_count, list(entity || ' (' || label || ')' ORDER BY entity) FILTER (WHERE i <= 20) AS names FROM cr GROUP BY 1)",
    "cx AS (SELECT community, string_agg(passage, ' | ' ORDER BY chunk_id) AS passages FROM (SELECT community, c.chunk_id, left(ch.text, 300) AS passage, row_number() OVER (PARTITION BY community ORDER BY c.chunk_id) AS j FROM (SELECT DISTINCT cr.community, mn.chunk_id FROM cr JOIN mn ON mn.entity = cr.entity WHERE cr.i <= 40) c JOIN ch ON ch.chunk_id = c.chunk_id) WHERE j <= 5 GROUP BY 1)",
)


@query(with_kg("SELECT format('community_{:05d}', cn.community) AS community_key, cn.member_count, array_to_string(cn.names, ', ') AS top_entities, cx.passages, array_to_string(cn.names[1:10], ', ') AS summary FROM cn LEFT JOIN cx ON cx.community = cn.community", *community_cte(), *_COMMUNITY_ROWS))
def community_context(spark, sf):
    """Size, up to 20 names, up to 5 passages of 300 characters and a summary of the first 10 names, per community."""
    named = kg.communities(spark, sf).join(kg.entities(spark, sf), "entity")
    w = Window.partitionBy("community").orderBy("entity")
    ranked = named.withColumn("i", F.row_number().over(w))
    shown = F.when(F.col("i") <= 20, F.struct("entity", F.concat(F.col("entity"), F.lit(" ("), F.col("label"), F.lit(")")).alias("s")))
    names = ranked.groupBy("community").agg(F.count("*").alias("member_count"), F.transform(F.array_sort(F.collect_set(shown)), lambda x: x["s"]).alias("names"))
    reached = ranked.where("i <= 40").join(kg.mentions(spark, sf), "entity").select("community", "chunk_id").distinct().join(kg.chunks(spark, sf).select("chunk_id", F.left("text", F.lit(300)).alias("passage")), "chunk_id")
    p = Window.partitionBy("community").orderBy("chunk_id")
    texts = reached.withColumn("j", F.row_number().over(p)).where("j <= 5").groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "passage"))), lambda x: x["passage"]), " | ").alias("passages"))
    out = names.join(texts, "community", "left")
    return out.select(F.format_string("community_%05d", F.col("community").cast("int")).alias("community_key"), "member_count", F.array_join("names", ", ").alias("top_entities"), "passages", F.array_join(F.slice("names", 1, 10), ", ").alias("summary"))


@query(with_kg("SELECT p.title, x.page_id IS NULL AS stub FROM (SELECT DISTINCT trim(t) AS title FROM (SELECT unnest(source_pages) AS t FROM qa_pairs) WHERE trim(t) <> '') p LEFT JOIN (SELECT title, min(page_id) AS page_id FROM pg GROUP BY title) x ON x.title = p.title"))
def stub_pages(spark, sf):
    """Titles that questions name, and whether a page has to be made for them."""
    titles = table(spark, sf, "qa_pairs").select(F.explode("source_pages").alias("t")).select(F.trim("t").alias("title")).where("title <> ''").distinct()
    known = kg.pages(spark, sf).groupBy("title").agg(F.min("page_id").alias("page_id"))
    return titles.join(known, "title", "left").select("title", F.col("page_id").isNull().alias("stub"))
