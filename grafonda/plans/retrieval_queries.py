"""Retrieval channels, fusion, reranking and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from grafonda.functions import lexicon as L
from grafonda.operators import metrics
from grafonda.operators import retrieval as R
from grafonda.plans import kg
from grafonda.plans.kg import NAMES_CTE, VECTOR_CTE, bm25_cte, community_cte, query, with_kg
from grafonda.session import materialise, table

_K = 10
_BM = bm25_cte("bm", "ch", "chunk_id", "text")
_TI = bm25_cte("ti", "pg", "page_id", "title || ' ' || summary")
_EN = NAMES_CTE + ", " + bm25_cte("eh", "nm", "entity", "text")
_TOP = "(SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM {0})"


def _chunk_hits(spark, sf):
    return kg.search(spark, sf, "chunk")


def _title_hits(spark, sf):
    return kg.search(spark, sf, "page")


def _entity_hits(spark, sf):
    return kg.search(spark, sf, "entity")


@query(with_kg("SELECT query_id, doc, score, rank FROM " + _TOP.format("bm") + " WHERE rank <= 10", _BM))
def bm25_topk(spark, sf):
    return R.top(_chunk_hits(spark, sf), _K)


@query(with_kg("SELECT query_id, doc, score, rank FROM " + _TOP.format("(SELECT ti.query_id, ch.chunk_id AS doc, ti.score FROM ti JOIN ch ON ch.page_id = ti.doc)") + " WHERE rank <= 10", _TI))
def title_search(spark, sf):
    """Every chunk of a page has the score of the page's title and summary."""
    hits = _title_hits(spark, sf).withColumnRenamed("doc", "page_id").join(kg.chunks(spark, sf).select("page_id", "chunk_id"), "page_id")
    return R.top(hits.select("query_id", F.col("chunk_id").alias("doc"), "score"), _K)


@query(with_kg("SELECT query_id, doc, score, rank FROM " + _TOP.format("eh") + " WHERE rank <= 10", _EN))
def entity_search(spark, sf):
    """Entities by name and aliases."""
    return R.top(_entity_hits(spark, sf), _K)


_GRAPH = "gr AS (SELECT eh.query_id, mn.chunk_id AS doc, max(eh.score) AS score FROM eh JOIN mn ON mn.entity = eh.doc GROUP BY 1, 2)"


@query(with_kg("SELECT query_id, doc, score, rank FROM " + _TOP.format("gr") + " WHERE rank <= 10", _EN, _GRAPH))
def graph_channel(spark, sf):
    return R.graph_channel(_entity_hits(spark, sf), kg.mentions(spark, sf), _K)


_VECTORS = """v AS (SELECT vec_id AS doc, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = 64),
  vq AS (SELECT doc AS query_id, e AS q FROM v WHERE doc % 100 = 0),
  vs AS (SELECT query_id, doc, round((1 + list_cosine_similarity(e, q)) / 2, 6) AS score FROM v CROSS JOIN vq)"""


@query("WITH " + _VECTORS + " SELECT query_id, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM vs) WHERE rank <= 10")
def vector_topk(spark, sf):
    """Vectors whose id is divisible by 100 against all, exactly."""
    v = table(spark, sf, "embeddings").where("size(embedding) = 64").select(F.col("vec_id").alias("doc"), "embedding")
    return R.vector_search(v.where("doc % 100 = 0").select(F.col("doc").alias("query_id"), "embedding"), v, _K)


@query("WITH " + _VECTORS + """, c AS (SELECT label, list_transform(range(1, 65), lambda i: i) AS ix FROM embeddings GROUP BY label),
  cv AS (SELECT label, list(a ORDER BY i) AS centre FROM (SELECT label, i, avg(x) AS a FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE len(embedding) = 64) GROUP BY label, i) GROUP BY label),
  best AS (SELECT query_id, label FROM (SELECT vq.query_id, cv.label, row_number() OVER (PARTITION BY vq.query_id ORDER BY round((1 + list_cosine_similarity(centre, q)) / 2, 6) DESC, cv.label) AS r FROM cv CROSS JOIN vq) WHERE r <= 3)
  SELECT query_id, doc, score, rank FROM (SELECT vs.query_id, vs.doc, vs.score, row_number() OVER (PARTITION BY vs.query_id ORDER BY vs.score DESC, vs.doc) AS rank FROM vs JOIN embeddings e ON e.vec_id = vs.doc JOIN best b ON b.query_id = vs.query_id AND b.label = e.label) WHERE rank <= 10""")
def community_vector_channel(spark, sf):
    """Communities (labels) by their mean vector, the best 3, their members by similarity."""
    v = table(spark, sf, "embeddings").where("size(embedding) = 64").select(F.col("vec_id").alias("doc"), "embedding", "label")
    parts = v.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("a"))
    centres = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("embedding"))
    q = v.where("doc % 100 = 0").select(F.col("doc").alias("query_id"), "embedding")
    best = R.vector_search(q, centres.withColumnRenamed("label", "doc"), 3).select("query_id", F.col("doc").alias("label"))
    scored = q.withColumnRenamed("embedding", "q").join(best, "query_id").join(v, "label").select("query_id", "doc", F.round((1 + R.cosine(F.col("embedding"), F.col("q"))) / 2, 6).alias("score"))
    return R.top(scored, _K)


_HITS20 = "eh20 AS (SELECT query_id, doc AS entity, score FROM " + _TOP.format("eh") + " WHERE rank <= 20)"


def _community_sql(k: int) -> tuple[str, ...]:
    """CTEs up to cc(query_id, doc, score) of the community channel for k documents."""
    return (
        *community_cte(),
        _HITS20,
        "cs AS (SELECT query_id, community AS doc, round(sum(score), 6) AS score FROM eh20 JOIN co USING (entity) GROUP BY 1, 2)",
        "c3 AS (SELECT query_id, doc AS community, score FROM " + _TOP.format("cs") + " WHERE rank <= 3)",
        "cm AS (SELECT DISTINCT co.community, mn.chunk_id FROM co JOIN mn USING (entity))",
        f"cc AS (SELECT query_id, chunk_id AS doc, max(score) AS score FROM (SELECT c3.query_id, cm.chunk_id, c3.score, row_number() OVER (PARTITION BY c3.query_id, c3.community ORDER BY cm.chunk_id) AS i FROM c3 JOIN cm USING (community)) WHERE i <= {2 * k} GROUP BY 1, 2)",
    )


@query(with_kg("SELECT query_id, doc, score, rank FROM " + _TOP.format("cc") + " WHERE rank <= 10", _EN, *_community_sql(_K)))
def community_channel(spark, sf):
    """Chunks of the detected communities whose entities the question finds."""
    return R.community_channel(_entity_hits(spark, sf), kg.communities(spark, sf), kg.mentions(spark, sf), _K)


_CANDIDATES = (
    "vc AS (SELECT query_id, doc, round((1 + list_cosine_similarity(e, q)) / 2, 6) AS score FROM cv CROSS JOIN qv)",
    "r1 AS (SELECT query_id, doc, 'bm25' AS channel, rank FROM " + _TOP.format("bm") + " WHERE rank <= 30)",
    "r2 AS (SELECT query_id, doc, 'graph' AS channel, rank FROM " + _TOP.format("gr") + " WHERE rank <= 30)",
    "r3 AS (SELECT query_id, doc, 'community' AS channel, rank FROM " + _TOP.format("cc") + " WHERE rank <= 20)",
    "r4 AS (SELECT query_id, doc, 'vector' AS channel, rank FROM " + _TOP.format("vc") + " WHERE rank <= 30)",
    "ra AS (SELECT *, CASE channel WHEN 'bm25' THEN 0.4 WHEN 'vector' THEN 0.4 WHEN 'graph' THEN 0.2 ELSE 0.15 END / (60.0 + rank) AS part FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4))",
    "fu AS (SELECT query_id, doc, round(sum(part), 9) AS score FROM ra GROUP BY 1, 2)",
)
_FUSED = (_BM, _EN, _GRAPH, *_community_sql(2 * _K), *VECTOR_CTE, *_CANDIDATES)
CHANNELS = ("bm25", "vector", "graph", "community")


def _fused(spark, sf, channels=CHANNELS):
    """Over-fetched channels (3k, communities 2k) fused by reciprocal ranks; the entity hits are shared by two channels."""
    mentions = kg.mentions(spark, sf)
    found = {}
    if "bm25" in channels:
        found["bm25"] = R.top(_chunk_hits(spark, sf), 3 * _K)
    if "vector" in channels:
        found["vector"] = R.vector_search(kg.question_vectors(spark, sf), kg.indexed_vectors(spark, sf), 3 * _K)
    if "graph" in channels or "community" in channels:
        hits = materialise(_entity_hits(spark, sf), "hits")
        if "graph" in channels:
            found["graph"] = R.graph_channel(hits, mentions, 3 * _K)
        if "community" in channels:
            found["community"] = R.community_channel(hits, kg.communities(spark, sf), mentions, 2 * _K)
    return R.fuse(found)


@query(with_kg("SELECT query_id, doc, score FROM fu", *_FUSED))
def wrrf_fusion(spark, sf):
    return _fused(spark, sf).select("query_id", "doc", "score")


@query(with_kg("SELECT f.query_id, f.rank, f.doc, f.score, pg.title, pg.url, substr(ch.text, 1, 500) AS snippet FROM " + _TOP.format("fu") + " f JOIN ch ON ch.chunk_id = f.doc LEFT JOIN pg ON pg.page_id = ch.page_id WHERE f.rank <= 10", *_FUSED))
def hybrid_retrieve(spark, sf):
    """The flagship: four channels, fused, cut, with page and snippet."""
    best = R.top(_fused(spark, sf).select("query_id", "doc", "score"), _K)
    ch = kg.chunks(spark, sf).select(F.col("chunk_id").alias("doc"), "page_id", F.substring("text", 1, 500).alias("snippet"))
    return best.join(ch, "doc").join(kg.pages(spark, sf).select("page_id", "title", "url"), "page_id", "left").select("query_id", "rank", "doc", "score", "title", "url", "snippet")


@query(with_kg("SELECT f.query_id, f.doc, f.score, f.rank, p.parts FROM " + _TOP.format("fu") + " f JOIN (SELECT query_id, doc, string_agg(channel || ':' || rank, ' ' ORDER BY channel) AS parts FROM ra GROUP BY 1, 2) p ON p.query_id = f.query_id AND p.doc = f.doc WHERE f.rank <= 10", *_FUSED))
def hybrid_channels(spark, sf):
    """Fused results with the rank that every channel gave them, read back from its part of the score."""
    weights = F.create_map(*[x for k, v in L.CHANNEL_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    ranked = F.transform(F.array_sort(F.map_entries("channel_scores")), lambda e: F.concat_ws(":", e["key"], F.round(F.element_at(weights, e["key"]) / e["value"] - L.FUSION_K).cast("int")))
    return R.top(_fused(spark, sf), _K).select("query_id", "doc", "score", "rank", F.array_join(ranked, " ").alias("parts"))


_UNION = (
    _BM, _TI, _EN, _GRAPH,
    "u1 AS (SELECT query_id, doc, score FROM " + _TOP.format("bm") + " WHERE rank <= 10)",
    "u2 AS (SELECT query_id, doc, score FROM " + _TOP.format("(SELECT ti.query_id, ch.chunk_id AS doc, round(ti.score * 0.8, 6) AS score FROM ti JOIN ch ON ch.page_id = ti.doc)") + " WHERE rank <= 10)",
    "u3 AS (SELECT query_id, doc, score FROM " + _TOP.format("(SELECT query_id, doc, round(score * 0.7, 6) AS score FROM gr)") + " WHERE rank <= 10)",
)


@query(with_kg("SELECT query_id, doc, score, rank FROM " + _TOP.format("(SELECT query_id, doc, max(score) AS score FROM (SELECT * FROM u1 UNION SELECT * FROM u2 UNION SELECT * FROM u3) GROUP BY 1, 2)") + " WHERE rank <= 10", *_UNION))
def legacy_union_search(spark, sf):
    """Text, title and entity branches at weights 1, 0.8 and 0.7, the best score of a chunk."""
    cut = lambda df: R.top(df, _K).select("query_id", "doc", "score")
    titles = _title_hits(spark, sf).withColumnRenamed("doc", "page_id").join(kg.chunks(spark, sf).select("page_id", "chunk_id"), "page_id").select("query_id", F.col("chunk_id").alias("doc"), F.round(F.col("score") * 0.8, 6).alias("score"))
    entities = _entity_hits(spark, sf).withColumnRenamed("doc", "entity").join(kg.mentions(spark, sf), "entity").groupBy("query_id", F.col("chunk_id").alias("doc")).agg(F.round(F.max("score") * 0.7, 6).alias("score"))
    every = cut(_chunk_hits(spark, sf)).union(cut(titles)).union(cut(entities)).distinct()
    return R.top(every.groupBy("query_id", "doc").agg(F.max("score").alias("score")), _K)


_EXPANDED = (
    _BM,
    "fp AS (SELECT DISTINCT b.query_id, ch.page_id FROM " + _TOP.format("bm") + " b JOIN ch ON ch.chunk_id = b.doc WHERE b.rank <= 10)",
    "lp AS (SELECT DISTINCT fp.query_id, lk.dst FROM fp JOIN lk ON lk.src = fp.page_id)",
    "lh AS (SELECT bm.query_id, bm.doc, round(bm.score * 0.9, 6) AS score FROM bm JOIN ch ON ch.chunk_id = bm.doc JOIN lp ON lp.query_id = bm.query_id AND lp.dst = ch.page_id)",
)


@query(with_kg("SELECT query_id, doc, score, rank FROM " + _TOP.format("lh") + " WHERE rank <= 10", *_EXPANDED))
def link_expansion(spark, sf):
    hits = materialise(_chunk_hits(spark, sf), "hits")
    ch = kg.chunks(spark, sf).select("chunk_id", "page_id")
    found = R.top(hits, _K).join(ch.withColumnRenamed("chunk_id", "doc"), "doc").select("query_id", "page_id")
    return R.expand_links(found, kg.links(spark, sf), ch, hits, _K)


_TERMS = r"regexp_extract_all(lower({0}), '([\p{{L}}\p{{N}}]+)', 1)"
_RERANK = (
    _BM,
    "rr AS (SELECT b.query_id, b.doc, coalesce(round(len(list_intersect(list_distinct(" + _TERMS.format("qs.question") + "), list_distinct(" + _TERMS.format("left(ch.text, 512)") + "))) / nullif(len(list_distinct(" + _TERMS.format("qs.question") + ")), 0), 6), 0) AS score FROM " + _TOP.format("bm") + " b JOIN qs USING (query_id) JOIN ch ON ch.chunk_id = b.doc WHERE b.rank <= 20)",
)


@query(with_kg("SELECT query_id, doc, score, rank FROM " + _TOP.format("rr") + " WHERE rank <= 5 AND (score >= 0.1 OR rank = 1)", *_RERANK))
def rerank_threshold(spark, sf):
    cand = R.top(_chunk_hits(spark, sf), 20).select("query_id", "doc").join(kg.chunks(spark, sf).select(F.col("chunk_id").alias("doc"), "text"), "doc").join(kg.questions(spark, sf), "query_id")
    return R.rerank(cand, R.overlap_score(F.col("question"), F.left("text", F.lit(R.SCORED)))).select("query_id", "doc", "score", "rank")


@query(with_kg("SELECT query_id, string_agg(left(ch.text, 300), ' | ' ORDER BY rank) AS answer FROM " + _TOP.format("bm") + " b JOIN ch ON ch.chunk_id = b.doc WHERE rank <= 3 GROUP BY query_id", _BM))
def answer_from_snippets(spark, sf):
    return R.snippets_answer(_chunk_hits(spark, sf), kg.chunks(spark, sf).select(F.col("chunk_id").alias("doc"), "text"))


_GOLD = "gold AS (SELECT qs.query_id, list(ch.chunk_id ORDER BY ch.chunk_id) AS gold FROM qs JOIN ch ON ch.page_id = qs.query_id GROUP BY 1)"
_RET = "ret AS (SELECT query_id, list(doc ORDER BY rank) AS docs FROM " + _TOP.format("(SELECT ti.query_id, ch.chunk_id AS doc, ti.score FROM ti JOIN ch ON ch.page_id = ti.doc)") + " WHERE rank <= 20 GROUP BY 1)"


def _with_gold(spark, sf):
    gold = kg.questions(spark, sf).join(kg.chunks(spark, sf).select(F.col("page_id").alias("query_id"), "chunk_id"), "query_id").groupBy("query_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("gold"))
    hits = _title_hits(spark, sf).withColumnRenamed("doc", "page_id").join(kg.chunks(spark, sf).select("page_id", "chunk_id"), "page_id").select("query_id", F.col("chunk_id").alias("doc"), "score")
    ret = R.top(hits, 20).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda s: s["doc"]).alias("docs"))
    return gold.join(ret, "query_id", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<string>")))


_JOINED = "gr_ AS (SELECT gold.query_id, gold, coalesce(docs, []) AS docs FROM gold LEFT JOIN ret USING (query_id)), rk AS (SELECT query_id, gold, docs, list_filter(list_transform(range(1, len(docs) + 1), lambda i: CASE WHEN list_contains(gold, docs[i]) THEN i END), lambda x: x IS NOT NULL) AS hits FROM gr_)"


@query(with_kg("SELECT count(*) AS evaluated, round(avg(CASE WHEN len(hits) > 0 THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(avg(CASE WHEN len(hits) > 0 AND hits[1] <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_at_5, round(avg(CASE WHEN len(hits) > 0 THEN 1.0 / hits[1] ELSE 0 END), 6) AS mrr FROM rk", _TI, _GOLD, _RET, _JOINED))
def metric_hit_mrr(spark, sf):
    d, g = F.col("docs"), F.col("gold")
    avg = lambda c, name: F.round(F.avg(c.cast("double")), 6).alias(name)
    return _with_gold(spark, sf).agg(F.count("*").alias("evaluated"), avg(metrics.hit(d, g), "hit_rate"), avg(metrics.hit(d, g, 5), "hit_at_5"), avg(metrics.reciprocal_rank(d, g), "mrr"))


@query(with_kg("SELECT query_id, round(coalesce(list_sum(list_transform(list_filter(hits, lambda h: h <= 10), lambda h: 1 / log2(h + 1))), 0) / list_sum(list_transform(range(1, least(len(gold), 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM rk", _TI, _GOLD, _RET, _JOINED))
def metric_ndcg(spark, sf):
    return _with_gold(spark, sf).select("query_id", F.round(metrics.ndcg(F.col("docs"), F.col("gold")), 6).alias("ndcg"))


def _scored(name: str, source: str) -> str:
    """CTE of query_id, doc, score: the overlap scorer over documents of `source`(query_id, doc)."""
    q, t = _TERMS.format("qs.question"), _TERMS.format("left(ch.text, 512)")
    return f"{name} AS (SELECT b.query_id, b.doc, coalesce(round(len(list_intersect(list_distinct({q}), list_distinct({t}))) / nullif(len(list_distinct({q})), 0), 6), 0) AS score FROM {source} b JOIN qs USING (query_id) JOIN ch ON ch.chunk_id = b.doc)"


_KEPT = "(SELECT query_id, doc, score, rank FROM {0} WHERE rank <= 5 AND (score >= 0.1 OR rank = 1))"
_PIPELINE = (
    "f10 AS (SELECT query_id, doc, score, rank FROM " + _TOP.format("fu") + " WHERE rank <= 10)",
    _scored("s1", "f10"),
    "k1 AS " + _KEPT.format(_TOP.format("s1")),
    "xp AS (SELECT DISTINCT k1.query_id, lk.dst FROM k1 JOIN ch ON ch.chunk_id = k1.doc JOIN lk ON lk.src = ch.page_id)",
    "xh AS (SELECT bm.query_id, bm.doc, round(bm.score * 0.9, 6) AS score FROM bm JOIN ch ON ch.chunk_id = bm.doc JOIN xp ON xp.query_id = bm.query_id AND xp.dst = ch.page_id)",
    "x5 AS (SELECT query_id, doc FROM " + _TOP.format("xh") + " WHERE rank <= 5)",
    _scored("s2", "(SELECT query_id, doc FROM k1 UNION SELECT query_id, doc FROM x5)"),
    "k2 AS " + _KEPT.format(_TOP.format("s2")),
    "k3 AS (SELECT query_id, doc, rank FROM f10 WHERE rank <= 5)",
    "xq AS (SELECT DISTINCT k3.query_id, lk.dst FROM k3 JOIN ch ON ch.chunk_id = k3.doc JOIN lk ON lk.src = ch.page_id)",
)


def _with_text(spark, sf, rows):
    """Rows (query_id, doc) with the question and what a scorer reads of the text."""
    texts = kg.chunks(spark, sf).select(F.col("chunk_id").alias("doc"), F.left("text", F.lit(R.SCORED)).alias("text"))
    return rows.select("query_id", "doc").join(texts, "doc").join(kg.questions(spark, sf), "query_id")


def _reranked(spark, sf, rows):
    return R.rerank(_with_text(spark, sf, rows), R.overlap_score(F.col("question"), F.col("text")))


def _pipeline(spark, sf, multi_hop: bool = True):
    """Fused candidates, reranked, widened along links by documents not had yet, and reranked again."""
    base = materialise(R.top(_fused(spark, sf).select("query_id", "doc", "score"), _K), "fused")
    first = _reranked(spark, sf, base)
    if not multi_hop:
        return base, first
    first = materialise(first.select("query_id", "doc", "score", "rank"), "ranked")
    ch = kg.chunks(spark, sf).select("chunk_id", "page_id")
    found = first.join(ch.withColumnRenamed("chunk_id", "doc"), "doc").select("query_id", "page_id")
    further = R.expand_links(found, kg.links(spark, sf), ch, _chunk_hits(spark, sf), 5)
    return base, _reranked(spark, sf, R.widen(first, further))


@query(with_kg("SELECT k2.query_id, k2.rank, k2.doc, k2.score, pg.title, pg.url FROM k2 JOIN ch ON ch.chunk_id = k2.doc LEFT JOIN pg ON pg.page_id = ch.page_id", *_FUSED, *_PIPELINE))
def query_graph(spark, sf):
    """The question pipeline up to its citations: hybrid retrieval, reranking, link widening, reranking."""
    ch = kg.chunks(spark, sf).select(F.col("chunk_id").alias("doc"), "page_id")
    return _pipeline(spark, sf)[1].join(ch, "doc").join(kg.pages(spark, sf).select("page_id", "title", "url"), "page_id", "left").select("query_id", "rank", "doc", "score", "title", "url")


@query(with_kg("SELECT f.query_id, f.doc, f.score FROM (SELECT query_id, doc, score FROM " + _TOP.format("gr") + " WHERE rank <= 10) f UNION ALL SELECT u.query_id, u.doc, u.score FROM (SELECT query_id, doc, score FROM " + _TOP.format("ti_") + " WHERE rank <= 10) u WHERE u.query_id NOT IN (SELECT query_id FROM gr)", _EN, _GRAPH, _TI, "ti_ AS (SELECT ti.query_id, ch.chunk_id AS doc, round(ti.score * 0.8, 6) AS score FROM ti JOIN ch ON ch.page_id = ti.doc)"))
def fallback_retrieve(spark, sf):
    """A channel's results, and for questions it finds nothing for those of the next one."""
    found = R.graph_channel(_entity_hits(spark, sf), kg.mentions(spark, sf), _K).select("query_id", "doc", "score")
    titles = _title_hits(spark, sf).withColumnRenamed("doc", "page_id").join(kg.chunks(spark, sf).select("page_id", "chunk_id"), "page_id").select("query_id", F.col("chunk_id").alias("doc"), F.round(F.col("score") * 0.8, 6).alias("score"))
    return R.else_from(found, R.top(titles, _K).select("query_id", "doc", "score"))


_MODES = """SELECT 'full_hybrid' AS mode, query_id, doc FROM k2 UNION ALL SELECT 'no_multi_hop', query_id, doc FROM k1 UNION ALL SELECT 'no_reranking', query_id, doc FROM k3
  UNION ALL SELECT 'text_only', query_id, doc FROM """ + _TOP.format("bm") + """ WHERE rank <= 5 UNION ALL SELECT 'graph_only', query_id, doc FROM """ + _TOP.format("gr") + " WHERE rank <= 5"
_ABLATION = """ab AS (SELECT mode, round(avg(hit), 6) AS hit_rate, count(*) AS questions FROM (
  SELECT m.mode, g.query_id, max(CASE WHEN list_contains(g.gold, m.doc) THEN 1.0 ELSE 0 END) AS hit FROM gold g JOIN (""" + _MODES + """) m ON m.query_id = g.query_id GROUP BY 1, 2) GROUP BY mode)"""


@query(with_kg("SELECT * FROM ab", *_FUSED, *_PIPELINE, _GOLD, _ABLATION))
def ablation_modes(spark, sf):
    """Five ways to retrieve against the chunks of the question's page: whole, without widening, without reranking, text alone, graph alone."""
    gold = kg.questions(spark, sf).join(kg.chunks(spark, sf).select(F.col("page_id").alias("query_id"), F.col("chunk_id").alias("doc")), "query_id").select("query_id", "doc").withColumn("gold", F.lit(1.0))
    base, full = _pipeline(spark, sf)
    modes = {
        "full_hybrid": full,
        "no_multi_hop": _reranked(spark, sf, base),
        "no_reranking": base.where("rank <= 5"),
        "text_only": R.top(_chunk_hits(spark, sf), 5),
        "graph_only": R.graph_channel(_entity_hits(spark, sf), kg.mentions(spark, sf), 5),
    }
    every = None
    for mode, found in modes.items():
        rows = found.select(F.lit(mode).alias("mode"), "query_id", "doc")
        every = rows if every is None else every.unionAll(rows)
    per = every.join(gold, ["query_id", "doc"], "left").groupBy("mode", "query_id").agg(F.coalesce(F.max("gold"), F.lit(0.0)).alias("hit"))
    return per.join(gold.select("query_id").distinct(), "query_id", "left_semi").groupBy("mode").agg(F.round(F.avg("hit"), 6).alias("hit_rate"), F.count("*").alias("questions"))


@query(with_kg("SELECT mode, hit_rate, round(hit_rate - (SELECT hit_rate FROM ab WHERE mode = 'full_hybrid'), 6) AS delta FROM ab", *_FUSED, *_PIPELINE, _GOLD, _ABLATION))
def ablation_deltas(spark, sf):
    """Every mode against the full one."""
    table_ = ablation_modes(spark, sf)
    base = table_.where("mode = 'full_hybrid'").select(F.col("hit_rate").alias("full"))
    return table_.crossJoin(F.broadcast(base)).select("mode", "hit_rate", F.round(F.col("hit_rate") - F.col("full"), 6).alias("delta"))


_BEFORE = (
    "b20 AS (SELECT query_id, doc, score, rank FROM " + _TOP.format("bm") + " WHERE rank <= 20)",
    _scored("sr", "b20"),
    "a5 AS " + _KEPT.format(_TOP.format("sr")),
    "fr AS (SELECT g.query_id, min(CASE WHEN list_contains(g.gold, b.doc) THEN b.rank END) AS before FROM gold g LEFT JOIN b20 b USING (query_id) GROUP BY 1)",
    "sd AS (SELECT g.query_id, min(CASE WHEN list_contains(g.gold, a.doc) THEN a.rank END) AS after FROM gold g LEFT JOIN a5 a USING (query_id) GROUP BY 1)",
)


@query(with_kg("SELECT (SELECT count(*) FROM qs) AS total, count(*) AS evaluated, round(avg(CASE WHEN before IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / before, 0)), 6) AS mrr, round(avg(CASE WHEN after IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS rerank_hit_rate, round(avg(coalesce(1.0 / after, 0)), 6) AS rerank_mrr FROM fr JOIN sd USING (query_id)", _BM, _GOLD, *_BEFORE))
def metric_before_after_rerank(spark, sf):
    """Hit rate and reciprocal rank of the first 20 and of what reranking keeps of them; questions without gold count in the total alone."""
    gold = kg.questions(spark, sf).join(kg.chunks(spark, sf).select(F.col("page_id").alias("query_id"), F.col("chunk_id").alias("doc")), "query_id").select("query_id", "doc")
    found = materialise(R.top(_chunk_hits(spark, sf), 20), "found")
    first = lambda rows, name: gold.join(rows.select("query_id", "doc", "rank"), ["query_id", "doc"], "left").groupBy("query_id").agg(F.min("rank").alias(name))
    both = first(found, "before").join(first(_reranked(spark, sf, found), "after"), "query_id")
    rate, mrr = (lambda c: F.round(F.avg(F.col(c).isNotNull().cast("double")), 6)), (lambda c: F.round(F.avg(F.coalesce(1.0 / F.col(c), F.lit(0.0))), 6))
    total = kg.questions(spark, sf).agg(F.count("*").alias("total"))
    return total.crossJoin(both.agg(F.count("*").alias("evaluated"), rate("before").alias("hit_rate"), mrr("before").alias("mrr"), rate("after").alias("rerank_hit_rate"), mrr("after").alias("rerank_mrr")))


@query("WITH " + _VECTORS + """, e AS (SELECT vec_id AS doc, label FROM embeddings),
  rk AS (SELECT query_id, vs.doc, e.label = q.label AS relevant, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vs.doc) AS rank FROM vs JOIN e ON e.doc = vs.doc JOIN e q ON q.doc = vs.query_id WHERE vs.doc <> query_id),
  pq AS (SELECT query_id, min(CASE WHEN relevant THEN rank END) AS first, sum(CASE WHEN relevant THEN 1 / log2(rank + 1) ELSE 0 END) AS gain FROM rk WHERE rank <= 10 GROUP BY 1)
  SELECT count(*) AS questions, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr_at_10, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_at_5, round(avg(gain / list_sum(list_transform(range(1, 11), lambda i: 1 / log2(i + 1)))), 6) AS gain_at_10 FROM pq""")
def embedding_benchmark(spark, sf):
    """How well a set of vectors ranks those of the same label: reciprocal rank, hits and discounted gain of the first 10."""
    v = table(spark, sf, "embeddings").where("size(embedding) = 64").select(F.col("vec_id").alias("doc"), "embedding", "label")
    q = v.where("doc % 100 = 0").select(F.col("doc").alias("query_id"), "embedding", F.col("label").alias("wanted"))
    found = R.vector_search(q, v, 11).where("doc <> query_id").select("query_id", "doc", "score")
    judged = R.top(found, 10).join(v.select("doc", "label"), "doc").join(q.select("query_id", "wanted"), "query_id").withColumn("relevant", F.col("label") == F.col("wanted"))
    per = judged.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.sum(F.when(F.col("relevant"), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return per.agg(F.count("*").alias("questions"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr_at_10"), F.round(F.avg((F.coalesce("first", F.lit(99)) <= 5).cast("double")), 6).alias("hit_at_5"), F.round(F.avg(F.col("gain") / ideal), 6).alias("gain_at_10"))
