"""The knowledge graph as views over the tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grafonda.functions.text import collapse
from grafonda.operators import graph
from grafonda.operators import retrieval as R
from grafonda.session import built, table

#: name -> (function, SQL or None), filled by the modules of this folder
REGISTRY: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def _latest(df: DataFrame, key: str, order: list) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """One row per page: the latest crawl."""
    df = table(spark, sf, "pages").select(F.col("id").alias("page_id"), F.trim("title").alias("title"), "url", F.coalesce("summary", F.lit("")).alias("summary"), "crawled_at")
    return _latest(df, "page_id", [F.desc_nulls_last("crawled_at"), F.asc_nulls_last("title"), F.asc_nulls_last("url"), F.asc_nulls_last("summary")]).drop("crawled_at")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """One row per chunk without its vector, the first of the rows given under its id: only the text columns are read."""
    df = table(spark, sf, "chunks").select("chunk_id", "page_id", "seq", "section", "text")
    first = F.min(F.struct(*(x for c in ("page_id", "seq", "section", "text") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))))).alias("r")
    return df.where("chunk_id is not null").groupBy("chunk_id").agg(first).select("chunk_id", "r.page_id", "r.seq", "r.section", "r.text")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(doc, page_id, seq, embedding): the latest vector of every chunk, if it has 64 finite values that are not all zero."""
    df = table(spark, sf, "chunks").select(F.col("chunk_id").alias("doc"), "page_id", "seq", "embedding", "embedded_at")
    last = F.max(F.struct(F.col("embedded_at").isNotNull().alias("t"), "embedded_at", "embedding", "page_id", "seq")).alias("r")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return df.where("doc is not null").groupBy("doc").agg(last).select("doc", "r.page_id", "r.seq", "r.embedding").where((F.size("embedding") == 64) & sound)


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """(chunk_id, entity) distinct: which chunk mentions which name, case and blanks aside."""
    df = table(spark, sf, "ner_mentions").select("chunk_id", F.lower(collapse(F.col("text"))).alias("entity"))
    return df.where("chunk_id is not null and entity <> ''").distinct()


def gathered(spark: SparkSession, sf: str, text: bool = False) -> DataFrame:
    """(chunk_id, page_id, title, names, ...): a row per chunk with mentions and all its names; page and title are null where there are none.

    With `text` also s, the passage: the first 300 characters of the chunk's text. A chunk's page is the
    smallest given under its id, as in `chunks`, so texts stay out of the way of the titles; and a text
    travels up to the end of its passage, which is as far as it decides which row is the first.
    """
    raw = table(spark, sf, "chunks").where("chunk_id is not null")
    on = raw.groupBy("chunk_id").agg(F.min("page_id").alias("page_id")).where("page_id is not null")
    titled = on.join(pages(spark, sf).select("page_id", "title"), "page_id")
    named = table(spark, sf, "ner_mentions").select("chunk_id", F.lower(collapse(F.col("text"))).alias("entity")).where("chunk_id is not null and entity <> ''")
    out = named.groupBy("chunk_id").agg(F.collect_set("entity").alias("names")).join(titled, "chunk_id", "left")
    if not text:
        return out
    blanks = F.length("text") - F.length(F.ltrim("text"))
    cut = raw.select("chunk_id", "page_id", "seq", "section", F.substring("text", F.lit(1), blanks + 300).alias("text"))
    first = F.min(F.struct(*(x for c in ("page_id", "seq", "section", "text") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))))).alias("r")
    return out.join(cut.groupBy("chunk_id").agg(first).select("chunk_id", F.trim("r.text").alias("s")), "chunk_id", "left")


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, label): every name mentioned with its most frequent known type."""
    df = table(spark, sf, "ner_mentions").select(F.lower(collapse(F.col("text"))).alias("entity"), F.nullif("entity_type", F.lit("Unknown")).alias("t")).where("entity <> ''")
    counted = df.groupBy("entity", "t").agg(F.count("*").alias("n"))
    best = F.max_by("t", F.struct(F.col("t").isNotNull(), "n", "t"))
    return counted.groupBy("entity").agg(F.coalesce(best, F.lit("Unknown")).alias("label"))


def links(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst) distinct page ids: pages whose titles follow one another behind a question, each to the next."""
    titles = F.col("source_pages")
    steps = F.transform(F.slice(titles, 2, F.size(titles)), lambda t, i: F.struct(F.trim(F.get(titles, i)).alias("a"), F.trim(t).alias("b")))
    named = table(spark, sf, "qa_pairs").where("size(source_pages) >= 2").select(F.inline(steps))
    p = pages(spark, sf).select("page_id", "title")
    return named.distinct().join(p.select(F.col("page_id").alias("src"), F.col("title").alias("a")), "a").join(p.select(F.col("page_id").alias("dst"), F.col("title").alias("b")), "b").select("src", "dst").where("src <> dst").distinct()


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, question): the titles of pages whose id is divisible by 100 search all chunks; written once a session."""
    asked = lambda: pages(spark, sf).where("try_cast(page_id as bigint) % 100 = 0 and title <> ''").select(F.col("page_id").alias("query_id"), F.col("title").alias("question"))
    return built(spark, sf, "questions", asked)


def question_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, embedding): a question's vector, here that of its page's first chunk that has one; written once a session."""

    def lead():
        v = indexed_vectors(spark, sf).select(F.col("page_id").alias("query_id"), "seq", "doc", "embedding")
        mine = v.join(questions(spark, sf).select("query_id"), "query_id", "left_semi")
        return mine.groupBy("query_id").agg(F.min_by("embedding", F.struct(F.col("seq").isNull(), "seq", "doc")).alias("embedding"))

    return built(spark, sf, "question_vectors", lead)


def indexed_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """`vectors`, written once a session."""
    return built(spark, sf, "vectors", lambda: vectors(spark, sf))


def names(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, text): what an entity is searched by, its name and, where the registry holds it, its aliases."""
    reg = table(spark, sf, "resolved_entities").select(F.lower(collapse(F.col("canonical_name"))).alias("entity"), F.explode("aliases").alias("alias")).where("entity <> '' and trim(alias) <> ''").distinct()
    also = reg.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("alias")), " ").alias("also"))
    return mentions(spark, sf).select("entity").distinct().join(also, "entity", "left").select("entity", F.concat_ws(" ", "entity", "also").alias("text"))


_SEARCHED = {
    "chunk": lambda spark, sf: chunks(spark, sf).select(F.col("chunk_id").alias("doc"), "text"),
    "page": lambda spark, sf: pages(spark, sf).select(F.col("page_id").alias("doc"), F.concat("title", F.lit(" "), "summary").alias("text")),
    "entity": lambda spark, sf: names(spark, sf).select(F.col("entity").alias("doc"), "text"),
}


def search(spark: SparkSession, sf: str, what: str) -> DataFrame:
    """BM25 hits of all questions over chunks, pages or entities; posting lists are written once and read by term."""
    index = built(spark, sf, f"{what}_postings", lambda: R.index_of(_SEARCHED[what](spark, sf)), "bucket")
    size = built(spark, sf, f"{what}_size", lambda: R.corpus_size(_SEARCHED[what](spark, sf), F.col("text")))
    return R.bm25(questions(spark, sf), index, size)


#: rounds of label propagation that the SQL of the community queries writes out; labels that settle earlier stay as they are
ROUNDS = 8


def communities(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, community) of the co-occurrence graph, found once a session."""
    edges = lambda: graph.cooccurrence(mentions(spark, sf))
    return built(spark, sf, "communities", lambda: graph.numbered_communities(graph.label_propagation(edges(), ROUNDS)))


CTE = r"""
pg AS (
  SELECT page_id, title, url, summary FROM (
    SELECT id AS page_id, trim(title) AS title, url, coalesce(summary, '') AS summary,
           row_number() OVER (PARTITION BY id ORDER BY crawled_at DESC NULLS LAST, trim(title) NULLS LAST, url NULLS LAST, coalesce(summary, '') NULLS LAST) AS r
    FROM pages WHERE id IS NOT NULL) WHERE r = 1
), ch AS (
  SELECT chunk_id, page_id, seq, section, text FROM (
    SELECT chunk_id, page_id, seq, section, text, row_number() OVER (PARTITION BY chunk_id ORDER BY page_id NULLS LAST, seq NULLS LAST, section NULLS LAST, text NULLS LAST) AS r FROM chunks WHERE chunk_id IS NOT NULL) WHERE r = 1
), mn AS (
  SELECT DISTINCT chunk_id, entity FROM (SELECT chunk_id, lower(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))) AS entity FROM ner_mentions) WHERE chunk_id IS NOT NULL AND entity <> ''
), en AS (
  SELECT entity, coalesce(max_by(t, {'k': t IS NOT NULL, 'n': n, 't': t}), 'Unknown') AS label FROM (
    SELECT entity, t, count(*) AS n FROM (
      SELECT lower(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))) AS entity, nullif(entity_type, 'Unknown') AS t FROM ner_mentions) WHERE entity <> '' GROUP BY entity, t)
  GROUP BY entity
), lk AS (
  SELECT DISTINCT a.page_id AS src, b.page_id AS dst FROM (SELECT DISTINCT trim(source_pages[i]) AS a, trim(source_pages[i + 1]) AS b FROM qa_pairs, unnest(range(1, len(source_pages))) AS u(i)) q
  JOIN pg a ON a.title = q.a JOIN pg b ON b.title = q.b WHERE a.page_id <> b.page_id
), qs AS (
  SELECT page_id AS query_id, title AS question FROM pg WHERE try_cast(page_id AS BIGINT) % 100 = 0 AND title <> ''
)"""


def bm25_cte(name: str, docs: str, doc: str, text: str) -> str:
    """CTEs {name}(query_id, doc, score) over a source of documents."""
    return rf"""
{name}_d AS (SELECT {doc} AS doc, regexp_extract_all(lower({text}), '([\p{{L}}\p{{N}}]+)', 1) AS ts FROM {docs}),
{name}_n AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM {name}_d),
{name}_p AS (SELECT doc, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc, len(ts) AS dl, unnest(ts) AS term FROM {name}_d) GROUP BY doc, term),
{name}_t AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name}_q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(question), '([\p{{L}}\p{{N}}]+)', 1)) AS term FROM qs),
{name} AS (SELECT q.query_id, p.doc, round(sum(ln(1 + (n.n - t.df + 0.5) / (t.df + 0.5)) * p.tf / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / n.avgdl))), 6) AS score
  FROM {name}_q q JOIN {name}_t t ON t.term = q.term JOIN {name}_p p ON p.term = q.term CROSS JOIN {name}_n n GROUP BY q.query_id, p.doc)"""


#: valid vectors of chunks and the questions' vectors
VECTOR_CTE = (
    """cv AS MATERIALIZED (SELECT doc, page_id, seq, e FROM (SELECT chunk_id AS doc, page_id, seq, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY chunk_id ORDER BY embedded_at DESC NULLS LAST, embedding DESC NULLS LAST, page_id DESC NULLS LAST, seq DESC NULLS LAST) AS r FROM chunks WHERE chunk_id IS NOT NULL)
      WHERE r = 1 AND len(e) = 64 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(e, lambda x: x <> 0)) > 0)""",
    "qv AS (SELECT query_id, e AS q FROM (SELECT qs.query_id, cv.e, row_number() OVER (PARTITION BY qs.query_id ORDER BY cv.seq NULLS LAST, cv.doc) AS r FROM cv JOIN qs ON qs.query_id = cv.page_id) WHERE r = 1)",
)
#: the entities as searched: name and aliases
NAMES_CTE = r"""nm AS (SELECT m.entity, concat_ws(' ', m.entity, a.also) AS text FROM (SELECT DISTINCT entity FROM mn) m LEFT JOIN (
  SELECT entity, string_agg(alias, ' ' ORDER BY alias) AS also FROM (SELECT DISTINCT lower(trim(regexp_replace(canonical_name, '[\s\p{Z}]+', ' ', 'g'))) AS entity, unnest(aliases) AS alias FROM resolved_entities) WHERE entity <> '' AND trim(alias) <> '' GROUP BY 1) a USING (entity))"""


def community_cte() -> tuple[str, ...]:
    """CTEs up to co(entity, community): label propagation written out round by round."""
    out = [
        "ed AS MATERIALIZED (SELECT a.entity AS a, b.entity AS b, count(*) AS w FROM mn a JOIN mn b ON a.chunk_id = b.chunk_id AND a.entity <> b.entity GROUP BY 1, 2)",
        "ow AS MATERIALIZED (SELECT a AS node, max(w) AS w FROM ed GROUP BY 1)",
        "l0 AS MATERIALIZED (SELECT node, node AS label FROM ow)",
    ]
    for i in range(ROUNDS):
        votes = f"SELECT ed.a AS node, l.label, ed.w FROM ed JOIN l{i} l ON l.node = ed.b UNION ALL SELECT l.node, l.label, ow.w FROM l{i} l JOIN ow ON ow.node = l.node"
        out.append(f"l{i + 1} AS MATERIALIZED (SELECT node, label FROM (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY sum(w) DESC, label) AS r FROM ({votes}) GROUP BY node, label) WHERE r = 1)")
    out.append(f"co AS MATERIALIZED (SELECT node AS entity, community FROM l{ROUNDS} JOIN (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS community FROM l{ROUNDS} GROUP BY label HAVING count(*) >= 3) USING (label))")
    return tuple(out)


def with_kg(body: str, *more: str) -> str:
    return "WITH " + CTE + "".join(", " + m for m in more) + "\n" + body
