"""The tools of the service surface as functions over graph tables, all returning DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from grafonda.functions import text as T
from grafonda.functions.udfs import structured_chunks
from grafonda.operators import graph
from grafonda.operators import retrieval as R


@dataclass
class KnowledgeGraph:
    """pages(page_id, title, url, summary), chunks(chunk_id, page_id, seq, text), entities(entity, label), mentions(chunk_id, entity), links(src, dst), relations(src, rel_type, dst), communities(entity, community, summary)."""

    spark: SparkSession
    pages: DataFrame
    chunks: DataFrame
    entities: DataFrame
    mentions: DataFrame
    links: DataFrame
    relations: DataFrame | None = None
    communities: DataFrame | None = None

    def search(self, questions: DataFrame, top_k: int = 10) -> DataFrame:
        """Fused text, vector, graph and community channels, cut, with page and 500 characters of text; scores to 4 places.

        The vector channel runs where chunks and questions have an `embedding`, the community channel
        where there are communities.
        """
        index, size = R.postings(self.chunks, "chunk_id", F.col("text")), R.corpus_size(self.chunks, F.col("text"))
        names = self.entities.select("entity")
        hits = R.bm25(questions, R.postings(names, "entity", F.col("entity")), R.corpus_size(names, F.col("entity")))
        channels = {"bm25": R.top(R.bm25(questions, index, size), 3 * top_k), "graph": R.graph_channel(hits, self.mentions, 3 * top_k)}
        if "embedding" in questions.columns and "embedding" in self.chunks.columns:
            channels["vector"] = R.vector_search(questions, self.chunks.select(F.col("chunk_id").alias("doc"), "embedding"), 3 * top_k)
        if self.communities is not None:
            channels["community"] = R.community_channel(hits, self.communities, self.mentions, 2 * top_k)
        best = R.top(R.fuse(channels), top_k).withColumn("score", F.round("score", 4))
        texts = self.chunks.select(F.col("chunk_id").alias("doc"), "page_id", F.left("text", F.lit(500)).alias("chunk_text"))
        return best.join(texts, "doc").join(self.pages.select("page_id", "title", "url"), "page_id", "left")

    def _ranked(self, rows: DataFrame, questions: DataFrame, k: int) -> DataFrame:
        texts = self.chunks.select(F.col("chunk_id").alias("doc"), "page_id", F.left("text", F.lit(R.SCORED)).alias("chunk_text"))
        cand = rows.select("query_id", "doc").join(texts, "doc").join(questions.select("query_id", "question"), "query_id")
        return R.rerank(cand, R.overlap_score(F.col("question"), F.col("chunk_text")), k)

    def answer(self, questions: DataFrame, top_k: int = 4) -> DataFrame:
        """(query_id, answer, citations): found chunks reranked, widened along the links of their pages, reranked again; the three best as answer text."""
        first = self._ranked(self.search(questions, top_k), questions, top_k)
        index, size = R.postings(self.chunks, "chunk_id", F.col("text")), R.corpus_size(self.chunks, F.col("text"))
        further = R.expand_links(first.select("query_id", "page_id"), self.links, self.chunks, R.bm25(questions, index, size), top_k)
        ranked = self._ranked(R.widen(first, further), questions, top_k).join(self.pages.select("page_id", "title", "url"), "page_id", "left")
        grouped = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "url", "doc", "chunk_text"))).alias("best"))
        said = questions.select("query_id").join(grouped, "query_id", "left")
        text = F.array_join(F.transform(F.slice("best", 1, 3), lambda s: F.left(F.replace(F.trim(s["chunk_text"]), F.lit("\n"), F.lit(" ")), F.lit(200))), " | ")
        return said.select("query_id", F.coalesce(F.nullif(text, F.lit("")), F.lit("Không tìm thấy thông tin phù hợp trong cơ sở tri thức.")).alias("answer"), F.transform("best", lambda s: F.struct(s["title"].alias("page_title"), s["url"].alias("page_url"), s["doc"].alias("chunk_id"))).alias("citations"))

    def explore(self, name: str) -> DataFrame:
        """Relations of an entity in either direction, at most 50."""
        centre = self.spark.createDataFrame([(name,)], "entity string")
        return graph.any_relation(centre, self.relations).orderBy("rel_type", "neighbour").limit(50)

    def path(self, a: str, b: str, max_hops: int = 5) -> DataFrame:
        """A shortest path between two entities over relations of any kind; hops are kept within 2 to 6."""
        start = self.spark.createDataFrame([(a,)], "node string")
        return graph.shortest_paths(start, self.relations.select("src", "dst"), min(6, max(2, max_hops)), b).where(F.col("node") == b)

    def community(self, name: str) -> DataFrame:
        """Community of an entity and its summary, empty where there is none."""
        return self.communities.where(F.col("entity") == name).select("community", F.coalesce("summary", F.lit("")).alias("summary"))

    def stats(self) -> DataFrame:
        """Rows by table."""
        parts = {n: getattr(self, n) for n in ("pages", "chunks", "entities", "mentions", "links", "relations") if getattr(self, n) is not None}
        rows = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("item"), "n", T.shown_number(F.col("n")).alias("shown")) for n, df in parts.items()]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionAll(r)
        return out

    def entity_types(self) -> DataFrame:
        return self.entities.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")

    def passage(self, chunk_id: str) -> DataFrame:
        return self.chunks.where(F.col("chunk_id") == chunk_id).join(self.pages, "page_id", "left")

    def trace(self, chunk_id: str) -> DataFrame:
        """A chunk with its page and the chunks next to it, in order."""
        c = self.chunks.where(F.col("chunk_id") == chunk_id).select("page_id", F.col("seq").alias("_s"))
        near = self.chunks.join(F.broadcast(c), "page_id").where(F.abs(F.col("seq") - F.col("_s")) <= 1).drop("_s")
        return near.join(self.pages.select("page_id", "title", "url"), "page_id", "left").orderBy("seq")

    def query(self, sql: str, limit: int = 100) -> tuple[DataFrame, bool]:
        """Rows of a read-only statement, at most `limit`, and whether there were more. Raises on anything but a query."""
        if not is_query(self.spark, sql):
            raise ValueError("only one reading statement is allowed")
        df = self.spark.sql(sql)
        more = df.limit(limit + 1).count() > limit
        return df.limit(limit), more


#: what the parser makes of statements that only read; commands and writes have other nodes
_READING = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Join LateralJoin Union Except Intersect SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedInlineTable"
    " UnresolvedWith WithWindowDefinition UnresolvedHaving Generate OneRowRelation LocalRelation Pivot Unpivot UnresolvedHint Sample View UnresolvedTableValuedFunction UnresolvedTVFAliases Repartition RepartitionByExpression RebalancePartitions UnresolvedOrdinal".split()
)


def is_query(spark: SparkSession, sql: str) -> bool:
    """Whether a text is one statement whose plan, subqueries and named parts included, only reads.

    Decided on the parser's tree: every node must be one of a query. Words in texts or names do not
    matter, and whatever the parser has for commands or writes is none of them.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception:
        return False
    queue = [plan]
    while queue:
        node = queue.pop()
        if node.getClass().getSimpleName().rstrip("$") not in _READING:
            return False
        for group in (node.children(), node.innerChildren(), node.subqueries()):
            items = group.toSeq() if hasattr(group, "toSeq") else group
            for i in range(items.size()):
                item = items.apply(i)
                if spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan", False, spark._jvm.Thread.currentThread().getContextClassLoader()).isInstance(item):
                    queue.append(item)
    return True


def hashed_embedding(dim: int = 64):
    """The default embedding where no model is given: a normalised bag of hashed words, as an Arrow UDF."""
    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        import xxhash

        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = xxhash.xxh64_intdigest(w)
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return pd.Series(out)

    return embed


def embedded(rows: DataFrame, text: str = "text", dim: int = 64, done: DataFrame | None = None, key: str = "chunk_id") -> DataFrame:
    """`rows` with `embedding`; rows whose key stands in `done(key, embedding)` keep theirs, so that a broken run goes on where it stopped."""
    embed = hashed_embedding(dim)
    if done is None:
        return rows.withColumn("embedding", embed(text))
    new = rows.join(done.select(key), key, "left_anti").withColumn("embedding", embed(text))
    return rows.join(done.select(key, "embedding"), key).unionByName(new)


def register_chunker(spark: SparkSession, name: str = "structured_chunks") -> None:
    """A table function for SQL: SELECT ... FROM t, LATERAL structured_chunks(t.text, t.title)."""
    from pyspark.sql.functions import udtf
    from pyspark.sql.types import IntegerType

    schema = StructType([StructField("seq", IntegerType()), StructField("section", StringType()), StructField("chunk", StringType()), StructField("context", StringType())])

    @udtf(returnType=schema)
    class Chunks:
        def eval(self, text: str, title: str):
            for c in structured_chunks(text, title):
                yield c["seq"], c["section"], c["text"], c["context"]

    spark.udtf.register(name, Chunks)
