"""Ranked retrieval, batched over a table of questions.

Shapes: questions(query_id, question[, embedding]); an index(doc, text); results(query_id, doc, score).
Scores are rounded before ranking and ties go to the smaller document, so every plan ranks alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafonda.functions import lexicon as L
from grafonda.functions.text import terms

K1, B = 1.2, 0.75


def postings(docs: DataFrame, doc: str, text: Column) -> DataFrame:
    """(doc, term, tf, dl): one row per distinct term of a document."""
    words = docs.select(F.col(doc).alias("doc"), terms(text).alias("ts")).select("doc", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    return words.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


BUCKETS = 64
#: asked terms up to which the scan itself is cut down to them
ASKED = 5_000


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int").alias("bucket")


def index_of(docs: DataFrame) -> DataFrame:
    """Posting rows (doc, term, tf, dl, bucket) of docs(doc, text) in the order of an index to be written partitioned by bucket.

    Ranges run over bucket, term and document, so a frequent term is spread over files and a file
    holds few terms: readers skip buckets by partition and row groups by term.
    """
    rows = postings(docs, "doc", F.col("text")).withColumn("bucket", _bucket(F.col("term")))
    return rows.repartitionByRange("bucket", "term", "doc").sortWithinPartitions("bucket", "term", "doc")


def bm25(questions: DataFrame, index: DataFrame, doc_count: DataFrame) -> DataFrame:
    """(query_id, doc, score) of every document that shares a term with a question.

    `index` as from `postings`, or written from `index_of`; `doc_count` one row (n, avgdl). The terms
    asked for cut the posting list down before anything else: by filters that the scan knows while
    they are few, else by a semi join.
    """
    asked = questions.select("query_id", F.explode(F.array_distinct(terms(F.col("question")))).alias("term"))
    words = asked.select("term", _bucket(F.col("term"))).distinct().limit(ASKED + 1).collect()
    if len(words) <= ASKED:
        wanted = index.where(F.col("term").isin([r["term"] for r in words]))
        if "bucket" in index.columns:
            wanted = wanted.where(F.col("bucket").isin(sorted({r["bucket"] for r in words})))
    else:
        wanted = index.join(asked.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    weighted = asked.join(df, "term").crossJoin(F.broadcast(doc_count)).withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("idf") * F.col("tf") / (F.col("tf") + K1 * ((1 - B) + B * F.col("dl") / F.col("avgdl")))
    return wanted.join(weighted, "term").groupBy("query_id", "doc").agg(F.round(F.sum(part), 6).alias("score"))


def corpus_size(docs: DataFrame, text: Column) -> DataFrame:
    """One row (n, avgdl)."""
    return docs.select(F.size(terms(text)).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def top(results: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best of every query, with their rank; a per-partition limit prunes before the exchange."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "doc")
    return results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null where one is zero."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.try_divide(dot, norm(a) * norm(b))


#: questions compared at once; their vectors travel to the tasks
QUESTION_BLOCK = 10_000


def _best_of_batches(matrix: np.ndarray, k: int):
    """(query, doc, cosine) of each batch's k best documents of every question, ties included."""

    def run(batches):
        norm = np.linalg.norm(matrix, axis=1)
        unit = matrix / np.where(norm, norm, np.nan)[:, None]
        for batch in batches:
            lists = batch.column("embedding")
            fits = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == matrix.shape[1])
            if not fits.any():
                continue
            doc = batch.column("doc").filter(pa.array(fits))
            v = lists.filter(pa.array(fits)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, matrix.shape[1])
            length = np.linalg.norm(v, axis=1)
            cosine = np.nan_to_num((unit @ v.T) / np.where(length, length, np.nan), nan=-2.0, posinf=-2.0, neginf=-2.0)
            # rounded scores decide later, so what rounds to the k-th best stays
            least = np.partition(cosine, -k, axis=1)[:, -k] - 4e-6 if cosine.shape[1] > k else np.full(len(cosine), -1.5)
            q, d = np.nonzero(cosine >= np.maximum(least, -1.5)[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), doc.take(pa.array(d)), pa.array(cosine[q, d])], names=["q", "doc", "cosine"])

    return run


def vector_search(questions: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, doc, score, rank): exact top k by (1 + cosine) / 2 of `vectors(doc, embedding)`.

    Questions travel to the vectors in blocks of `QUESTION_BLOCK`; a batch of vectors meets a block in
    one matrix product and keeps k a question before the exchange. Vectors of another length than the
    questions', with nulls or without a direction are found by none.
    """
    spark = vectors.sparkSession
    q = questions.select("query_id", F.col("embedding").cast("array<double>").alias("e")).where(F.col("e").isNotNull() & ~F.exists("e", lambda x: x.isNull()))
    usable = vectors.select("doc", "embedding").where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    few = q.limit(QUESTION_BLOCK + 1).collect()
    blocks = 1 if len(few) <= QUESTION_BLOCK else -(-q.count() // QUESTION_BLOCK)
    kinds = dict(vectors.dtypes)["doc"], dict(q.dtypes)["query_id"]
    every = spark.createDataFrame([], f"query_id {kinds[1]}, doc {kinds[0]}, cosine double")
    for block in range(blocks):
        rows = few if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        for dim in {len(r["e"]) for r in rows} - {0}:
            some = [r for r in rows if len(r["e"]) == dim]
            named = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(some)], f"q int, query_id {kinds[1]}")
            found = usable.mapInArrow(_best_of_batches(np.array([r["e"] for r in some]), k), f"q int, doc {kinds[0]}, cosine double")
            every = every.unionByName(found.join(F.broadcast(named), "q").select("query_id", "doc", "cosine"))
    return top(every.select("query_id", "doc", F.round((1 + F.col("cosine")) / 2, 6).alias("score")), k)


def graph_channel(entity_hits: DataFrame, mentions: DataFrame, k: int, distinct_scores: bool = False) -> DataFrame:
    """Documents that mention the entities found; a document has its best entity's score (or a row for each distinct score)."""
    reached = entity_hits.withColumnRenamed("doc", "entity").join(mentions, "entity").select("query_id", F.col("chunk_id").alias("doc"), "score")
    return top(reached.distinct() if distinct_scores else reached.groupBy("query_id", "doc").agg(F.max("score").alias("score")), k)


def community_channel(entity_hits: DataFrame, communities: DataFrame, mentions: DataFrame, k: int, best: int = 3, entities: int = 20) -> DataFrame:
    """Documents of the communities whose entities score highest: `entities` hits, `best` communities, 2k documents each, k in all."""
    hits = top(entity_hits, entities).select("query_id", F.col("doc").alias("entity"), "score")
    summed = hits.join(communities, "entity").groupBy("query_id", "community").agg(F.round(F.sum("score"), 6).alias("score"))
    chosen = top(summed.withColumnRenamed("community", "doc"), best).select("query_id", F.col("doc").alias("community"), "score")
    # a community's first documents are the same for every question, so they are drawn before questions meet them
    members = communities.join(mentions, "entity").select("community", "chunk_id").distinct()
    first = members.withColumn("i", F.row_number().over(Window.partitionBy("community").orderBy("chunk_id"))).where(F.col("i") <= 2 * k).drop("i")
    capped = chosen.join(first, "community")
    return top(capped.groupBy("query_id", F.col("chunk_id").alias("doc")).agg(F.max("score").alias("score")), k)


def fuse(channels: dict[str, DataFrame], k: int = L.FUSION_K, weights: dict[str, float] | None = None, duplicates: str = "first") -> DataFrame:
    """(query_id, doc, score, channel_scores) by weighted reciprocal ranks of channels (query_id, doc, rank).

    A document's first (or last) rank in a channel counts; channels without a weight add nothing;
    documents that are null or empty are skipped. One union and one aggregation, whatever the channels.
    """
    weights = L.CHANNEL_WEIGHTS if weights is None else weights
    every = None
    for name, df in channels.items():
        rows = df.where("doc is not null and doc <> ''").groupBy("query_id", "doc").agg((F.min if duplicates == "first" else F.max)("rank").alias("rank")).select("query_id", "doc", F.lit(name).alias("channel"), (F.lit(float(weights.get(name, 0.0))) / (k + F.col("rank"))).alias("part"))
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy("query_id", "doc").agg(F.round(F.sum("part"), 9).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", F.round("part", 9).alias("part"))))).alias("channel_scores"))


def overlap_score(question: Column, text: Column) -> Column:
    """Share of the question's distinct terms that stand in the text: the scorer used where no model is given."""
    asked = F.array_distinct(terms(question))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(asked, F.array_distinct(terms(text)))), F.size(asked)), F.lit(0.0)), 6)


#: characters of a text that a scorer reads
SCORED = 512


def rerank(candidates: DataFrame, score: Column, k: int = 5, least: float = L.RERANK_MIN_SCORE) -> DataFrame:
    """Candidates by a new score: those of `least` or more, the best one if there is none, at most k."""
    scored = candidates.withColumn("score", score)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(w)).where(((F.col("score") >= least) | (F.col("rank") == 1)) & (F.col("rank") <= k))


def expand_links(found_pages: DataFrame, links: DataFrame, chunks: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Hits among the chunks of pages that the found pages link to, at a reduced score."""
    linked = found_pages.select("query_id", F.col("page_id").alias("src")).distinct().join(links, "src").select("query_id", F.col("dst").alias("page_id")).distinct()
    reach = linked.join(chunks.select("page_id", F.col("chunk_id").alias("doc")), "page_id").select("query_id", "doc").distinct()
    return top(hits.join(reach, ["query_id", "doc"]).select("query_id", "doc", F.round(F.col("score") * L.LINK_EXPANSION_FACTOR, 6).alias("score")), k)


def snippets_answer(fused: DataFrame, texts: DataFrame, count: int = 3, size: int = 300) -> DataFrame:
    """(query_id, answer): the beginnings of the best documents joined by a bar; a fixed sentence where there is none."""
    best = top(fused, count).join(texts, "doc")
    rows = best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.left("text", F.lit(size)).alias("s")))), lambda x: x["s"]), " | ").alias("answer"))
    return rows


def widen(ranked: DataFrame, expanded: DataFrame) -> DataFrame:
    """`ranked` with the rows of `expanded` whose document a query does not have yet."""
    new = expanded.join(ranked.select("query_id", "doc"), ["query_id", "doc"], "left_anti")
    return ranked.select("query_id", "doc").unionByName(new.select("query_id", "doc"))


def else_from(found: DataFrame, fallback: DataFrame) -> DataFrame:
    """`found`, and for queries that found nothing the rows of `fallback`."""
    missing = fallback.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found.unionByName(missing.select(found.columns))


def require(df: DataFrame, *columns: str) -> DataFrame:
    """`df` if it has all the columns; raises with the missing ones else."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
