"""The queries of this folder and the SQL that can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafonda.llm import cutting, defects, ivfpq, mixing, names, packing, parity, spam, suffixes
from grafonda.operators.components import connected_components
from grafonda.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = parity.near_duplicate_pairs(table(spark, sf, "qa_pairs"), "qa_id", "question")
    return pairs.select(F.col("id_a").alias("qa_id_a"), F.col("id_b").alias("qa_id_b"))


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row per qa_id: its group, and the number of forms its own form is linked to."""
    members = parity.materialise(parity.plain_forms(table(spark, sf, "qa_pairs"), "qa_id", "question"), "forms")
    links = parity.materialise(parity.similar_forms(members), "links")
    both = links.select(F.col("form_a").alias("form")).unionAll(links.select(F.col("form_b").alias("form")))
    degree = both.groupBy("form").agg(F.count("*").alias("n_links"))
    groups = connected_components(links.select(F.col("form_a").alias("src"), F.col("form_b").alias("dst")))
    return (
        members.select(F.col("id").alias("qa_id"), "form")
        .join(groups.select(F.col("node").alias("form"), "component"), "form", "left")
        .join(degree, "form", "left")
        .select("qa_id", F.coalesce("component", "form").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = ivfpq.neighbour_pairs(*ivfpq.most_similar(table(spark, sf, "chunks")))
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p2_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """chunk_id, rank, neighbour and cosine: the 10 most similar chunks of every chunk."""
    nearest, vectors = ivfpq.most_similar(table(spark, sf, "chunks"))
    edges = nearest.select("n", F.posexplode("top").alias("pos", "t")).select("n", (F.col("pos") + 1).alias("rank"), F.col("t.n").alias("m"), (-F.col("t.d").cast("double")).alias("cosine"))
    return (
        edges.join(vectors.select("n", F.col("id").alias("chunk_id")), "n")
        .join(vectors.select(F.col("n").alias("m"), F.col("id").alias("neighbour_id")), "m")
        .select("chunk_id", "rank", "neighbour_id", F.round("cosine", 6).alias("cosine"))
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = suffixes.cross_split_overlaps(table(spark, sf, "qa_pairs"))
    return pairs.select(F.least("train_id", "eval_id").alias("qa_id_a"), F.greatest("train_id", "eval_id").alias("qa_id_b"))


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "qa_pairs")
    return suffixes.overlap_report(rows, suffixes.cross_split_overlaps(rows))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return defects.broken_pairs(table(spark, sf, "qa_pairs")).select(F.col("id").alias("qa_id"), "defect")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    links = names.link_names(table(spark, sf, "ner_mentions"), table(spark, sf, "resolved_entities"))
    return links.select(F.col("id").alias("mention_id"), F.col("entity").alias("entity_id"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    pieces = cutting.cut_items(table(spark, sf, "chunks_v2"), keep_small=False)
    return pieces.select(F.col("id").alias("chunk_id")).distinct()


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    pieces = cutting.cut_items(table(spark, sf, "chunks_v2"), keep_small=False)
    return pieces.select(F.col("id").alias("chunk_id"), "version", "section", "seq", "begin", "end", "text")


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(packing.pack_documents(table(spark, sf, "documents")))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    sizes = mixing.measured(table(spark, sf, "documents"))
    return mixing.mix_documents(sizes, table(spark, sf, "mix_targets")).withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    sizes, targets = mixing.measured(table(spark, sf, "documents")), table(spark, sf, "mix_targets")
    return mixing.mix_report(mixing.mix_documents(sizes, targets), mixing.plan_mix(sizes, targets))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return spam.filler_pages(table(spark, sf, "documents")).select(F.col("id").alias("doc_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_neighbours, p3_found, p3_report, p4_found, p5_found, p6_found, p6_pieces, p7_containers, p7_fill, p8_mix, p8_shares, p9_found)}


def oracle_sql() -> dict[str, str]:
    return {
        # the rule for oversized items is plain SQL; the operator's pieces are tested by round trips
        "p6_found": r"""
            SELECT DISTINCT chunk_id FROM chunks_v2
            WHERE chunk_id IS NOT NULL
              AND length(regexp_replace(trim(nfc_normalize(text), E' \t\r\n'), '[ \t\r\n]+', ' ', 'g')) > 2048
        """,
        # every pair of one title set over both splits, compared by the stated rule
        "p3_found": r"""
            WITH base AS (
              SELECT DISTINCT qa_id, split, question, source_pages FROM qa_pairs
              WHERE split IN ('train', 'dev', 'test') AND qa_id IS NOT NULL AND question IS NOT NULL AND source_pages IS NOT NULL
            ), plainform AS (
              SELECT qa_id, split, source_pages,
                     trim(regexp_replace(replace(lower(strip_accents(nfc_normalize(question))), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g')) AS p
              FROM base
            ), keyed AS (
              SELECT qa_id, split, p,
                     (SELECT string_agg(k, chr(10) ORDER BY k) FROM (
                        SELECT DISTINCT lower(trim(regexp_replace(replace(nfc_normalize(t), '_', ' '), '\s+', ' ', 'g'))) AS k
                        FROM (SELECT unnest(source_pages) AS t) WHERE t IS NOT NULL) WHERE k <> '') AS pages
              FROM plainform WHERE length(p) >= 3
            ), grams AS (
              SELECT qa_id, split, pages, list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS g
              FROM keyed WHERE pages IS NOT NULL
            ), pairs AS (
              SELECT a.qa_id AS x, b.qa_id AS y, len(list_intersect(a.g, b.g)) AS i, len(a.g) AS m, len(b.g) AS n
              FROM grams a JOIN grams b ON a.pages = b.pages AND a.split = 'train' AND b.split <> 'train' AND a.qa_id <> b.qa_id
            )
            SELECT DISTINCT least(x, y) AS qa_id_a, greatest(x, y) AS qa_id_b FROM pairs WHERE 100 * i >= 65 * (m + n - i)
        """,
    }
