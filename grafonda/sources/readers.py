"""Sources: dumps, article tables, evaluation files, graph exports. Schemas are explicit, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafonda.functions.text import paragraphs

ARTICLE = "id string, url string, title string, text string"
QA = "id string, question string, answer string, metadata struct<walk_id:string,hops:int,question_type:string,evidence_chunk_ids:array<string>,source_pages:array<string>>"
READING = "id string, question string, context string, title string, answers struct<text:array<string>>, gold_answers array<string>, is_impossible boolean"
COMMUNITY = "community_id string, id string, summary string, member_count int, top_entities array<string>, entity_ids array<string>, level int"
_DUMP = "id string, ns string, title string, revision struct<text:struct<_VALUE:string>>"


def wiki_dump(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id, title, text) of the articles (namespace 0) of a MediaWiki XML dump; splittable by page."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(_DUMP).load(path)
    out = pages.where("trim(ns) = '0'").select("id", "title", F.coalesce("revision.text._VALUE", F.lit("")).alias("text"))
    return out.limit(limit) if limit else out


def page_in_dump(spark: SparkSession, path: str, title: str) -> DataFrame:
    """The first page of any namespace whose title is `title` but for case and blanks around."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(_DUMP).load(path)
    return pages.where(F.lower(F.trim("title")) == title.strip().lower()).select("id", "title", F.coalesce("revision.text._VALUE", F.lit("")).alias("text")).limit(1)


def article_url(title, base: str = "https://vi.wikipedia.org/wiki/"):
    """Address of an article: percent-encoded, blanks as %20, slashes kept."""
    return F.concat(F.lit(base), F.replace(F.replace(F.url_encode(title), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")))


def articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARTICLE).parquet(path)


def article_by_title(df: DataFrame, title: str) -> DataFrame:
    """The article of exactly this title, else the first one that differs in case only; both filters reach the scan."""
    exact = df.where(F.col("title") == title).withColumn("_o", F.lit(0))
    loose = df.where(F.lower("title") == title.lower()).withColumn("_o", F.lit(1))
    return exact.unionByName(loose).orderBy("_o", "id").limit(1).drop("_o")


def paragraph_table(df: DataFrame, least: int = 50) -> DataFrame:
    """(paragraph_id, article_id, title, url, paragraph_index, text): paragraphs of `least` characters, numbered after the short ones are out."""
    rows = df.select(F.col("id").alias("article_id"), "title", "url", F.posexplode(paragraphs(F.col("text"), least)).alias("paragraph_index", "text"))
    return rows.select(F.md5(F.concat_ws(":", "article_id", "paragraph_index")).alias("paragraph_id"), "article_id", "title", "url", "paragraph_index", "text")


def by_suffix(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table by the ending of its name: .jsonl, .csv, .json (one list) or else Parquet."""
    reader = spark.read.schema(schema)
    if path.endswith(".jsonl"):
        return reader.json(path)
    if path.endswith(".csv"):
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if path.endswith(".json"):
        return reader.option("multiLine", True).json(path)
    return reader.parquet(path)


def slice_of(df: DataFrame, order: str, start: int, limit: int) -> DataFrame:
    """Rows [start, start + limit) in an order."""
    return df.orderBy(order).offset(start).limit(limit)


def qa_set(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Question-answer pairs of a JSON-lines file with nested metadata."""
    df = spark.read.schema(QA).json(path)
    return df.limit(limit) if limit else df


def reading_set(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Reading-comprehension samples with their gold answers."""
    df = spark.read.schema(READING).json(path)
    golds = F.coalesce("gold_answers", "answers.text", F.array().cast("array<string>"))
    out = df.select("id", "question", golds.alias("gold_answers"), "context", "title", F.coalesce("is_impossible", F.lit(False)).alias("is_impossible"))
    return out.limit(limit) if limit else out


def with_gold(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Samples that have a gold answer; the limit counts those."""
    out = df.where(F.size("gold_answers") > 0)
    return out.limit(limit) if limit else out


def passages_set(spark: SparkSession, path: str) -> DataFrame:
    """(question, gold) of evaluation files with differing fields: the first of context, passages, gold_passages, answer_passage and answer."""
    schema = "question string, query string, context string, passages array<string>, gold_passages array<string>, answer_passage string, answer string"
    df = spark.read.schema(schema).json(path)
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    gold = F.coalesce(one("context"), "passages", "gold_passages", one("answer_passage"), one("answer"))
    return df.select(F.coalesce("question", "query").alias("question"), gold.alias("gold")).where("question is not null and size(gold) > 0")


def community_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(community, summary, member_count, top_entities): numbers from ids like community_00042; others are skipped."""
    df = spark.read.schema(COMMUNITY).json(path)
    raw = F.coalesce("community_id", "id")
    number = F.coalesce(F.expr("try_cast(regexp_extract(coalesce(community_id, id), '^community_([0-9]+)$', 1) as int)"), F.expr("try_cast(coalesce(community_id, id) as int)"))
    return df.where(raw.isNotNull()).select(number.alias("community"), "summary", "member_count", "top_entities").where("community is not null")


def catalogue_of(spark: SparkSession) -> DataFrame:
    """(table_name, column_name, data_type) of all tables and views of the session."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def with_raw_text(rows: DataFrame, raw: DataFrame) -> DataFrame:
    """`rows(title, ...)` with `raw_text`: the markup of the first article of `raw(id, title, text)` whose title agrees but for case; null where there is none."""
    first = raw.groupBy(F.lower("title").alias("_k")).agg(F.min_by("text", "id").alias("raw_text"))
    return rows.withColumn("_k", F.lower("title")).join(first, "_k", "left").drop("_k")


def json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row of a JSON object kept in a file; a missing, blank, corrupt or other file gives a row of nulls."""
    from pyspark.errors import AnalysisException

    try:
        text = spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("o"))
        row = text.select("o.*").limit(1)
        return row if not row.isEmpty() else spark.range(1).select(F.from_json(F.lit("{}"), schema).alias("o")).select("o.*")
    except AnalysisException:
        return spark.range(1).select(F.from_json(F.lit("{}"), schema).alias("o")).select("o.*")
