"""Building the graph's tables from articles, keyed writes, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafonda.functions import text as T
from grafonda.functions.udfs import strip_templates


def build_graph(articles: DataFrame, least: int = 200) -> dict[str, DataFrame]:
    """pages, chunks, entities, mentions and links of articles (title, url, text), as lazy tables of one plan.

    Pages are numbered by the name-based id of their address, chunks by page and place, entities by
    their lower-case name; entities keep the label seen first; links make stub pages where a title
    has none.
    """
    src = articles.where(F.length(F.trim("text")) >= least).withColumn("page_id", T.uuid5(F.col("url")))
    clean = src.withColumn("clean", T.strip_markup(strip_templates("text")))
    pages = clean.select("page_id", "title", "url", F.substring("clean", 1, 400).alias("summary")).dropDuplicates(["page_id"])
    pieces = clean.select("page_id", F.posexplode(T.windows(F.col("clean"))).alias("seq", "text"))
    chunks = pieces.select(T.uuid5(F.concat(F.col("page_id"), F.lit("#chunk#"), F.col("seq").cast("string"))).alias("chunk_id"), "page_id", "seq", "text").dropDuplicates(["chunk_id"])
    found = clean.select("page_id", F.posexplode(T.simple_names(F.col("clean"))).alias("ord", "name")).withColumn("label", T.entity_type(F.col("name"))).where(~T.is_noise(F.col("name")))
    keyed = found.withColumn("entity_id", T.uuid5(F.lower("name"), "dns"))
    entities = keyed.groupBy("entity_id").agg(F.min_by("name", F.struct("page_id", "ord")).alias("name"), F.min_by("label", F.struct("page_id", "ord")).alias("label"))
    mentions = chunks.select("chunk_id", "page_id", "text").join(keyed.select("page_id", "entity_id", "name", "label").distinct(), "page_id").where(F.contains(F.lower("text"), F.lower("name"))).select("chunk_id", "entity_id", F.concat(F.lit("MENTIONS_"), F.upper("label")).alias("relation_type")).distinct()
    targets = src.select("page_id", F.explode(T.wikilinks(F.col("text"))).alias("l")).select(F.col("page_id").alias("src"), F.col("l.target").alias("title")).distinct()
    known = pages.groupBy("title").agg(F.min("page_id").alias("dst"))
    resolved = targets.join(known, "title", "left").withColumn("stub", F.col("dst").isNull()).withColumn("dst", F.coalesce("dst", T.uuid5(F.concat(F.lit("title:"), F.col("title")))))
    stubs = resolved.where("stub").select(F.col("dst").alias("page_id"), "title", F.lit("").alias("url"), F.lit("").alias("summary")).distinct()
    return {"pages": pages.unionByName(stubs), "chunks": chunks, "entities": entities, "mentions": mentions, "links": resolved.select("src", "dst").distinct()}


def write_graph(tables: dict[str, DataFrame], path: str, rows_per_file: int = 100_000) -> None:
    """Every table as Parquet below `path`, replacing what is there; a table's files hold a bounded number of rows."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/{name}")


def export_graph(tables: dict[str, DataFrame], path: str) -> None:
    """pages, chunks and entities as JSON lines, mentions and links as CSV with a header, and the rows of each as a report."""
    for name in ("pages", "chunks", "entities"):
        tables[name].write.mode("overwrite").json(f"{path}/{name}.jsonl")
    for name in ("mentions", "links"):
        tables[name].write.mode("overwrite").option("header", True).csv(f"{path}/{name}.csv")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n") for name, df in tables.items()]
    stats = counts[0]
    for c in counts[1:]:
        stats = stats.unionAll(c)
    write_report(stats, f"{path}/stats.json")


def convert_dump(dump: DataFrame, clean_path: str, raw_path: str, rows_per_file: int = 100_000) -> None:
    """Articles of a dump as two Parquet tables, raw and cleaned, with addresses."""
    from grafonda.functions.udfs import clean_wikitext
    from grafonda.sources.readers import article_url

    base = dump.select("id", article_url(F.replace("title", F.lit(" "), F.lit("_"))).alias("url"), "title", "text")
    base.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(raw_path)
    base.withColumn("text", clean_wikitext("text")).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(clean_path)


def write_qa(qa: DataFrame, path: str) -> None:
    """QA pairs as JSON lines with nested metadata."""
    qa.select("id", "question", "answer", F.struct("walk_id", "hops", "question_type", "evidence_chunk_ids", "source_pages").alias("metadata")).write.mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Metrics as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_communities(rows: DataFrame, path: str) -> None:
    """Community summaries (community, summary, member_count, top_entities) as JSON lines that `readers.community_summaries` reads."""
    rows.select(F.format_string("community_%05d", F.col("community").cast("int")).alias("community_id"), "summary", "member_count", "top_entities").write.mode("overwrite").json(path)


def write_reading_set(rows: DataFrame, path: str) -> None:
    """Reading-comprehension samples as JSON lines that `readers.reading_set` reads."""
    rows.select("id", "question", "context", "title", "gold_answers", "is_impossible").write.mode("overwrite").json(path)


def write_plain(articles: DataFrame, path: str) -> None:
    """Articles (id, title, url, text) as text files: a head with title, id and address, then the text."""
    head = F.concat(F.lit("# "), F.col("title"), F.lit("\nid: "), F.col("id"), F.lit("\nurl: "), F.coalesce("url", F.lit("")))
    articles.select(F.concat(head, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


#: columns that name a row of each table of the graph
KEYS = {"pages": ("page_id",), "chunks": ("chunk_id",), "entities": ("entity_id",), "mentions": ("chunk_id", "entity_id"), "links": ("src", "dst")}


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n, keys, nulls, unique): whether the rows of every table are told apart by its key."""
    out = None
    for name, df in tables.items():
        key = KEYS[name]
        empty = F.count_if(F.greatest(*(F.col(c).isNull().cast("int") for c in key), F.lit(0)) == 1)
        row = df.agg(F.count("*").alias("n"), F.count_distinct(F.struct(*key)).alias("keys"), empty.alias("nulls")).select(F.lit(name).alias("table_name"), "n", "keys", "nulls", ((F.col("n") == F.col("keys")) & (F.col("nulls") == 0)).alias("unique"))
        out = row if out is None else out.unionAll(row)
    return out


def upsert_graph(current: dict[str, DataFrame], changes: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables of a graph with the rows of another put in by key: new rows added, rows of a key replaced, loading twice the same as once."""
    out = dict(current)
    for name, new in changes.items():
        key = list(KEYS[name])
        new = new.dropDuplicates(key)
        out[name] = current[name].join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True) if name in current else new
    return out


def paragraph_graph(paragraphs: DataFrame) -> dict[str, DataFrame]:
    """pages, chunks, entities and mentions of a paragraph table (see `readers.paragraph_table`): every paragraph is a chunk."""
    chunks = paragraphs.select(F.col("paragraph_id").alias("chunk_id"), F.col("article_id").alias("page_id"), F.col("paragraph_index").alias("seq"), "text")
    pages = paragraphs.groupBy(F.col("article_id").alias("page_id")).agg(F.min("title").alias("title"), F.min("url").alias("url"))
    found = paragraphs.select(F.col("paragraph_id").alias("chunk_id"), F.explode(T.vietnamese_names(F.col("text"))).alias("name")).withColumn("entity_id", T.uuid5(F.lower("name"), "dns"))
    entities = found.groupBy("entity_id").agg(F.min("name").alias("name")).withColumn("label", T.entity_type(F.col("name")))
    return {"pages": pages, "chunks": chunks, "entities": entities, "mentions": found.select("chunk_id", "entity_id").distinct()}


def vector_dimension(chunks: DataFrame) -> int | None:
    """The one length of the vectors; raises where they have several, null where there is none."""
    sizes = [r[0] for r in chunks.where("size(embedding) > 0").select(F.size("embedding")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("vectors of several lengths")
    return sizes[0] if sizes else None
