"""Entity resolution and extraction over mention tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafonda.functions import lexicon as L
from grafonda.functions.text import any_match, collapse, disambiguation, entity_type, hint_type, is_noise, wikilinks
from grafonda.functions.plainform import nfkc
from grafonda.functions.udfs import without_marks
from grafonda.operators.graph import crossed
from grafonda.session import materialise


def name_key(name: Column) -> Column:
    """Key under which spellings are one: trimmed, lower case, blanks collapsed."""
    return collapse(F.lower(name))


def resolve(mentions: DataFrame, name: str = "name", kind: str = "type", order: str = "ord", aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(entity_key, canonical_name, entity_type, aliases, mentions): names equal without marks are one entity.

    The first name in order is canonical, the last known type counts, other spellings are aliases.
    `aliases` maps canonical names to other names known beforehand (None: the built-in ones).
    """
    known = L.KNOWN_ALIASES if aliases is None else aliases
    spark = mentions.sparkSession
    rows = [(alias, canonical) for canonical, others in known.items() for alias in (canonical, *others)]
    table = spark.createDataFrame(rows, "alias string, canonical string") if rows else spark.createDataFrame([], "alias string, canonical string")
    seeds = table.select(without_marks(name_key(F.col("alias"))).alias("bare"), "canonical").groupBy("bare").agg(F.min("canonical").alias("canonical"))
    named = mentions.where(F.trim(F.col(name)) != "").select(F.col(name).alias("name"), F.col(kind).alias("type"), F.col(order).alias("ord"), without_marks(name_key(F.col(name))).alias("bare"))
    keyed = named.join(F.broadcast(seeds), "bare", "left").withColumn("key", F.coalesce(without_marks(name_key(F.col("canonical"))), F.col("bare")))
    known_type = F.when(F.coalesce("type", F.lit("Unknown")) != "Unknown", F.col("type"))
    return keyed.groupBy(F.col("key").alias("entity_key")).agg(
        F.coalesce(F.min("canonical"), F.min_by("name", "ord")).alias("canonical_name"),
        F.coalesce(F.max_by(known_type, F.when(known_type.isNotNull(), F.col("ord"))), F.lit("Unknown")).alias("entity_type"),
        F.array_sort(F.collect_set("name")).alias("spellings"),
        F.count("*").alias("mentions"),
    ).withColumn("aliases", F.filter("spellings", lambda x: x != F.col("canonical_name"))).drop("spellings")


def link_entities(rows: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pos, name, type): entities of wiki links, typed by the hint in brackets, else by the name."""
    found = rows.select(F.col(doc).alias("doc"), F.posexplode(wikilinks(F.col(text))).alias("pos", "l"))
    d = found.withColumn("d", disambiguation(F.col("l.target")))
    hinted = hint_type(F.col("d.hint"))
    return d.select("doc", "pos", F.col("d.clean").alias("name"), F.when(hinted != "Unknown", hinted).otherwise(entity_type(F.col("d.clean"))).alias("type"))


def postprocess(found: DataFrame) -> DataFrame:
    """(doc, pos, name, type): normalised names that are no noise, the first of each in a document, types corrected by surface."""
    n = found.withColumn("name", collapse(F.btrim(nfkc("name"), F.lit(" .,;:!?\"'[]{}«»")))).where((F.col("name") != "") & ~is_noise(F.col("name")))
    typed = n.withColumn("type", F.when(any_match(F.col("name"), L.ORG_SURFACE), "Organization").otherwise(F.col("type")))
    return typed.groupBy("doc", F.lower("name").alias("key")).agg(F.min(F.struct("pos", "name", "type")).alias("s")).select("doc", "s.pos", "s.name", "s.type")


def parse_triples(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, subject, relation, object, confidence): triples of model output, fences aside; kept relations with both ends."""
    from grafonda.functions.text import json_array

    schema = "array<struct<subject:string,relation:string,object:string,confidence:double>>"
    t = rows.select(key, F.explode(F.from_json(json_array(F.col(raw)), schema)).alias("t"))
    out = t.select(key, F.trim("t.subject").alias("subject"), F.trim("t.relation").alias("relation"), F.trim("t.object").alias("object"), F.coalesce("t.confidence", F.lit(1.0)).alias("confidence"))
    return out.where(F.col("relation").isin(*L.RELATION_TYPES) & (F.col("subject") != "") & (F.col("object") != ""))


def typed_facts(facts: DataFrame) -> DataFrame:
    """(title, relation, target, target_type) of facts (title, prop, value): known properties, labels that are no bare ids."""
    spark = facts.sparkSession
    kinds = spark.createDataFrame(list(L.FACT_RELATIONS), "prop string, relation string, target_type string")
    return facts.join(F.broadcast(kinds), "prop").where((F.trim("value") != "") & ~F.col("value").rlike(r"^Q\d+$")).select("title", "relation", F.col("value").alias("target"), "target_type")


def literal_facts(facts: DataFrame) -> DataFrame:
    """(title, name, value) of literal properties; times are cut to their year."""
    spark = facts.sparkSession
    kinds = spark.createDataFrame(list(L.FACT_LITERALS), "prop string, name string")
    year = F.when(F.contains("value", F.lit("T")), F.substring_index(F.ltrim(F.col("value"), F.lit("+")), "-", 1)).otherwise(F.col("value"))
    return facts.join(F.broadcast(kinds), "prop").where(F.trim("value") != "").select("title", "name", year.alias("value"))


def bio_spans(tokens: DataFrame, doc: str = "doc", pos: str = "pos", word: str = "word", tag: str = "tag") -> DataFrame:
    """(doc, pos, name, type) of B/I/O tagged words: a B, or an I of another kind than the span before, opens a span."""
    from pyspark.sql import Window

    w = Window.partitionBy(doc).orderBy(pos)
    kind = F.when(F.col(tag).rlike("^[BI]-"), F.substring(F.col(tag), F.lit(3), F.length(tag)))
    begins = kind.isNotNull() & (F.col(tag).startswith("B-") | F.lag(kind).over(w).isNull() | (F.lag(kind).over(w) != kind))
    marked = tokens.withColumns({"_k": kind, "_b": begins})
    grouped = marked.withColumn("_s", F.sum(F.col("_b").cast("int")).over(w)).where("_k is not null")
    spans = grouped.groupBy(F.col(doc).alias("doc"), "_s").agg(F.min(pos).alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, word))), lambda s: s[word]), " ").alias("name"), F.min("_k").alias("t"))
    kinds = F.create_map(*[F.lit(x) for kv in {"PER": "Person", "PERSON": "Person", "ORG": "Organization", "LOC": "Location", "GPE": "Location", "MISC": "Work", "MISCELLANEOUS": "Work"}.items() for x in kv])
    return spans.select("doc", "pos", "name", F.coalesce(F.try_element_at(kinds, F.upper("t")), F.lit("Unknown")).alias("type"))


def resolved_triples(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """(src, rel_type, dst, confidence): triples whose both ends are the exact name of an entity(entity_id, name); one edge a relation, the surest."""
    ends = lambda a, c: entities.select(F.col("entity_id").alias(a), F.col("name").alias(c))
    named = triples.join(ends("src", "subject"), "subject").join(ends("dst", "object"), "object")
    return named.groupBy("src", F.col("relation").alias("rel_type"), "dst").agg(F.max("confidence").alias("confidence"))


def typed_labels(entities: DataFrame) -> DataFrame:
    """`entities` with `typed`: whether they carry a label of their own."""
    return entities.withColumn("typed", F.coalesce(F.col("label"), F.lit("Unknown")).isin("Person", "Organization", "Location", "Work"))


def without_noise(entities: DataFrame) -> DataFrame:
    """`entities` without untyped ones whose name is under two characters or all digits and marks."""
    noise = (F.length("entity") < 2) | F.col("entity").rlike(r"^[0-9,.%\s]+$")
    return typed_labels(entities).where(F.col("typed") | ~noise).drop("typed")


#: a blank and the three characters on either side of it, by which names and texts meet
_AROUND_BLANK = "(?s).{3} .{3}"


def contained(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """(chunk_id, entity): distinct names (page_id, entity) that stand in the texts (chunk_id, page_id, low) of their page, anywhere in a word too.

    A text that holds a name holds what is around the name's first blank: names meet only texts that do
    and are then looked for. Names without three characters on either side of a blank are looked for
    in all texts of their page, many of them in separate tasks.
    """
    chunks = materialise(chunks.where("page_id is not null and low is not null"), "texts")
    keyed = materialise(names.select("page_id", "entity", F.regexp_extract("entity", _AROUND_BLANK, 0).alias("gram")).distinct(), "names")
    every = F.regexp_extract_all("low", F.lit(f"(?=({_AROUND_BLANK}))"), F.lit(1))  # matches may overlap
    # hashes travel instead of texts: a collision adds a candidate, and candidates are looked for in the text
    place, key = F.xxhash64("chunk_id").alias("place"), lambda gram: F.xxhash64("page_id", gram)
    grams = chunks.select(place, F.explode(F.transform(F.array_distinct(every), key)).alias("key"))
    likely = grams.join(keyed.where("gram <> ''").select(key(F.col("gram")).alias("key"), "page_id", "entity"), "key").drop("key")
    found = likely.join(chunks.select("*", place), ["place", "page_id"]).where(F.contains("low", "entity"))
    rest = crossed(chunks, keyed.where("gram = ''").select("page_id", "entity"), "page_id").where(F.contains("low", "entity"))
    return found.select("chunk_id", "entity").unionByName(rest.select("chunk_id", "entity")).distinct()


def backfilled(chunks: DataFrame, most: int = 25) -> DataFrame:
    """(chunk_id, name): names found anywhere on a page, in the chunks of the page that hold them.

    A page's names are its first `most` in the order of its chunks; names do not run on from one chunk
    to the next. Chunks are read one by one and only their names meet, so a page of any size is no
    single task.
    """
    from pyspark.sql import Window

    from grafonda.functions.text import simple_names

    found = chunks.select("page_id", "seq", "chunk_id", F.posexplode(simple_names(F.col("text"), most)).alias("pos", "name"))
    first = found.groupBy("page_id", F.lower("name").alias("key")).agg(F.min(F.struct("seq", "chunk_id", "pos", "name")).alias("s"))
    w = Window.partitionBy("page_id").orderBy("s")
    kept = first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("page_id", "s.name", "key")
    return chunks.select("page_id", "chunk_id", F.lower("text").alias("low")).join(kept, "page_id").where(F.contains("low", "key")).select("chunk_id", "name")
