"""Text functions, extraction and resolution over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from grafonda.functions import lexicon as L
from grafonda.functions import text as T
from grafonda.functions import udfs
from grafonda.functions.plainform import nfc, nfkc
from grafonda.operators import quality as Q
from grafonda.operators import resolution as RES
from grafonda.plans import kg
from grafonda.plans.kg import query, with_kg
from grafonda.session import table

def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _any(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{T.bounded(p).replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


@query(r"""SELECT doc_id, i - 1 AS paragraph_index, md5(doc_id || ':' || (i - 1)) AS paragraph_id, p[i] AS text FROM (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n{2,}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 50) AS p FROM documents), unnest(range(1, len(p) + 1)) AS t(i)""")
def scan_paragraph_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("paragraph_index", "text"))
    return d.select("doc_id", "paragraph_index", F.md5(F.concat_ws(":", "doc_id", "paragraph_index")).alias("paragraph_id"), "text")


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS t FROM documents)
  SELECT doc_id, i AS seq, substr(t, i * 780 + 1, 900) AS chunk FROM (SELECT doc_id, t, length(t) AS n FROM d WHERE length(t) > 0),
  unnest(range(0, CASE WHEN n <= 900 THEN 1 ELSE ceil((n - 900) / 780.0)::BIGINT + 1 END)) AS u(i)""")
def chunk_fixed_window(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.windows(F.col("text"))).alias("seq", "chunk"))


@query(None)
def chunk_structure_aware(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "title", F.inline(udfs.structured_chunks_udf("text", "title")))


@query(r"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '[\s\p{Z}]+', ' ', 'g')) AS clean FROM documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.collapse(nfc("text")).alias("clean"))


@query(None)
def strip_markup(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.strip_markup(udfs.strip_templates("text")).alias("clean"))


@query(None)
def clean_wikitext(spark, sf):
    return table(spark, sf, "documents").select("doc_id", udfs.clean_wikitext("text").alias("clean"))


_MARKED = "(SELECT DISTINCT qa_id, '[[' || array_to_string(source_pages, ' (thành phố)|nơi này]] và [[') || ']]' AS text FROM qa_pairs WHERE qa_id IS NOT NULL AND len(list_filter(source_pages, lambda t: t IS NOT NULL)) = len(source_pages) AND len(source_pages) > 0)"


def _marked(spark, sf):
    """Titles behind a question as links of a text, all but the last with a hint and a display text."""
    q = table(spark, sf, "qa_pairs").where(F.col("qa_id").isNotNull() & (F.size("source_pages") > 0) & ~F.exists("source_pages", lambda t: t.isNull()))
    return q.select("qa_id", F.concat(F.lit("[["), F.array_join("source_pages", " (thành phố)|nơi này]] và [["), F.lit("]]")).alias("text")).distinct()


@query(rf"""WITH l AS (SELECT qa_id, text, i, a[i] AS x FROM (SELECT qa_id, text, regexp_extract_all(text, '\[\[([^\[\]]+)\]\]', 1) AS a FROM {_MARKED}), unnest(range(1, len(a) + 1)) AS u(i)),
  s AS (SELECT qa_id, text, i, trim(split_part(trim(x), '|', 1)) AS target FROM l)
  SELECT qa_id, upper(substr(t, 1, 1)) || substr(t, 2) AS target FROM (SELECT qa_id, text, min_by(replace(trim(split_part(target, '#', 1)), '_', ' '), i) AS t, lower(replace(trim(split_part(target, '#', 1)), '_', ' ')) AS k FROM s
  WHERE target <> '' AND trim(split_part(target, '#', 1)) <> '' AND NOT regexp_matches(lower(target), '^(file|image|category|template|wikipedia|tập tin|hình|thể loại|bản mẫu|wikt|s|q|b|n|v|commons):') GROUP BY qa_id, text, k)""")
def extract_links(spark, sf):
    return _marked(spark, sf).select("qa_id", F.explode(T.wikilinks(F.col("text"))).alias("l")).select("qa_id", F.col("l.target").alias("target"))


@query(r"""SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
  FROM (SELECT DISTINCT chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(page_id || '#chunk#' || seq)) AS h FROM chunks WHERE page_id IS NOT NULL AND seq IS NOT NULL)""")
def chunk_ids_uuid5(spark, sf):
    c = table(spark, sf, "chunks").where("page_id is not null and seq is not null").select("chunk_id", "page_id", "seq").distinct()
    return c.select("chunk_id", T.uuid5(F.concat(F.col("page_id"), F.lit("#chunk#"), F.col("seq").cast("string"))).alias("uuid")).distinct()


_TEXTS = "(SELECT DISTINCT text FROM ner_mentions WHERE text IS NOT NULL)"


def _names(spark, sf):
    return table(spark, sf, "ner_mentions").select("text").where("text is not null").distinct()


_CUT = "(SELECT text FROM (SELECT DISTINCT text FROM ner_mentions WHERE text IS NOT NULL) UNION SELECT DISTINCT text || ' (thành phố' FROM ner_mentions WHERE text IS NOT NULL UNION SELECT DISTINCT text || ' (sông)' FROM ner_mentions WHERE text IS NOT NULL)"
_CLOSED, _OPEN = r"[\s\p{Z}]*\(([^)]+)\)[\s\p{Z}]*$", r"[\s\p{Z}]*\(([^)]*)$"


@query(f"""SELECT text, CASE WHEN closed AND c <> '' THEN c WHEN NOT closed AND open AND o <> '' THEN o ELSE text END AS clean,
  CASE WHEN closed AND c <> '' THEN trim(regexp_extract(text, '{_CLOSED}', 1)) WHEN NOT closed AND open AND o <> '' THEN trim(regexp_extract(text, '{_OPEN}', 1)) ELSE '' END AS hint
  FROM (SELECT text, regexp_matches(text, '{_CLOSED}') AS closed, regexp_matches(text, '{_OPEN}') AS open, trim(regexp_replace(text, '{_CLOSED}', '')) AS c, trim(regexp_replace(text, '{_OPEN}', '')) AS o FROM {_CUT})""")
def disambiguation(spark, sf):
    """Names as found, with a hint behind them, and with one whose bracket is not closed."""
    n = _names(spark, sf)
    every = n.union(n.select(F.concat("text", F.lit(" (thành phố")))).union(n.select(F.concat("text", F.lit(" (sông)")))).distinct()
    return every.withColumn("d", T.disambiguation(F.col("text"))).select("text", "d.clean", "d.hint")


def _type_sql(column: str) -> str:
    low, words = f"lower({column})", rf"list_filter(string_split(trim(regexp_replace(lower({column}), '[\s\p{{Z}}]+', ' ', 'g')), ' '), lambda w: w <> '')"
    single, phrase = (lambda k: [x for x in k if " " not in x]), (lambda k: [x for x in k if " " in x])
    begins = lambda k: f"list_bool_or(list_transform({_quoted(single(k))}, lambda k: starts_with({low}, k || ' ') OR starts_with({low}, k || '_')))"
    holds = lambda k: f"list_bool_or(list_transform({_quoted(k)}, lambda k: contains({low}, k)))"
    suffix = rf"lower(trim(regexp_replace(regexp_extract({column}, '^[^,]*,(.*)$', 1), '[\s\p{{Z}}]+', ' ', 'g')))"
    return f"""CASE WHEN {holds(phrase(L.ORG_KEYWORDS))} OR {begins(L.ORG_KEYWORDS)} OR list_has_any({words}, {_quoted(single(L.ORG_KEYWORDS))}) THEN 'Organization'
      WHEN {holds(phrase(L.LOCATION_KEYWORDS))} OR {begins(L.LOCATION_KEYWORDS)} OR list_has_any({words}[2:], {_quoted(single(L.LOCATION_KEYWORDS))}) THEN 'Location'
      WHEN {holds(L.WORK_KEYWORDS)} THEN 'Work'
      WHEN len({words}) >= 2 AND list_contains({_quoted(L.FAMILY_NAMES)}, {words}[1]) THEN 'Person'
      WHEN {_any(column, L.ORG_SURFACE)} THEN 'Organization'
      WHEN contains({column}, ',') AND (list_has_any(string_split({suffix}, ' '), {_quoted(L.LOCATION_KEYWORDS)}) OR list_contains({_quoted(L.GEO_SUFFIXES)}, {suffix})) THEN 'Location'
      WHEN NOT contains({column}, ',') AND len({words}) BETWEEN 2 AND 4 AND list_bool_and(list_transform(list_filter(string_split(trim(regexp_replace({column}, '[\\s\\p{{Z}}]+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: regexp_matches(w, '^\\p{{Lu}}')))
        THEN CASE WHEN list_contains({_quoted(L.GEO_PREFIXES)}, {words}[1]) THEN 'Location' ELSE 'Person' END
      ELSE 'Unknown' END"""


@query(f"SELECT text, {_type_sql('text')} AS type FROM {_TEXTS}")
def ner_classify(spark, sf):
    return _names(spark, sf).select("text", T.entity_type(F.col("text")).alias("type"))


@query(rf"SELECT text, (length(text) <= 1 OR (length(text) <= 2 AND NOT contains(trim(text), ' ')) OR (regexp_matches(text, '^\p{{Ll}}') AND NOT regexp_matches(text, '(?s)^.[\s\S]*\p{{Lu}}')) OR {_any('text', L.NOISE + L.LINK_NOISE)}) AS noise FROM {_TEXTS}")
def ner_noise(spark, sf):
    return _names(spark, sf).select("text", T.is_noise(F.col("text")).alias("noise"))


@query(rf"""SELECT count(*) AS names, count(*) FILTER (WHERE noise) AS noisy, round(count(*) FILTER (WHERE noise) / count(*), 6) AS noise_rate, count(*) FILTER (WHERE surface AND NOT noise) AS type_errors FROM (
  SELECT text, (length(text) <= 1 OR (length(text) <= 2 AND NOT contains(trim(text), ' ')) OR (regexp_matches(text, '^\p{{Ll}}') AND NOT regexp_matches(text, '(?s)^.[\s\S]*\p{{Lu}}')) OR {_any('text', L.NOISE)}) AS noise, {_any('text', L.ORG_SURFACE + L.ORG_SURFACE_CHECK)} AS surface FROM {_TEXTS})""")
def ner_type_errors(spark, sf):
    n = _names(spark, sf).select(T.is_noise(F.col("text"), links=False).alias("noise"), T.any_match(F.col("text"), L.ORG_SURFACE + L.ORG_SURFACE_CHECK).alias("surface"))
    return n.agg(F.count("*").alias("names"), F.count_if("noise").alias("noisy"), F.round(F.count_if("noise") / F.count("*"), 6).alias("noise_rate"), F.count_if(F.col("surface") & ~F.col("noise")).alias("type_errors"))


@query(r"""WITH m AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)(?:$|[^\p{L}\p{N}_])', 1) AS a FROM documents),
  n AS (SELECT doc_id, i, regexp_replace(a[i], '(\s)\s', '\1', 'g') AS name FROM m, unnest(range(1, len(a) + 1)) AS u(i)),
  f AS (SELECT doc_id, min(i) AS i, min_by(name, i) AS name FROM n WHERE length(name) >= 3 GROUP BY doc_id, lower(name))
  SELECT doc_id, name FROM (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f) WHERE r <= 25""")
def ner_simple(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(T.simple_names(F.col("text"))).alias("name"))


_SIMPLE = r"""m AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)(?:$|[^\p{L}\p{N}_])', 1) AS a FROM documents),
  n AS (SELECT doc_id, i, regexp_replace(a[i], '(\s)\s', '\1', 'g') AS name FROM m, unnest(range(1, len(a) + 1)) AS u(i)),
  f AS (SELECT doc_id, min(i) AS i, min_by(name, i) AS name FROM n WHERE length(name) >= 3 GROUP BY doc_id, lower(name)),
  sn AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f)"""


@query(f"""WITH {_SIMPLE}, c AS (SELECT doc_id, r - 1 AS pos, trim(regexp_replace(trim(name, ' .,;:!?"''[]{{}}«»'), '[\\s\\p{{Z}}]+', ' ', 'g')) AS name, name AS raw FROM sn WHERE r <= 25),
  k AS (SELECT doc_id, pos, name, {_type_sql('raw')} AS t FROM c WHERE name <> ''),
  x AS (SELECT doc_id, pos, name, CASE WHEN {_any('name', L.ORG_SURFACE)} THEN 'Organization' ELSE t END AS type FROM k
    WHERE NOT (length(name) <= 1 OR (length(name) <= 2 AND NOT contains(trim(name), ' ')) OR (regexp_matches(name, '^\\p{{Ll}}') AND NOT regexp_matches(name, '(?s)^.[\\s\\S]*\\p{{Lu}}')) OR {_any('name', L.NOISE + L.LINK_NOISE)}))
  SELECT doc_id AS doc, min(pos) AS pos, min_by(name, pos) AS name, min_by(type, pos) AS type FROM x GROUP BY doc_id, lower(name)""")
def ner_postprocess(spark, sf):
    found = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(T.simple_names(F.col("text"))).alias("pos", "name")).withColumn("type", T.entity_type(F.col("name")))
    return RES.postprocess(found)


@query(None)
def ner_wikilinks(spark, sf):
    return RES.postprocess(RES.link_entities(_marked(spark, sf), "qa_id", "text"))


_BARE = r"strip_accents(nfc_normalize(trim(regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g'))))"


_KEY_OF = r"strip_accents(nfc_normalize(trim(regexp_replace(lower({0}), '[\s\p{{Z}}]+', ' ', 'g'))))"
_KNOWN = "(VALUES " + ", ".join(f"('{a}', '{c}')" for c, others in L.KNOWN_ALIASES.items() for a in (c, *others)) + ") AS t(alias, canonical)"


@query(rf"""WITH s AS (SELECT {_KEY_OF.format('alias')} AS bare, min(canonical) AS canonical FROM {_KNOWN} GROUP BY 1),
  m AS (SELECT DISTINCT mention_id, text, entity_type, {_BARE} AS bare FROM ner_mentions WHERE trim(text) <> ''),
  j AS (SELECT m.*, s.canonical, coalesce({_KEY_OF.format('s.canonical')}, m.bare) AS k FROM m LEFT JOIN s USING (bare)),
  g AS (SELECT k AS entity_key, coalesce(min(canonical), min_by(text, mention_id)) AS canonical_name, coalesce(arg_max(entity_type, mention_id) FILTER (WHERE coalesce(entity_type, 'Unknown') <> 'Unknown'), 'Unknown') AS entity_type, count(*) AS mentions, list_sort(list_distinct(list(text))) AS spellings FROM j GROUP BY k)
  SELECT entity_key, canonical_name, entity_type, mentions, array_to_string(list_filter(spellings, lambda x: x <> canonical_name), '|') AS aliases FROM g""")
def entity_resolution(spark, sf):
    m = table(spark, sf, "ner_mentions").select("mention_id", "text", "entity_type").distinct()
    return RES.resolve(m, "text", "entity_type", "mention_id").select("entity_key", "canonical_name", "entity_type", "mentions", F.array_join("aliases", "|").alias("aliases"))


@query(with_kg("SELECT DISTINCT ch.chunk_id, e.entity FROM ch JOIN (SELECT DISTINCT ch.page_id, mn.entity FROM mn JOIN ch ON ch.chunk_id = mn.chunk_id) e ON e.page_id = ch.page_id WHERE contains(lower(ch.text), e.entity)"))
def mentions_containment(spark, sf):
    """Chunks of a page that hold a name mentioned anywhere on the page."""
    ch = kg.chunks(spark, sf).select("chunk_id", "page_id", F.lower("text").alias("low"))
    names = kg.mentions(spark, sf).join(ch.select("chunk_id", "page_id"), "chunk_id").select("page_id", "entity").distinct()
    return RES.contained(ch, names)


@query(with_kg(r"""SELECT chunk_id, entity, e <> '' AND (contains(t, e) OR (len(w) >= 2 AND contains(t, array_to_string(w[-2:], ' '))) OR (len(w) >= 3 AND contains(t, w[1] || ' ' || w[-1]))) AS grounded
  FROM (SELECT mn.chunk_id, mn.entity, trim(lower(replace(nfc_normalize(ch.text), chr(160), ' '))) AS t, trim(lower(nfc_normalize(mn.entity))) AS e, string_split(trim(lower(nfc_normalize(mn.entity))), ' ') AS w FROM mn JOIN ch ON ch.chunk_id = mn.chunk_id)"""))
def mentions_grounded(spark, sf):
    j = kg.mentions(spark, sf).join(kg.chunks(spark, sf).select("chunk_id", "text"), "chunk_id")
    name = nfkc("entity")
    return j.select("chunk_id", "entity", nfkc("text").alias("t"), name.alias("e")).select("chunk_id", "entity", T.grounded(F.col("e"), F.col("e"), F.col("t")).alias("grounded"))


@query(r"""SELECT DISTINCT qa_id, trim(regexp_replace(regexp_replace(lower(answer), '[^\p{L}\p{N}_\s]', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS spaced, trim(regexp_replace(regexp_replace(lower(answer), '[^\p{L}\p{N}_\s]', '', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS bare,
  regexp_replace(lower(trim(answer)), '[.\s]+$', '') AS untailed, trim(regexp_replace(regexp_replace(lower(answer), '\([^)]*\)', '', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS unbracketed, trim(regexp_replace(lower(answer), '[\s\p{Z}]+', ' ', 'g')) AS collapsed,
  nullif(replace(regexp_extract(answer, '([0-9,.]+)', 1), ',', ''), '') AS number FROM qa_pairs WHERE answer IS NOT NULL""")
def answer_normalizers(spark, sf):
    a = F.col("answer")
    return table(spark, sf, "qa_pairs").where("answer is not null").select("qa_id", T.answer_spaced(a).alias("spaced"), T.answer_bare(a).alias("bare"), T.answer_untailed(a).alias("untailed"), T.answer_unbracketed(a).alias("unbracketed"), T.answer_collapsed(a).alias("collapsed"), T.first_number(a).alias("number")).distinct()


@query(r"SELECT DISTINCT qa_id, array_to_string(list_filter(regexp_extract_all(question, '([A-ZÀ-Ỹ][a-zà-ỹ]+(?:\s+[A-ZÀ-Ỹ][a-zà-ỹ]+)*)', 1), lambda x: length(x) > 3), '|') AS terms FROM qa_pairs WHERE question IS NOT NULL")
def key_terms(spark, sf):
    return table(spark, sf, "qa_pairs").where("question is not null").select("qa_id", F.array_join(T.key_terms(F.col("question")), "|").alias("terms")).distinct()


@query("""SELECT 'N' || n_nationkey AS id, 'N' || n_nationkey AS subject, 'LOCATED_IN' AS relation, 'R' || n_regionkey AS object, 1.0::DOUBLE AS confidence FROM nation""")
def relation_triples(spark, sf):
    """Model output in fences, with an unknown relation and an empty end in between, back to triples."""
    n = table(spark, sf, "nation")
    raw = F.concat(F.lit('```json\n[{"subject": "N'), F.col("n_nationkey").cast("string"), F.lit('", "relation": "LOCATED_IN", "object": "R'), F.col("n_regionkey").cast("string"), F.lit('"}, {"subject": "x", "relation": "LIKES", "object": "y"}, {"subject": "", "relation": "PART_OF", "object": "y"}]\n```'))
    return RES.parse_triples(n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), raw.alias("raw")), "id", "raw")


@query(r"""WITH w AS (SELECT DISTINCT upper(trim(title)) AS title FROM pages WHERE trim(title) <> '' AND try_cast(id AS BIGINT) % 2 = 0 UNION SELECT DISTINCT trim(title) FROM pages WHERE trim(title) <> ''),
  x AS (SELECT w.title, min(c.page_id) AS page_id FROM w JOIN chunks_v2 c ON c.page_title = w.title GROUP BY 1)
  SELECT * FROM x UNION ALL SELECT w.title, min(c.page_id) FROM w JOIN chunks_v2 c ON lower(c.page_title) = lower(w.title) WHERE w.title NOT IN (SELECT title FROM x) GROUP BY 1""")
def scan_point_lookup(spark, sf):
    """Titles looked up exactly, those not found again regardless of case; half of the titles are asked for in capitals as well."""
    c = table(spark, sf, "chunks_v2").where("page_title is not null").select("page_title", "page_id")
    p = table(spark, sf, "pages").select("id", F.trim("title").alias("title")).where("title <> ''")
    wanted = p.select("title").union(p.where("try_cast(id as bigint) % 2 = 0").select(F.upper("title"))).distinct()
    exact = wanted.join(c, wanted.title == c.page_title).groupBy("title").agg(F.min("page_id").alias("page_id"))
    rest = wanted.join(c.select("page_title").distinct(), wanted.title == F.col("page_title"), "left_anti")
    loose = rest.join(c, F.lower("title") == F.lower("page_title")).groupBy("title").agg(F.min("page_id").alias("page_id"))
    return exact.unionAll(loose)


@query("SELECT doc_id FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def keyset_page(spark, sf):
    return table(spark, sf, "documents").where("doc_id > 100").select("doc_id").orderBy("doc_id").limit(50)


@query("SELECT doc_id FROM documents WHERE length(trim(text)) >= 200")
def min_length(spark, sf):
    return table(spark, sf, "documents").where(F.length(F.trim("text")) >= 200).select("doc_id")


@query("SELECT DISTINCT qa_id, 'Dạng ' || question_type || ' (' || hops || ' bước): ' || question AS prompt FROM qa_pairs WHERE question IS NOT NULL AND question_type IS NOT NULL AND hops IS NOT NULL")
def prompt_rendering(spark, sf):
    t = F.lit("Dạng {type} ({hops} bước): {question}")
    return table(spark, sf, "qa_pairs").where("question is not null and question_type is not null and hops is not null").select("qa_id", T.filled(t, type=F.col("question_type"), hops=F.col("hops").cast("string"), question=F.col("question")).alias("prompt")).distinct()


@query(None)
def ner_duplicates(spark, sf):
    """Registry names in groups of alike ones, by a sorted neighbourhood of 50 places."""
    r = table(spark, sf, "resolved_entities").where("trim(canonical_name) <> ''").select(F.col("canonical_name").alias("name"), F.coalesce("entity_type", F.lit("Unknown")).alias("label"))
    return Q.duplicate_groups(r).withColumn("types", F.array_join("types", ", "))


@query(None)
def ner_fragmentation(spark, sf):
    """Duplicate groups among the registry's names that are no noise, and their share."""
    r = table(spark, sf, "resolved_entities").where("trim(canonical_name) <> ''").select(F.col("canonical_name").alias("name"), F.coalesce("entity_type", F.lit("Unknown")).alias("label")).distinct()
    clean = r.where(~T.is_noise(F.col("name"), links=False))
    groups = Q.duplicate_groups(clean).agg(F.count("*").alias("duplicate_groups"))
    return clean.agg(F.count("*").alias("names")).crossJoin(groups).withColumn("fragmentation_rate", F.round(F.col("duplicate_groups") / F.col("names"), 6))


_VI = r"'(?:^|[^\p{L}\p{N}_])([A-ZÀ-Ỹ][a-zà-ỹ]+(?:\s+[A-ZÀ-Ỹ][a-zà-ỹ]+){1,5})(?:$|[^\p{L}\p{N}_])'"


@query(rf"""SELECT doc_id, min_by(name, i) AS name FROM (SELECT doc_id, i, regexp_replace(a[i], '(\s)\s', '\1', 'g') AS name FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), {_VI}, 1) AS a FROM documents), unnest(range(1, len(a) + 1)) AS u(i)) GROUP BY doc_id, lower(name)""")
def ner_vietnamese(spark, sf):
    """Runs of two to six capitalised words, accents included."""
    return table(spark, sf, "documents").select("doc_id", F.explode(T.vietnamese_names(F.col("text"))).alias("name"))


_ENTITIES_OF = r"""CASE WHEN len(regexp_extract_all(rest, '([A-ZÀ-Ỹ][a-zà-ỹ]+(?:\s+[A-ZÀ-Ỹ][a-zà-ỹ]+)*)', 1)) > 0 THEN regexp_extract_all(rest, '([A-ZÀ-Ỹ][a-zà-ỹ]+(?:\s+[A-ZÀ-Ỹ][a-zà-ỹ]+)*)', 1)
  WHEN len(regexp_extract_all(question, '"([^"]+)"', 1)) > 0 THEN regexp_extract_all(question, '"([^"]+)"', 1)
  WHEN len(list_filter(string_split(trim(regexp_replace(rest, '[\s\p{Z}]+', ' ', 'g')), ' '), lambda w: w <> '')) > 0 THEN [array_to_string(list_filter(string_split(trim(regexp_replace(rest, '[\s\p{Z}]+', ' ', 'g')), ' '), lambda w: w <> '')[1:3], ' ')] ELSE [] END"""
_RESTED = f"(SELECT DISTINCT qa_id, question, regexp_replace(trim(question), '(?i)^({T._OPENERS})\\s*', '') AS rest FROM qa_pairs WHERE question IS NOT NULL)"


@query(f"SELECT qa_id, array_to_string({_ENTITIES_OF}, '|') AS names FROM {_RESTED}")
def question_entities(spark, sf):
    """What each question is about."""
    return table(spark, sf, "qa_pairs").where("question is not null").select("qa_id", "question").distinct().select("qa_id", F.array_join(T.question_entities(F.col("question")), "|").alias("names"))


@query(with_kg(r"""SELECT ch.chunk_id, k.name FROM ch JOIN (
  SELECT page_id, name FROM (SELECT page_id, key, name, row_number() OVER (PARTITION BY page_id ORDER BY seq NULLS FIRST, chunk_id, i, name) AS r FROM (
    SELECT page_id, lower(name) AS key, unnest([arg_min({'s': seq, 'c': chunk_id, 'i': i, 'n': name}, (coalesce(seq, -1), chunk_id, i, name))], recursive := true) FROM (
      SELECT page_id, seq, chunk_id, i, name, row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS q FROM (
        SELECT page_id, seq, chunk_id, min(i) AS i, min_by(name, i) AS name FROM (SELECT page_id, seq, chunk_id, i, regexp_replace(a[i], '(\s)\s', '\1', 'g') AS name FROM (SELECT page_id, seq, chunk_id, regexp_extract_all(regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)(?:$|[^\p{L}\p{N}_])', 1) AS a FROM ch WHERE page_id IS NOT NULL), unnest(range(1, len(a) + 1)) AS u(i)) WHERE length(name) >= 3 GROUP BY page_id, seq, chunk_id, lower(name))) WHERE q <= 25 GROUP BY page_id, lower(name)) AS z(page_id, key, seq, chunk_id, i, name)) WHERE r <= 25) k ON k.page_id = ch.page_id WHERE contains(lower(ch.text), lower(k.name))"""))
def backfill_entities(spark, sf):
    """Names found anywhere on a page in the chunks of the page that hold them."""
    return RES.backfilled(kg.chunks(spark, sf).where("page_id is not null"))


@query(with_kg(r"SELECT entity, label FROM en WHERE label IN ('Person', 'Organization', 'Location', 'Work') OR NOT (length(entity) < 2 OR regexp_matches(entity, '^[0-9,.%\s]+$'))"))
def noise_cleanup(spark, sf):
    return RES.without_noise(kg.entities(spark, sf))


@query("WITH rel AS (SELECT n_name AS s, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT 'N:' || s AS src, 'LOCATED_IN' AS rel_type, 'R:' || o AS dst, 1.0::DOUBLE AS confidence FROM rel")
def relation_edges(spark, sf):
    """Triples given by name, some of them unknown, as edges between entities."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    known = n.select(F.concat(F.lit("N:"), F.col("n_name")).alias("entity_id"), F.col("n_name").alias("name")).unionAll(r.select(F.concat(F.lit("R:"), F.col("r_name")), "r_name"))
    t = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("subject"), F.lit("LOCATED_IN").alias("relation"), F.col("r_name").alias("object"), F.lit(1.0).alias("confidence"))
    stray = t.withColumn("object", F.lit("ATLANTIS"))
    return RES.resolved_triples(t.unionAll(t.withColumn("confidence", F.lit(0.5))).unionAll(stray), known)


@query("SELECT count(*) AS entities, sum(len(list_filter(coalesce(aliases, []), lambda a: a IS NOT NULL))) AS aliases FROM resolved_entities")
def entity_totals(spark, sf):
    held = F.size(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull()))
    return table(spark, sf, "resolved_entities").agg(F.count("*").alias("entities"), F.sum(held).alias("aliases"))


@query("SELECT len(embedding) AS dimension, count(*) AS n FROM chunks WHERE embedding IS NOT NULL GROUP BY 1")
def vector_dimensions(spark, sf):
    return table(spark, sf, "chunks").where("embedding is not null").groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("n"))
