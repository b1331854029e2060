"""Scalar text functions as Column expressions; everything here stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from grafonda.functions import lexicon as L

WORD_BEGIN, WORD_END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def bounded(pattern: str) -> str:
    """A lexicon pattern for every regex dialect: its word limits written out for all letters, as dialects read \\b differently."""
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    rest = pattern.removeprefix("(?i)")
    begins = rest.startswith(r"\b")
    rest = rest[2:] if begins else rest
    return flag + (WORD_BEGIN if begins else "") + rest.replace(r"\b", WORD_END)


def _any_case(pattern: str) -> str:
    """The pattern with case set aside for all letters; the JVM's flag alone means ASCII letters."""
    return pattern.replace("(?i)", "(?iu)")


def any_match(column: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [column.rlike(_any_case(bounded(p))) for p in patterns])


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once; inside a lambda an expression would run once per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(column: Column) -> Column:
    """White space runs of any kind as one blank, none at the ends."""
    return F.trim(F.regexp_replace(column, r"[\s\p{Z}]+", " "))


def windows(column: Column, size: int = 900, overlap: int = 120) -> Column:
    """array<string>: fixed windows over the collapsed text; the last one is the first to reach the end."""
    step = size - overlap

    def cut(text):
        n = F.length(text)
        last = F.greatest(F.ceil((n - size) / step).cast("int"), F.lit(0))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    return let(collapse(column), cut)


def paragraphs(column: Column, least: int = 50) -> Column:
    """array<string>: parts between blank lines, trimmed, of at least `least` characters."""
    return F.filter(F.transform(F.split(column, r"\n{2,}"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) >= least)


def terms(column: Column) -> Column:
    """array<string>: lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(column), F.lit(r"([\p{L}\p{N}]+)"), 1)


_CAPITALISED = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"


def doubled_limits(column: Column) -> Column:
    """Every character that is no word character twice, so that patterns may consume one at either side."""
    return F.regexp_replace(column, r"([^\p{L}\p{N}_])", "$1$1")


def simple_names(column: Column, most: int = 25) -> Column:
    """array<string>: runs of capitalised ASCII words of 3 or more characters, the first spelling of each, at most `most`."""
    found = F.regexp_extract_all(doubled_limits(column), F.lit(r"(?:^|[^\p{L}\p{N}_])" + _CAPITALISED + r"(?:$|[^\p{L}\p{N}_])"), 1)
    names = F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"(\s)\s", "$1")), lambda x: F.length(x) >= 3)
    none = F.array().cast("array<string>")

    def keep(state, x):
        new = (F.size(state["names"]) < most) & ~F.array_contains(state["keys"], F.lower(x))
        return F.when(new, F.struct(F.array_append(state["names"], x).alias("names"), F.array_append(state["keys"], F.lower(x)).alias("keys"))).otherwise(state)

    return F.aggregate(names, F.struct(none.alias("names"), none.alias("keys")), keep, lambda state: state["names"])


_VIETNAMESE = r"([A-ZÀ-Ỹ][a-zà-ỹ]+(?:\s+[A-ZÀ-Ỹ][a-zà-ỹ]+){1,5})"


def vietnamese_names(column: Column) -> Column:
    """array<string>: runs of two to six capitalised words, the first spelling of each; ranges are those of the code points."""
    found = F.regexp_extract_all(doubled_limits(column), F.lit(r"(?:^|[^\p{L}\p{N}_])" + _VIETNAMESE + r"(?:$|[^\p{L}\p{N}_])"), 1)
    names = F.transform(found, lambda x: F.regexp_replace(x, r"(\s)\s", "$1"))
    return let(names, lambda all_: let(F.transform(all_, lambda x: F.lower(x)), lambda keys: F.filter(all_, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)))


# Words that open a question.
_OPENERS = "ai|gì|nào|ở đâu|khi nào|bao giờ|tại sao|vì sao|như thế nào|cho biết|hãy|mô tả|giới thiệu|tóm tắt|liệt kê"


def question_entities(column: Column) -> Column:
    """array<string>: names a question is about: capitalised runs behind the opening word, else what it quotes, else its first three words."""
    rest = F.regexp_replace(F.trim(column), rf"(?iu)^({_OPENERS})\s*", "")
    names = F.regexp_extract_all(rest, F.lit(r"([A-ZÀ-Ỹ][a-zà-ỹ]+(?:\s+[A-ZÀ-Ỹ][a-zà-ỹ]+)*)"), 1)
    quoted = F.regexp_extract_all(column, F.lit('"([^"]+)"'), 1)
    words = F.filter(F.split(collapse(rest), " "), lambda w: w != "")
    first = F.when(F.size(words) > 0, F.array(F.array_join(F.slice(words, 1, 3), " "))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(names) > 0, names).when(F.size(quoted) > 0, quoted).otherwise(first)


# Question patterns in order, with the template each stands for.
QUESTION_PATTERNS = (
    (r"(?i)(?:thông tin|cho biết|mô tả).*(?:về|của)\s+(.+)", "find_entity"),
    (r"(?i)(.+)\s+là (?:ai|gì|cái gì)", "find_entity"),
    (r"(?i)(?:ai|người nào)\s+(?:là|đã)\s+(.+)", "find_entity_typed"),
    (r"(?i)(?:bài viết|trang|nội dung).*(?:về|của)\s+(.+)", "find_page"),
    (r"(?i)(?:tóm tắt|giới thiệu)\s+(.+)", "find_page"),
    (r"(?i)(.+)\s+(?:liên quan|có quan hệ|kết nối).*(?:với|đến)\s+(.+)", "multi_hop_link"),
    (r"(?i)(?:mối quan hệ|liên hệ).*giữa\s+(.+)\s+và\s+(.+)", "two_entity_intersection"),
    (r"(?i)(?:những|các)\s+(?:thực thể|đối tượng|nhân vật).*(?:trong|của)\s+(.+)", "entity_from_page"),
    (r"(?i)(?:những|các)\s+(?:trang|bài).*(?:liên kết|link).*(?:từ|của)\s+(.+)", "linked_pages"),
)
# Words of a question that asks for a relation.
_RELATING = "liên quan|quan hệ|kết nối|ảnh hưởng|tác động"
#: what each template is in this engine: SQL over pages, chunks, mentions and links
QUERY_TEMPLATES = {
    "find_entity": "SELECT c.chunk_id FROM mentions m JOIN chunks c USING (chunk_id) WHERE contains(m.entity, lower('{first}'))",
    "find_entity_typed": "SELECT c.chunk_id FROM mentions m JOIN entities e USING (entity) JOIN chunks c USING (chunk_id) WHERE contains(m.entity, lower('{first}'))",
    "find_page": "SELECT c.chunk_id FROM pages p JOIN chunks c USING (page_id) WHERE contains(p.title, '{first}')",
    "multi_hop_link": "SELECT c.chunk_id FROM pages p JOIN links l ON l.src = p.page_id JOIN chunks c ON c.page_id = l.dst WHERE contains(p.title, '{first}')",
    "multi_hop_entity_bridge": "SELECT d.chunk_id FROM pages p JOIN chunks c USING (page_id) JOIN mentions m USING (chunk_id) JOIN mentions n ON n.entity = m.entity JOIN chunks d ON d.chunk_id = n.chunk_id WHERE contains(p.title, '{first}') AND d.page_id <> p.page_id",
    "two_entity_intersection": "SELECT m.chunk_id FROM mentions m JOIN mentions n USING (chunk_id) WHERE m.entity = lower('{first}') AND n.entity = lower('{second}')",
    "entity_from_page": "SELECT DISTINCT m.entity FROM pages p JOIN chunks c USING (page_id) JOIN mentions m USING (chunk_id) WHERE p.title = '{first}'",
    "linked_pages": "SELECT c.chunk_id FROM pages p JOIN links l ON l.src = p.page_id JOIN chunks c ON c.page_id = l.dst WHERE p.title = '{first}'",
}


def question_template(column: Column) -> Column:
    """struct<template, first, second>: the first pattern a question fits with its parameters, else a guess from the names it is about."""
    names = question_entities(column)
    relating = F.lower(column).rlike(_RELATING)
    second = F.coalesce(F.get(names, F.lit(1)), F.lit(""))
    guess = F.struct(
        F.when(relating & (F.size(names) >= 2), "two_entity_intersection").when(relating, "multi_hop_entity_bridge").otherwise("find_entity").alias("template"),
        F.get(names, F.lit(0)).alias("first"),
        F.when(relating, second).otherwise("").alias("second"),
    )
    out = F.when(F.lit(False), F.struct(F.lit("").alias("template"), F.lit("").alias("first"), F.lit("").alias("second")))
    for pattern, name in ((_any_case(p), n) for p, n in QUESTION_PATTERNS):
        two = F.trim(F.regexp_extract(column, pattern, 2)) if name == "two_entity_intersection" else F.lit("")
        out = out.when(column.rlike(pattern), F.struct(F.lit(name).alias("template"), F.trim(F.regexp_extract(column, pattern, 1)).alias("first"), two.alias("second")))
    return out.when(F.size(names) > 0, guess)


def template_query(found: Column) -> Column:
    """The query text of a template with its parameters, quotes in them doubled."""
    texts = F.create_map(*[x for kv in QUERY_TEMPLATES.items() for x in map(F.lit, kv)])
    safe = lambda c: F.replace(c, F.lit("'"), F.lit("''"))
    return filled(F.element_at(texts, found["template"]), first=safe(found["first"]), second=safe(found["second"]))


def wikilinks(column: Column) -> Column:
    """array<struct<target, display>>: link targets with display text, the first of each target."""
    inner = F.regexp_extract_all(column, F.lit(r"\[\[([^\[\]]+)\]\]"), 1)

    def parts(x):
        target = F.trim(F.regexp_extract(F.trim(x), r"^([^|]*)", 1))
        shown = F.trim(F.when(F.instr(x, "|") > 0, F.regexp_extract(F.trim(x), r"^[^|]*\|(.*)$", 1)).otherwise(x))
        return F.struct(target.alias("target"), shown.alias("display"))

    kept = F.filter(
        F.transform(inner, parts),
        lambda s: (F.length(s["target"]) > 0) & (F.length(s["display"]) > 0) & ~reduce(lambda a, b: a | b, [F.lower(s["target"]).startswith(p) for p in L.SKIPPED_NAMESPACES]),
    )
    cut = F.transform(kept, lambda s: F.struct(F.trim(F.regexp_extract(s["target"], r"^([^#]*)", 1)).alias("t"), s["display"].alias("display")))
    named = F.transform(
        F.filter(cut, lambda s: F.length(s["t"]) > 0),
        lambda s: F.struct(F.replace(F.concat(F.upper(F.substring(s["t"], 1, 1)), F.substring(s["t"], F.lit(2), F.length(s["t"]))), F.lit("_"), F.lit(" ")).alias("target"), s["display"].alias("display")),
    )
    return let(named, lambda all_: let(F.transform(all_, lambda s: F.lower(s["target"])), lambda keys: F.filter(all_, lambda s, i: F.array_position(keys, F.lower(s["target"])) == i + 1)))


# What is taken out of wiki markup and what stays, in this order.
MARKUP = (
    (r"(?s)<ref[^>]*>.*?</ref>|<ref[^>]*/?>", ""),
    (r"\{\{[^}]*\}\}", ""),
    (r"(?i)\[\[(File|Image|Tập tin|Hình):[^\]]*\]\]", ""),
    (r"(?i)\[\[(Category|Thể loại|Danh mục):[^\]]*\]\]", ""),
    (r"<[^>]+>", ""),
    (r"(?m)^={2,6}\s*(.+?)\s*={2,6}\s*$", "$1"),
    (r"'{2,3}(.+?)'{2,3}", "$1"),
    (r"\[\[([^\[\]|]+)\|([^\[\]]+)\]\]", "$2"),
    (r"\[\[([^\[\]]+)\]\]", "$1"),
)


def strip_markup(column: Column) -> Column:
    """Readable text of wiki markup; nested templates must be gone before (see `udfs.strip_templates`)."""
    text = reduce(lambda t, s: F.regexp_replace(t, _any_case(s[0]), s[1]), MARKUP, column)
    # what is left of a link cut off at the begin of a chunk
    stray = F.ltrim(text).startswith("|") | ((F.instr(text, "]]") > 0) & (F.instr(F.substring_index(text, "]]", 1), "[[") == 0))
    text = F.when(stray, F.regexp_replace(text, r"^(?s)(.*?)[^\[]*?\]\]", "$1")).otherwise(text)
    text = F.regexp_replace(text, r"\[\[[^\]]*$", "")
    text = F.regexp_replace(text, r"\]\]|\[\[", "")
    return collapse(F.regexp_replace(text, r"\|[a-zA-Z_][a-zA-Z0-9_ ]*=[^|]*", ""))


def disambiguation(column: Column) -> Column:
    """struct<clean, hint>: a name and what stood in brackets at its end, closed or not."""
    closed, open_ = r"[\s\p{Z}]*\(([^)]+)\)[\s\p{Z}]*$", r"[\s\p{Z}]*\(([^)]*)$"
    clean_closed, clean_open = F.trim(F.regexp_replace(column, closed, "")), F.trim(F.regexp_replace(column, open_, ""))
    nothing = F.struct(column.alias("clean"), F.lit("").alias("hint"))
    return (
        F.when(column.rlike(closed), F.when(clean_closed != "", F.struct(clean_closed.alias("clean"), F.trim(F.regexp_extract(column, closed, 1)).alias("hint"))).otherwise(nothing))
        .when(column.rlike(open_), F.when(clean_open != "", F.struct(clean_open.alias("clean"), F.trim(F.regexp_extract(column, open_, 1)).alias("hint"))).otherwise(nothing))
        .otherwise(nothing)
    )


def hint_type(hint: Column) -> Column:
    """Entity type named by a hint; Unknown if none."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, words in L.HINTS.items():
        out = out.when(reduce(lambda a, b: a | b, [F.contains(F.lower(hint), F.lit(w)) for w in words]), kind)
    return out.otherwise("Unknown")


def _words_or_phrases(lowered: Column, words: Column, keywords, skip_first: bool) -> Column:
    phrases = [k for k in keywords if " " in k]
    singles = [k for k in keywords if " " not in k]
    where = F.slice(words, 2, 1000) if skip_first else words
    begins = reduce(lambda a, b: a | b, [lowered.startswith(k + " ") | lowered.startswith(k + "_") for k in singles])
    holds = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(k)) for k in phrases])
    return holds | begins | F.arrays_overlap(where, F.array(*map(F.lit, singles)))


def entity_type(name: Column) -> Column:
    """Person, Organization, Location, Work or Unknown, by keywords, family names and surface."""
    lowered = F.lower(name)
    words = F.filter(F.split(collapse(lowered), " "), lambda w: w != "")
    count = F.size(words)
    first = F.element_at(words, 1)
    comma = F.instr(name, ",") > 0
    suffix = F.lower(collapse(F.regexp_extract(name, r"^[^,]*,(.*)$", 1)))
    capitals = F.forall(F.filter(F.split(collapse(name), " "), lambda w: w != ""), lambda w: w.rlike(r"^\p{Lu}"))
    geo = F.arrays_overlap(F.split(suffix, " "), F.array(*map(F.lit, L.LOCATION_KEYWORDS))) | suffix.isin(*L.GEO_SUFFIXES)
    return (
        F.when(_words_or_phrases(lowered, words, L.ORG_KEYWORDS, False), "Organization")
        .when(_words_or_phrases(lowered, words, L.LOCATION_KEYWORDS, True), "Location")
        .when(reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(k)) for k in L.WORK_KEYWORDS]), "Work")
        .when((count >= 2) & first.isin(*L.FAMILY_NAMES), "Person")
        .when(any_match(name, L.ORG_SURFACE), "Organization")
        .when(comma & geo, "Location")
        .when(~comma & (count >= 2) & (count <= 4) & capitals, F.when(first.isin(*L.GEO_PREFIXES), "Location").otherwise("Person"))
        .otherwise("Unknown")
    )


def context_type(name: Column, context: Column, known: Column) -> Column:
    """Type from the 30 characters before the name's first place, for types that are open to doubt."""
    at = F.instr(F.lower(context), F.lower(name))
    before = F.when(at > 1, F.substring(F.lower(context), F.greatest(at - 30, F.lit(1)), F.least(at - 1, F.lit(30)))).otherwise("")
    has = lambda keys: reduce(lambda a, b: a | b, [F.contains(before, F.lit(k)) for k in keys])
    return F.when(~known.isin("Unknown", "Location", "Person"), known).when(has(L.LOCATION_CONTEXT), "Location").when(has(L.PERSON_CONTEXT), "Person").otherwise(known)


def is_noise(name: Column, links: bool = True) -> Column:
    """Whether an extracted name is not one."""
    short = (F.length(name) <= 1) | ((F.length(name) <= 2) & ~F.contains(F.trim(name), F.lit(" ")))
    lower_start = name.rlike(r"^\p{Ll}") & ~name.rlike(r"^.[\s\S]*\p{Lu}")
    return short | lower_start | any_match(name, L.NOISE + (L.LINK_NOISE if links else ()))


def grounded(name: Column, display: Column, text: Column, strict: bool = False) -> Column:
    """Whether a name, its display form, its last two words or its first and last word as one phrase stand in the text.

    Compared in lower case and trimmed; callers bring all three to one Unicode form (`plainform.nfkc`).
    An empty name stands nowhere. `strict` asks of a name of one word that it stands as a word.
    """
    low, n, d = F.trim(F.lower(text)), F.trim(F.lower(name)), F.trim(F.lower(F.coalesce(display, name)))
    tokens = F.split(collapse(n), " ")
    two = (F.size(tokens) >= 2) & F.contains(low, F.array_join(F.slice(tokens, -2, 2), " "))
    ends = (F.size(tokens) >= 3) & F.contains(low, F.concat_ws(" ", F.element_at(tokens, 1), F.element_at(tokens, -1)))
    inside = F.contains(low, n) | F.contains(low, d)
    if strict:
        whole = F.regexp_like(low, F.concat(F.lit(WORD_BEGIN + r"\Q"), n, F.lit(r"\E" + WORD_END)))
        inside = F.when(F.size(tokens) == 1, whole).otherwise(inside)
    return (n != "") & (inside | two | ends)


def key_terms(column: Column) -> Column:
    """array<string>: capitalised runs of more than 3 characters; the ranges are those of the code points, both cases included."""
    found = F.regexp_extract_all(column, F.lit(r"([A-ZÀ-Ỹ][a-zà-ỹ]+(?:\s+[A-ZÀ-Ỹ][a-zà-ỹ]+)*)"), 1)
    return F.filter(found, lambda x: F.length(x) > 3)


def aliases_in(name: Column, text: Column, most: int = 5, within: int = 2000) -> Column:
    """array<string>: what stands in brackets behind the name, 2 to 60 characters, other than the name."""
    found = F.regexp_extract_all(F.substring(text, 1, within), F.concat(F.lit(r"(?i)\Q"), name, F.lit(r"\E\s*\(([^)]{2,60})\)")), F.lit(1))
    return F.slice(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.lower(x) != F.lower(name)), 1, most)


# answers, by the five ways they are compared
def answer_spaced(column: Column) -> Column:
    """Lower case, marks as blanks, collapsed."""
    return collapse(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}_\s]", " "))


def answer_bare(column: Column) -> Column:
    """Lower case, marks deleted, collapsed."""
    return collapse(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}_\s]", ""))


def answer_untailed(column: Column) -> Column:
    """Trimmed, lower case, without full stops and blanks at the end."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[.\s]+$", "")


def answer_unbracketed(column: Column) -> Column:
    """Lower case, brackets and what is in them deleted, collapsed."""
    return collapse(F.regexp_replace(F.lower(column), r"\([^)]*\)", ""))


def answer_collapsed(column: Column) -> Column:
    """Lower case, collapsed."""
    return collapse(F.lower(column))


def first_number(column: Column) -> Column:
    """The first run of digits, commas and points, commas left out; null if none."""
    return F.nullif(F.replace(F.regexp_extract(column, r"([\d,.]+)", 1), F.lit(","), F.lit("")), F.lit(""))


def unfenced(column: Column) -> Column:
    """Text without a surrounding code fence."""
    return F.trim(F.regexp_replace(F.trim(column), r"^```[a-zA-Z]*\s*|\s*```$", ""))


def json_object(column: Column) -> Column:
    return F.nullif(F.regexp_extract(unfenced(column), r"(?s)(\{.*\})", 1), F.lit(""))


def json_array(column: Column) -> Column:
    return F.nullif(F.regexp_extract(unfenced(column), r"(?s)(\[.*\])", 1), F.lit(""))


_NAMESPACES = {"dns": "6ba7b8109dad11d180b400c04fd430c8", "url": "6ba7b8119dad11d180b400c04fd430c8"}


def uuid5(name: Column, namespace: str = "url") -> Column:
    """Name-based UUID (SHA-1) as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(_NAMESPACES[namespace])), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def shown_number(column: Column) -> Column:
    """Thousands separated; a dash for null."""
    return F.coalesce(F.format_number(column, 0), F.lit("—"))


def filled(template: Column, **values: Column) -> Column:
    """A template with {name} replaced by the values."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), template)
