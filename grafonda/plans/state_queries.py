"""Evaluation, quality control and per-key state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from grafonda.functions import text as T
from grafonda.operators import metrics as M
from grafonda.operators import quality as Q
from grafonda.operators import state as S
from grafonda.plans import kg
from grafonda.plans.kg import query, with_kg
from grafonda.plans.text_queries import _ENTITIES_OF, _RESTED
from grafonda.session import table

_QA = "qa AS (SELECT qa_id, any_value(question) AS question, any_value(answer) AS answer, any_value(question_type) AS question_type, any_value(evidence_chunk_ids) AS ev, any_value(source_pages) AS sp, any_value(hops) AS hops FROM qa_pairs WHERE qa_id IS NOT NULL GROUP BY qa_id)"


def _qa(spark, sf):
    t = table(spark, sf, "qa_pairs").where("qa_id is not null")
    return t.groupBy("qa_id").agg(*[F.first(c, ignorenulls=True).alias(a) for c, a in (("question", "question"), ("answer", "answer"), ("question_type", "question_type"), ("evidence_chunk_ids", "ev"), ("source_pages", "sp"), ("hops", "hops"))])


_TOK = r"list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g')), ' '), lambda t: t <> '')"
_GOLDS = "gd AS (SELECT qa_id, answer AS pred, list_filter(sp, lambda t: t IS NOT NULL AND trim(t) <> '') AS golds FROM qa WHERE answer IS NOT NULL AND sp IS NOT NULL)"


def _golds(spark, sf):
    return _qa(spark, sf).where("answer is not null and sp is not null").select("qa_id", F.col("answer").alias("pred"), F.filter("sp", lambda t: t.isNotNull() & (F.trim(t) != "")).alias("golds"))


@query("WITH " + _QA + ", " + _GOLDS + ", x AS (SELECT qa_id, " + _TOK.format("pred") + " AS p, unnest(golds) AS g FROM gd), y AS (SELECT qa_id, p, " + _TOK.format("g") + r""" AS g FROM x),
  z AS (SELECT qa_id, len(list_filter(p, lambda t: list_contains(g, t))) AS o, len(p) AS np, len(g) AS ng, (p = g) AS em FROM y)
  SELECT qa_id, max(em::INT) AS em, round(max(CASE WHEN o = 0 OR np = 0 OR ng = 0 THEN 0 ELSE 2.0 * (o / np) * (o / ng) / ((o / np) + (o / ng)) END), 6) AS f1 FROM z GROUP BY qa_id""")
def metric_em_f1(spark, sf):
    """Answers against the titles behind the question, the best title counting."""
    g = _golds(spark, sf).where(F.size("golds") > 0)
    return g.select("qa_id", M.exact_match(F.col("pred"), F.col("golds")).cast("int").alias("em"), F.round(M.token_f1(F.col("pred"), F.col("golds")), 6).alias("f1"))


_BTOK = r"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g')), ' '), lambda t: t <> ''))"


@query("WITH " + _QA + ", s AS (SELECT qa_id, " + _BTOK.format("answer") + " AS a, " + _BTOK.format("question") + " AS b FROM qa WHERE answer IS NOT NULL AND question IS NOT NULL), o AS (SELECT qa_id, len(list_intersect(a, b)) AS o, len(a) AS na, len(b) AS nb FROM s) SELECT qa_id, round(CASE WHEN o = 0 OR na = 0 OR nb = 0 THEN 0 ELSE 2.0 * (o / na) * (o / nb) / ((o / na) + (o / nb)) END, 6) AS f1 FROM o")
def metric_f1_set(spark, sf):
    return _qa(spark, sf).where("answer is not null and question is not null").select("qa_id", F.round(M.set_f1(F.col("answer"), F.col("question")), 6).alias("f1"))


_EV = "ex AS (SELECT qa.qa_id, u.pos, ch.text FROM qa, unnest(range(1, len(ev) + 1)) AS u(pos) JOIN ch ON ch.chunk_id = ev[pos])"


def _evidence(spark, sf):
    """(qa_id, contexts): texts of a question's evidence in its order."""
    e = _qa(spark, sf).select("qa_id", F.posexplode("ev").alias("pos", "chunk_id"))
    j = e.join(kg.chunks(spark, sf).select("chunk_id", "text"), "chunk_id")
    return j.groupBy("qa_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("contexts"))


_TERMS = r"list_distinct(regexp_extract_all(lower({0}), '([\p{{L}}\p{{N}}]+)', 1))"


@query(with_kg("SELECT qa_id, round(len(list_intersect(g, c)) / nullif(len(g), 0), 6) AS overlap, coalesce(len(list_intersect(g, c)) / nullif(len(g), 0), 0) >= 0.5 AS hit FROM (SELECT qa.qa_id, " + _TERMS.format("qa.question") + " AS g, " + _TERMS.format("string_agg(ex.text, ' ' ORDER BY ex.pos)") + " AS c FROM qa JOIN ex ON ex.qa_id = qa.qa_id WHERE qa.question IS NOT NULL GROUP BY qa.qa_id, qa.question) WHERE len(g) > 0", _QA, _EV))
def metric_context_overlap(spark, sf):
    j = _qa(spark, sf).where("question is not null").select("qa_id", "question").join(_evidence(spark, sf), "qa_id")
    o = M.context_overlap(F.array_join("contexts", " "), F.col("question"))
    return j.where(F.size(T.terms(F.col("question"))) > 0).select("qa_id", F.round(o, 6).alias("overlap"), (o >= 0.5).alias("hit"))


_BARE = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"


@query(with_kg("SELECT qa_id, coalesce(arg_min(r, gi) FILTER (WHERE r IS NOT NULL), 0) AS rank FROM (SELECT qa_id, gi, min(CASE WHEN len(g) > 0 AND len(list_intersect(g, c)) / len(g) >= 0.6 THEN place END) AS r FROM (SELECT gd.qa_id, gi, list_distinct(list_filter(string_split(" + _BARE.format("gd.golds[gi]") + ", ' '), lambda t: t <> '')) AS g, x.place, string_split(" + _BARE.format("x.text") + ", ' ') AS c FROM gd, unnest(range(1, greatest(len(golds), 1) + 1)) AS u(gi) JOIN (SELECT qa_id, text, row_number() OVER (PARTITION BY qa_id ORDER BY pos, text) AS place FROM ex) x ON x.qa_id = gd.qa_id) GROUP BY 1, 2) GROUP BY qa_id", _QA, _GOLDS, _EV))
def metric_answer_in_context(spark, sf):
    """Rank of the evidence that holds a title behind the question, title by title."""
    j = _golds(spark, sf).join(_evidence(spark, sf), "qa_id")
    return j.select("qa_id", M.answer_in_context(F.col("golds"), F.col("contexts")).alias("rank"))


@query(with_kg("SELECT qa_id, round(coalesce(len(list_intersect(s, c)) / nullif(len(s), 0), 0), 6) AS faithfulness FROM (SELECT qa.qa_id, " + _TERMS.format("qa.answer") + " AS s, " + _TERMS.format("string_agg(ex.text, ' ' ORDER BY ex.pos)") + " AS c FROM qa JOIN ex ON ex.qa_id = qa.qa_id WHERE qa.answer IS NOT NULL GROUP BY qa.qa_id, qa.answer)", _QA, _EV))
def metric_faithfulness(spark, sf):
    j = _qa(spark, sf).where("answer is not null").select("qa_id", "answer").join(_evidence(spark, sf), "qa_id")
    return j.select("qa_id", F.round(M.faithfulness(F.col("answer"), F.col("contexts")), 6).alias("faithfulness"))


_REFUSES = "regexp_matches(lower(answer), 'không thể trả lời|không có thông tin|không đủ|không tìm thấy|cannot answer|unable to')"


@query("WITH " + _QA + f" SELECT question_type, count(*) AS n, round(avg(CASE WHEN ({_REFUSES}) = (question_type = 'unanswerable') THEN 1.0 ELSE 0 END), 6) AS abstain_accuracy FROM qa WHERE answer IS NOT NULL AND question_type IS NOT NULL GROUP BY 1")
def metric_abstain(spark, sf):
    a = _qa(spark, sf).where("answer is not null and question_type is not null")
    refuses = F.lower("answer").rlike("không thể trả lời|không có thông tin|không đủ|không tìm thấy|cannot answer|unable to")
    return a.groupBy("question_type").agg(F.count("*").alias("n"), F.round(F.avg((refuses == (F.col("question_type") == "unanswerable")).cast("double")), 6).alias("abstain_accuracy"))


_GOLD_NER = "g AS (SELECT DISTINCT chunk_id, lower(text) AS name, entity_type AS type FROM ner_mentions WHERE confidence >= 0.5 AND entity_type IN ('Person', 'Organization', 'Location', 'Work')), p AS (SELECT DISTINCT chunk_id, lower(text) AS name, CASE WHEN entity_type = 'Unknown' THEN 'Person' ELSE entity_type END AS type FROM ner_mentions WHERE confidence >= 0.7 AND entity_type IN ('Person', 'Organization', 'Location', 'Work', 'Unknown'))"


@query("WITH " + _GOLD_NER + """, j AS (SELECT coalesce(g.type, p.type) AS type, g.name IS NOT NULL AS g, p.name IS NOT NULL AS p FROM g FULL JOIN p ON g.chunk_id = p.chunk_id AND g.name = p.name AND g.type = p.type),
  c AS (SELECT type, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g) AS fp, count(*) FILTER (WHERE NOT p) AS fn FROM j GROUP BY type)
  SELECT type, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) END, 6) AS f1 FROM c""")
def ner_prf(spark, sf):
    """Confident mentions against surer ones, by type."""
    m = table(spark, sf, "ner_mentions").select("chunk_id", F.lower("text").alias("name"), F.col("entity_type").alias("type"), "confidence")
    gold = m.where("confidence >= 0.5 and type in ('Person', 'Organization', 'Location', 'Work')")
    pred = m.where("confidence >= 0.7 and type in ('Person', 'Organization', 'Location', 'Work', 'Unknown')").withColumn("type", F.when(F.col("type") == "Unknown", "Person").otherwise(F.col("type")))
    return M.precision_recall(gold, pred, ["chunk_id", "name", "type"], "type")


_QC = r"""qt AS (SELECT qa_id, coalesce(question, '') AS q, coalesce(answer, '') AS a, coalesce(question_type, '') AS k FROM qa),
  te AS (SELECT qt.*, coalesce(lower(e.t), '') AS e FROM qt LEFT JOIN (SELECT qa_id, string_agg(text, ' ' ORDER BY pos) AS t FROM ex GROUP BY 1) e USING (qa_id)),
  st AS (SELECT qa_id, q, CASE WHEN NOT (length(q) >= 15 AND length(a) >= 10 AND q <> a AND (ends_with(q, '?') OR ends_with(q, '？'))) THEN 'well_formed'
    WHEN NOT (k = 'unanswerable' OR (trim(e) <> '' AND (length(a) > 20 OR len(list_filter(regexp_extract_all(a, '([A-ZÀ-Ỹ][a-zà-ỹ]+(?:\s+[A-ZÀ-Ỹ][a-zà-ỹ]+)*)', 1), lambda t: length(t) > 3 AND contains(e, lower(t)))) > 0))) THEN 'grounding' ELSE 'passed' END AS v FROM te),
  dd AS (SELECT qa_id, CASE WHEN v = 'passed' AND row_number() OVER (PARTITION BY v, lower(trim(q)) ORDER BY qa_id) > 1 THEN 'duplicate' ELSE v END AS verdict FROM st)"""


@query(with_kg("SELECT qa_id, verdict FROM dd", _QA, _EV, _QC))
def qc_pipeline(spark, sf):
    e = _evidence(spark, sf).select("qa_id", F.array_join("contexts", " ").alias("text"))
    qa = _qa(spark, sf).select("qa_id", "question", "answer", "question_type", F.col("qa_id").alias("ord"))
    return S.quality_checked(qa, e).select("qa_id", "verdict")


@query(with_kg("SELECT verdict, count(*) AS n FROM dd GROUP BY 1", _QA, _EV, _QC))
def qc_counts(spark, sf):
    return qc_pipeline(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"))


_VOTES = r"vt AS (SELECT walk_id, regexp_replace(lower(trim(answer)), '[.\s]+$', '') AS k, len(evidence_chunk_ids) AS c, qa_id FROM (SELECT DISTINCT walk_id, qa_id, answer, evidence_chunk_ids FROM qa_pairs WHERE walk_id IS NOT NULL AND answer IS NOT NULL))"


@query("WITH " + _VOTES + " SELECT walk_id, k AS answer, n AS votes FROM (SELECT walk_id, k, count(*) AS n, row_number() OVER (PARTITION BY walk_id ORDER BY count(*) DESC, max(coalesce(c, 0)) DESC, k) AS r FROM vt GROUP BY 1, 2) WHERE r = 1")
def majority_vote(spark, sf):
    """Answers to one walk, equal ones without case and end points together; ties by evidence, then by text."""
    t = table(spark, sf, "qa_pairs").where("walk_id is not null and answer is not null").select("walk_id", "qa_id", "answer", "evidence_chunk_ids").distinct()
    g = t.groupBy("walk_id", T.answer_untailed(F.col("answer")).alias("answer")).agg(F.count("*").alias("votes"), F.max(F.coalesce(F.when(F.col("evidence_chunk_ids").isNotNull(), F.size("evidence_chunk_ids")), F.lit(0))).alias("c"))
    w = Window.partitionBy("walk_id").orderBy(F.desc("votes"), F.desc("c"), "answer")
    return g.withColumn("r", F.row_number().over(w)).where("r = 1").select("walk_id", "answer", "votes")


@query(None)
def majority_vote_similar(spark, sf):
    """The same with containment of longer answers."""
    t = table(spark, sf, "qa_pairs").where("walk_id is not null and answer is not null").groupBy("qa_id").agg(F.first("walk_id").alias("walk_id"), F.first("answer").alias("answer"), F.max(F.size("evidence_chunk_ids")).alias("citations"))
    return S.majority(t.withColumn("ord", F.col("qa_id")), "walk_id")


@query("SELECT question_type, hops, count(DISTINCT qa_id) AS n FROM qa_pairs GROUP BY 1, 2")
def qa_counts(spark, sf):
    return table(spark, sf, "qa_pairs").groupBy("question_type", "hops").agg(F.count_distinct("qa_id").alias("n"))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def job_status_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


def _jobs(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("started_at"))


@query("SELECT event_id AS job_id, event_type AS status, ts AS started_at FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 10")
def job_page(spark, sf):
    return S.page_of(_jobs(spark, sf), "click", 50, 10)


@query("SELECT event_id AS job_id, CASE WHEN event_type IN ('click', 'view') THEN 'interrupted' ELSE event_type END AS status, ts AS started_at FROM events WHERE epoch((SELECT max(ts) FROM events)) - floor(epoch(ts)) <= 864000 + 1 AND floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(ts)) <= 864000")
def restore_jobs(spark, sf):
    jobs = _jobs(spark, sf).withColumn("status", F.when(F.col("status") == "click", "running").when(F.col("status") == "view", "cancelling").otherwise(F.col("status")))
    now = jobs.agg(F.max("started_at").alias("now"))
    return S.restored(jobs.crossJoin(F.broadcast(now)), F.col("now"), 864_000).drop("now")


@query("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_queries(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query("SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_embedding(spark, sf):
    """Last writer wins, per key."""
    return S.latest(table(spark, sf, "events").select("user_id", "event_id", "value", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query(None)
def rate_limiter(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return S.rate_limited(e, "user_id", "ts", "event_id", 2, 3600.0)


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def gauge_windows(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("WITH " + _QA + """, o AS (SELECT qa_id, list_filter(coalesce(ev, []), lambda c: c IS NOT NULL) AS e FROM qa)
  SELECT qa_id, s AS score, s >= 0.5 AS sufficient FROM (SELECT qa_id, round(CASE WHEN len(e) = 0 THEN 0.0 ELSE least(1.0, least(1.0, len(list_distinct(e)) / 3.0) + least(0.3, len(e) * 0.1)) END, 6) AS s FROM o)""")
def sufficiency(spark, sf):
    """Evidence of every question judged as an agent would judge its observations."""
    e = _qa(spark, sf).select("qa_id", F.transform(F.coalesce("ev", F.array().cast("array<string>")), lambda c: F.concat(F.lit('[{"chunk_id": "'), c, F.lit('"}]'))).alias("obs"))
    return e.select("qa_id", M.sufficiency(F.col("obs")).alias("s")).select("qa_id", "s.score", "s.sufficient")


# Sub-questions of each kind of reasoning.
_STEPS = {
    "bridge_2hop": ("What is {entity1} connected to via {rel1}?", "What is [answer1] connected to via {rel2}?"),
    "intersection": ("What entities are related to {entity1} via {rel1}?", "What entities are related to {entity2} via {rel2}?", "Which entity appears in both [answer1] and [answer2]?"),
    "temporal": ("What events involve {entity1}?", "Which of those events occurred {temporal_constraint}?"),
}


@query("SELECT 'C' || c_custkey AS id, i AS step_no, CASE i WHEN 1 THEN 'What is C' || c_custkey || ' connected to via BORN_IN?' ELSE 'What is [answer1] connected to via LOCATED_IN?' END AS question, CASE i WHEN 1 THEN n_name ELSE r_name END AS answer FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey, unnest([1, 2]) AS u(i)")
def decomposition(spark, sf):
    """Two-hop questions over relations taken apart: a sub-question and its answer a hop."""
    c, n, r = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region")
    paths = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), "n_name", "r_name")
    given = {"entity1": F.col("id"), "rel1": F.lit("BORN_IN"), "rel2": F.lit("LOCATED_IN")}
    asked = F.array(*(T.filled(F.lit(q), **given) for q in _STEPS["bridge_2hop"]))
    steps = F.arrays_zip(asked.alias("question"), F.array("n_name", "r_name").alias("answer"))
    return paths.select("id", F.posexplode(steps).alias("i", "s")).select("id", (F.col("i") + 1).alias("step_no"), F.col("s")["question"].alias("question"), F.col("s")["answer"].alias("answer"))


# What surrounds a rejected answer.
_BEFORE, _AFTER = "Based on the schema, here is the appropriate query:\n\n```sql\n", "\n```\n\nHope this helps! Feel free to ask if you have more questions."
_ANSWER = "SELECT answer FROM walks WHERE walk_id = '{walk}'"


@query("WITH " + _QA + ", c AS (SELECT qa_id, question, 'SELECT answer FROM walks WHERE walk_id = ''' || qa_id || '''' AS q FROM qa WHERE question IS NOT NULL) SELECT qa_id, i AS variant, 'Generate a query to answer: ' || question AS prompt, q AS chosen, CASE i WHEN 1 THEN '" + _BEFORE + "' || q || '" + _AFTER + "' ELSE CASE ('0x' || substr(md5(qa_id), 1, 6))::BIGINT % 3 WHEN 0 THEN regexp_replace(q, 'SELECT .+ FROM', 'SELECT count(*) AS answer FROM') WHEN 1 THEN regexp_replace(q, '''[^'']*''', '''PLACEHOLDER''') ELSE q || ' UNION SELECT name FROM nodes LIMIT 1' END END AS rejected FROM c, unnest([1, 2]) AS u(i)")
def preference_pairs(spark, sf):
    """Two pairs a question: its query against the same wrapped in talk, and against a changed one that no longer answers it."""
    q = _qa(spark, sf).where("question is not null").select("qa_id", "question", T.filled(F.lit(_ANSWER), walk=F.col("qa_id")).alias("q"))
    pick = F.conv(F.substring(F.md5("qa_id"), 1, 6), 16, 10).cast("bigint") % 3
    changed = F.when(pick == 0, F.regexp_replace("q", "SELECT .+ FROM", "SELECT count(*) AS answer FROM")).when(pick == 1, F.regexp_replace("q", "'[^']*'", "'PLACEHOLDER'")).otherwise(F.concat("q", F.lit(" UNION SELECT name FROM nodes LIMIT 1")))
    variants = F.array(F.struct(F.lit(1).alias("variant"), F.concat(F.lit(_BEFORE), F.col("q"), F.lit(_AFTER)).alias("rejected")), F.struct(F.lit(2).alias("variant"), changed.alias("rejected")))
    return q.select("qa_id", F.concat(F.lit("Generate a query to answer: "), F.col("question")).alias("prompt"), F.col("q").alias("chosen"), F.explode(variants).alias("v")).select("qa_id", "v.variant", "prompt", "chosen", "v.rejected")


def _template_sql() -> str:
    when = " ".join(f"WHEN regexp_matches(question, '{p}') THEN '{n}'" for p, n in T.QUESTION_PATTERNS)
    return f"CASE {when} WHEN regexp_matches(lower(question), '{T._RELATING}') AND len(names) >= 2 THEN 'two_entity_intersection' WHEN regexp_matches(lower(question), '{T._RELATING}') THEN 'multi_hop_entity_bridge' WHEN len(names) > 0 THEN 'find_entity' END"


def _first_sql() -> str:
    when = " ".join(f"WHEN regexp_matches(question, '{p}') THEN trim(regexp_extract(question, '{p}', 1))" for p, _ in T.QUESTION_PATTERNS)
    return f"CASE {when} WHEN len(names) > 0 THEN names[1] END"


@query("SELECT qa_id, " + _template_sql() + " AS template, " + _first_sql() + " AS parameter FROM (SELECT qa_id, question, " + _ENTITIES_OF + " AS names FROM " + _RESTED + ")")
def text2query_templates(spark, sf):
    """The query template of every question and its first parameter."""
    q = table(spark, sf, "qa_pairs").where("question is not null").select("qa_id", "question").distinct()
    return q.select("qa_id", T.question_template(F.col("question")).alias("t")).select("qa_id", F.col("t.template").alias("template"), F.col("t.first").alias("parameter"))


@query(None)
def text2query_pairs(spark, sf):
    """Question and query text, as pairs to learn from."""
    q = table(spark, sf, "qa_pairs").where("question is not null").select("qa_id", "question").distinct()
    t = q.withColumn("t", T.question_template(F.col("question"))).where("t is not null")
    return t.select("qa_id", "question", T.template_query(F.col("t")).alias("query"))


_MATCH = r"""ma AS (SELECT qa_id, question_type, ev IS NULL AS failed, coalesce(len(v) > 0 AND (list_contains(v, nullif(replace(regexp_extract(answer, '([0-9,.]+)', 1), ',', ''), '')) OR contains(said, bare) OR (len(parts) > 1 AND 2 * len(list_filter(parts, lambda p: contains(said, trim(regexp_replace(regexp_replace(lower(p), '[\s\p{Z}]+', ' ', 'g'), '[()（）]', '', 'g'))))) >= len(parts))), false) AS ok FROM (
  SELECT qa_id, question_type, answer, ev, v, regexp_replace(trim(regexp_replace(lower(array_to_string(v, ' ')), '[\s\p{Z}]+', ' ', 'g')), '[()（）]', '', 'g') AS said, regexp_replace(trim(regexp_replace(lower(answer), '[\s\p{Z}]+', ' ', 'g')), '[()（）]', '', 'g') AS bare, list_filter(list_transform(string_split_regex(answer, '[,，]'), lambda p: trim(p)), lambda p: p <> '') AS parts
  FROM (SELECT qa_id, question_type, answer, ev, list_filter(coalesce(sp, []), lambda t: t IS NOT NULL) AS v FROM qa)))"""


@query("WITH " + _QA + ", " + _MATCH + " SELECT question_type, count(*) AS n, count(*) FILTER (WHERE failed) AS errors, count(*) FILTER (WHERE ok AND NOT failed) AS correct, round(coalesce(count(*) FILTER (WHERE ok AND NOT failed) / nullif(count(*) FILTER (WHERE NOT failed), 0), 0), 6) AS accuracy FROM ma GROUP BY 1")
def metric_accuracy_by_type(spark, sf):
    """Answers held against the titles behind the question, by question type; questions without evidence count as failed runs."""
    q = _qa(spark, sf).withColumn("v", F.filter(F.coalesce("sp", F.array().cast("array<string>")), lambda t: t.isNotNull()))
    return Q.accuracy_by(q, "question_type", Q.answer_matches(F.col("answer"), F.col("v")), F.col("ev").isNull())


@query("WITH " + _QA + ", x AS (SELECT hops, round(avg(CASE WHEN hops > 0 THEN 1.0 / hops ELSE 0 END), 6) AS efficiency, sum(length(question)) AS i, sum(length(answer)) AS o FROM qa WHERE hops IS NOT NULL GROUP BY 1) SELECT hops, efficiency, i AS tokens_read, o AS tokens_written, round((i * 0.8 + o * 4.0) / 1000000, 4) AS cost FROM x")
def metric_efficiency_cost(spark, sf):
    """Efficiency by number of steps, and the estimated price of reading the questions and writing the answers, a character a token."""
    g = _qa(spark, sf).where("hops is not null").groupBy("hops").agg(F.round(F.avg(Q.efficiency(F.col("hops"))), 6).alias("efficiency"), F.sum(F.length("question")).alias("tokens_read"), F.sum(F.length("answer")).alias("tokens_written"))
    return g.withColumn("cost", Q.token_cost(F.col("tokens_read"), F.col("tokens_written")))


@query("WITH " + _QA + " SELECT qa_id, length(r) >= 10 AND r <> question AND length(r) <= 3 * length(question) AS valid FROM (SELECT qa_id, question, replace(question, 'Theo ', '') AS r FROM qa WHERE question IS NOT NULL)")
def rewrite_validity(spark, sf):
    q = _qa(spark, sf).where("question is not null")
    return q.select("qa_id", Q.valid_rewrite(F.col("question"), F.replace("question", F.lit("Theo "), F.lit(""))).alias("valid"))


@query("SELECT user_id AS job_id, CASE WHEN max(CASE WHEN s = 'failed' AND ts >= f THEN 1 ELSE 0 END) = 1 THEN 'failed' WHEN min(f) IS NOT NULL THEN 'running' END AS status FROM (SELECT user_id, ts, CASE event_type WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'seen' END AS s, min(ts) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id) AS f FROM events) GROUP BY 1")
def job_states(spark, sf):
    """State of every user's job: clicks start it, errors end it, anything else may not follow and is ignored."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failed").otherwise("seen").alias("s"), "ts", "event_id")
    return Q.job_states(e, "job_id", "s", [F.col("ts"), F.col("event_id")]).select("job_id", "status")


@query("SELECT event_type AS channel, count(*) AS n, round(sum(value), 4) AS contribution FROM (SELECT * FROM events WHERE user_id = (SELECT user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1) ORDER BY ts DESC, event_id DESC LIMIT 50) GROUP BY 1")
def recent_breakdown(spark, sf):
    """The 50 latest entries of whoever came last, by channel."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts", "value")
    last = e.agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("user_id"))
    mine = e.join(F.broadcast(last), "user_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return mine.groupBy(F.col("event_type").alias("channel")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("contribution"))
