"""State kept per key: job records, query logs, rate limits, latest values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of every key (last writer wins)."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def restored(jobs: DataFrame, now: Column, most_age: int = 86_400) -> DataFrame:
    """Job records after a restart: what was running or cancelling is interrupted; what started too long ago is dropped."""
    status = F.when(F.col("status").isin("running", "cancelling"), "interrupted").otherwise(F.col("status"))
    return jobs.withColumn("status", status).where((now.cast("timestamp").cast("long") - F.col("started_at").cast("timestamp").cast("long")) <= most_age)


def upserted(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """`current` with the rows of `changes` instead of its own under their keys, and new ones added."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def page_of(jobs: DataFrame, status: str | None, limit: int, offset: int) -> DataFrame:
    """One page of job records, newest first; the size is kept within 1 to 200."""
    some = jobs.where(F.col("status") == status) if status else jobs
    return some.orderBy(F.desc("started_at"), "job_id").offset(max(0, offset)).limit(min(200, max(1, limit)))


def allowed(times: list[float], most: int, window: float, log: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Sliding-log decisions for one key in time order: calls older than the window fall out, refused calls are not logged."""
    log = list(log or [])
    out = []
    for t in times:
        log = [x for x in log if x > t - window]
        ok = len(log) < most
        if ok:
            log.append(t)
        out.append(ok)
    return out, log


def rate_limited(events: DataFrame, key: str, time: str, order: str, most: int, window: float) -> DataFrame:
    """Events with `allowed`: at most `most` allowed ones within `window` seconds per key.

    A decision depends on all before it, so a key is one sequential scan; keys are independent.
    Within a batch events are decided in order of time and `order`.
    """
    import pandas as pd
    from pyspark.sql.types import BooleanType, StructField, StructType

    schema = StructType([*events.schema.fields, StructField("allowed", BooleanType())])

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([time, order], kind="stable")
        return pdf.assign(allowed=allowed([t.timestamp() for t in pdf[time]], most, window)[0])

    return events.groupBy(key).applyInPandas(decide, schema)


def majority(answers: DataFrame, question: str = "question_id", answer: str = "answer", citations: str = "citations", order: str = "ord") -> DataFrame:
    """(question, answer, votes): the answer of the largest group of similar ones, ties by most citations.

    Similar: equal without case and end points, or, both over 10 characters, one inside the other. An
    answer joins the first group whose first member is similar. One question's answers are few; they
    are grouped in one place.
    """
    import pandas as pd

    kind = answers.schema[question].dataType.simpleString()

    def plain(t: str) -> str:
        return t.strip().lower().rstrip(". \t\r\n")

    def similar(a: str, b: str) -> bool:
        return a == b or (min(len(a), len(b)) > 10 and (a in b or b in a))

    def vote(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[list[int]] = []
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        texts = [plain(t or "") for t in pdf[answer]]
        for i, t in enumerate(texts):
            home = next((g for g in groups if similar(t, texts[g[0]])), None)
            if home is None:
                groups.append([i])
            else:
                home.append(i)
        cited = pdf[citations].fillna(0).astype(int).tolist()
        best = max(groups, key=lambda g: (len(g), max(cited[i] for i in g)))
        winner = max(best, key=lambda i: cited[i])
        return pd.DataFrame({question: [pdf[question][winner]], "answer": [pdf[answer][winner]], "votes": [len(best)]})

    return answers.groupBy(question).applyInPandas(vote, f"{question} {kind}, answer string, votes long")


def quality_checked(qa: DataFrame, evidence: DataFrame) -> DataFrame:
    """QA rows (qa_id, question, answer, question_type, ord) with `verdict`: passed, or the first check that rejects.

    Well-formed, then grounded in `evidence(qa_id, text)`, then not a repeated question (the first in
    order among those that passed so far stays).
    """
    from grafonda.functions.text import key_terms

    q, a = F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))
    formed = (F.length(q) >= 15) & (F.length(a) >= 10) & (q != a) & (q.endswith("?") | q.endswith("？"))
    joined = qa.join(evidence, "qa_id", "left").withColumn("_e", F.lower(F.coalesce("text", F.lit("")))).drop("text")
    found = F.exists(key_terms(a), lambda t: F.contains(F.col("_e"), F.lower(t))) | (F.length(a) > 20)
    ground = (F.coalesce("question_type", F.lit("")) == "unanswerable") | ((F.trim("_e") != "") & found)
    staged = joined.withColumn("verdict", F.when(~formed, "well_formed").when(~ground, "grounding").otherwise("passed"))
    w = Window.partitionBy("verdict", F.lower(F.trim(q))).orderBy("ord")
    return staged.withColumn("verdict", F.when((F.col("verdict") == "passed") & (F.row_number().over(w) > 1), "duplicate").otherwise(F.col("verdict"))).drop("_e")
