"""Checks and reports over answers, generated questions, extracted names and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafonda.functions.text import answer_collapsed, first_number, let


def answer_matches(expected: Column, values: Column) -> Column:
    """Whether the values (array<string>) of a result give the expected answer.

    Its first number is one of them, or it stands in them as text, or at least half of its parts
    between commas do; compared in lower case without brackets. No values match nothing.
    """
    bare = lambda c: F.regexp_replace(answer_collapsed(c), "[()（）]", "")
    parts = F.filter(F.transform(F.split(expected, "[,，]"), lambda p: F.trim(p)), lambda p: p != "")

    def judge(said):
        found = F.size(F.filter(parts, lambda p: F.contains(said, bare(p))))
        number = first_number(expected)
        return F.coalesce(F.array_contains(values, number), F.lit(False)) | F.contains(said, bare(expected)) | ((F.size(parts) > 1) & (found * 2 >= F.size(parts)))

    return F.coalesce((F.size(values) > 0) & let(bare(F.array_join(values, " ")), judge), F.lit(False))


def accuracy_by(rows: DataFrame, kind: str, correct: Column, failed: Column) -> DataFrame:
    """(kind, n, errors, correct, accuracy): failed rows count as errors and are left out of the accuracy."""
    judged = rows.select(F.col(kind), F.coalesce(correct, F.lit(False)).alias("_c"), F.coalesce(failed, F.lit(False)).alias("_f"))
    good, valid = F.count_if(F.col("_c") & ~F.col("_f")), F.count_if(~F.col("_f"))
    return judged.groupBy(kind).agg(F.count("*").alias("n"), F.count_if("_f").alias("errors"), good.alias("correct"), F.round(F.coalesce(F.try_divide(good, valid), F.lit(0.0)), 6).alias("accuracy"))


def efficiency(calls: Column) -> Column:
    """1 / calls, 0 where there was none."""
    return F.coalesce(F.try_divide(F.lit(1.0), F.greatest(calls, F.lit(0))), F.lit(0.0))


def token_cost(read: Column, written: Column, price_read: float = 0.80, price_written: float = 4.0) -> Column:
    """Estimated price of a run in dollars, by prices a million tokens."""
    return F.round((read * price_read + written * price_written) / 1_000_000, 4)


def valid_rewrite(original: Column, rewritten: Column) -> Column:
    """Whether a rewritten question may stand for the original: not empty or short, not the same, not three times as long."""
    said = F.coalesce(rewritten, F.lit(""))
    return (F.length(said) >= 10) & (said != original) & (F.length(said) <= 3 * F.length(original))


def compile_rate(rows: DataFrame, ok: Column) -> DataFrame:
    """(n, compiled, rate) of generated statements."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce(ok, F.lit(False))).alias("compiled"), F.round(F.avg(F.coalesce(ok, F.lit(False)).cast("double")), 6).alias("rate"))


def compiles(spark, sql: str) -> bool:
    """Whether a statement parses and resolves against the session's tables; nothing is run."""
    try:
        spark.sql(sql).schema
        return True
    except Exception:
        return False


#: states of a job and those that may follow
TRANSITIONS = {"running": ("cancelling", "completed", "failed", "interrupted"), "cancelling": ("cancelled", "completed", "failed", "interrupted")}


def job_states(events: DataFrame, job: str, status: str, order: list[Column]) -> DataFrame:
    """(job, status, ignored): the state of every job after its events in order; events that may not follow the state are ignored.

    A job begins with its first `running`; what comes before is ignored. The events of one job are
    folded in order as one array: a job has few, and jobs are independent.
    """
    steps = events.groupBy(job).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(status).alias("_s")))), lambda x: x["_s"]).alias("_all"))
    may = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    begin = F.struct(F.lit("").alias("s"), F.lit(0).alias("ignored"))

    def step(state, s):
        fits = ((state["s"] == "") & (s == "running")) | F.coalesce(F.array_contains(F.try_element_at(may, state["s"]), s), F.lit(False))
        return F.when(fits, F.struct(s.alias("s"), state["ignored"].alias("ignored"))).otherwise(F.struct(state["s"].alias("s"), (state["ignored"] + 1).alias("ignored")))

    return steps.select(job, F.aggregate("_all", begin, step).alias("r")).select(job, F.nullif("r.s", F.lit("")).alias("status"), F.col("r.ignored").alias("ignored"))


def duplicate_groups(names: DataFrame, least: float = 0.85, within: int = 50) -> DataFrame:
    """(canonical, n, types, type_conflict): groups of alike names (name, label) by a sorted neighbourhood.

    Names are ordered by their normal form; in that order each name that is in no group yet opens one
    with those of the next `within` - 1 places that are alike and free. Candidate pairs come from a
    band join on blocks of places and their similarity is computed in parallel. What a name opens
    depends on the names before it through chains of pairs only, so the greedy choice runs per
    connected stretch of pairs, and stretches are independent.
    """
    import pandas as pd

    from grafonda.functions.plainform import nfkc
    from grafonda.functions.text import collapse
    from grafonda.functions.udfs import gestalt_ratio
    from grafonda.operators.components import connected_components
    from grafonda.operators.graph import numbered

    norm = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.lower(nfkc("name"))), "[.\\-,;:()'\"]", ""), r"\s+", " "))
    placed = numbered(names.where(collapse(F.col("name")) != "").select("name", "label", norm.alias("norm")).distinct(), "norm", "name", "label")
    block = F.floor(F.col("place") / within)
    a = placed.select(F.col("place").alias("src"), F.col("norm").alias("na"), block.alias("block"))
    b = placed.select(F.col("place").alias("dst"), F.col("norm").alias("nb"), F.explode(F.array(block, block - 1)).alias("block"))
    from grafonda.session import materialise

    near = a.join(b, "block").where(f"dst > src and dst - src < {within}").where(gestalt_ratio("na", "nb") >= least).select("src", "dst")
    near = materialise(near, "near")
    stretch = connected_components(near)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        ahead: dict[int, list[int]] = {}
        for s, d in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
            ahead.setdefault(s, []).append(d)
        taken: set[int] = set()
        out = []
        for s in sorted(ahead):
            if s in taken:
                continue
            free = [d for d in sorted(ahead[s]) if d not in taken]
            taken.update(free)
            out += [(s, x) for x in [s, *free]] if free else []
        return pd.DataFrame(out, columns=["opened", "place"]).astype("int64")

    grouped = near.join(stretch.select(F.col("node").alias("src"), "component"), "src").groupBy("component").applyInPandas(greedy, "opened long, place long")
    members = grouped.join(placed.select("place", "name", "label"), "place")
    return members.groupBy("opened").agg(F.min_by("name", "place").alias("canonical"), F.count("*").alias("n"), F.array_sort(F.collect_set("label")).alias("types")).select("canonical", "n", "types", (F.size("types") > 1).alias("type_conflict"))
