"""Retrieval, answer and extraction metrics as expressions and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafonda.functions.text import answer_bare, answer_spaced, let, terms


def reciprocal_rank(retrieved: Column, gold: Column) -> Column:
    """1 / rank of the first retrieved id that is gold, 0 if none; ids in rank order."""
    ranks = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda r: r.isNotNull())
    return F.when(F.size(ranks) > 0, 1.0 / F.array_min(ranks)).otherwise(0.0)


def hit(retrieved: Column, gold: Column, k: int | None = None) -> Column:
    some = F.slice(retrieved, 1, k) if k else retrieved
    return F.coalesce(F.arrays_overlap(some, gold), F.lit(False))


def ndcg(retrieved: Column, gold: Column, k: int = 10) -> Column:
    """Discounted gain of gold ids in the first k over that of the best order."""
    gain = F.aggregate(F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(gold, x), 1 / F.log2((i + 2).cast("double"))).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.size(gold), F.lit(k)), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2((i + 1).cast("double")))
    return F.when(F.size(gold) > 0, gain / ideal).otherwise(0.0)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(answer_spaced(text), " "), lambda t: t != "")


def exact_match(prediction: Column, golds: Column) -> Column:
    return let(answer_spaced(prediction), lambda p: F.exists(golds, lambda g: answer_spaced(g) == p))


def _f1(overlap: Column, n_pred: Column, n_gold: Column) -> Column:
    p, r = F.try_divide(overlap, n_pred), F.try_divide(overlap, n_gold)
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def token_f1(prediction: Column, golds: Column) -> Column:
    """Best F1 over the golds; predicted tokens count as often as they stand, gold tokens once."""

    def best(p):
        def one(g):
            return let(_tokens(g), lambda t: _f1(F.size(F.filter(p, lambda x: F.array_contains(t, x))), F.size(p), F.size(t)))

        return F.coalesce(F.array_max(F.transform(golds, one)), F.lit(0.0))

    return let(_tokens(prediction), best)


def set_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the token sets, marks deleted."""
    a = F.array_distinct(F.filter(F.split(answer_bare(prediction), " "), lambda t: t != ""))
    b = F.array_distinct(F.filter(F.split(answer_bare(gold), " "), lambda t: t != ""))
    return _f1(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def context_overlap(context: Column, gold_context: Column) -> Column:
    """Share of the gold context's distinct tokens that the context holds."""
    gold = F.array_distinct(terms(gold_context))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(gold, F.array_distinct(terms(context)))), F.size(gold)), F.lit(0.0))


def answer_in_context(golds: Column, contexts: Column, least: float = 0.6) -> Column:
    """Rank of the first context holding `least` of an answer's tokens, gold by gold; 0 if none."""

    def over(split):
        def rank_of(g):
            def fits(want):
                return F.array_min(F.transform(split, lambda c, i: F.when(F.try_divide(F.size(F.array_intersect(want, c)), F.size(want)) >= least, i + 1)))

            return let(F.array_distinct(F.filter(F.split(answer_bare(g), " "), lambda t: t != "")), fits)

        return F.coalesce(F.get(F.filter(F.transform(golds, rank_of), lambda r: r.isNotNull()), F.lit(0)), F.lit(0))

    return let(F.transform(contexts, lambda c: F.split(answer_bare(c), " ")), over)


def faithfulness(answer: Column, contexts: Column) -> Column:
    """Share of the answer's distinct tokens that stand in the contexts."""
    said = F.array_distinct(terms(answer))
    there = F.array_distinct(F.flatten(F.transform(contexts, terms)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(said, there)), F.size(said)), F.lit(0.0))


def precision_recall(gold: DataFrame, predicted: DataFrame, keys: list[str], by: str | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of two sets of key rows, over all or by one of the keys."""
    g, p = gold.select(keys).distinct().withColumn("g", F.lit(True)), predicted.select(keys).distinct().withColumn("p", F.lit(True))
    both = g.join(p, keys, "full")
    grouped = both.groupBy(by) if by else both.groupBy()
    counted = grouped.agg(F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    precision, recall = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return counted.withColumns({"precision": F.round(precision, 6), "recall": F.round(recall, 6), "f1": F.round(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)), 6)})


def sufficiency(observations: Column) -> Column:
    """struct<score, sufficient>: evidence judged by distinct chunk ids and by the number of usable observations."""
    usable = F.filter(observations, lambda o: o.isNotNull() & (o != "") & ~o.startswith("Error") & (o != "No results found."))
    ids = F.array_distinct(F.flatten(F.transform(usable, lambda o: F.regexp_extract_all(o, F.lit(r'"chunk_id"\s*:\s*"([^"]*)"'), 1))))
    score = F.when(F.size(usable) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.least(F.lit(1.0), F.size(ids) / 3.0) + F.least(F.lit(0.3), F.size(usable) * 0.1)))
    return F.struct(F.round(score, 6).alias("score"), (F.round(score, 6) >= 0.5).alias("sufficient"))
