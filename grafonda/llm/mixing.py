"""Mixing sources to target shares of tokens, by weighted sampling without replacement.

For every mix the shares of the sources that hold tokens are scaled to one, and the total is the
largest at which every source reaches its share within its allowed repeats (or the total asked
for, cut down to that). A source's tokens are first used in complete epochs; the fraction left is
filled by Efraimidis-Spirakis sampling: documents in ascending order of ``-ln(u)/w``, u from a hash
of mix and document, w the document's quality weight, taken while their running sum is nearest to
the fraction.

The running sum needs no window over a source, however large: keys are counted into buckets
(partial sums only), the buckets' running sums tell the one bucket per mix and source in which the
fraction ends, and only that bucket's documents are ordered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafonda.llm.tokens import DEFAULT, FOLDER, Counter
from grafonda.session import materialise

BUCKETS = 1 << 16
BROADCAST_ROWS = 10_000


def source_key(column: Column) -> Column:
    """One key for all spellings of a source: lower case, trimmed, hyphens as underscores; empty is null."""
    return F.nullif(F.replace(F.lower(F.trim(column)), F.lit("-"), F.lit("_")), F.lit(""))


def _measure(tokenizer: str, folder: str):
    def run(batches):
        counter = Counter(tokenizer, folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, runs = counter.count_and_runs([x or "" for x in batch.column("text").to_pylist()])
            # words per token: text the vocabulary knows well scores high, debris scores low
            quality = np.clip(2 * runs / np.maximum(tokens, 1), 0.25, 4.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), pa.array(tokens), pa.array(quality)], names=["id", "source", "tokens", "weight"])

    return run


def _small(df: DataFrame) -> DataFrame:
    """Broadcast hint for a table counted to be small; a larger one is joined by exchange."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def measured(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = DEFAULT, folder: str = FOLDER) -> DataFrame:
    """(id, source, tokens, weight) of every document with an id, a source and at least one token, as a table."""
    kind = rows.schema[id_col].dataType.simpleString()
    texts = rows.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("source"), F.col(text_col).alias("text"))
    return materialise(
        texts.where("id is not null and source is not null").mapInArrow(_measure(tokenizer, folder), f"id {kind}, source string, tokens long, weight double").where("tokens > 0"), "sizes"
    )


def plan_mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, available, wanted, epochs, fraction) per mix and source, sources without tokens included.

    Shares of the spellings of one source add up, its repeats are the most allowed by any. Null or
    non-positive shares and repeats want nothing.
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"))
    want = (
        targets.select("mix_name", source_key(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("r"))
        .where("mix_name is not null and source is not null")
        .distinct()
        .groupBy("mix_name", "source")
        .agg(F.sum("share").alias("share"), F.max("r").alias("max_repeats"))
    )
    mix = Window.partitionBy("mix_name")
    usable = F.when((F.col("available") > 0) & (F.col("max_repeats") > 0), F.col("share")).otherwise(0.0)
    plan = (
        want.join(have, "source", "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("target_share", F.try_divide(F.col("share"), F.sum("share").over(mix)))
        .withColumn("scaled", F.coalesce(F.try_divide(usable, F.sum(usable).over(mix)), F.lit(0.0)))
        .withColumn("limit", F.when(F.col("scaled") > 0, F.col("available") * F.col("max_repeats") / F.col("scaled")))
        .withColumn("total", F.least(F.min("limit").over(mix), F.lit(total_tokens).cast("double")))
        .withColumn("wanted", F.coalesce(F.col("total") * F.col("scaled"), F.lit(0.0)))
        .withColumn("epochs", F.least(F.floor(F.coalesce(F.try_divide(F.col("wanted") + 1e-6, F.col("available")), F.lit(0.0))), F.col("max_repeats")).cast("int"))
        .withColumn("fraction", F.when(F.col("epochs") < F.col("max_repeats"), F.col("wanted") - F.col("epochs") * F.col("available")).otherwise(0.0))
    )
    return plan.select("mix_name", "source", "target_share", "max_repeats", "available", "wanted", "epochs", "fraction")


def mix_documents(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42) -> DataFrame:
    """(mix_name, source, id, repeats, tokens): documents of each mix and how often they are used.

    Documents of sources that a mix does not name, without source or without a token are in no mix;
    equal keys are ordered by id; repeated rows of an id count as rows. Empty tables give no row.
    """
    plan = materialise(plan_mix(sizes, targets, total_tokens), "plan")
    u = (F.pmod(F.xxhash64("mix_name", "id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    # of one mix and source a third of all rows may be one key: nothing below is grouped by it without partial sums
    drawn = (
        sizes.join(_small(plan), "source")
        .withColumn("key", -F.log(u) / F.col("weight"))
        .withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * BUCKETS).cast("int"))
    )
    ordered = Window.partitionBy("mix_name", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = drawn.where("fraction > 0").groupBy("mix_name", "source", "bucket", "fraction").agg(F.sum("tokens").alias("held"))
    running = sums.withColumn("upto", F.sum("held").over(ordered))
    ends = (
        running.where("upto >= fraction")
        .groupBy("mix_name", "source")
        .agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("held")).alias("before")), "bucket").alias("end"))
        .select("mix_name", "source", F.col("end.bucket").alias("last"), F.col("end.before").alias("before"))
    )
    known = drawn.join(_small(materialise(ends, "ends")), ["mix_name", "source"], "left")
    whole = known.where("last is null or bucket <> last").withColumn("extra", F.when((F.col("fraction") > 0) & (F.col("last").isNull() | (F.col("bucket") < F.col("last"))), 1).otherwise(0))
    inside = Window.partitionBy("mix_name", "source").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)
    cut = known.where("bucket = last").withColumn("upto", F.col("before") + F.sum("tokens").over(inside)).withColumn("extra", F.when(F.col("upto") - F.col("tokens") / 2 <= F.col("fraction"), 1).otherwise(0)).drop("upto")
    return whole.unionByName(cut).withColumn("repeats", F.col("epochs") + F.col("extra")).where("repeats > 0").select("mix_name", "source", "id", "repeats", "tokens")


def mix_report(mixed: DataFrame, targets_plan: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, reached_share, tokens, documents, most_repeats) per mix and source, sources without documents too."""
    got = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    mix = Window.partitionBy("mix_name")
    full = targets_plan.select("mix_name", "source", "target_share").join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "documents", "most_repeats"])
    return full.withColumn("reached_share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(mix)), F.lit(0.0))).select("mix_name", "source", "target_share", "reached_share", "tokens", "documents", "most_repeats")
