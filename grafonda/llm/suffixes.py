"""Records of evaluation splits that also stand in the training split, by suffix arrays.

Records can only overlap where the same set of page titles is behind them, so the collection is
partitioned by that set; sets without both sides drop out after one counting aggregation. The texts
of many whole sets are concatenated and one suffix array over them is built by prefix doubling, with
the set's number as the leading symbol of every character so that no suffix matches across sets.
Neighbours in the array with a common prefix of ``span`` characters or more form intervals; every
evaluation and training suffix of one interval share a span, the spans are merged to the
characters of the evaluation record that the training record covers, and pairs of sufficient cover
are compared exactly. Texts under twice ``span`` long, which can be alike without such a span, meet
every text of the other side that shares three characters with them.

A set with very many records is cut into slices per side and every slice pair is a unit of its own
(``slice_rows`` per side), so that neither a task nor an interval grows with the set.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from grafonda.functions.plainform import title_key
from grafonda.llm.parity import _codes, plain_forms
from grafonda.session import materialise

_REACH = 32


@F.pandas_udf(StringType())
def title_set(titles: pd.Series) -> pd.Series:
    """Sorted distinct title keys joined by line feeds; null where none is left."""

    def one(values):
        keys = sorted({k for k in map(title_key, values if values is not None else ()) if k})
        return "\n".join(keys) or None

    return titles.map(one)


def suffix_array(texts: list[str], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix with the one before, text of each place, characters left at each place).

    Order and common prefixes are exact up to 64 characters. Suffixes of different groups share nothing.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    end = np.cumsum(sizes)
    left = end[owner] - np.arange(len(owner))
    raw = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    symbols = np.unique(raw, return_inverse=True)[1] + 1
    rank = np.unique(groups[owner] * (int(symbols.max(initial=0)) + 1) + symbols, return_inverse=True)[1] + 1
    n, ranks, step = len(rank), [], 1
    while step <= _REACH:
        ranks.append(rank)
        behind = np.zeros(n, np.int64)
        behind[:-step or None] = rank[step:]
        behind[left <= step] = 0
        rank = np.unique(rank * (n + 2) + behind, return_inverse=True)[1] + 1
        step *= 2
    order = np.argsort(rank, kind="stable")
    prefix = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    room = np.minimum(left[a], left[b])
    common = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        step = 1 << level
        for _ in range(2 if step == _REACH else 1):
            fits = common + step <= room
            x, y = np.where(fits, a + common, 0), np.where(fits, b + common, 0)
            common += step * (fits & (ranks[level][x] == ranks[level][y]))
    prefix[1:] = common
    return order, prefix, owner, left


def shared_cover(texts: list[str], groups: np.ndarray, evaluation: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (evaluation text, training text) with a common span, and the characters of the first that such spans cover."""
    none = np.zeros(0, np.int64)
    if not len(texts) or not sum(map(len, texts)):
        return none, none, none
    order, prefix, owner, _ = suffix_array(texts, groups)
    interval = np.cumsum(prefix < span) - 1
    side = evaluation[owner[order]]
    total = interval[-1] + 1
    n_eval, n_train = np.bincount(interval[side], minlength=total), np.bincount(interval[~side], minlength=total)
    use = (n_eval > 0) & (n_train > 0)
    keep = use[interval]
    order, interval, side = order[keep], interval[keep], side[keep]
    if not len(order):
        return none, none, none
    e, t = order[side], order[~side]
    ie, it = interval[side], interval[~side]
    first = np.searchsorted(it, ie)
    count = n_train[ie]
    pick = np.repeat(np.arange(len(e)), count)
    mate = np.arange(len(pick)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    pair = owner[e[pick]] * len(texts) + owner[t[mate]]
    spot = np.unique(pair * (len(owner) + 1) + e[pick])
    pair, place = spot // (len(owner) + 1), spot % (len(owner) + 1)
    width = np.full(len(spot), span, np.int64)
    same = pair[1:] == pair[:-1]
    width[:-1][same] = np.minimum(span, np.diff(place))[same]
    ids, start = np.unique(pair, return_index=True)
    return ids // len(texts), ids % len(texts), np.add.reduceat(width, start)


def _grams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def short_pairs(texts: list[str], groups: np.ndarray, evaluation: np.ndarray, least: int) -> set[tuple[int, int]]:
    """Pairs (evaluation text, training text) of a group with three characters in common, one of them under `least` long."""
    holders = defaultdict(list)
    for i in (i for i, text in enumerate(texts) if len(text) < least):
        for gram in _grams(texts[i]):
            holders[groups[i], gram].append(i)
    pairs = set()
    for j in range(len(texts) if holders else 0):
        for gram in _grams(texts[j]):
            pairs.update((i, j) if evaluation[i] else (j, i) for i in holders.get((groups[j], gram), ()) if evaluation[i] != evaluation[j])
    return pairs


def gram_cover(text: str, other: str) -> int:
    """Characters of `text` inside sequences of three that `other` holds as well."""
    shared = _grams(other)
    return len({i + k for i in range(len(text) - 2) if text[i : i + 3] in shared for k in range(3)})


def _overlaps(threshold: float, span: int, cover: float, chars: int):
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf["plain"].tolist()
        groups = pd.factorize(pd.MultiIndex.from_frame(pdf[["pages", "se", "st"]]))[0].astype(np.int64)
        evaluation = pdf["evaluation"].to_numpy(bool)
        e, t, covered = shared_cover(texts, groups, evaluation, span)
        pairs = {(i, j): c for i, j, c in zip(e.tolist(), t.tolist(), covered.tolist()) if c >= cover * len(texts[i])}
        for i, j in short_pairs(texts, groups, evaluation, 2 * span) - pairs.keys():
            pairs[i, j] = gram_cover(texts[i], texts[j])
        sets = {i: _codes(texts[i].encode()) for i in {x for pair in pairs for x in pair}}
        rows = []
        for (i, j), c in pairs.items():
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            union = len(sets[i]) + len(sets[j]) - shared
            if shared * 10**6 >= round(threshold * 10**6) * union:
                rows.append((i, j, c / len(texts[i]), shared / union))
        pick = pd.DataFrame(rows, columns=["i", "j", "cover", "similarity"])
        return pd.DataFrame(
            {
                "pages": pdf["pages"].to_numpy()[pick["i"].astype(int)],
                "form_e": pdf["form"].to_numpy()[pick["i"].astype(int)],
                "form_t": pdf["form"].to_numpy()[pick["j"].astype(int)],
                "cover": pick["cover"].astype(float),
                "similarity": pick["similarity"].astype(float),
            }
        )

    def run(frames):
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in frames:
            if not len(pdf):
                continue
            held.append(pdf)
            size += int(pdf["plain"].str.len().sum())
            if size > chars:
                everything = pd.concat(held, ignore_index=True)
                last = everything[["pages", "se", "st"]].iloc[-1]
                rest = (everything[["pages", "se", "st"]] == last).all(axis=1)
                if not rest.all():
                    yield block(everything[~rest].reset_index(drop=True))
                    everything = everything[rest].reset_index(drop=True)
                held, size = [everything], int(everything["plain"].str.len().sum())
        if held:
            yield block(pd.concat(held, ignore_index=True))

    return run


def cross_split_overlaps(
    rows: DataFrame,
    id_col: str = "qa_id",
    text_col: str = "question",
    pages_col: str = "source_pages",
    split_col: str = "split",
    train: str = "train",
    evaluation: tuple[str, ...] = ("dev", "test"),
    threshold: float = 0.65,
    span: int = 5,
    cover: float = 0.25,
    slice_rows: int = 256,
) -> DataFrame:
    """(train_id, eval_id, cover, similarity): records of either side alike over the same non-empty set of titles.

    ``cover`` is the share of the evaluation text's plain form inside spans that the training text
    holds as well (spans of three characters where one text is short), ``similarity`` the Jaccard similarity of three-character sequences. Rows without
    an id, with a split other than those named (or null), without titles or with a plain form of
    under three characters are in no pair; repeated rows count once; an empty table gives no pair;
    texts are compared whole. An id that stands in both splits is not paired with itself.
    """
    sides = (
        rows.where(F.col(split_col).isin(train, *evaluation))
        .select(F.col(id_col).alias("rid"), F.col(text_col).alias("text"), title_set(F.col(pages_col)).alias("pages"), F.col(split_col).isin(*evaluation).alias("evaluation"))
        .where(F.col("rid").isNotNull() & F.col("pages").isNotNull())
        .withColumn("key", F.struct("rid", "pages", "evaluation"))
    )
    members = materialise(plain_forms(sides, "key", "text").select("id.*", "plain", "form"), "split")
    distinct = members.select("pages", "evaluation", "form", "plain").dropDuplicates(["pages", "evaluation", "form"])
    sizes = (
        members.groupBy("pages")
        .agg(F.count_if("evaluation").alias("n_e"), F.count_if(~F.col("evaluation")).alias("n_t"))
        .where("n_e > 0 and n_t > 0")
        .select("pages", F.ceil(F.col("n_e") / slice_rows).cast("int").alias("e"), F.ceil(F.col("n_t") / slice_rows).cast("int").alias("t"))
    )
    sliced = distinct.join(sizes, "pages")
    own = lambda n: F.pmod(F.xxhash64("form", F.lit(7)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    units = (
        sliced.withColumn("se", F.explode(F.when(F.col("evaluation"), F.array(own("e"))).otherwise(every("e"))))
        .withColumn("st", F.explode(F.when(~F.col("evaluation"), F.array(own("t"))).otherwise(every("t"))))
        .select("pages", "se", "st", "evaluation", "form", "plain")
    )
    found = (
        units.repartition("pages", "se", "st")
        .sortWithinPartitions("pages", "se", "st")
        .mapInPandas(_overlaps(threshold, span, cover, 1 << 20), "pages string, form_e long, form_t long, cover double, similarity double")
    )
    e = members.where("evaluation").select("pages", F.col("form").alias("form_e"), F.col("rid").alias("eval_id"))
    t = members.where("not evaluation").select("pages", F.col("form").alias("form_t"), F.col("rid").alias("train_id"))
    return (
        found.join(e, ["pages", "form_e"])
        .join(t, ["pages", "form_t"])
        .where("eval_id <> train_id")
        .groupBy("train_id", "eval_id")
        .agg(F.max("cover").alias("cover"), F.max("similarity").alias("similarity"))
    )


def overlap_report(rows: DataFrame, pairs: DataFrame, id_col: str = "qa_id", split_col: str = "split", source_col: str = "source") -> DataFrame:
    """(split, source, overlapping, pairs): evaluation records with an overlap and their pairs, per split and source (null stays null)."""
    about = rows.select(F.col(id_col).alias("eval_id"), F.col(split_col).alias("split"), F.col(source_col).alias("source")).dropDuplicates(["eval_id"])
    each = pairs.groupBy("eval_id").agg(F.count("*").alias("n"))
    return each.join(about, "eval_id").groupBy("split", "source").agg(F.count("*").alias("overlapping"), F.sum("n").alias("pairs"))
