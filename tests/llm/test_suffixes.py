"""Suffix arrays and cross-split overlaps."""

import random

import numpy as np

from grafonda.llm import suffixes as S
from grafonda.llm.parity import _codes
from grafonda.functions.plainform import plain


def test_suffix_array_order_and_prefixes():
    texts = ["banana band", "bandana", "ana", "banana band"]
    order, prefix, owner, left = S.suffix_array(texts, np.zeros(4, np.int64))
    whole = "".join(texts)
    suffix = [whole[i : i + left[i]] for i in order]
    for a, b, p in zip(suffix, suffix[1:], prefix[1:]):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert n == p
        assert a[:64] <= b[:64] or a.startswith(b) or b.startswith(a)


def test_groups_share_nothing():
    _, prefix, _, _ = S.suffix_array(["same text", "same text"], np.array([0, 1]))
    assert S.shared_cover(["same text", "same text"], np.array([0, 1]), np.array([True, False]), 3)[0].size == 0


def test_cover():
    e, t, c = S.shared_cover(["hello brave new world", "xx brave new yy"], np.zeros(2, np.int64), np.array([True, False]), 5)
    assert (e.tolist(), t.tolist(), c.tolist()) == ([0], [1], [len(" brave new ")])


def table(spark, rows):
    return spark.createDataFrame(rows, "qa_id string, question string, source_pages array<string>, split string, source string, pages string, form int")


def test_overlaps_by_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        base = f"câu hỏi số {i % 40} về trang {'abcdefgh'[i % 8] * 3} và {i % 40 * 7919} điều khác"
        words = base.split()
        rng.shuffle(words) if i % 5 == 0 else None
        pages = ["A_b", "C"] if i % 3 else ["c", " A  B"]
        rows.append((f"q{i}", " ".join(words), pages if i % 11 else None, ["train", "dev", "test", None][rng.choice([0, 0, 0, 1, 2, 3])], "s", "x", 1))
    rows += [rows[0], ("n", None, ["C"], "dev", "s", "x", 1), ("m", "abc", [], "dev", "s", "x", 1)]
    true = set()
    for a in rows:
        for b in rows:
            if a[3] == "train" and b[3] in ("dev", "test") and a[2] and b[2] and a[1] and b[1]:
                x, y = set(_codes(plain(a[1]).encode()).tolist()), set(_codes(plain(b[1]).encode()).tolist())
                if len(x & y) * 100 >= 65 * len(x | y):
                    true.add((a[0], b[0]))
    got = {(r["train_id"], r["eval_id"]) for r in S.cross_split_overlaps(table(spark, rows)).collect()}
    assert got == true and len(true) > 20
    sliced = {(r["train_id"], r["eval_id"]) for r in S.cross_split_overlaps(table(spark, rows), slice_rows=7).collect()}
    assert sliced == true


def test_empty(spark):
    assert S.cross_split_overlaps(table(spark, [])).count() == 0


def test_short_forms(spark):
    """Forms shorter than the span, and short ones that are alike without a common span."""
    texts = ["1954", "1954 年", "abc", "aaa", "aaaaaaa", "abcd", "abcde", "babab", "ababa", "abcab", "bcabc", "xyz", "1955"]
    rows = [(f"{s}{i}", q, ["P"] if i != 2 else ["Q"], s, "s", "x", 1) for i, q in enumerate(texts) for s in ("train", "dev")]
    rows.append(("other", "1954", ["Q"], "test", "s", "x", 1))
    sets = {r[0]: set(_codes(plain(r[1]).encode()).tolist()) for r in rows}
    true = {(a[0], b[0]) for a in rows for b in rows if a[3] == "train" and b[3] != "train" and a[2] == b[2] and len(sets[a[0]] & sets[b[0]]) * 100 >= 65 * len(sets[a[0]] | sets[b[0]])}
    assert {("train0", "dev1"), ("train3", "dev4"), ("train5", "dev6"), ("train7", "dev8"), ("train9", "dev10")} <= true
    got = S.cross_split_overlaps(table(spark, rows)).collect()
    assert {(r["train_id"], r["eval_id"]) for r in got} == true
    assert all(0 < r["cover"] <= 1 for r in got)
