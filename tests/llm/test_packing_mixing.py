"""Containers, token counts and mixes."""

import os
import random

import numpy as np
import pytest

from grafonda.llm import mixing as M
from grafonda.llm import packing as P
from grafonda.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.isdir(T.FOLDER), reason="no vocabulary files here")


def test_counts_are_exact():
    counter = T.Counter(limit=20)
    texts = ["", " ", "a  b\n\n c", "Xin chào các bạn, 123!", "it's   we'll\t\tgo ", "x" * 5000, "漢字 đẹp​\r\n\r\nnhé"]
    for _ in range(3):
        assert counter.count(texts).tolist() == [len(T.encoding().encode_ordinary(t)) for t in texts]


def test_curve_visits_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = grid[np.argsort(P.hilbert(grid, 3))]
    assert np.abs(np.diff(order, axis=0)).sum(1).max() == 1


def documents(spark, n=400):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["sông", "núi", "the river", "đò", "năm 1800."]) for _ in range(rng.choice([3, 40, 200, 900]))), ["a", "b"][i % 3 == 0], 1) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None, "a", 1), (n + 1, "", "a", 1), (n + 2, "dài " * 20000, " A ", 1), (None, "x", "a", 1)], "doc_id long, text string, source string, tokens int")


def test_containers(spark):
    docs = documents(spark)
    got = P.pack_documents(docs, capacity=1000, partitions=2).collect()
    room, whole = {}, {}
    for r in got:
        room[r["container"]] = room.get(r["container"], 0) + r["tokens"]
        whole.setdefault(r["id"], []).append((r["piece"], r["begin"], r["tokens"]))
    assert max(room.values()) <= 1000
    texts = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id is not null").collect()}
    assert set(whole) == set(texts)
    for i, pieces in whole.items():
        n = len(T.encoding().encode_ordinary(texts[i]))
        assert sum(p[2] for p in pieces) == n and (len(pieces) == 1 or n > 1000)
        assert [p[1] for p in sorted(pieces)] == [1000 * k for k in range(len(pieces))]
    assert sum(room.values()) / (1000 * len(room)) > 0.97
    assert P.pack_documents(docs.limit(0)).count() == 0


def test_mix(spark):
    sizes = M.measured(documents(spark))
    targets = spark.createDataFrame([("m", "A", 3.0, 2), ("m", "b ", 1.0, 3), ("m", "none", 1.0, 1), ("m", None, 1.0, 1), ("z", "none", 1.0, 1), (None, "a", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    mixed = M.mix_documents(sizes, targets)
    report = {(r["mix_name"], r["source"]): r for r in M.mix_report(mixed, M.plan_mix(sizes, targets)).collect()}
    assert abs(report["m", "a"]["reached_share"] - 0.75) < 0.01 and abs(report["m", "b"]["reached_share"] - 0.25) < 0.01
    assert report["m", "a"]["most_repeats"] <= 2 and report["m", "b"]["most_repeats"] <= 3
    assert report["m", "none"]["documents"] == 0 and report["z", "none"]["reached_share"] == 0
    repeats = {}
    for r in mixed.collect():
        repeats.setdefault(r["source"], set()).add(r["repeats"])
    assert all(max(x) - min(x) <= 1 for x in repeats.values())  # complete epochs come first
    assert M.mix_documents(sizes, targets.limit(0)).count() == 0 and M.mix_documents(sizes.limit(0), targets).count() == 0
    small = M.mix_documents(sizes, targets, total_tokens=5000)
    assert abs(small.selectExpr("sum(tokens * repeats) as t").first()["t"] - 5000) < 2500
