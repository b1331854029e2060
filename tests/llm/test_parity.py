"""Near-duplicates against comparison of all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grafonda.functions.plainform import plain
from grafonda.llm import parity as P


def pairs_by_brute_force(rows, threshold=0.65):
    forms = {(i, t): set(f[k : k + 3] for k in range(len(f) - 2)) for i, t in rows if i is not None and len(f := plain(t)) >= 3}
    out = set()
    for (a, ta), x in forms.items():
        for (b, tb), y in forms.items():
            if a < b and len(x & y) * 100 >= threshold * 100 * len(x | y) - 1e-9:
                out.add((a, b))
    return out


def edited(rng, text):
    words = text.split()
    for _ in range(rng.randint(0, 4)):
        i = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.4 and len(words[i]) > 2:
            j = rng.randrange(len(words[i]))
            words[i] = words[i][:j] + rng.choice("abcdefgh") + words[i][j + 1 :]
        elif kind < 0.7:
            words.insert(i, rng.choice(["vậy", "theo bạn", "chính xác"]))
        else:
            k = rng.randrange(len(words))
            words[i], words[k] = words[k], words[i]
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for g in range(60):
        base = " ".join("".join(rng.choice("aăâbcdđeêghiklmnoôơpqrstuưvxy") for _ in range(rng.randint(2, 6))) for _ in range(rng.choice([1, 2, 4, 8, 20])))
        for k in range(rng.randint(1, 5)):
            out.append((f"{g}-{k}", edited(rng, base)))
    return out + [("n", None), ("e", ""), (None, "abc def"), ("s", "a"), ("x1", "Trùng  nhau?"), ("x2", "trung NHAU"), ("x1", "Trùng  nhau?"), ("long", "dài " * 5000)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "qid string, q string, id string, form int")
    return {(r["id_a"], r["id_b"]) for r in P.near_duplicate_pairs(df, "qid", "q", **kw).collect()}


def test_all_pairs_found(spark, rows):
    assert run(spark, rows) == pairs_by_brute_force(rows)


def test_large_groups_are_tiled(spark, rows, monkeypatch):
    original = P.similar_forms
    monkeypatch.setattr(P, "similar_forms", lambda m, t: original(m, t, tile=3))
    assert run(spark, rows) == pairs_by_brute_force(rows)


def test_empty(spark):
    assert run(spark, []) == set()


@settings(max_examples=200, deadline=None)
@given(st.text("abc d", min_size=3, max_size=60), st.text("abc d", min_size=3, max_size=60))
def test_sketch_never_exceeds_difference(a, b):
    x, y = (P._codes((" ".join(t.split()) or "aaa").ljust(3, "a").encode()) for t in (a, b))
    s = P._sketches(np.repeat([0, 1], [len(x), len(y)]), np.concatenate([x, y]), 2)
    assert sum(np.bitwise_count(s[0] ^ s[1])) <= len(np.setxor1d(x, y))


def test_guarantee_of_partitions():
    for d in (1, 3, 9, 42, 61):
        for r in (1, 3, 8):
            k = P.blocks_for(d, r)
            assert P._empty_block_fails(d, k) ** r < P.MISS
    assert P.blocks_for(5, 1) <= 6 and P._empty_block_fails(5, 6) == 0


def test_texts_of_one_template_seldom_meet():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghiklmnopqrstuvxy") for _ in range(4)) for _ in range(3000)]
    texts = [" ".join(["vi sao trang ghi noi dat tru so cua nguoi dung dau", *rng.sample(words, 9)]) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], names=["form", "plain"])
    (out,) = P._signatures(P.columns_for(0.65), P.ROWS, 300, range(12))([batch])
    met = 0
    for row in out.to_pylist():
        key = np.frombuffer(row["packed"], np.uint32, offset=300 * P._HEAD).reshape(row["columns"], 300)
        met += sum(int((np.unique(k, return_counts=True)[1] ** 2).sum()) - 300 for k in key)
    assert met / (300 * 299) < 0.1


def test_pairs_at_the_limit_meet():
    assert (1 - 0.65**P.ROWS) ** P.columns_for(0.65) < P.MISS
    rng = random.Random(4)
    lost = 0
    for size, differing in ((1, 0), (13, 3), (13, 3), (33, 7), (113, 24), (113, 24), (113, 24), (1000, 212)):
        codes = rng.sample(range(P.UNIVERSE), size + differing)
        ranks = P._ranks(np.array(codes), np.arange(P.columns_for(0.65) * P.ROWS))
        a, b = ranks[:size].min(0), ranks[differing:].min(0)
        lost += not (a == b).reshape(-1, P.ROWS).all(1).any()
    assert not lost


def test_what_is_exchanged_of_a_text_at_once_is_bounded():
    for forms in (10, 10**5, 10**6, 2 * 10**7):
        columns = P.columns_for(0.65)
        groups = P.layout(columns, forms)[0]
        chosen = P.passes(columns, forms)
        assert [g for p in chosen for g in p] == list(range(groups))
        assert max(len(p) * P._HEAD + 4 * sum(len(range(g, columns, groups)) for g in p) for p in chosen) < 2 * P._TRAVEL


@pytest.mark.parametrize("entries, travel", [(2000, 1000), (100, 2000)])
def test_passes_and_ranges_find_the_same(spark, rows, monkeypatch, entries, travel):
    monkeypatch.setattr(P, "_ENTRIES", entries)
    monkeypatch.setattr(P, "_TRAVEL", travel)
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    assert run(spark, rows) == pairs_by_brute_force(rows)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before
