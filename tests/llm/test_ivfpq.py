"""Nearest vectors against brute force."""

import datetime as dt

import numpy as np

from grafonda.llm import ivfpq as V

T0 = dt.datetime(2024, 1, 1)


def table(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, embedding array<float>, embedded_at timestamp, n int, cell int")


def clustered(count, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(count // 20 + 1, 64))
    return (centres[rng.integers(0, len(centres), count)] + 0.2 * rng.normal(size=(count, 64))) * rng.uniform(0.5, 3, (count, 1))


def recall(spark, df, x, ids, **kw):
    pairs = {(r["id_a"], r["id_b"]) for r in V.neighbour_pairs(*V.most_similar(df, **kw)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, 1)[:, :10]
    want = [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in top[i]]
    return np.mean([w in pairs for w in want])


def test_recall_and_slices(spark):
    x = clustered(3000)
    ids = [f"c{i:05d}" for i in range(len(x))]
    df = table(spark, [(i, v.tolist(), T0, 0, 0) for i, v in zip(ids, x)])
    assert recall(spark, df, x, ids) > 0.98
    assert recall(spark, df, x, ids, cell_rows=800, slice_rows=300, query_rows=500) > 0.98


def test_dirty_vectors(spark, tmp_path):
    ok = np.eye(64).tolist()
    rows = [("a", ok[0], T0, 0, 0), ("b", ok[1], T0, 0, 0), ("c", ok[0], T0, 0, 0)]
    rows += [("b", ok[0], T0 + dt.timedelta(1), 0, 0), ("z", None, T0, 0, 0), ("y", [], T0, 0, 0), ("x", [1.0], T0, 0, 0), ("w", [0.0] * 64, T0, 0, 0), ("v", [float("nan")] * 64, T0, 0, 0), (None, ok[2], T0, 0, 0), ("d", ok[5], None, 0, 0), ("d", ok[5], None, 0, 0)]
    for df in (table(spark, rows), None):
        if df is None:  # the same from files, where superseded rows are found by their places
            table(spark, rows).write.parquet(str(tmp_path / "v"))
            df = spark.read.parquet(str(tmp_path / "v"))
        got = {(r["id_a"], r["id_b"]): r["cosine"] for r in V.neighbour_pairs(*V.most_similar(df)).collect()}
        assert set(got) == {("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("b", "d"), ("c", "d")}
        assert abs(got["a", "b"] - 1) < 1e-6 and abs(got["a", "d"]) < 1e-6


def test_empty(spark):
    assert V.neighbour_pairs(*V.most_similar(table(spark, []))).count() == 0


def test_recall_in_a_tight_group(spark):
    """A third of the rows lie close together without being equal, in far more lists than a query visits elsewhere."""
    rng = np.random.default_rng(5)
    for noise in (0.5, 0.1):
        x = rng.normal(size=(9000, 64))
        x[:3000] = rng.normal(size=64) + noise * rng.normal(size=(3000, 64))
        df = table(spark, [(f"c{i:05d}", v.tolist(), T0, 0, 0) for i, v in enumerate(x)])
        nearest, vectors = V.most_similar(df, list_rows=64, cell_rows=2000)
        name = {r["n"]: int(r["id"][1:]) for r in vectors.select("n", "id").collect()}
        got = {name[r["n"]]: {name[t["n"]] for t in r["top"]} for r in nearest.collect()}
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = u[:3000] @ u.T
        s[np.arange(3000), np.arange(3000)] = -2
        top = np.argpartition(-s, 10, axis=1)[:, :10]
        assert np.mean([j in got[i] for i in range(3000) for j in top[i]]) > 0.98
