import numpy as np
import pytest
from pyspark.sql import functions as F

from simcat.llm import queries, topk


def brute(rows, asks, k, scale=64):
    """rows: {id: list of components}, or (id, components) pairs with repeated ids; exact integers."""
    rows = sorted(rows.items() if isinstance(rows, dict) else rows, key=lambda r: r[0])
    x = [[int(np.floor(scale * float(c))) for c in v] for _, v in rows]
    out = []
    for at, (i, _) in enumerate(rows):
        if asks(i):
            best = sorted((-sum(a * b for a, b in zip(x[at], y)), j) for n, ((j, _), y) in enumerate(zip(rows, x)) if n != at)[:k]
            out += [(i, r + 1, j, -v) for r, (v, j) in enumerate(best)]
    return sorted(out)


def test_query_equals_brute_force(spark, sf):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = queries.op3_impact_topk(spark, sf).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 20 == 0, 20)


def test_ties_copies_lengths_nulls_and_repeats(spark):
    rng = np.random.default_rng(5)
    rows = {i: list(np.round(rng.normal(size=6), 1)) for i in range(60)}
    rows |= {i: [0.5, -0.5, 0.25] for i in range(100, 190)} | {200: [], 201: [0.0] * 6, 202: [1.0] * 6, 203: [1.0] * 6}
    sound = [(i, [float(x) for x in v]) for i, v in rows.items()] + [(202, [1.0] * 6), (7, [1e6] * 3), (5, [2.0, 3.0]), (5, [2.0, 3.0]), (10, [-1.0])]
    table = [(*r, "x") for r in sound] + [(300, None, ""), (301, [None, 1.0], ""), (302, [float("nan")], ""), (303, [float("inf")], ""), (None, [1.0], "")]
    df = spark.createDataFrame(table, "id2 long, q array<double>, rep string")
    got = topk.top_k(df, F.col("id2") % 5 == 0, k=4, key="id2", vector="q")
    assert sorted(map(tuple, got.collect())) == brute(sound, lambda i: i % 5 == 0, 4)


def test_rows_that_share_an_id_are_all_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [-1.0]), (1, [5.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 20480), (0, 2, 1, -4096)]
    both = topk.top_k(df, F.col("vec_id") == 1).collect()
    assert sorted(map(tuple, both)) == sorted([(1, 1, 0, -4096), (1, 2, 1, -20480), (1, 1, 0, 20480), (1, 2, 1, -20480)])


def test_large_components_are_exact_or_refused(spark):
    rows = [(1, [2e6]), (2, [3e6]), (3, [4e6]), (4, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.lit(True)).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: True, 20) and [r.vec_id if "vec_id" in r else r.id for r in got if r.query_id == 1] == [3, 2, 4]
    rng = np.random.default_rng(4)
    near = [(i, [float(2**24 + x), float(2**24 - x), 3.0]) for i, x in enumerate(rng.integers(0, 9, 40))]
    got = topk.top_k(spark.createDataFrame(near, "vec_id long, embedding array<double>"), F.col("vec_id") % 3 == 0, k=5).collect()
    assert sorted(map(tuple, got)) == brute(near, lambda i: i % 3 == 0, 5)
    for huge in (1e9, 1e300, -3e38):
        with pytest.raises(ValueError, match=r"64 bits: ids \[9\]"):
            topk.top_k(df.union(spark.createDataFrame([(9, [huge])], df.schema)), F.lit(True))


def test_fewer_rows_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, k=20).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0


def test_scan_stops_early_only_with_all_members(monkeypatch):
    rng = np.random.default_rng(1)
    x = np.floor(64 * rng.normal(size=(3000, 16)) ** 3).astype(np.int64)
    q = x[:50]
    exact = x @ q.T
    seen = []
    real = topk.Block.residuals
    monkeypatch.setattr(topk.Block, "residuals", lambda self, m: seen.append(m) or real(self, m))
    v, c = topk.possible_members(topk.Block(x), q, np.full(50, -np.inf), 5)
    assert seen and len(v) < exact.size / 4
    members = set(zip(v.tolist(), c.tolist()))
    for j in range(50):
        kth = np.sort(exact[:, j])[-5]
        assert all((i, j) in members for i in np.flatnonzero(exact[:, j] >= kth).tolist())


def test_several_chunks_blocks_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 16)
    monkeypatch.setattr(topk, "PER_TASK", 40)
    rng = np.random.default_rng(2)
    rows = {i: [float(x) for x in rng.normal(size=4)] for i in range(150)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 2 == 0, k=3).collect())) == brute(rows, lambda i: i % 2 == 0, 3)
