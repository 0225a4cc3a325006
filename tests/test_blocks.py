"""Pruned search over blocks (J-1): the hits of ``search``, and less work."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from simcat import params as P
from simcat.operators.blocks import build_blocks, search_blocks
from simcat.operators.search import search

CATALOG = "id long, vector array<float>"


def rows(df):
    return sorted(map(tuple, df.select("qid", "rank", "id", "score_rate").collect()))


def clusters(n=3000, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    v = centres[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def test_hits_of_search_with_most_pairs_skipped(spark):
    v = clusters()
    cat = spark.createDataFrame([(i + 1, x.tolist()) for i, x in enumerate(v)], CATALOG)
    q = cat.filter("id % 10 = 0").select(F.col("id").alias("qid"), (F.col("id") % 7 + 1).cast("int").alias("k"), "vector")
    index = build_blocks(cat, pivots=24, block_rows=64)
    hits, report = search_blocks(q, index)
    assert rows(hits) == rows(search(q, cat))
    r = report.first()
    assert r.pairs == 300 * 3000 and r.skipped_share > 0.5 and r.scored == round(r.pairs * (1 - r.skipped_share))
    chunked, report = search_blocks(q, index, chunk_rows=37)
    assert rows(chunked) == rows(hits) and report.first().pairs == 300 * 3000


def test_the_layout_holds_every_row_once_in_bounded_blocks(spark):
    v = clusters(700)
    rows_ = [(i + 1, x.tolist()) for i, x in enumerate(v)] + [(i + 1001, v[0].tolist()) for i in range(400)]  # a third are copies
    index = build_blocks(spark.createDataFrame(rows_, CATALOG).repartition(5), pivots=8, block_rows=50)
    blocks = index.blocks(spark).collect()
    assert sorted(i for b in blocks for i in b.ids) == sorted(i for i, _ in rows_) and max(len(b.ids) for b in blocks) <= 50
    for b in blocks:
        x = np.frombuffer(b.vectors, "<f8").reshape(len(b.ids), -1)
        c = np.frombuffer(b.centre, "<f8")
        assert np.allclose(x.mean(axis=0), c) and np.sqrt(((x - c) ** 2).sum(axis=1)).max() <= b.radius + 1e-12


def test_ties_unnormalised_and_negative_scores(spark):
    rng = np.random.default_rng(5)
    v = [*(rng.integers(-3, 4, size=(200, 3)) * 1.0), *[np.array([1.0, 1.0, 1.0])] * 100, np.zeros(3), np.array([50.0, 0, 0])]
    cat = spark.createDataFrame([(i + 1, [float(z) for z in x]) for i, x in enumerate(v)], CATALOG)
    q = cat.filter("id < 60").select(F.col("id").alias("qid"), F.lit(9).alias("k"), "vector")
    hits, _ = search_blocks(q, build_blocks(cat, pivots=5, block_rows=7))
    raw = search(q, cat, keep_raw=True)
    assert rows(hits) == rows(raw)


def test_small_and_empty_tables(spark):
    cat = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], CATALOG)
    q = spark.createDataFrame([(7, 5, [1.0, 0.5])], "qid long, k int, vector array<float>")
    index = build_blocks(cat)
    assert rows(search_blocks(q, index)[0]) == rows(search(q, cat)) and search_blocks(q.limit(0), index)[0].count() == 0
    hits, report = search_blocks(q, build_blocks(cat.limit(0)))
    assert hits.count() == 0 and report.first().pairs == 0


def test_wrong_dimensions_and_repeated_queries_raise(spark):
    cat = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], CATALOG)
    q = spark.createDataFrame([(7, 5, [1.0, 0.5]), (7, 5, [1.0, 0.5])], "qid long, k int, vector array<float>")
    with pytest.raises(ValueError, match="repeated qid"):
        search_blocks(q, build_blocks(cat))
    with pytest.raises(Exception, match="dimension mismatch"):
        build_blocks(cat.union(spark.createDataFrame([(3, [1.0])], CATALOG)))


def test_the_catalog_is_not_exchanged_by_a_search(spark, monkeypatch):
    v = clusters(300)
    cat = spark.createDataFrame([(i + 1, x.tolist()) for i, x in enumerate(v)], CATALOG)
    q = cat.select(F.col("id").alias("qid"), F.lit(3).alias("k"), "vector")
    index, plans, real = build_blocks(cat), [], type(q).mapInArrow
    monkeypatch.setattr(type(q), "mapInArrow", lambda self, *a, **k: plans.append(self._jdf.queryExecution().executedPlan().toString()) or real(self, *a, **k))
    search_blocks(q, index, P.DEFAULT.with_(broadcast_query_bytes=1 << 13))
    assert len(plans) > 1 and all("Exchange" not in p for p in plans)


def test_chunks_that_fit_the_budget_share_a_scan(spark, monkeypatch):
    """The layout was scanned once per chunk, one job after another, however small the chunks."""
    v = clusters(300)
    cat = spark.createDataFrame([(i + 1, x.tolist()) for i, x in enumerate(v)], CATALOG)
    q = cat.select(F.col("id").alias("qid"), F.lit(3).alias("k"), "vector")
    index, plans, real = build_blocks(cat), [], type(q).mapInArrow
    monkeypatch.setattr(type(q), "mapInArrow", lambda self, *a, **k: plans.append(1) or real(self, *a, **k))
    hits, report = search_blocks(q, index, chunk_rows=10)
    assert len(plans) == 1 and rows(hits) == rows(search(q, cat)) and report.first().pairs == 300 * 300


def test_small_blocks_are_scored_in_runs(monkeypatch):
    """Every block was scored by itself, so blocks of a few rows made as many small products for each tile of queries."""
    import pyarrow as pa

    from simcat.operators import blocks as B

    rng = np.random.default_rng(3)
    v = rng.normal(size=(4000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids, pivots = np.arange(1, 4001), v[:6]
    rows_ = pa.RecordBatch.from_arrays([pa.array(np.zeros(4000, np.int32)), pa.array(ids), pa.array(list(v))], names=["pivot", "id", "vector"])
    met, real = [], B._Best.meet
    monkeypatch.setattr(B._Best, "meet", lambda self, i, *a: met.append(len(i)) or real(self, i, *a))
    k = rng.integers(1, 9, 300)
    *found, counted = B._scan(ids[:300], k, v[:300], pivots, 24)(B._packer(24, 8)(iter([rows_])))
    assert counted.to_pylist()[0]["pairs"] == 300 * 4000 and len(met) < 6 * 12
    hits = {}
    for b in found:
        for r in b.to_pylist():
            hits.setdefault(r["qid"], []).append((-r["score"], r["id"]))
    scores = v[:300] @ v.T
    for j in range(300):
        assert [i for _, i in sorted(hits[j + 1])] == (np.argsort(-scores[j])[: k[j]] + 1).tolist()


def test_repeated_rows_give_the_hits_of_search(spark):
    v = clusters(600)
    v[200:] = v[200]
    cat = spark.createDataFrame([(i + 1, x.tolist()) for i, x in enumerate(v)], CATALOG)
    q = cat.filter("id % 4 = 0").select(F.col("id").alias("qid"), F.lit(6).alias("k"), "vector")
    hits, report = search_blocks(q, build_blocks(cat, pivots=9, block_rows=20))
    assert rows(hits) == rows(search(q, cat)) and report.first().pairs == 150 * 600
    by_id = [r[2] for r in rows(hits) if r[0] == 400]
    assert by_id == [201, 202, 203, 204, 205, 206]
