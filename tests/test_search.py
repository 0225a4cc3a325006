"""Search plans against a numpy brute force, plan shape, and ranking properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from simcat.operators.search import prepare_queries, search
from simcat.plans.fixtures import embeddings_catalog


def brute(cat_rows, q_rows, k):
    ids = np.array([r.id for r in cat_rows])
    C = np.array([r.vector for r in cat_rows], dtype=np.float64)
    out = {}
    for q in q_rows:
        s = C @ np.array(q.vector, dtype=np.float64)
        order = sorted(range(len(ids)), key=lambda i: (-round(s[i], 12), ids[i]))[:k]
        out[q.qid] = [(int(ids[i]), max(-1.0, min(1.0, round(float(s[i]), 4)))) for i in order]
    return out


@pytest.fixture(scope="module")
def cat(spark, sf):
    return embeddings_catalog(spark, sf).cache()


@pytest.mark.parametrize("plan,blocks", [("broadcast", None), ("blocked", (2, 3)), ("blocked", (1, 1))])
def test_plans_equal_brute_force(spark, cat, plan, blocks):
    q = cat.select(F.col("id").alias("qid"), F.lit(5).alias("k"), "vector")
    hits = search(q, cat, plan=plan, blocks=blocks).collect()
    got = {}
    for h in sorted(hits, key=lambda h: (h.qid, h.rank)):
        got.setdefault(h.qid, []).append((h.id, h.score_rate))
    exp = brute(cat.collect(), q.collect(), 5)
    assert got == exp


def test_broadcast_plan_reduces_across_many_arrow_batches(spark, cat):
    """Candidates are reduced batch by batch inside a task; tiny Arrow batches (and
    one catalog partition) must give the brute-force answer, ties included."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        one = cat.coalesce(1)
        q = cat.select(F.col("id").alias("qid"), F.lit(5).alias("k"), "vector")
        hits = search(q, one, plan="broadcast").collect()
    finally:
        spark.conf.set(key, old)
    got = {}
    for h in sorted(hits, key=lambda h: (h.qid, h.rank)):
        got.setdefault(h.qid, []).append((h.id, h.score_rate))
    assert got == brute(cat.collect(), q.collect(), 5)


def test_ranking_properties(spark, cat):
    q = cat.select(F.col("id").alias("qid"), F.lit(7).alias("k"), "vector")
    hits = search(q, cat, keep_raw=True).collect()
    by_q = {}
    for h in hits:
        by_q.setdefault(h.qid, []).append(h)
    ids = {r.id for r in cat.select("id").collect()}
    for qid, hs in by_q.items():
        hs.sort(key=lambda h: h.rank)
        assert [h.rank for h in hs] == list(range(1, 8))          # dense ranks
        assert all(h.id in ids for h in hs)                        # hits come from the catalog
        raw = [h._raw_score for h in hs]
        assert raw == sorted(raw, reverse=True)                    # non-increasing
        assert hs[0].id == qid                                      # distinct unit vectors: self first


def test_batch_equals_singles(spark, cat):
    q = cat.select(F.col("id").alias("qid"), F.lit(3).alias("k"), "vector").orderBy("qid").limit(4)
    batch = sorted((h.qid, h.rank, h.id) for h in search(q, cat).collect())
    singles = []
    for r in q.collect():
        one = spark.createDataFrame([(r.qid, 3, r.vector)], "qid long, k int, vector array<float>")
        singles += [(h.qid, h.rank, h.id) for h in search(one, cat).collect()]
    assert batch == sorted(singles)


def test_k_and_empty_catalog(spark, cat):
    small = cat.orderBy("id").limit(3)
    q = cat.select(F.col("id").alias("qid"), F.lit(5).alias("k"), "vector").limit(4)
    assert all(c == 3 for c in search(q, small).groupBy("qid").count().select("count").toPandas()["count"])
    assert search(q, cat.filter(F.lit(False))).count() == 0


def test_query_validation(spark):
    rows = [(1, "ok", None), (2, "", None), (3, "  ", None), (4, "x" * 100001, None),
            (5, "ok", 0), (6, "ok", 51), (7, "ok", 50)]
    df = spark.createDataFrame(rows, "qid long, text string, top_k int")
    valid, rejects = prepare_queries(df)
    assert {r.qid: r.k for r in valid.collect()} == {1: 5, 7: 50}
    assert {r.qid: r.reason for r in rejects.collect()} == {
        2: "text length must be within 1..100000", 3: "Query text cannot be empty",
        4: "text length must be within 1..100000", 5: "top_k must be >= 1", 6: "top_k must be <= 50"}


def test_plan_has_no_pair_explosion(spark, cat):
    q = cat.select(F.col("id").alias("qid"), F.lit(5).alias("k"), "vector")
    for plan, blocks in (("broadcast", None), ("blocked", (2, 2))):
        text = search(q, cat, plan=plan, blocks=blocks)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
        assert "WindowGroupLimit" in text


@pytest.mark.parametrize("plan,blocks", [("broadcast", None), ("blocked", (2, 3))])
def test_exact_ties_break_by_id_across_tasks(spark, plan, blocks):
    base = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.6, 0.8, 0.0]]
    rows = [(i + 1, base[i % 3]) for i in range(60)]               # every vector 20 times
    cat = spark.createDataFrame(rows, "id long, vector array<float>").repartition(7)
    q = spark.createDataFrame([(j + 1, k, base[j]) for j, k in enumerate([5, 1, 12])],
                              "qid long, k int, vector array<float>")
    hits = search(q, cat, plan=plan, blocks=blocks).collect()
    got = {}
    for h in sorted(hits, key=lambda h: (h.qid, h.rank)):
        got.setdefault(h.qid, []).append(h.id)
    expect = {j + 1: [i + 1 for i in range(60) if i % 3 == j][:k] for j, k in enumerate([5, 1, 12])}
    assert got == expect


def test_auto_plan_falls_back_to_blocks_beyond_the_broadcast_budget(spark, cat):
    from simcat import params as P

    small = P.DEFAULT.with_(broadcast_query_bytes=10 * 64 * 8)  # ten 64-d queries
    q = cat.select(F.col("id").alias("qid"), F.lit(5).alias("k"), "vector")
    plan = search(q, cat, small)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapCoGroupsInArrow", "")
    got = {}
    for h in sorted(search(q, cat, small).collect(), key=lambda h: (h.qid, h.rank)):
        got.setdefault(h.qid, []).append((h.id, h.score_rate))
    assert got == brute(cat.collect(), q.collect(), 5)
    with pytest.raises(ValueError, match="broadcast budget"):
        search(q, cat, small, plan="broadcast")


def test_search_run_report_counts_rejected_queries(spark, sf):
    """A catalog row whose text is too long to be a query (V-6) is a failed query of
    the run, and averages cover the successful ones only."""
    from simcat.operators.report import search_run_report
    from simcat.plans.fixtures import hashing_embedder

    emb = hashing_embedder()
    docs = (spark.read.parquet(f"{sf}/documents.parquet")
            .select((F.col("doc_id") + 1).alias("id"), "text").filter("id <= 20"))
    long = spark.createDataFrame([(1000, "w " * 50001)], "id long, text string")  # 100,002 chars
    cat = emb.embed(docs.unionByName(long), "text", "vector")
    r = search_run_report(cat, emb, n=25, k=3).first()
    assert (r.queries, r.success, r.failed) == (21, 20, 1)
    assert r.avg_results == 3.0 and 0.0 <= r.self_hit_rate <= 1.0


def test_equal_vectors_give_k_candidates_per_query_and_task(spark):
    import numpy as np

    from simcat.operators import search as S

    q = np.repeat(np.arange(3), 5000)
    ids, scores, k = np.tile(np.arange(5000)[::-1], 3), np.full(15000, 0.5), np.array([5, 1, 7])
    kept_q, kept_i, _ = S._reduce_candidates(q, ids, scores, k)
    assert sorted(zip(kept_q.tolist(), kept_i.tolist())) == [(j, i) for j in range(3) for i in range(k[j])]


def test_mixed_dimensions_name_their_ids_and_repeated_queries_are_refused(spark):
    import pytest

    from simcat.operators.search import search

    good = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<float>")
    bad = spark.createDataFrame([(7, [1.0]), (8, [1.0, 0.0, 0.0])], "id long, vector array<float>")
    q = spark.createDataFrame([(1, 1, [1.0, 0.0])], "qid long, k int, vector array<float>")
    for how in ("broadcast", "blocked"):
        with pytest.raises(Exception, match="ids \\[[78]"):
            search(q, bad.coalesce(1), plan=how).collect()
        with pytest.raises(ValueError, match="repeated qid"):
            search(q.unionByName(q), good, plan=how).collect()


def test_cells_of_the_blocked_plan_are_bounded():
    """Blocks were sized by bytes alone: 262,144 queries against as many rows were one task; given counts held at any size."""
    import simcat.operators.search as S

    for n, k, least in ((600_000, 5, (1, 1)), (600_000, 60, (2, 3)), (50_000, 1000, (2, 3)), (10, 5, (2, 3)), (0, 1, (1, 1))):
        bq, bc = S._cells(n, n, k, 64, least)
        q, c = -(-n // bq), -(-n // bc)
        assert q * c <= S._CELL_PAIRS and q * k <= S._HELD_CANDS and 8 * 64 * max(q, c) <= S._CELL_BYTES
        assert bq % least[0] == bc % least[1] == 0
    assert S._cells(10, 10, 5, 64, (2, 3)) == (2, 3)


def test_a_task_hands_on_candidates_part_by_part(spark, cat, monkeypatch):
    """A task of the broadcast plan held the candidates of all its queries until its end."""
    import simcat.operators.search as S

    monkeypatch.setattr(S, "_HELD_CANDS", 70)
    monkeypatch.setattr(S, "_HELD_COMPONENTS", 64 * 100)
    sent, real = [], S._cand_batch
    q = cat.select(F.col("id").alias("qid"), F.lit(7).alias("k"), "vector")
    tbl = q.toArrow()
    arrays = S._query_arrays(tbl, 64)
    monkeypatch.setattr(S, "_cand_batch", lambda *a: sent.append(len(a[2])) or real(*a))

    class Catalog:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return list(run(iter(cat.select("id", "vector").toArrow().to_batches(max_chunksize=60))))

    made = S._broadcast_candidates(spark, *arrays, Catalog(), 64)
    S.release_broadcasts()
    assert len(made) == len(sent) > 100 and max(sent) <= 2 * 70


def test_equal_scores_are_reduced_tile_by_tile(monkeypatch):
    """All rows of a block stood among the candidates at once where their scores were equal."""
    import simcat.operators.search as S

    monkeypatch.setattr(S, "_TILE_ELEMS", 5000)
    Q, C = np.ones((40, 4)) / 2, np.ones((1000, 4)) / 2
    q, ids, scores = S._score_block(Q, np.full(40, 3), np.arange(1000), C)
    assert len(q) == 120 and set(ids.tolist()) == {0, 1, 2} and np.allclose(scores, 1.0)


def test_a_single_precision_screen_loses_nothing():
    """Every score was computed and sorted in double precision."""
    import simcat.operators.search as S

    rng = np.random.default_rng(4)
    for dim, scale, equal in ((1, 0, 1), (3, 0, 40), (64, 0, 1), (64, 7, 1), (64, 60, 1), (300, 3, 9)):
        C = rng.normal(size=(2500, dim)) * 10.0 ** rng.integers(-scale, scale + 1, size=(2500, 1))
        C = C[np.arange(2500) // equal]
        Q, k, ids = C[rng.integers(0, 2500, 90)], rng.integers(1, 70, 90), rng.permutation(2500)
        thin, q = S._thin(C), S._thin(Q, S._slack(dim))
        assert (thin is None) == (scale > 15)
        if thin is not None:
            assert (q.astype(float) @ thin.astype(float).T >= Q @ C.T).all()
        scores = np.array([np.einsum("ij,ij->i", np.repeat(x[None], 2500, 0), C) for x in Q])
        found = list(zip(*S._score_block(Q, k, ids, C)))
        for j in range(90):
            best = sorted((-np.round(s, 12), int(i)) for x, i, s in found if x == j)[: k[j]]
            assert [i for _, i in best] == ids[np.lexsort((ids, -np.round(scores[j], 12)))[: k[j]]].tolist()


def test_many_queries_are_ranked_in_one_exchange(spark, cat, monkeypatch):
    """All candidates were exchanged and sorted twice, by (query, hash of id) and then by query."""
    import simcat.operators.search as S

    q = cat.select(F.col("id").alias("qid"), F.lit(6).alias("k"), "vector")
    rows = lambda df: sorted(map(tuple, df.collect()))
    two = rows(search(q, cat))
    monkeypatch.setattr(S, "_MANY_QUERIES", 1)
    hits = search(q, cat)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and rows(hits) == two


def test_parts_of_the_broadcast_plan_follow_the_pairs(spark, sf, monkeypatch):
    """A catalog of one file of one row group was one task's work for all queries that fit the broadcast budget."""
    from simcat.plans import search_queries as Q

    monkeypatch.setattr(Q, "PART_PAIRS", 1 << 13)
    sent, real = [], Q.search
    monkeypatch.setattr(Q, "search", lambda q, c, *a, **k: sent.append(k.get("plan")) or real(q, c, *a, **k))
    hits = Q.search_plans_agree(spark, sf)
    assert sent.count("broadcast") == min(spark.sparkContext.defaultParallelism, 1 + hits.select("qid").distinct().count() ** 2 // (1 << 13)) > 1
    by = {p: sorted(map(tuple, hits.filter(F.col("plan") == p).drop("plan").collect())) for p in ("broadcast", "blocked", "auto")}
    assert by["broadcast"] == by["blocked"] == by["auto"]


def test_repeats_of_a_row_beyond_k_are_left_out():
    import simcat.operators.search as S

    rng = np.random.default_rng(6)
    for dim, kind in ((5, np.float32), (64, np.float64)):
        C = rng.normal(size=(30, dim)).astype(kind)[rng.integers(0, 30, 900)]
        C[100:] = C[100]
        ids = rng.integers(0, 500, 900)  # some come twice
        few = S._few_equal(ids, C, 4)
        expect = []
        for v in np.unique(C, axis=0):
            expect += sorted(ids[(C == v).all(axis=1)].tolist())[:4]
        assert sorted(ids[few].tolist()) == sorted(expect)
        assert S._few_equal(ids, C, 900) is None and S._few_equal(np.arange(50), rng.normal(size=(50, dim)), 1) is None
        Q = C[:70].astype(float)
        q, i, s = S._score_block(Q, np.full(70, 4), ids, C)
        scores = np.array([np.einsum("ij,ij->i", np.repeat(x[None], 900, 0), C.astype(float)) for x in Q])
        for j in range(70):
            best = np.lexsort((ids, -np.round(scores[j], 12)))[:4]
            found = np.lexsort((i[q == j], -np.round(s[q == j], 12)))[:4]
            assert i[q == j][found].tolist() == ids[best].tolist()
