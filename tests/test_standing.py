"""Standing queries (ST-3): after every upsert the kept answers are those of a full search."""

import random

import numpy as np
from pyspark.sql import functions as F

from simcat.operators import catalog as C
from simcat.operators.search import search
from simcat.session import shared_dir
from simcat.sources.store import CatalogStore
from simcat.streaming.standing import StandingQueries

FEED = "seq long, id long, text string, ts long, vector array<float>"


def rows(df):
    return sorted(map(tuple, df.select("qid", "rank", "id", "score_rate").collect()))


def setup(spark, spare):
    rng = np.random.default_rng(2)
    queries = spark.createDataFrame([(q, [3, None, 1][q % 3], [float(x) for x in rng.normal(size=4)]) for q in range(12)], "qid long, k int, vector array<float>")
    store = CatalogStore(spark, shared_dir(spark, "t-standing"), buckets=2, delta_share=1.0)
    return rng, queries, store, StandingQueries(spark, shared_dir(spark, "t-standing-state"), queries, spare=spare)


def upsert(spark, store, standing, changes, seq):
    feed = spark.createDataFrame([(seq + i, row, "t", 1, [float(x) for x in v]) for i, (row, v) in enumerate(changes)], FEED)
    store.merge(C.fold_upserts(feed))
    now, ids = store.latest(), feed.select("id").distinct()
    changed = store.read(now).join(ids, "id", "left_semi").select("id", "vector")
    asked = []

    def catalog():
        asked.append(True)
        return store.read(now)

    standing.refresh(now["version"], changed, catalog)
    return asked


def test_answers_follow_every_upsert(spark):
    rng, queries, store, standing = setup(spark, spare=1)
    pick, seq, scans = random.Random(4), 0, []
    plain = queries.withColumn("k", F.coalesce("k", F.lit(5)))
    for step in range(6):
        ids = pick.sample(range(1, 40), 12) if step else list(range(1, 25))
        # values on a grid make ties; a shrinking vector makes queries lose hits
        changes = [(i, np.round(rng.normal(size=4) * (0.2 if step == 3 else 1.0), 0 if step % 2 else 3)) for i in ids]
        scans.append(upsert(spark, store, standing, changes, seq))
        seq += 100
        assert rows(standing.answers()) == rows(search(plain, store.read().select("id", "vector")))
    counted = standing.rescans()
    assert list(counted.values())[0] == 12 and len(counted) == 6
    assert any(n == 0 for n in list(counted.values())[1:]) == any(not s for s in scans[1:])


def test_unrelated_rows_cost_no_scan_and_a_lost_hit_one(spark):
    _, queries, store, standing = setup(spark, spare=2)
    far = queries.filter("qid = 0").first().vector
    good = [(i, np.array(far) * (1 + i / 100)) for i in range(1, 11)]
    upsert(spark, store, standing, good, 0)
    standing.queries = standing.queries.filter("qid = 0")
    assert not upsert(spark, store, standing, [(50, -np.array(far))], 100)  # below the floor: nothing changes
    assert [r[2] for r in rows(standing.answers().filter("qid = 0"))] == [10, 9, 8]
    assert not upsert(spark, store, standing, [(10, -np.array(far)), (9, -np.array(far))], 200)  # two to spare
    assert [r[2] for r in rows(standing.answers().filter("qid = 0"))] == [8, 7, 6]
    assert upsert(spark, store, standing, [(8, -np.array(far))], 300)  # fewer than k are left
    assert [r[2] for r in rows(standing.answers().filter("qid = 0"))] == [7, 6, 5]


def test_a_replayed_refresh_changes_nothing_and_state_reopens(spark):
    rng, queries, store, standing = setup(spark, spare=1)
    upsert(spark, store, standing, [(i, rng.normal(size=4)) for i in range(1, 9)], 0)
    upsert(spark, store, standing, [(i, rng.normal(size=4)) for i in range(5, 12)], 100)
    want, now = rows(standing.answers()), store.latest()
    changed = store.read(now).filter("id between 5 and 11").select("id", "vector")
    standing.refresh(now["version"], changed, lambda: store.read(now))
    again = StandingQueries(spark, standing.root, spare=1)
    assert rows(again.answers()) == want and len(again.versions()) == 2


def test_an_empty_catalog_has_no_hits(spark):
    _, queries, store, standing = setup(spark, spare=1)
    standing.refresh(0, C.empty_catalog(spark).select("id", "vector"), lambda: C.empty_catalog(spark))
    assert standing.answers().count() == 0
    upsert(spark, store, standing, [(1, np.ones(4))], 0)
    assert standing.answers().count() == 12


def test_changed_rows_are_kept_while_the_answers_are_refreshed(spark, monkeypatch):
    from simcat.streaming import standing as S

    kept, levels = S.StandingQueries.refresh, []
    monkeypatch.setattr(S.StandingQueries, "refresh", lambda self, v, changed, catalog: (levels.append(changed.storageLevel.useMemory), kept(self, v, changed, catalog)))
    from simcat.plans.fixtures import hashing_embedder
    from simcat.session import shared_dir
    from simcat.sources.store import CatalogStore
    from simcat.streaming.feed import deliver, read_feed_stream

    run, emb = shared_dir(spark, "test-standing-kept"), hashing_embedder()
    store = CatalogStore(spark, f"{run}/catalog", buckets=2, delta_share=0.5)
    queries = emb.embed(spark.createDataFrame([(1, "a b")], "qid long, text string"), "text", "vector").selectExpr("qid", "1 as k", "vector")
    standing = S.StandingQueries(spark, f"{run}/standing", queries)
    feed = spark.createDataFrame([(0, 1, "a b", 0), (1, 2, "c", 0), (2, 0, "a b", 0)], "seq long, id long, text string, ts long")
    deliver(spark, [feed], lambda src: S.run_standing_stream(read_feed_stream(spark, src, feed.schema), store, emb, standing, f"{run}/checkpoint", dim=64))
    assert levels == [True]
    assert [(r.qid, r.id) for r in standing.answers().collect()] == [(1, 1)]
