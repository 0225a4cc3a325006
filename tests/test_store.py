"""The catalog store (K-1): deltas over buckets, buckets that grow, checks at commit, upkeep."""

import random

import pytest
from pyspark.sql import functions as F

from simcat.operators import catalog as C
from simcat.session import shared_dir
from simcat.sources.store import CatalogStore, Layout

SCHEMA = "seq long, id long, text string, ts long, vector array<float>"
BOOK = "id, text, vector, dim, count, created_at, updated_at, first_seq, last_seq"


def feed(spark, rows):
    return C.fold_upserts(spark.createDataFrame(rows, SCHEMA))


def events(n, ids, seed, start=0):
    rng = random.Random(seed)
    rows = [(start + s, rng.choice([1, rng.randint(1, ids)]), f"t{rng.randint(0, 99)}", 1000 + start + s, [float(s), 1.0]) for s in range(n)]
    rng.shuffle(rows)
    return rows


def content(df):
    return sorted(map(tuple, df.selectExpr(*BOOK.split(", ")).collect()))


def rows_in(store, folder):
    return store.spark.read.parquet(f"{store.root}/data/{folder}").count()


def folders(commit):
    return {d for e in commit["manifest"].values() for d in [e["base"], *e["deltas"]] if d}


def test_deltas_equal_rewrites_and_cost_their_feed(spark):
    rows = events(400, 80, 3)
    batches = [rows[i::5] for i in range(5)]  # every id comes late and early
    plain = CatalogStore(spark, shared_dir(spark, "t-plain"), buckets=4)
    never = CatalogStore(spark, shared_dir(spark, "t-never"), buckets=4, delta_share=1e9, max_deltas=99)
    due = CatalogStore(spark, shared_dir(spark, "t-due"), buckets=4, delta_share=0.5)
    for batch in batches:
        f = feed(spark, batch)
        before = folders(never.latest()) if never.latest() else set()
        for store in (plain, never, due):
            store.merge(f)
        (new,) = folders(never.latest()) - before
        assert rows_in(never, new) == len({r[1] for r in batch})  # a row per id of the feed, whatever the catalog holds
        assert content(never.read(bookkeeping=True)) == content(due.read(bookkeeping=True)) == content(plain.read(bookkeeping=True))
        assert never.count() == due.count() == plain.count() == plain.read().count()
    assert all(len(e["deltas"]) == 4 and e["base"] for e in never.latest()["manifest"].values())
    assert due.latest()["version"] > 5 and all(len(e["deltas"]) < 4 for e in due.latest()["manifest"].values())  # compactions are commits
    version = never.latest()["version"]
    never.compact()
    assert never.latest()["version"] == version + 1 and all(not e["deltas"] for e in never.latest()["manifest"].values())
    assert content(never.read(bookkeeping=True)) == content(plain.read(bookkeeping=True)) == content(never.read(never.commit_of(version), bookkeeping=True))


def test_deltas_over_a_written_base_without_bookkeeping(spark):
    cat = spark.createDataFrame([(i, "old", [1.0, 2.0], 2, 5, 100, 100) for i in range(1, 30)], "id long, text string, vector array<float>, dim int, count long, created_at long, updated_at long")
    stores = [CatalogStore(spark, shared_dir(spark, "t-base"), buckets=2, delta_share=s) for s in (None, 9.0)]
    for store in stores:
        store.write(cat)
        store.merge(feed(spark, [(50, 1, "t50", 5000, [3.0, 3.0]), (51, 40, "new", 5100, [4.0, 4.0])]))
        store.merge(feed(spark, [(40, 1, "t40", 4000, [5.0, 5.0]), (52, 40, "new2", 5200, [6.0, 6.0])]))
    a, b = (content(s.read(bookkeeping=True)) for s in stores)
    row = {r[0]: r for r in a}
    assert a == b and row[1][1:2] + row[1][4:7] == ("t50", 7, 100, 5000) and row[40][1] == "new2" and row[40][5:7] == (5100, 5200)
    assert sorted(r.id for r in stores[1].lookup([1, 40, 99]).collect()) == [1, 40]


def test_the_base_is_not_shuffled_to_lay_deltas_over_it(spark):
    store = CatalogStore(spark, shared_dir(spark, "t-plan"), buckets=2, delta_share=9.0)
    store.write(spark.createDataFrame([(i, "old", [1.0], 1, 5, 100, 100) for i in range(1, 3000)], "id long, text string, vector array<float>, dim int, count long, created_at long, updated_at long"))
    store.merge(feed(spark, [(50, 1, "t50", 5000, [3.0])]))
    df = store.read()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan.split("Initial Plan")[0]


def test_buckets_grow_from_4_to_64_and_old_versions_stay(spark):
    store = CatalogStore(spark, shared_dir(spark, "t-grow"), buckets=4)
    first = [(i, i, f"t{i}", i, [1.0]) for i in range(1, 200)]
    store.merge(feed(spark, first))
    old, before = store.latest(), content(store.read(bookkeeping=True))
    store.split()
    kept = {b: e for b, e in old["manifest"].items() if b != "0"}
    now = store.latest()
    assert (now["level"], now["split"], store.buckets) == (0, 1, 5)
    assert {b: e for b, e in now["manifest"].items() if b not in ("0", "4")} == kept  # the others keep their files
    store.rows_per_bucket = 10
    store.merge(feed(spark, [(i, i, f"t{i}", i, [1.0]) for i in range(200, 641)]))
    assert store.buckets == 64 and store.latest()["level"] == 4
    assert store.count() == store.read().count() == 640
    ids = [1, 77, 640]
    found = store.lookup(ids)
    assert sorted(r.id for r in found.collect()) == ids and len(found.inputFiles()) <= 3
    for b in (0, 37, 63):
        mine = store.read(buckets={b})
        assert mine.select(store.layout.of(F.col("id")).alias("b")).distinct().collect() in ([(b,)], [])
    assert content(store.read(old, bookkeeping=True)) == before and sorted(r.id for r in store.lookup([5], old).collect()) == [5]
    reopened = CatalogStore(spark, store.root)
    assert reopened.buckets == 64
    reopened.merge(feed(spark, [(900, 7, "again", 900, [1.0])]))
    assert {r.id: r["count"] for r in reopened.lookup([7, 8]).collect()} == {7: 2, 8: 1}


def test_deltas_are_folded_when_their_bucket_is_split(spark):
    store = CatalogStore(spark, shared_dir(spark, "t-both"), buckets=1, delta_share=1e9, rows_per_bucket=20, max_deltas=99)
    plain = CatalogStore(spark, shared_dir(spark, "t-both-plain"), buckets=1)
    rows = events(300, 100, 8)
    for i in range(4):
        f = feed(spark, rows[i::4])
        store.merge(f)
        plain.merge(f)
    assert store.buckets == -(-store.count() // 20) and content(store.read(bookkeeping=True)) == content(plain.read(bookkeeping=True))


def test_layout_splits_in_turn(spark):
    ids = spark.range(500)
    layout = Layout(3)
    for _ in range(9):
        after = layout.after(1)
        moved = {(r[0], r[1]) for r in ids.select(layout.of(F.col("id")), after.of(F.col("id"))).collect() if r[0] != r[1]}
        assert moved == {(layout.split, layout.split + layout.whole)} and after.buckets == layout.buckets + 1
        layout = after


@pytest.mark.parametrize("share", [None, 5.0])
def test_mixed_dimensions_are_refused_and_leave_nothing(spark, share):
    store = CatalogStore(spark, shared_dir(spark, "t-dim"), buckets=2, delta_share=share)
    with pytest.raises(ValueError, match=r"expected 2; ids \[3\]"):
        store.merge(feed(spark, [(1, 1, "a", 1, [1.0, 2.0]), (2, 2, "b", 1, [1.0, 2.0]), (3, 3, "c", 1, [1.0])]))
    assert store.latest() is None and store._names("data") == [] and store.count() == 0
    store.merge(feed(spark, [(1, 1, "a", 1, [1.0, 2.0])]))
    for bad in ([1.0], None, []):
        with pytest.raises(ValueError, match="expected 2"):
            store.merge(feed(spark, [(9, 2, "b", 1, bad), (9, 3, "ok", 1, [1.0, 1.0])]))
    assert store.latest()["version"] == 1 and store.latest()["dim"] == 2 and len(store._names("data")) == 1
    store.write(store.read().withColumn("vector", F.array(F.lit(1.0).cast("float"))).withColumn("dim", F.lit(1)))
    assert store.latest()["dim"] == 1  # a new catalog may have another one


def test_two_writers_cannot_commit_one_version(spark):
    root = shared_dir(spark, "t-race")
    a, b = CatalogStore(spark, root, buckets=2), CatalogStore(spark, root, buckets=2)
    prev = a.latest()
    a._commit(prev, {})
    with pytest.raises(RuntimeError, match="committed concurrently"):
        b._commit(prev, {})
    assert a.versions() == [1] and not [n for n in a._names("_commits") if "tmp" in n]


def test_vacuum_removes_old_versions_and_lost_attempts(spark):
    store = CatalogStore(spark, shared_dir(spark, "t-vacuum"), buckets=2, delta_share=9.0)
    for i in range(4):
        store.merge(feed(spark, [(i, i % 2 + 1, f"t{i}", i, [1.0])]))
    store._write_buckets(store.read(bookkeeping=True), "v000002-lost")
    store._write_buckets(store.read(bookkeeping=True), "v000009-underway")
    before = content(store.read(bookkeeping=True))
    assert store.vacuum(keep=2) == ["v000002-lost"]  # the deltas of older versions are still in use
    assert store.versions() == [3, 4] and content(store.read(bookkeeping=True)) == before
    store.compact()
    gone = store.vacuum()
    assert len(gone) == 4 and store.versions() == [5] and content(store.read(bookkeeping=True)) == before
    assert "v000009-underway" in store._names("data")


def test_max_deltas_compacts(spark):
    store = CatalogStore(spark, shared_dir(spark, "t-max"), buckets=1, delta_share=1e9, max_deltas=2)
    for i in range(5):
        store.merge(feed(spark, [(i, 1, f"t{i}", i, [1.0])]))
    assert [len(e["deltas"]) for e in store.latest()["manifest"].values()] == [1] and store.read().first()["count"] == 5


def test_commits_of_streams_survive_upkeep(spark):
    store = CatalogStore(spark, shared_dir(spark, "t-streams"), buckets=1, delta_share=0.0, rows_per_bucket=1)
    assert store.merge(feed(spark, [(1, 1, "a", 1, [1.0]), (2, 2, "a", 1, [1.0])]), batch_id=0, stream="s", counts={"rows": 2})
    assert store.last_batch("s") == {"batch_id": 0, "rows": 2, "catalog_count": 2}
    assert store.merge(feed(spark, [(1, 1, "a", 1, [1.0])]), batch_id=0, stream="s") is None


def test_texts_come_from_the_winners_buckets(spark):
    store = CatalogStore(spark, shared_dir(spark, "t-texts"), buckets=32)
    store.merge(feed(spark, [(i, i, f"t{i}", i, [1.0]) for i in range(1, 400)]))
    hits = spark.createDataFrame([(1, 1, 17), (1, 2, 300), (2, 1, 17)], "qid long, rank int, id long")
    found = store.texts_of(hits)
    assert sorted((r.qid, r["rank"], r.text) for r in found.collect()) == [(1, 1, "t17"), (1, 2, "t300"), (2, 1, "t17")]
    assert len([f for f in found.inputFiles() if "bucket=" in f]) <= 2


def test_growth_over_several_levels_is_one_commit(spark):
    """Each doubling was a commit of its own that read and wrote every row again."""
    from simcat.sources.store import Layout

    for old in (Layout(4), Layout(4, 0, 3), Layout(4, 1, 5)):
        for n in range(old.buckets, 70):
            new = old.grown(n)
            assert new.buckets == n and new.split < new.whole
            for h in range(0, 4096, 7):
                of = lambda x: h % (2 * x.whole) if h % x.whole < x.split else h % x.whole
                assert of(old) == of(new) or of(old) in old.changed(new)
            step = old
            while step.buckets < n:
                step = step.after(min(n - step.buckets, step.whole - step.split))
            assert (step.whole, step.split) == (new.whole, new.split)
    store = CatalogStore(spark, shared_dir(spark, "t-grow-far"), buckets=4, rows_per_bucket=3)
    rows_ = [(i, f"t{i}", [1.0, float(i)], 2, 1, 0, 0) for i in range(1, 131)]
    store.write(spark.createDataFrame(rows_, "id long, text string, vector array<float>, dim int, count long, created_at long, updated_at long"))
    before = store.latest()["version"]
    store.grow()
    after = store.latest()
    assert after["version"] == before + 1 and store.buckets == 44
    assert store.read().count() == 130 and {r.id for r in store.lookup([1, 77, 130]).collect()} == {1, 77, 130}


def test_a_small_delta_needs_few_tasks(spark):
    from simcat.session import shared_dir

    store = CatalogStore(spark, shared_dir(spark, "test-few-tasks"), buckets=2, delta_share=5.0)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        spark.sparkContext.setJobGroup("few-tasks", "merges of two rows")
        for s in (0, 2):
            rows = [(s, 1, f"t{s}", s, [1.0]), (s + 1, 2, f"t{s + 1}", s, [1.0])]
            store.merge(C.fold_upserts(spark.createDataFrame(rows, "seq long, id long, text string, ts long, vector array<float>")))
        track = spark.sparkContext.statusTracker()
        stages = [track.getStageInfo(i) for j in track.getJobIdsForGroup("few-tasks") for i in track.getJobInfo(j).stageIds]
        assert max(x.numCompletedTasks for x in stages if x) < 37
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [(r.id, r.text, r["count"]) for r in store.read().orderBy("id").collect()] == [(1, "t2", 2), (2, "t3", 2)]
