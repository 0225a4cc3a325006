"""Upsert fold/merge invariants, actions, snapshots, scans (A-6, J-2, W-1, K-1, S-2..S-5)."""

import random

from pyspark.sql import functions as F

from simcat.operators import catalog as C
from simcat.session import shared_dir
from simcat.sources.store import CatalogStore


def feed_rows(n=300, ids=7, seed=3):
    rnd = random.Random(seed)
    return [(s, rnd.randint(1, ids) if s % 11 else 1, f"t{s}", 1000 + s, [float(s % 5), 1.0]) for s in range(n)]


SCHEMA = "seq long, id long, text string, ts long, vector array<float>"


def brute_final(rows):
    out = {}
    for seq, i, t, ts, v in sorted(rows):
        if i not in out:
            out[i] = dict(text=t, count=1, created_at=ts, updated_at=ts)
        else:
            out[i].update(text=t, updated_at=ts)
            out[i]["count"] += 1
    return out


def as_dict(df):
    return {r.id: dict(text=r.text, count=r["count"], created_at=r.created_at, updated_at=r.updated_at)
            for r in df.collect()}


def test_fold_merge_any_split_any_order(spark):
    rows = feed_rows()
    exp = brute_final(rows)
    for parts, order_seed in ((1, None), (3, None), (5, 1), (4, 2)):
        chunks = [rows[i::parts] if order_seed is None else None for i in range(parts)]
        if order_seed is not None:  # contiguous seq ranges applied in a shuffled order
            size = len(rows) // parts + 1
            chunks = [rows[i:i + size] for i in range(0, len(rows), size)]
            random.Random(order_seed).shuffle(chunks)
        cat = C.empty_catalog(spark)
        for ch in chunks:
            cat = C.merge_upserts(cat, C.fold_upserts(spark.createDataFrame(ch, SCHEMA)))
        assert as_dict(cat) == exp
        assert sum(v["count"] for v in exp.values()) == len(rows)


def test_actions_match_brute_force(spark):
    rows = feed_rows(120, 9)
    known = spark.createDataFrame([(2,), (5,)], "id long")
    acts = {r.seq: r.action for r in C.upsert_actions(spark.createDataFrame(rows, SCHEMA), known).collect()}
    seen = {2, 5}
    for seq, i, *_ in sorted(rows):
        assert acts[seq] == ("updated" if i in seen else "inserted"), seq
        seen.add(i)


def test_store_versions_replay_and_buckets(spark):
    rows = feed_rows()
    store = CatalogStore(spark, shared_dir(spark, "test-store"), buckets=4)
    half = len(rows) // 2
    assert store.read().count() == 0
    v1 = store.merge(C.fold_upserts(spark.createDataFrame(rows[:half], SCHEMA)), batch_id=0)
    v2 = store.merge(C.fold_upserts(spark.createDataFrame(rows[half:], SCHEMA)), batch_id=1)
    assert (v1, v2) == (1, 2)
    # crash after the commit, batch replayed: nothing applied twice
    assert store.merge(C.fold_upserts(spark.createDataFrame(rows[half:], SCHEMA)), batch_id=1) is None
    assert as_dict(store.read()) == brute_final(rows)
    one = store.lookup([1]).collect()
    assert len(one) == 1 and one[0].id == 1
    v3 = store.write(store.read())
    assert v3 == 3 and as_dict(store.read()) == brute_final(rows)


def test_validation_order(spark):
    rows = [(1, "0", "x", [1.0]), (2, "3", "  ", [1.0]), (3, "3", "ok", []), (4, "3", "ok", [1.0, 2.0]),
            (5, "abc", "ok", [1.0]), (6, "3", "x" * 100001, [1.0]), (7, "3", " ok ", [1.0])]
    df = spark.createDataFrame(rows, "seq long, id string, text string, vector array<float>")
    valid, rejects = C.validate_upserts(df, dim=1)
    assert [(r.seq, r.text) for r in valid.collect()] == [(7, "ok")]
    got = {r.seq: r.reason for r in rejects.collect()}
    assert got == {1: C.REASON_ID, 2: C.REASON_BLANK, 3: C.REASON_VECTOR_EMPTY,
                   4: "Vector dimension mismatch: expected 1, got 2", 5: C.REASON_ID, 6: C.REASON_LENGTH}


def test_scans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 1).alias("id"), "text")
    ids = [r.id for r in docs.collect()]
    assert [r.id for r in C.page(docs, 5, 10).collect()] == sorted(ids)[10:15]
    assert [r.id for r in C.page_after(docs, 50, 3).collect()] == [i for i in sorted(ids) if i > 50][:3]
    s1 = [r.id for r in C.sample_rows(docs, 3, 42).collect()]
    assert s1 == [r.id for r in C.sample_rows(docs, 3, 42).collect()] and len(set(s1)) == 3
    m = C.catalog_metrics(docs, "m").first()
    assert m.vectors_count == len(ids) and m.status == "ok"
    assert C.catalog_metrics(docs.filter(F.lit(False)), "m").first().vectors_count == 0


def test_rejects_sink(spark):
    from simcat.sources.store import write_rejects

    rows = [(1, "0", "x", [1.0]), (2, "3", "  ", [1.0]), (3, "3", "ok", [])]
    df = spark.createDataFrame(rows, "seq long, id string, text string, vector array<float>")
    _, rejects = C.validate_upserts(df, dim=1)
    path = shared_dir(spark, "test-rejects")
    write_rejects(rejects.select("seq", "id", "reason"), path)
    back = spark.read.parquet(path)
    assert sorted((r.seq, r.reason) for r in back.collect()) == [
        (1, C.REASON_ID), (2, C.REASON_BLANK), (3, C.REASON_VECTOR_EMPTY)]
    assert back.select("reason_key").distinct().count() == 3


def test_store_row_count_follows_every_commit(spark):
    """The commit's row count equals a scan after full writes, merges into new and
    existing buckets, and an empty merge."""
    store = CatalogStore(spark, shared_dir(spark, "test-count"), buckets=4)
    assert store.count() == 0
    rows = feed_rows(n=120, ids=40, seed=5)
    for lo, hi in ((0, 10), (10, 60), (60, 60), (60, 120)):
        chunk = spark.createDataFrame(rows[lo:hi], SCHEMA)
        store.merge(C.fold_upserts(chunk))
        assert store.count() == store.read().count() == len({r[1] for r in rows[:hi]})
    store.write(store.read().filter(F.col("id") % 2 == 0))
    assert store.count() == store.read().count()


def test_store_keeps_its_bucket_count(spark):
    import pytest

    path = shared_dir(spark, "test-buckets")
    rows = feed_rows(100, 20)
    CatalogStore(spark, path, buckets=4).merge(C.fold_upserts(spark.createDataFrame(rows, SCHEMA)))
    with pytest.raises(ValueError, match="4 buckets"):
        CatalogStore(spark, path, buckets=16)
    again = CatalogStore(spark, path)
    again.merge(C.fold_upserts(spark.createDataFrame([(s + 1000, *r) for s, *r in rows], SCHEMA)))
    assert again.buckets == 4 and again.count() == again.read().count() == again.read().select("id").distinct().count() == 20


def test_replay_guard_is_per_stream_and_outlives_other_merges(spark):
    store = CatalogStore(spark, shared_dir(spark, "test-streams"), buckets=2)
    fold = lambda s, i: C.fold_upserts(spark.createDataFrame([(s, i, "t", s, [1.0])], SCHEMA))
    assert store.merge(fold(1, 1), batch_id=0, stream="a") and store.merge(fold(2, 1), batch_id=1, stream="a")
    assert store.merge(fold(3, 2), batch_id=0, stream="b")  # another stream starts at 0
    assert store.merge(fold(4, 3))  # un-numbered: always applied
    assert store.merge(fold(2, 1), batch_id=1, stream="a") is None and store.merge(fold(3, 2), batch_id=0, stream="b") is None
    store.write(store.read(bookkeeping=True))
    assert store.merge(fold(2, 1), batch_id=1, stream="a") is None
    assert {r.id: r["count"] for r in store.read().collect()} == {1: 2, 2: 1, 3: 1}


def test_late_feeds_leave_a_written_row_its_created_at(spark):
    cat = spark.createDataFrame([(1, "old", [1.0], 1, 5, 100, 100)], "id long, text string, vector array<float>, dim int, count long, created_at long, updated_at long")
    store = CatalogStore(spark, shared_dir(spark, "test-late"), buckets=2)
    store.write(cat)
    for seq, ts in ((50, 5000), (40, 4000)):
        store.merge(C.fold_upserts(spark.createDataFrame([(seq, 1, f"t{seq}", ts, [1.0])], SCHEMA)))
    row = store.read().first()
    assert (row.created_at, row.updated_at, row.text, row["count"]) == (100, 5000, "t50", 7)


def test_duplicate_delivery_inserts_once(spark):
    rows = [(1, 7, "a", 1, [1.0])] * 3 + [(2, 7, "b", 2, [1.0])]
    feed = spark.createDataFrame(rows, SCHEMA)
    acts = sorted((r.seq, r.action) for r in C.upsert_actions(feed, spark.createDataFrame([], "id long")).collect())
    assert acts == [(1, "inserted"), (1, "updated"), (1, "updated"), (2, "updated")]
    folded = C.fold_upserts(spark.createDataFrame([(2, 7, "z", 1, [1.0]), (2, 7, "b", 1, [1.0])], SCHEMA)).collect()
    assert [(r.n, r.text) for r in folded] == [(2, "b")]


def test_integral_float_ids_are_ids(spark):
    df = spark.createDataFrame([(1, "4.0", "x"), (2, "4.5", "x"), (3, " 5 ", "x"), (4, "-1.0", "x")], "seq long, id string, text string")
    valid, rejects = C.validate_upserts(df, vector_col=None)
    assert sorted((r.seq, r.id) for r in valid.collect()) == [(1, 4), (3, 5)]
    assert {r.seq for r in rejects.collect()} == {2, 4}


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    import pytest

    from simcat import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_base(Session())
