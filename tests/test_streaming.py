"""Streaming upsert equals the batch fold; replays are no-ops (ST-1, ST-2, ST-4)."""

from pyspark.sql import functions as F

from simcat.operators import catalog as C
from simcat.plans.fixtures import hashing_embedder
from simcat.session import shared_dir
from simcat.sources.store import CatalogStore
from simcat.streaming.feed import deliver, read_feed_stream
from simcat.streaming.upsert import run_upsert_stream, stateful_acks, stream_identity, upsert_batch


def _feed(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"),
                    F.col("event_type").alias("text"), C.epoch_seconds(F.col("ts")).alias("ts"),
                    F.floor(F.col("event_id") / 400).cast("int").alias("_slice"))


def _arrivals(feed):
    n_slices = feed.agg(F.max("_slice")).first()[0] + 1
    return [feed.filter(F.col("_slice") == s).drop("_slice") for s in range(n_slices)]


def _run_acks(spark, valid_of, run, seed=None):
    """A stateful-ack stream runner for ``deliver``: one availableNow run per arrival."""
    def run_once(src):
        q = (stateful_acks(valid_of(src), initial_counts=seed).writeStream.format("parquet")
             .option("path", f"{run}/out").option("checkpointLocation", f"{run}/ckpt")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return run_once


def test_stream_equals_batch_and_replay_is_noop(spark, sf):
    feed = _feed(spark, sf)
    arrivals = _arrivals(feed)
    schema = arrivals[0].schema
    run = shared_dir(spark, "test-stream")
    store = CatalogStore(spark, f"{run}/catalog", buckets=4)
    emb = hashing_embedder()

    def run_once(src):
        run_upsert_stream(read_feed_stream(spark, src, schema), store, emb, f"{run}/ckpt", out_dir=run, dim=64)

    src = deliver(spark, arrivals, run_once)
    valid, _ = C.validate_upserts(feed.drop("_slice"), vector_col=None)
    batch = C.merge_upserts(C.empty_catalog(spark), C.fold_upserts(emb.embed(valid, "text", "vector")))
    cols = ["id", "text", "count", "created_at", "updated_at"]
    assert sorted(store.read().select(*cols).collect()) == sorted(batch.select(*cols).collect())
    # restart on the same checkpoint: nothing new, nothing applied twice
    run_once(src)
    before = store.latest()["version"]
    # a batch replayed by hand after its commit is skipped
    upsert_batch(feed.drop("_slice").limit(10), 0, store, emb, stream=stream_identity(store, f"{run}/ckpt"))
    assert store.latest()["version"] == before
    m = spark.read.parquet(f"{run}/metrics").collect()
    assert len(m) == len(arrivals) and sum(r.rows for r in m) == feed.count()


def test_one_file_per_task_and_one_batch_per_arrival(spark, sf):
    feed = _feed(spark, sf)
    arrivals = [a.repartition(3) for a in _arrivals(feed)]
    batches = []

    def run_once(src):
        q = (read_feed_stream(spark, src, arrivals[0].schema).writeStream
             .foreachBatch(lambda df, bid: batches.append((bid, df.count())))
             .option("checkpointLocation", f"{src}-ckpt").trigger(availableNow=True).start())
        q.awaitTermination()

    src = deliver(spark, arrivals, run_once)
    files = [f for f in spark.read.parquet(src).inputFiles()]
    assert len(files) == 3 * len(arrivals)
    assert batches == [(i, a.count()) for i, a in enumerate(arrivals)]


def test_stateful_running_counts(spark, sf):
    feed = _feed(spark, sf)
    arrivals = _arrivals(feed)
    run = shared_dir(spark, "test-state")
    valid_of = lambda src: C.validate_upserts(read_feed_stream(spark, src, arrivals[0].schema), vector_col=None)[0]
    deliver(spark, arrivals, _run_acks(spark, valid_of, run))
    got = spark.read.parquet(f"{run}/out").collect()
    rows = sorted((r.seq, r.id) for r in feed.filter("id > 0").collect())
    seen = {}
    exp = {}
    for seq, i in rows:
        seen[i] = seen.get(i, 0) + 1
        exp[seq] = seen[i]
    assert {r.seq: r.running_count for r in got} == exp
    assert sum(1 for r in got if r.action == "inserted") == len(seen)


def test_stateful_acks_start_from_catalog_counts(spark, sf):
    feed = _feed(spark, sf).filter("id > 0")
    arrivals = _arrivals(feed)
    run = shared_dir(spark, "test-state-seed")
    seed = spark.createDataFrame([(r.id, 10) for r in feed.select("id").distinct().limit(3).collect()],
                                 "id long, count long")
    seeded = {r.id for r in seed.collect()}
    valid_of = lambda src: C.validate_upserts(read_feed_stream(spark, src, arrivals[0].schema), vector_col=None)[0]
    deliver(spark, arrivals, _run_acks(spark, valid_of, run, seed))
    got = spark.read.parquet(f"{run}/out").collect()
    firsts = {}
    for r in sorted(got, key=lambda r: r.seq):
        firsts.setdefault(r.id, r)
    for i, r in firsts.items():
        assert r.running_count == (11 if i in seeded else 1)
        assert r.action == ("updated" if i in seeded else "inserted")


def test_unfit_vectors_are_rejected_and_counted_and_metrics_survive_a_replay(spark):
    from simcat.operators.embed import PrecomputedEmbedder

    run = shared_dir(spark, "test-unfit")
    store = CatalogStore(spark, f"{run}/catalog", buckets=2)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 1.0])], "k long, v array<float>")
    emb = PrecomputedEmbedder(vectors, "k", "v", 2)
    rows = [(s, s % 5, f"t{s}", s) for s in range(10)]
    batch = spark.createDataFrame(rows, "seq long, id long, text string, ts long")
    upsert_batch(batch, 0, store, emb, out_dir=run, dim=2, stream="s")
    metrics = lambda: spark.read.parquet(f"{run}/metrics").select("rows", "success", "failed", "catalog_count").collect()
    assert [tuple(r) for r in metrics()] == [(10, 4, 6, 2)]
    assert spark.read.parquet(f"{run}/acks").count() == 4
    reasons = {(r.id, r.reason) for r in spark.read.parquet(f"{run}/rejects").collect()}
    assert reasons == {("0", C.REASON_ID), ("2", "Vector dimension mismatch: expected 2, got 1"), ("4", C.REASON_VECTOR_EMPTY)}
    # a crash between the commit and the metrics: the replay writes them from the commit record
    other = shared_dir(spark, "test-unfit-replay")
    upsert_batch(batch, 0, store, emb, out_dir=other, dim=2, stream="s")
    assert [tuple(r) for r in spark.read.parquet(f"{other}/metrics").select("rows", "success", "failed", "catalog_count").collect()] == [(10, 4, 6, 2)]
    assert store.latest()["version"] == 1


def _captured(monkeypatch, module):
    """The frames that ``module`` keeps, as (columns, tasks)."""
    seen, keep = [], module.kept

    def spy(df):
        seen.append((df.columns, df.rdd.getNumPartitions()))
        return keep(df)

    monkeypatch.setattr(module, "kept", spy)
    return seen


def test_stored_vectors_are_not_kept_and_a_batch_of_one_file_is_spread(spark, monkeypatch):
    from simcat.operators.embed import PrecomputedEmbedder
    from simcat.streaming import upsert

    seen = _captured(monkeypatch, upsert)
    run = shared_dir(spark, "test-slim")
    store = CatalogStore(spark, f"{run}/catalog", buckets=2)
    # key 1 has a fit vector twice and an unfit one, key 2 an unfit one only
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0]), (2, [1.0]), (3, [0.0, 1.0])], "k long, v array<float>")
    rows = [(s, s % 4, f" t{s} ", s) for s in range(8)]
    batch = spark.createDataFrame(rows, "seq long, id long, text string, ts long").coalesce(1)
    upsert_batch(batch, 0, store, PrecomputedEmbedder(vectors, "k", "v", 2), out_dir=run, dim=2, stream="s")
    assert seen[0][1] >= spark.sparkContext.defaultParallelism
    assert all(set(columns) <= {"seq", "id", "text", "ts", "reason", "_raw_id"} for columns, _ in seen)
    got = {r.id: (r.text, r["count"], r.dim, list(r.vector)) for r in store.read().collect()}
    assert got == {1: ("t5", 4, 2, [1.0, 0.0]), 3: ("t7", 2, 2, [0.0, 1.0])}
    assert spark.read.parquet(f"{run}/acks").groupBy("id", "action").count().count() == 4
    assert sorted(r.id for r in spark.read.parquet(f"{run}/rejects").collect()) == ["0", "0", "1", "1", "2", "2"]


def test_ids_read_as_numbers_need_no_pattern(spark):
    from simcat.functions.text import integral_id

    raw = ["7", " 7 ", "+7.0", "-7.00", "7.5", "7.", "x", "", None, "9223372036854775808", "1e3"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i long, x string").orderBy("i").select(integral_id(F.col("x"))).collect()]
    assert got == [7, 7, 7, -7, None, None, None, None, None, None, None]
