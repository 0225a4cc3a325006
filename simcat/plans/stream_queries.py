"""Registered streaming queries (ST-1..ST-4) and their oracles.

The feed is ``events`` arriving in three ten-day slices of ``ts``, in slice order:
each slice is appended to a feed folder below the shared checkpoint folder (an
ordinary distributed write, the ``ts`` range pushed into the scan), and after
each arrival the stream runs once with ``availableNow``, so every slice is one
micro-batch and the checkpoint carries the stream from one run to the next. Each
query returns what its stream produced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simcat.operators import catalog as C
from simcat.operators.embed import PrecomputedEmbedder
from simcat.plans.catalog_queries import events_feed
from simcat.plans.fixtures import (HASH_DIM, benchmark_queries, documents_catalog, embeddings_catalog, hashing_embedder,
                                   sql_hash_vectors, table)
from simcat.plans.search_queries import (SQL_SEARCH_QUERY_REJECTS, SQL_SEARCH_TEXT_TOPK, SQL_SEARCH_TOPK_BATCH,
                                        variant_queries)
from simcat.session import shared_dir
from simcat.sources.store import CatalogStore
from simcat.streaming.acks import read_acks, read_totals, run_ack_stream
from simcat.streaming.feed import deliver, read_feed_stream
from simcat.streaming.search import run_search_stream
from simcat.streaming.standing import StandingQueries, run_standing_stream
from simcat.streaming.upsert import run_upsert_stream, stateful_acks

# Fixed slice boundaries of the feed (ts ranges).
SLICES = ["2024-01-11 00:00:00", "2024-01-21 00:00:00"]
N_SLICES = len(SLICES) + 1
MICRO_BATCHES = 20
# Invalid variants of the text queries come under ids from here on.
VARIANT_QID = 1_000_000


def _slice_pred(s: int) -> Column:
    """Raw ``events.ts`` range of slice ``s`` (a plain range: pushed into the scan); rows
    without a ``ts`` arrive with the last slice."""
    ts = F.col("ts")
    pred = F.lit(True)
    if s > 0:
        pred = pred & (ts >= F.lit(SLICES[s - 1]).cast("timestamp_ntz"))
    if s < len(SLICES):
        pred = pred & (ts < F.lit(SLICES[s]).cast("timestamp_ntz"))
    return pred if s < len(SLICES) else pred | ts.isNull()


_SQL_SLICE = f"CASE WHEN ts < TIMESTAMP '{SLICES[0]}' THEN 0 WHEN ts < TIMESTAMP '{SLICES[1]}' THEN 1 ELSE 2 END"


def _slice_feed(spark: SparkSession, sf_dir: str, s: int) -> DataFrame:
    return events_feed(spark, sf_dir, where=_slice_pred(s)).drop("before_cut")


_RUNS: dict = {}


def _run_upsert(spark: SparkSession, sf_dir: str):
    """One stream run per (application, fixture): its catalog, acks and metrics are
    the outputs of three registered queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        _RUNS[key] = _start_upsert(spark, sf_dir)
    return _RUNS[key]


def _start_upsert(spark: SparkSession, sf_dir: str):
    run_dir = shared_dir(spark, "stream-upsert")
    store = CatalogStore(spark, f"{run_dir}/catalog", buckets=8)
    arrivals = [_slice_feed(spark, sf_dir, s) for s in range(N_SLICES)]
    schema = arrivals[0].schema
    embedder = hashing_embedder()

    def run(src: str) -> None:
        run_upsert_stream(read_feed_stream(spark, src, schema), store, embedder,
                          f"{run_dir}/checkpoint", out_dir=run_dir, dim=HASH_DIM)

    deliver(spark, arrivals, run)
    return store, run_dir


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1: the final catalog after streaming the whole feed equals the batch fold."""
    store, _ = _run_upsert(spark, sf_dir)
    return store.read().select("id", "text", "dim", "count", "created_at", "updated_at")


_SQL_VALID = """
  f AS (SELECT event_id AS seq, user_id AS id, event_type AS text, ts AS raw_ts,
               CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events WHERE user_id > 0)
"""

SQL_STREAM_UPSERT = f"""
WITH {_SQL_VALID}
SELECT id, arg_max(text, seq) AS text, {HASH_DIM} AS dim, count(*)::BIGINT AS count,
       arg_min(ts, seq) AS created_at, arg_max(ts, seq) AS updated_at
FROM f GROUP BY id
"""


def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-4: one report row per micro-batch: rows, success, failed, catalog size after it."""
    _, run_dir = _run_upsert(spark, sf_dir)
    return spark.read.parquet(f"{run_dir}/metrics").select(
        F.col("batch_id").cast("long"), "rows", "success", "failed", "catalog_count")


SQL_STREAM_METRICS = f"""
WITH e AS (SELECT *, {_SQL_SLICE} AS s FROM events),
  per AS (SELECT s, count(*)::BIGINT AS rows, count(*) FILTER (WHERE user_id > 0)::BIGINT AS success,
                 count(*) FILTER (WHERE user_id <= 0)::BIGINT AS failed FROM e GROUP BY s),
  firsts AS (SELECT user_id, min(s) AS s FROM e WHERE user_id > 0 GROUP BY user_id)
SELECT per.s::BIGINT AS batch_id, rows, success, failed,
       (SELECT count(*) FROM firsts WHERE firsts.s <= per.s)::BIGINT AS catalog_count
FROM per
"""


def stream_upsert_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1 acks: one per valid event, inserted for an id's first event, as the stream wrote them."""
    _, run_dir = _run_upsert(spark, sf_dir)
    return spark.read.parquet(f"{run_dir}/acks").select("seq", "id", "action", "status", "message")


SQL_STREAM_UPSERT_ACKS = f"""
WITH {_SQL_VALID},
  r AS (SELECT seq, id, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM f)
SELECT seq, id, CASE WHEN rn = 1 THEN 'inserted' ELSE 'updated' END AS action, 'ok' AS status,
       'Upserted (ID: ' || CAST(id AS VARCHAR) || ', ' || CASE WHEN rn = 1 THEN 'inserted' ELSE 'updated' END || ')' AS message
FROM r
"""


def stream_upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-2: per-id running counts held in streaming state, one ack per valid event.

    The catalog as of the first slice seeds the state (initial state = its per-id
    counts); the two later slices arrive on the stream, one run each, the state
    carried between runs by the checkpoint."""
    first, _ = C.validate_upserts(_slice_feed(spark, sf_dir, 0), vector_col=None)
    seed = first.groupBy("id").agg(F.count(F.lit(1)).alias("count"))
    run_dir = shared_dir(spark, "stream-state")
    arrivals = [_slice_feed(spark, sf_dir, s) for s in range(1, N_SLICES)]
    schema = arrivals[0].schema

    def run(src: str) -> None:
        valid, _ = C.validate_upserts(read_feed_stream(spark, src, schema, max_files=16), vector_col=None)
        q = (stateful_acks(valid, initial_counts=seed).writeStream.format("parquet").outputMode("append")
             .option("path", f"{run_dir}/out").option("checkpointLocation", f"{run_dir}/checkpoint")
             .trigger(availableNow=True).start())
        q.awaitTermination()

    deliver(spark, arrivals, run)
    return spark.read.schema("seq long, id long, action string, running_count long").parquet(f"{run_dir}/out")


SQL_STREAM_UPSERT_STATE = f"""
WITH {_SQL_VALID},
  r AS (SELECT seq, id, raw_ts, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM f)
SELECT seq, id, CASE WHEN rn = 1 THEN 'inserted' ELSE 'updated' END AS action, rn::BIGINT AS running_count
FROM r WHERE raw_ts >= TIMESTAMP '{SLICES[0]}'
"""


def _hot_arrival(late_seq: Column, ts: Column) -> Column:
    """The slice an event arrives with: its own, or the last one for every seventh of the first."""
    own = F.when(ts < F.lit(SLICES[0]).cast("timestamp_ntz"), 0).when(ts < F.lit(SLICES[1]).cast("timestamp_ntz"), 1).otherwise(N_SLICES - 1)
    return F.when((own == 0) & (late_seq % 7 == 0), N_SLICES - 1).otherwise(own)


def stream_ack_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-2 at its hardest: a third of the events under one id, events that arrive two slices late, and deliveries repeated at
    once (every eleventh) and with the last slice (every tenth). One ack per delivery, beside the id's state at the end."""
    e = table(spark, sf_dir, "events")
    seq = F.col("event_id")
    hot = F.when(seq % 3 == 0, F.lit(1)).otherwise(F.col("user_id"))
    feed = e.select(seq.alias("seq"), hot.cast("long").alias("id"), C.epoch_seconds(F.col("ts")).alias("ts"), _hot_arrival(seq, F.col("ts")).alias("_at")).filter("id > 0")
    last = N_SLICES - 1
    arrivals = []
    for s in range(N_SLICES):
        own = feed.filter(F.col("_at") == s)
        own = own.unionByName(own.filter("seq % 11 = 0"))
        if s == last:
            own = own.unionByName(feed.filter((F.col("_at") < last) & (F.col("seq") % 10 == 0)))
        arrivals.append(own.drop("_at"))
    run_dir, schema = shared_dir(spark, "stream-acks"), arrivals[0].schema
    deliver(spark, arrivals, lambda src: run_ack_stream(read_feed_stream(spark, src, schema), f"{run_dir}/out", f"{run_dir}/checkpoint", size=64))
    return read_acks(spark, f"{run_dir}/out").join(read_totals(spark, f"{run_dir}/out").withColumnRenamed("count", "total"), "id")


SQL_STREAM_ACK_TOTALS = f"""
WITH f AS (SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
                  CASE WHEN ts < TIMESTAMP '{SLICES[0]}' AND event_id % 7 = 0 THEN {N_SLICES - 1} ELSE {_SQL_SLICE} END AS pos FROM events),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos, seq) AS n FROM f WHERE id > 0),
  totals AS (SELECT id, count(*)::BIGINT AS total, arg_min(ts, n) AS created_at, max(seq) AS last_seq FROM firsts GROUP BY id),
  acks AS (
    SELECT seq, id, CASE WHEN n = 1 THEN 'inserted' ELSE 'updated' END AS action, n::BIGINT AS running_count FROM firsts
    UNION ALL SELECT seq, id, 'repeated', NULL FROM firsts WHERE seq % 11 = 0
    UNION ALL SELECT seq, id, 'repeated', NULL FROM firsts WHERE pos < {N_SLICES - 1} AND seq % 10 = 0)
SELECT seq, id, action, running_count, total, created_at, last_seq FROM acks JOIN totals USING (id)
"""


def stream_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-3: every embedding arrives as a query on a stream (three arrivals by label)
    and is answered against the static embeddings catalog, k = 5."""
    q = embeddings_catalog(spark, sf_dir).select(F.col("id").alias("qid"), F.lit(5).alias("k"),
                                                 "vector", "label")
    bounds = [(None, 3), (3, 6), (6, None)]
    # queries without a label arrive with the last ones
    arrivals = [q.filter((F.col("label") >= lo if lo is not None else F.lit(True))
                         & (F.col("label") < hi if hi is not None else F.lit(True))
                         | (F.col("label").isNull() if hi is None else F.lit(False))).drop("label")
                for lo, hi in bounds]
    schema = arrivals[0].schema
    run_dir = shared_dir(spark, "stream-search")

    def run(src: str) -> None:
        run_search_stream(read_feed_stream(spark, src, schema), lambda: embeddings_catalog(spark, sf_dir),
                          f"{run_dir}/out", f"{run_dir}/checkpoint")

    deliver(spark, arrivals, run)
    return spark.read.parquet(f"{run_dir}/out").select("qid", "rank", "id", "score_rate")


def _start_rejects(spark: SparkSession, sf_dir: str) -> str:
    """The feed embedded by a table that fits some events only: the vector of the event's
    user, cut to half its length where its label is 3, and missing for users without one."""
    run_dir = shared_dir(spark, "stream-rejects")
    store = CatalogStore(spark, f"{run_dir}/catalog", buckets=8)
    vectors = embeddings_catalog(spark, sf_dir).select("id", F.when(F.col("label") == 3, F.slice("vector", 1, 32)).otherwise(F.col("vector")).alias("v"))
    embedder = PrecomputedEmbedder(vectors.filter("id % 7 != 0"), "id", "v", 64)
    arrivals = [_slice_feed(spark, sf_dir, s) for s in range(N_SLICES)]
    schema = arrivals[0].schema
    deliver(spark, arrivals, lambda src: run_upsert_stream(
        read_feed_stream(spark, src, schema), store, embedder, f"{run_dir}/checkpoint", out_dir=run_dir, dim=64))
    return run_dir


def _run_rejects(spark: SparkSession, sf_dir: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, "rejects")
    if key not in _RUNS:
        _RUNS[key] = _start_rejects(spark, sf_dir)
    return _RUNS[key]


def stream_upsert_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-3, V-4, V-8, V-9 on a stream: every event that made no upsert, with its reason, read back."""
    return spark.read.parquet(f"{_run_rejects(spark, sf_dir)}/rejects").select("seq", "id", "reason")


_SQL_MIXED = f"""
  v AS (SELECT vec_id + 1 AS id, CASE WHEN label = 3 THEN 32 ELSE 64 END AS d FROM embeddings WHERE (vec_id + 1) % 7 != 0),
  e AS (SELECT event_id AS seq, user_id AS id, {_SQL_SLICE} AS s,
               CASE WHEN user_id IS NULL OR user_id <= 0 THEN 'ID must be positive'
                    WHEN v.d IS NULL THEN 'Vector cannot be empty'
                    WHEN v.d <> 64 THEN 'Vector dimension mismatch: expected 64, got ' || v.d END AS reason
        FROM events LEFT JOIN v ON v.id = events.user_id)
"""

SQL_STREAM_UPSERT_REJECTS = f"WITH {_SQL_MIXED} SELECT seq, CAST(id AS VARCHAR) AS id, reason FROM e WHERE reason IS NOT NULL"


def stream_upsert_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-4 with rejects: per micro-batch rows = success + failed, acks = success, rejects = failed."""
    run_dir = _run_rejects(spark, sf_dir)
    per = lambda name: spark.read.parquet(f"{run_dir}/{name}").groupBy(F.col("batch_id").cast("long").alias("batch_id")).agg(F.count(F.lit(1)).alias(name))
    metrics = spark.read.parquet(f"{run_dir}/metrics").select(F.col("batch_id").cast("long").alias("batch_id"), "rows", "success", "failed", "catalog_count")
    return (metrics.join(per("acks"), "batch_id", "left").join(per("rejects"), "batch_id", "left")
            .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("acks", "rejects")}))


SQL_STREAM_UPSERT_BALANCE = f"""
WITH {_SQL_MIXED},
  firsts AS (SELECT id, min(s) AS s FROM e WHERE reason IS NULL GROUP BY id)
SELECT s::BIGINT AS batch_id, count(*)::BIGINT AS rows, count(*) FILTER (WHERE reason IS NULL)::BIGINT AS success,
       count(*) FILTER (WHERE reason IS NOT NULL)::BIGINT AS failed,
       (SELECT count(*) FROM firsts WHERE firsts.s <= e.s)::BIGINT AS catalog_count,
       count(*) FILTER (WHERE reason IS NULL)::BIGINT AS acks, count(*) FILTER (WHERE reason IS NOT NULL)::BIGINT AS rejects
FROM e GROUP BY s
"""


def _run_text_search(spark: SparkSession, sf_dir: str) -> str:
    """Text queries, valid and invalid, arriving in three runs by item, against the documents."""
    key = (spark.sparkContext.applicationId, sf_dir, "text-search")
    if key not in _RUNS:
        run_dir = shared_dir(spark, "stream-text-search")
        # every benchmark text as it is, and the invalid variants under ids of their own
        variants = variant_queries(spark, sf_dir).filter("pmod(qid, 6) != 0")
        q = benchmark_queries(spark, sf_dir).unionByName(variants.withColumn("qid", F.col("qid") + VARIANT_QID))
        arrivals = [q.filter("qid < 40"), q.filter(f"qid >= 40 and qid < {VARIANT_QID}"), q.filter(f"qid >= {VARIANT_QID} or qid is null")]
        schema, emb = arrivals[0].schema, hashing_embedder()
        deliver(spark, arrivals, lambda src: run_search_stream(
            read_feed_stream(spark, src, schema), lambda: documents_catalog(spark, sf_dir, emb),
            run_dir, f"{run_dir}/checkpoint", with_text=True, embedder=emb))
        _RUNS[key] = run_dir
    return _RUNS[key]


def stream_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-3 on texts: validated, embedded, searched and answered with the hits' texts."""
    return spark.read.parquet(f"{_run_text_search(spark, sf_dir)}/hits").select("qid", "rank", "id", "score_rate", F.md5("text").alias("text_md5"))


SQL_STREAM_SEARCH_TEXT = f"""
WITH hits AS ({SQL_SEARCH_TEXT_TOPK}) SELECT qid, rank, id, score_rate, md5(text) AS text_md5 FROM hits
"""


def stream_search_text_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-6, V-7, V-10 on a stream: the queries that got no search, with their reasons."""
    return spark.read.parquet(f"{_run_text_search(spark, sf_dir)}/rejects").select("qid", "reason")


SQL_STREAM_SEARCH_TEXT_REJECTS = f"SELECT qid + {VARIANT_QID} AS qid, reason FROM ({SQL_SEARCH_QUERY_REJECTS})"


def stream_upsert_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1 + K-1: the feed in twenty micro-batches, dealt over them by hash, so that every id comes late and early;
    each appends deltas, and buckets are compacted as they fall due. The catalog equals the batch fold."""
    run_dir = shared_dir(spark, "stream-deltas")
    store = CatalogStore(spark, f"{run_dir}/catalog", buckets=4, delta_share=2.0, max_deltas=6)
    feed = events_feed(spark, sf_dir).select("seq", "id", "text", "ts")
    embedder = hashing_embedder()
    deliver(spark, [feed.repartition(MICRO_BATCHES, "seq")], lambda src: run_upsert_stream(
        read_feed_stream(spark, src, feed.schema, max_files=1), store, embedder, f"{run_dir}/checkpoint", dim=HASH_DIM))
    return store.read().select("id", "text", "dim", "count", "created_at", "updated_at")


def _standing_feed(spark: SparkSession, sf_dir: str, s: int) -> DataFrame:
    """A slice of the feed whose texts differ: event type and properties."""
    e = table(spark, sf_dir, "events").filter(_slice_pred(s))
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.concat_ws(" ", "event_type", "props").alias("text"), C.epoch_seconds(F.col("ts")).alias("ts"))


def stream_standing_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-3: the benchmark texts as standing queries over a catalog that three feed slices change; the answers
    after every slice."""
    run_dir, embedder = shared_dir(spark, "stream-standing"), hashing_embedder()
    store = CatalogStore(spark, f"{run_dir}/catalog", buckets=8, delta_share=0.5)
    queries = embedder.embed(benchmark_queries(spark, sf_dir), "text", "vector").select("qid", F.lit(5).alias("k"), "vector")
    standing = StandingQueries(spark, f"{run_dir}/standing", queries)
    arrivals, seen = [_standing_feed(spark, sf_dir, s) for s in range(N_SLICES)], []

    def run(src: str) -> None:
        run_standing_stream(read_feed_stream(spark, src, arrivals[0].schema), store, embedder, standing, f"{run_dir}/checkpoint", dim=HASH_DIM)
        seen.append(standing.versions()[-1])

    deliver(spark, arrivals, run)
    out = [standing.answers(v).select(F.lit(s).cast("long").alias("slice"), "qid", "rank", "id", "score_rate") for s, v in enumerate(seen)]
    return reduce(DataFrame.unionByName, out)


SQL_STREAM_STANDING_QUERIES = f"""
WITH e AS (SELECT event_id AS seq, user_id AS id, event_type || ' ' || props AS text, {_SQL_SLICE} AS s FROM events WHERE user_id > 0),
  slices AS (SELECT unnest(range({N_SLICES})) AS slice),
  state AS MATERIALIZED (SELECT slice, id, arg_max(text, seq) AS text FROM e JOIN slices ON e.s <= slice GROUP BY slice, id),
  cv AS MATERIALIZED ({sql_hash_vectors("(SELECT DISTINCT text FROM state)", "text", "text")}),
  qv AS MATERIALIZED ({sql_hash_vectors("benchmark", "item_id", "text")}),
  scores AS (SELECT qv.id AS qid, cv.id AS text, list_dot_product(qv.v, cv.v) AS score FROM qv CROSS JOIN cv),
  ranked AS (SELECT slice, qid, state.id, score, (row_number() OVER (PARTITION BY slice, qid ORDER BY round(score, 12) DESC, state.id))::INTEGER AS rank
             FROM state JOIN scores USING (text))
SELECT slice::BIGINT AS slice, qid, rank, id, greatest(-1.0, least(1.0, round_even(score, 4))) AS score_rate FROM ranked WHERE rank <= 5
"""


QUERIES = {
    "stream_search_text": (stream_search_text, SQL_STREAM_SEARCH_TEXT),
    "stream_search_text_rejects": (stream_search_text_rejects, SQL_STREAM_SEARCH_TEXT_REJECTS),
    "stream_upsert_deltas": (stream_upsert_deltas, SQL_STREAM_UPSERT),
    "stream_standing_queries": (stream_standing_queries, SQL_STREAM_STANDING_QUERIES),
    "stream_upsert_rejects": (stream_upsert_rejects, SQL_STREAM_UPSERT_REJECTS),
    "stream_upsert_balance": (stream_upsert_balance, SQL_STREAM_UPSERT_BALANCE),
    "stream_upsert": (stream_upsert, SQL_STREAM_UPSERT),
    "stream_upsert_acks": (stream_upsert_acks, SQL_STREAM_UPSERT_ACKS),
    "stream_metrics": (stream_metrics, SQL_STREAM_METRICS),
    "stream_upsert_state": (stream_upsert_state, SQL_STREAM_UPSERT_STATE),
    "stream_ack_totals": (stream_ack_totals, SQL_STREAM_ACK_TOTALS),
    "stream_search": (stream_search, SQL_SEARCH_TOPK_BATCH),
}
