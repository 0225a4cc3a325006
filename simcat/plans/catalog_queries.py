"""Registered catalog queries: upsert fold/merge/actions/rejects (A-6, J-2, W-1, J-4,
V-4..V-9), snapshots (K-1, S-2), scans (S-3..S-5), metrics (A-1), blob codec (S-6,
K-2) and the embedding operators (E-1..E-4).

Upsert feed (FIXTURES.md part C): every ``events`` row is an upsert with
id = user_id, seq = event_id, text = event_type, ts = epoch seconds of ts. The
catalog as of ``CUT`` folds the events before it; the rest of the table is the
feed merged into it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simcat import params as P
from simcat.functions.vector import l2_normalize
from simcat.operators import catalog as C
from simcat.operators.embed import HashingEmbedder, ModelEmbedder, mean_pool
from simcat.plans.fixtures import (FIXTURE_TASKS, HASH_DIM, SAMPLE_SEED, docs_store, documents_catalog, embeddings_catalog,
                                   hashing_embedder, sql_hash_vectors, table)
from simcat.operators.partitioning import spread
from simcat.session import shared_dir
from simcat.sources.blob import export_blob_table, import_blob_table
from simcat.sources.ranked import build_ranked
from simcat.sources.store import CatalogStore

CUT = "2024-01-16 00:00:00"


def events_feed(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """The upsert feed from ``events``; ``where`` filters the raw table first, so a
    predicate on its columns (e.g. a ``ts`` range) reaches the Parquet scan."""
    e = table(spark, sf_dir, "events")
    e = spread(e.filter(where) if where is not None else e, FIXTURE_TASKS)
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"),
                    F.col("event_type").alias("text"), C.epoch_seconds(F.col("ts")).alias("ts"),
                    F.coalesce(F.col("ts") < F.lit(CUT).cast("timestamp_ntz"), F.lit(False)).alias("before_cut"))


def _base_and_feed(spark: SparkSession, sf_dir: str):
    valid, _ = C.validate_upserts(events_feed(spark, sf_dir), dim=None, vector_col=None)
    base_events = valid.filter(F.col("before_cut")).drop("before_cut")
    feed_events = valid.filter(~F.col("before_cut")).drop("before_cut")
    return base_events, feed_events


_OUT = ["id", "text", "dim", "count", "created_at", "updated_at"]

_SQL_FEED = f"""
  f AS (SELECT event_id AS seq, user_id AS id, event_type AS text,
               CAST(floor(epoch(ts)) AS BIGINT) AS ts, coalesce(ts < TIMESTAMP '{CUT}', false) AS before_cut
        FROM events WHERE user_id > 0),
  base AS (SELECT id, count(*) AS n, arg_max(text, seq) AS text, arg_min(ts, seq) AS t0, arg_max(ts, seq) AS t1
           FROM f WHERE before_cut GROUP BY id),
  feed AS (SELECT id, count(*) AS n, arg_max(text, seq) AS text, arg_min(ts, seq) AS t0, arg_max(ts, seq) AS t1
           FROM f WHERE NOT before_cut GROUP BY id)
"""


def upsert_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-6 + J-2: catalog as of CUT, then the later events folded per id and merged."""
    base_events, feed_events = _base_and_feed(spark, sf_dir)
    base = C.merge_upserts(C.empty_catalog(spark), C.fold_upserts(base_events, hashing_embedder()))
    return C.merge_upserts(base, C.fold_upserts(feed_events, hashing_embedder())).select(*_OUT)


SQL_UPSERT_FOLD = f"""
WITH {_SQL_FEED}
SELECT coalesce(feed.id, base.id) AS id,
       CASE WHEN feed.id IS NOT NULL THEN feed.text ELSE base.text END AS text,
       {HASH_DIM} AS dim,
       (coalesce(base.n, 0) + coalesce(feed.n, 0))::BIGINT AS count,
       coalesce(base.t0, feed.t0) AS created_at,
       coalesce(feed.t1, base.t1) AS updated_at
FROM base FULL OUTER JOIN feed ON base.id = feed.id
"""


def catalog_snapshot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-1 + S-2: the same two steps through the versioned snapshot store (bucketed,
    touched buckets rewritten, atomic commits); a replayed batch id is skipped."""
    base_events, feed_events = _base_and_feed(spark, sf_dir)
    store = CatalogStore(spark, shared_dir(spark, "catalog"), buckets=8)
    store.merge(C.fold_upserts(base_events, hashing_embedder()), batch_id=0)
    store.merge(C.fold_upserts(feed_events, hashing_embedder()), batch_id=1)
    replayed = store.merge(C.fold_upserts(feed_events, hashing_embedder()), batch_id=1)
    return store.read().select(*_OUT, F.lit(replayed is None).alias("replay_skipped"))


SQL_SNAPSHOT_MERGE = f"SELECT *, true AS replay_skipped FROM ({SQL_UPSERT_FOLD})"


GROWTH_CUTS = ["2024-01-08 00:00:00", "2024-01-16 00:00:00", "2024-01-24 00:00:00"]
GROWTH_ROWS = 8


def catalog_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-1 with buckets that grow: four merges into a store that starts with four buckets and splits them beyond
    eight rows each; every merge's version is read back at the end, and its buckets are counted."""
    store = CatalogStore(spark, shared_dir(spark, "growth"), buckets=4, rows_per_bucket=GROWTH_ROWS)
    cuts = [F.lit(c).cast("timestamp_ntz") for c in GROWTH_CUTS]
    made = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        ts = F.col("ts")
        late = F.lit(True) if high is None else ts < high
        where = late if low is None else (ts >= low) & late
        valid, _ = C.validate_upserts(events_feed(spark, sf_dir, where), vector_col=None)
        store.merge(C.fold_upserts(valid, hashing_embedder()))
        made.append(store.latest())
    out = [store.read(c).select(F.lit(i).alias("step"), F.lit(store.layout_of(c).buckets).alias("buckets"), "id", "text", "count") for i, c in enumerate(made)]
    return reduce(DataFrame.unionByName, out)


SQL_CATALOG_GROWTH = f"""
WITH e AS (SELECT event_id AS seq, user_id AS id, event_type AS text,
                  CASE {' '.join(f"WHEN ts < TIMESTAMP '{c}' THEN {i}" for i, c in enumerate(GROWTH_CUTS))} ELSE {len(GROWTH_CUTS)} END AS s FROM events WHERE user_id > 0),
  steps AS (SELECT unnest(range({len(GROWTH_CUTS) + 1})) AS step),
  folded AS (SELECT step, id, arg_max(text, seq) AS text, count(*)::BIGINT AS count FROM e JOIN steps ON s <= step GROUP BY step, id)
SELECT step::INTEGER AS step, greatest(4, max(ceil(n / {GROWTH_ROWS}.0)) OVER (ORDER BY step))::INTEGER AS buckets, id, text, count
FROM (SELECT *, count(*) OVER (PARTITION BY step) AS n FROM folded)
"""


def upsert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-1 + J-4 + P-14: one ack per feed event against the catalog as of CUT."""
    base_events, feed_events = _base_and_feed(spark, sf_dir)
    return C.upsert_actions(feed_events, base_events.select("id").distinct())


SQL_UPSERT_ACTIONS = f"""
WITH {_SQL_FEED},
  firsts AS (SELECT id, min(seq) AS seq FROM f WHERE NOT before_cut
             AND id NOT IN (SELECT id FROM base) GROUP BY id),
  acts AS (SELECT f.seq, f.id,
                  CASE WHEN firsts.id IS NOT NULL THEN 'inserted' ELSE 'updated' END AS action
           FROM f LEFT JOIN firsts ON firsts.id = f.id AND firsts.seq = f.seq
           WHERE NOT f.before_cut)
SELECT seq, id, action, 'ok' AS status, 'Upserted (ID: ' || CAST(id AS VARCHAR) || ', ' || action || ')' AS message
FROM acts
"""


def upsert_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-4, V-5, V-7, V-8, V-9 on the feed; edge cases by event type: 'error' events carry
    blank text, 'signup' an empty vector, 'purchase' a 32-d vector; user 0 is an invalid id."""
    e = table(spark, sf_dir, "events")
    emb = hashing_embedder()
    text = (F.when(F.col("event_type") == "error", F.lit("  "))
            .otherwise(F.concat_ws(" ", "event_type", "props")))
    feed = emb.embed(e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"),
                              text.alias("text"), F.col("event_type")), "text", "vector")
    vec = (F.when(F.col("event_type") == "signup", F.array().cast("array<float>"))
           .when(F.col("event_type") == "purchase", F.slice("vector", 1, 32))
           .otherwise(F.col("vector")))
    feed = feed.withColumn("vector", vec)
    _, rejects = C.validate_upserts(feed, dim=HASH_DIM)
    return rejects.select("seq", "id", "reason")


SQL_UPSERT_REJECTS = f"""
WITH r AS (
  SELECT event_id AS seq, user_id AS id,
    CASE WHEN user_id <= 0 THEN 'ID must be positive'
         WHEN event_type = 'error' THEN 'Text cannot be empty'
         WHEN event_type = 'signup' THEN 'Vector cannot be empty'
         WHEN event_type = 'purchase' THEN 'Vector dimension mismatch: expected {HASH_DIM}, got 32' END AS reason
  FROM events)
SELECT seq, id, reason FROM r WHERE reason IS NOT NULL
"""


# ---------------------------------------------------------------- scans

def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-2 + K-1: the documents catalog written as a snapshot and scanned back in id order."""
    store = docs_store(spark, sf_dir)
    return store.read().orderBy("id").select("id", F.char_length("text").alias("n_chars"), "dim")


SQL_CATALOG_SCAN = f"""
SELECT doc_id + 1 AS id, length(text)::INTEGER AS n_chars, {HASH_DIM} AS dim FROM documents ORDER BY id
"""


def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-4: ORDER BY id LIMIT 50 OFFSET 100 over the documents catalog."""
    cat = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("id"), "text")
    return C.page(cat, 50, 100).select("id", F.md5("text").alias("text_md5"))


SQL_CATALOG_PAGE = """
SELECT doc_id + 1 AS id, md5(text) AS text_md5 FROM documents ORDER BY id LIMIT 50 OFFSET 100
"""


def catalog_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-4, keyset form for deep pages: the 50 ids after the largest labelled id's half.

    The boundary comes from the data (half the largest labelled doc id). It is compared with the stored column, so it
    is pushed to the Parquet scan."""
    boundary = table(spark, sf_dir, "labels").agg(F.max("doc_id")).first()[0] // 2
    cat = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return C.page_after(cat, boundary - 1, 50).select((F.col("id") + 1).alias("id"), F.md5("text").alias("text_md5"))


SQL_CATALOG_PAGE_AFTER = """
SELECT doc_id + 1 AS id, md5(text) AS text_md5 FROM documents
WHERE doc_id + 1 > (SELECT max(doc_id) // 2 FROM labels) ORDER BY id LIMIT 50
"""


def catalog_page_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-4 at any depth: pages of 50 at the start, the middle and the end of the documents catalog, each read from the
    files that the rank index names."""
    cat = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("id"), "text")
    n = cat.count()
    ranked = build_ranked(cat, file_rows=max(1, n // 16))
    pages = [ranked.page(50, at).select(F.lit(at).cast("long").alias("offset"), "id", F.md5("text").alias("text_md5")) for at in (0, n // 2, n - 20)]
    return reduce(DataFrame.unionByName, pages)


SQL_CATALOG_PAGE_RANKED = """
WITH d AS (SELECT doc_id + 1 AS id, md5(text) AS text_md5, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
  starts AS (SELECT DISTINCT unnest([0, n // 2, n - 20]) AS start FROM d)
SELECT start::BIGINT AS "offset", id, text_md5 FROM d JOIN starts ON pos >= start AND pos < start + 50
"""


def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-3: catalog rows whose id is labelled (left semi join)."""
    cat = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("id"), "lang")
    ids = table(spark, sf_dir, "labels").select((F.col("doc_id") + 1).alias("id"))
    return C.lookup(cat, ids)


SQL_CATALOG_LOOKUP = """
SELECT doc_id + 1 AS id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
"""


def catalog_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-4 as a flag: for every conversation id, is it a catalog id?"""
    cat = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("id"))
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return C.exists_flag(ids, cat)


SQL_CATALOG_EXISTS = """
SELECT DISTINCT c.conv_id AS id, (d.doc_id IS NOT NULL) AS exists
FROM conversations c LEFT JOIN documents d ON d.doc_id + 1 = c.conv_id
"""


def catalog_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-5: three rows drawn with a seed (md5(seed || id) order), engine-independent."""
    cat = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("id"), "lang")
    return C.sample_rows(cat, 3, SAMPLE_SEED)


SQL_CATALOG_SAMPLE = f"""
SELECT doc_id + 1 AS id, lang FROM documents
ORDER BY md5('{SAMPLE_SEED}' || CAST(doc_id + 1 AS VARCHAR)), doc_id + 1 LIMIT 3
"""


def catalog_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-1: health record over the embeddings catalog."""
    return C.catalog_metrics(embeddings_catalog(spark, sf_dir), P.MODEL_NAME)


SQL_CATALOG_METRICS = f"""
SELECT 'ok' AS status, 'Service is running' AS message, '{P.MODEL_NAME}' AS model,
       count(*)::BIGINT AS vectors_count FROM embeddings
"""


def catalog_store_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-1 on the snapshot store: the documents catalog is written, a feed of event
    ids (user_id * 7, partly new, partly known) is merged into it, and the size is
    read from the latest commit record, which the writes observed (no scan)."""
    store = docs_store(spark, sf_dir)
    feed = events_feed(spark, sf_dir).select("seq", (F.col("id") * 7).alias("id"), "text", "ts")
    valid, _ = C.validate_upserts(feed, vector_col=None)
    store.merge(C.fold_upserts(valid, hashing_embedder()))
    return C.metrics_of_count(spark, store.count(), P.MODEL_NAME)


SQL_CATALOG_STORE_METRICS = f"""
SELECT 'ok' AS status, 'Service is running' AS message, '{P.MODEL_NAME}' AS model,
       (SELECT count(*) FROM (SELECT doc_id + 1 AS id FROM documents
                              UNION SELECT user_id * 7 FROM events WHERE user_id > 0))::BIGINT AS vectors_count
"""


# ---------------------------------------------------------------- codec and embedding

def blob_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-2 then S-6: vectors exported as float32 little-endian bytes and imported back."""
    cat = embeddings_catalog(spark, sf_dir)
    blobs = export_blob_table(cat.select("id", "vector"))
    back, _ = import_blob_table(blobs)
    j = back.join(cat.select("id", F.col("vector").alias("orig")), "id")
    return (j.join(blobs.select("id", "blob"), "id")
            .select("id", "dim", F.lower(F.hex("blob")).alias("blob_hex"), (F.col("vector") == F.col("orig")).alias("same")))


# The bytes of a binary32 number, from its sign, exponent and fraction.
_SQL_F32_HEX = """list_transform(list_transform(list_transform(embedding, lambda x: x::DOUBLE), lambda x:
    CASE WHEN x = 0 THEN 0 ELSE CASE WHEN x < 0 THEN 2147483648 ELSE 0 END
      + (floor(log2(abs(x))) + CASE WHEN pow(2, floor(log2(abs(x)))) > abs(x) THEN -1 WHEN pow(2, floor(log2(abs(x))) + 1) <= abs(x) THEN 1 ELSE 0 END + 126)::BIGINT * 8388608
      + (abs(x) / pow(2, floor(log2(abs(x))) + CASE WHEN pow(2, floor(log2(abs(x)))) > abs(x) THEN -1 WHEN pow(2, floor(log2(abs(x))) + 1) <= abs(x) THEN 1 ELSE 0 END) * 8388608)::BIGINT END),
  lambda b: printf('%02x%02x%02x%02x', (b & 255)::INTEGER, ((b >> 8) & 255)::INTEGER, ((b >> 16) & 255)::INTEGER, ((b >> 24) & 255)::INTEGER))"""

SQL_BLOB_ROUNDTRIP = f"""
SELECT vec_id + 1 AS id, len(embedding)::INTEGER AS dim, array_to_string({_SQL_F32_HEX}, '') AS blob_hex, true AS same FROM embeddings
"""


def blob_import_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-6 rejects: blobs whose stored dimension is off by one (every third id) or that are missing (every seventh)."""
    blobs = export_blob_table(embeddings_catalog(spark, sf_dir).select("id", "vector"))
    blobs = (blobs.withColumn("dim", F.when(F.col("id") % 3 == 0, F.col("dim") + 1).otherwise(F.col("dim")))
             .withColumn("blob", F.when(F.col("id") % 7 != 0, F.col("blob"))))
    _, rejects = import_blob_table(blobs)
    return rejects.select("id", "reason")


SQL_BLOB_IMPORT_REJECTS = """
SELECT vec_id + 1 AS id, 'Blob size does not match 4 * dim' AS reason FROM embeddings WHERE (vec_id + 1) % 3 = 0 OR (vec_id + 1) % 7 = 0
"""


def toy_model():
    """A stand-in for a sentence model: per word (length, code of the first character modulo 7, 1)."""
    def encode(texts):
        rows = [[w for w in str(t).split(" ") if w][:P.MAX_TEXT_LENGTH] for t in texts]
        width = max((len(r) for r in rows), default=0) or 1
        tok, mask = np.zeros((len(rows), width, 3), np.float32), np.zeros((len(rows), width), np.float32)
        for i, r in enumerate(rows):
            tok[i, :len(r)] = [(len(w), ord(w[0]) % 7, 1.0) for w in r] or np.zeros((0, 3))
            mask[i, :len(r)] = 1
        return tok, mask

    return encode


def model_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-1a: a model behind ``ModelEmbedder`` over the benchmark texts (E-1, E-2, E-3 around it)."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    made = ModelEmbedder(toy_model, 3, name="toy").embed(b)
    return made.select("item_id", F.transform("vector", lambda x: F.round(x.cast("double"), 4)).alias("vector"))


SQL_MODEL_EMBED = f"""
WITH t AS (SELECT item_id, list_filter(string_split(text, ' '), lambda w: w <> '')[1:{P.MAX_TEXT_LENGTH}] AS w FROM benchmark),
  m AS (SELECT item_id, list_avg(list_transform(w, lambda x: length(x)::DOUBLE)) AS a, list_avg(list_transform(w, lambda x: (unicode(x) % 7)::DOUBLE)) AS b FROM t)
SELECT item_id, [round(a / sqrt(a * a + b * b + 1), 4), round(b / sqrt(a * a + b * b + 1), 4), round(1 / sqrt(a * a + b * b + 1), 4)] AS vector FROM m
"""


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-1b / E-4: the hashing embedder over every document (float32, bit-exact)."""
    return documents_catalog(spark, sf_dir).select("id", "vector")


SQL_HASH_EMBED = f"""
SELECT id, list_transform(v, lambda x: x::FLOAT) AS vector FROM ({sql_hash_vectors("documents", "doc_id + 1", "text")})
"""


def token_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-1: tokens of every document, first 512 kept."""
    emb = HashingEmbedder(dim=HASH_DIM, max_tokens=P.MAX_TEXT_LENGTH)
    docs = table(spark, sf_dir, "documents")
    toks = emb.tokens(F.col("text"))
    return docs.select("doc_id", F.size(toks).alias("n_tokens"),
                       F.md5(F.array_join(toks, " ")).alias("tokens_md5"))


SQL_TOKEN_TRUNCATE = """
WITH t AS (SELECT doc_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '')[1:512] AS toks FROM documents)
SELECT doc_id, len(toks)::INTEGER AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM t
"""


def mean_pool_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-2: token table from ``embeddings`` (doc = label, token = row, mask = vec_id % 3 <> 0)."""
    e = table(spark, sf_dir, "embeddings")
    tok = e.select(F.col("label").alias("doc"), F.col("vec_id").alias("pos"),
                   F.when(F.pmod("vec_id", F.lit(3)) != 0, 1).otherwise(0).alias("mask"),
                   F.col("embedding").alias("vec"))
    pooled = mean_pool(tok, "doc", "pos", "mask", "vec", "vector")
    return pooled.select(F.col("doc").alias("label"),
                         F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


SQL_MEAN_POOL = """
WITH cells AS (
  SELECT label, u.d AS d, u.x::DOUBLE AS x, CASE WHEN vec_id % 3 <> 0 THEN 1.0 ELSE 0.0 END AS m
  FROM embeddings, LATERAL (SELECT unnest(embedding) AS x, unnest(range(len(embedding))) AS d) u),
  s AS (SELECT label, d, sum(x * m) / greatest(sum(m), 1e-9) AS v FROM cells GROUP BY label, d)
SELECT label, list(round(v, 6) ORDER BY d) AS vector FROM s GROUP BY label
"""


def l2_normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-3: embeddings scaled by their label (label 0 gives zero vectors), re-normalised."""
    e = table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: x * F.col("label"))
    return e.select((F.col("vec_id") + 1).alias("id"),
                    F.transform(l2_normalize(scaled), lambda x: F.round(x, 5)).alias("vector"))


SQL_L2_NORMALIZE = """
-- "+ 0.0" turns -0.0 into 0.0, as Spark's round does.
WITH s AS (SELECT vec_id + 1 AS id, list_transform(embedding, lambda x: x::DOUBLE * label) AS v FROM embeddings),
  n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM s)
SELECT id, list_transform(v, lambda x: round((x / greatest(nrm, 1e-12))::FLOAT, 5) + 0.0::FLOAT) AS vector FROM n
"""


QUERIES = {
    "upsert_fold": (upsert_fold, SQL_UPSERT_FOLD),
    "catalog_snapshot_merge": (catalog_snapshot_merge, SQL_SNAPSHOT_MERGE),
    "catalog_growth": (catalog_growth, SQL_CATALOG_GROWTH),
    "upsert_actions": (upsert_actions, SQL_UPSERT_ACTIONS),
    "upsert_rejects": (upsert_rejects, SQL_UPSERT_REJECTS),
    "catalog_scan": (catalog_scan, SQL_CATALOG_SCAN),
    "catalog_page": (catalog_page, SQL_CATALOG_PAGE),
    "catalog_page_after": (catalog_page_after, SQL_CATALOG_PAGE_AFTER),
    "catalog_page_ranked": (catalog_page_ranked, SQL_CATALOG_PAGE_RANKED),
    "catalog_lookup": (catalog_lookup, SQL_CATALOG_LOOKUP),
    "catalog_exists": (catalog_exists, SQL_CATALOG_EXISTS),
    "catalog_sample": (catalog_sample, SQL_CATALOG_SAMPLE),
    "catalog_metrics": (catalog_metrics, SQL_CATALOG_METRICS),
    "catalog_store_metrics": (catalog_store_metrics, SQL_CATALOG_STORE_METRICS),
    "blob_roundtrip": (blob_roundtrip, SQL_BLOB_ROUNDTRIP),
    "blob_import_rejects": (blob_import_rejects, SQL_BLOB_IMPORT_REJECTS),
    "model_embed": (model_embed, SQL_MODEL_EMBED),
    "hash_embed": (hash_embed, SQL_HASH_EMBED),
    "token_truncate": (token_truncate, SQL_TOKEN_TRUNCATE),
    "mean_pool": (mean_pool_query, SQL_MEAN_POOL),
    "l2_normalize": (l2_normalize_query, SQL_L2_NORMALIZE),
}
