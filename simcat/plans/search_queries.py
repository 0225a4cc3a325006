"""Registered search queries (J-1, T-1..T-4, J-3, A-5, S-5) and their DuckDB oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simcat import params as P
from simcat.functions.text import PY_SPACE_CLASS, preview
from simcat.operators.blocks import build_blocks, search_blocks
from simcat.operators.catalog import sample_rows
from simcat.operators.report import search_run_report
from simcat.operators.search import prepare_queries, search
from simcat.plans.fixtures import (HASH_DIM, SAMPLE_SEED, SQL_EMB_CATALOG, benchmark_queries, docs_store, documents_catalog,
                                   embeddings_catalog, hashing_embedder, sql_hash_vectors, table)
from simcat.session import shared_dir

# Shared oracle tail: rank scores (ties at 12 decimals broken by id), round half-even, clamp.
_SQL_RANK = """
  ranked AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, id))::INTEGER AS rank
             FROM scored)
"""
_SQL_SCORE = "greatest(-1.0, least(1.0, round_even(score, 4))) AS score_rate"


def search_topk_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-1 + S-5: one catalog row drawn by the seeded sample is the query; k = 5."""
    cat = embeddings_catalog(spark, sf_dir)
    pick = sample_rows(cat, 1, SAMPLE_SEED)
    q = pick.select(F.col("id").alias("qid"), F.lit(5).alias("k"), "vector")
    return search(q, cat)


SQL_SEARCH_TOPK_SINGLE = f"""
WITH c AS ({SQL_EMB_CATALOG}),
  q AS (SELECT id AS qid, v FROM c ORDER BY md5('{SAMPLE_SEED}' || CAST(id AS VARCHAR)), id LIMIT 1),
  scored AS (SELECT q.qid, c.id, list_dot_product(q.v, c.v) AS score FROM q CROSS JOIN c),
  {_SQL_RANK}
SELECT qid, rank, id, {_SQL_SCORE} FROM ranked WHERE rank <= 5
"""


def search_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-1 + T-2: every catalog vector queries the whole catalog, k = 5."""
    cat = embeddings_catalog(spark, sf_dir)
    q = cat.select(F.col("id").alias("qid"), F.lit(5).alias("k"), "vector")
    return search(q, cat)


SQL_SEARCH_TOPK_BATCH = f"""
WITH c AS ({SQL_EMB_CATALOG}),
  scored AS (SELECT q.id AS qid, c.id, list_dot_product(q.v, c.v) AS score FROM c q CROSS JOIN c),
  {_SQL_RANK}
SELECT qid, rank, id, {_SQL_SCORE} FROM ranked WHERE rank <= 5
"""


def search_topk_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-1 block x block plan forced, blocks sized from the data; same answer as the batch query."""
    cat = embeddings_catalog(spark, sf_dir)
    q = cat.select(F.col("id").alias("qid"), F.lit(5).alias("k"), "vector")
    return search(q, cat, plan="blocked")


def search_topk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-1 over the catalog laid out in blocks around pivots, blocks pruned by their bounds, queries in
    several chunks; same answer as the batch query."""
    cat = embeddings_catalog(spark, sf_dir)
    q = cat.select(F.col("id").alias("qid"), F.lit(5).alias("k"), "vector")
    hits, _ = search_blocks(q, build_blocks(cat, pivots=64, block_rows=32), chunk_rows=400)
    return hits


PLANS_K = 60
# Pairs that a part of the broadcast plan's queries scores at least, and bytes of vectors that a task of it reads.
PART_PAIRS, SCAN_BYTES = 1 << 30, 128 << 20


def search_plans_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-1 + T-3: k above the default maximum, the same hits from the broadcast plan, the
    blocked plan and the automatic one under a budget far below the query set."""
    cat = embeddings_catalog(spark, sf_dir)
    q = cat.select(F.col("id").alias("qid"), F.lit(PLANS_K).alias("k"), "vector")
    wide = P.DEFAULT.with_(max_top_k=100)
    tiny = wide.with_(broadcast_query_bytes=1 << 16)
    # The broadcast plan refuses more queries than its budget: they come in parts, by hash, with room for uneven ones. The
    # catalog may be one file of one row group, so parts, not splits of it, are what keeps the cores busy; with enough of them
    # it is read in few tasks, as each leaves its own candidates.
    n, cores = q.count(), spark.sparkContext.defaultParallelism
    parts = max(1 + n * HASH_DIM * 8 * 5 // (4 * wide.broadcast_query_bytes), min(cores, 1 + n * n // PART_PAIRS))
    part = F.pmod(F.xxhash64("qid"), F.lit(parts))
    scanned = cat.coalesce(max(1 + n * HASH_DIM * 8 // SCAN_BYTES, -(-2 * cores // parts)))
    sent = [search(q.filter(part == i), scanned, wide, plan="broadcast") for i in range(parts)]
    runs = {"broadcast": reduce(DataFrame.unionByName, sent), "blocked": search(q, cat, wide, plan="blocked", blocks=(2, 3)),
            "auto": search(q, cat, tiny)}
    out = None
    for name, hits in runs.items():
        hits = hits.select(F.lit(name).alias("plan"), "qid", "rank", "id", "score_rate")
        out = hits if out is None else out.unionByName(hits)
    return out


SQL_SEARCH_PLANS_AGREE = f"""
WITH c AS ({SQL_EMB_CATALOG}),
  scored AS (SELECT q.id AS qid, c.id, list_dot_product(q.v, c.v) AS score FROM c q CROSS JOIN c),
  {_SQL_RANK}
SELECT plan, qid, rank, id, {_SQL_SCORE}
FROM ranked CROSS JOIN (VALUES ('broadcast'), ('blocked'), ('auto')) p(plan) WHERE rank <= {PLANS_K}
"""


def _k_rule(label):
    # Per-query k from the label column: null (default 5), 3, 50, and two invalid values.
    return (F.when(label == 0, F.lit(None)).when(label == 1, 3).when(label == 2, 50)
            .when(label == 3, 51).when(label == 4, 0).otherwise(label)).cast("int")


_SQL_K_RULE = ("CASE WHEN label = 0 THEN NULL WHEN label = 1 THEN 3 WHEN label = 2 THEN 50 "
               "WHEN label = 3 THEN 51 WHEN label = 4 THEN 0 ELSE label END")


def search_topk_per_query_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-3 + V-10: per-row k (null -> 5); rows with k outside 1..50 are rejected."""
    cat = embeddings_catalog(spark, sf_dir)
    q = cat.select(F.col("id").alias("qid"), _k_rule(F.col("label")).alias("top_k"), "vector")
    valid, _ = prepare_queries(q, text_col=None, k_col="top_k")
    return search(valid, cat)


SQL_SEARCH_TOPK_PER_QUERY_K = f"""
WITH c AS ({SQL_EMB_CATALOG}),
  q AS (SELECT id AS qid, v, coalesce({_SQL_K_RULE}, 5) AS k FROM c
        WHERE coalesce({_SQL_K_RULE}, 5) BETWEEN 1 AND 50),
  scored AS (SELECT q.qid, q.k, c.id, list_dot_product(q.v, c.v) AS score FROM q CROSS JOIN c),
  {_SQL_RANK}
SELECT qid, rank, id, {_SQL_SCORE} FROM ranked WHERE rank <= k
"""


def variant_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as queries (qid, text, top_k), five of six invalid in some way, by item_id."""
    b = table(spark, sf_dir, "benchmark")
    variant = F.pmod(F.col("item_id"), F.lit(6))
    text = (F.when(variant == 1, F.lit("\u00a0\u2003\u001f"))
            .when(variant == 2, F.repeat(F.lit("x"), P.MAX_TEXT_CHARS + 1))
            .when(variant == 3, F.lit(""))
            .otherwise(F.col("text")))
    k = F.when(variant == 4, 51).when(variant == 5, 0).otherwise(F.lit(None)).cast("int")
    return b.select(F.col("item_id").alias("qid"), text.alias("text"), k.alias("top_k"))


def search_query_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-6, V-7, V-10 on text queries: benchmark texts with edge variants assigned by item_id."""
    _, rejects = prepare_queries(variant_queries(spark, sf_dir))
    return rejects.select("qid", "reason")


SQL_SEARCH_QUERY_REJECTS = """
WITH q AS (
  SELECT item_id AS qid,
         CASE item_id % 6 WHEN 1 THEN chr(160) || chr(8195) || chr(31)
                          WHEN 2 THEN repeat('x', 100001) WHEN 3 THEN '' ELSE text END AS text,
         CASE item_id % 6 WHEN 4 THEN 51 WHEN 5 THEN 0 END AS top_k
  FROM benchmark),
r AS (
  SELECT qid,
    CASE WHEN text IS NULL OR length(text) < 1 OR length(text) > 100000 THEN 'text length must be within 1..100000'
         WHEN regexp_replace(text, '^[\\x{0009}-\\x{000D}\\x{001C}-\\x{0020}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', '') = ''
              THEN 'Query text cannot be empty'
         WHEN top_k < 1 THEN 'top_k must be >= 1'
         WHEN top_k > 50 THEN 'top_k must be <= 50' END AS reason
  FROM q)
SELECT qid, reason FROM r WHERE reason IS NOT NULL
"""


def search_k_exceeds_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-3 min(k, n): a catalog of the distinct return flags of all line items (3 rows), k = 5."""
    li = table(spark, sf_dir, "lineitem")
    flags = li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    emb = hashing_embedder()
    cat = emb.embed(flags.select(F.ascii("l_returnflag").cast("long").alias("id"),
                                 F.concat(F.lit("return flag "), F.col("l_returnflag")).alias("text")),
                    "text", "vector")
    q = emb.embed(benchmark_queries(spark, sf_dir), "text", "vector").select("qid", F.lit(5).alias("k"), "vector")
    return search(q, cat)


SQL_SEARCH_K_EXCEEDS_CATALOG = f"""
WITH cv AS ({sql_hash_vectors("(SELECT DISTINCT l_returnflag FROM lineitem)",
                              "ascii(l_returnflag)::BIGINT", "'return flag ' || l_returnflag")}),
  qv AS ({sql_hash_vectors("benchmark", "item_id", "text")}),
  scored AS (SELECT qv.id AS qid, cv.id, list_dot_product(qv.v, cv.v) AS score FROM qv CROSS JOIN cv),
  {_SQL_RANK}
SELECT qid, rank, id, {_SQL_SCORE} FROM ranked WHERE rank <= 5
"""


def search_empty_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-4: an empty catalog gives each query an empty answer, not an error."""
    cat = embeddings_catalog(spark, sf_dir).filter(F.lit(False))
    q = embeddings_catalog(spark, sf_dir).select(F.col("id").alias("qid"), F.lit(5).alias("k"), "vector")
    hits = search(q, cat).groupBy("qid").agg(F.count(F.lit(1)).alias("n_hits"))
    return q.select("qid").join(hits, "qid", "left").select("qid", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


SQL_SEARCH_EMPTY_CATALOG = "SELECT vec_id + 1 AS qid, 0::BIGINT AS n_hits FROM embeddings"


def search_text_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: benchmark texts -> hashing embedder -> exact top-5 over all documents, with hit text."""
    emb = hashing_embedder()
    cat = documents_catalog(spark, sf_dir, emb)
    valid, _ = prepare_queries(benchmark_queries(spark, sf_dir))
    q = emb.embed(valid, "text", "vector")
    texts = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("id"), "text")
    return search(q, cat.select("id", "vector"), catalog_text=texts)


SQL_SEARCH_TEXT_TOPK = f"""
WITH cv AS ({sql_hash_vectors("documents", "doc_id + 1", "text")}),
  qv AS ({sql_hash_vectors("benchmark", "item_id", "text")}),
  scored AS (SELECT qv.id AS qid, cv.id, list_dot_product(qv.v, cv.v) AS score FROM qv CROSS JOIN cv),
  {_SQL_RANK}
SELECT r.qid, r.rank, r.id, greatest(-1.0, least(1.0, round_even(r.score, 4))) AS score_rate, d.text
FROM ranked r JOIN documents d ON d.doc_id + 1 = r.id
WHERE r.rank <= 5
"""


def search_text_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-3 over the catalog store: the flagship's search on a snapshot, texts read from the winners' buckets only."""
    store = docs_store(spark, sf_dir)
    valid, _ = prepare_queries(benchmark_queries(spark, sf_dir))
    commit, path = store.latest(), shared_dir(spark, "store-hits")
    search(hashing_embedder().embed(valid, "text", "vector"), store.read(commit).select("id", "vector")).write.parquet(path)
    return store.texts_of(spark.read.parquet(path), commit).select("qid", "rank", "id", "score_rate", "text")


def search_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-9: the printed search result -- query preview (100 chars), rank, id, score at
    four decimals and hit preview (150 chars), for every benchmark query."""
    hits = search_text_topk(spark, sf_dir)
    qtext = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("qtext"))
    return hits.join(qtext, "qid").select(
        "qid", preview(F.col("qtext"), 100).alias("query_preview"), "rank", "id",
        F.format_string("%.4f", F.col("score_rate")).alias("score"),
        preview(F.col("text"), 150).alias("text_preview"))


SQL_SEARCH_PRINT = f"""
WITH hits AS ({SQL_SEARCH_TEXT_TOPK})
SELECT h.qid, left(b.text, 100) || '...' AS query_preview, h.rank, h.id,
       printf('%.4f', h.score_rate) AS score, left(h.text, 150) || '...' AS text_preview
FROM hits h JOIN benchmark b ON b.item_id = h.qid
"""


def search_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-5: the first 1000 catalog rows by id are the query set (the load run's rule), k = 5."""
    emb = hashing_embedder()
    cat = documents_catalog(spark, sf_dir, emb)
    return search_run_report(cat, emb, n=P.SEARCH_RUN_SIZE, k=P.SEARCH_RUN_K)


SQL_SEARCH_QUALITY_REPORT = f"""
WITH cv AS ({sql_hash_vectors("documents", "doc_id + 1", "text")}),
  first AS (SELECT doc_id + 1 AS qid, text FROM documents ORDER BY qid LIMIT 1000),
  -- The query rules (V-6, V-7): length 1..100000, not blank after a Python strip.
  chk AS (SELECT qid, (text IS NULL OR length(text) < 1 OR length(text) > 100000
                       OR regexp_replace(text, '^{PY_SPACE_CLASS}+', '') = '') AS bad FROM first),
  qv AS (SELECT cv.id AS qid, cv.v FROM cv JOIN chk ON chk.qid = cv.id WHERE NOT chk.bad),
  scored AS (SELECT qv.qid, cv.id, list_dot_product(qv.v, cv.v) AS score FROM qv CROSS JOIN cv),
  {_SQL_RANK},
  hits AS (SELECT * FROM ranked WHERE rank <= 5),
  per_q AS (SELECT qv.qid, count(h.id) AS n_results,
                   coalesce(bool_or(h.rank = 1 AND h.id = qv.qid), false) AS self_first
            FROM qv LEFT JOIN hits h ON h.qid = qv.qid GROUP BY qv.qid)
SELECT (SELECT count(*) FROM chk)::BIGINT AS queries,
       (SELECT count(*) FROM chk WHERE NOT bad)::BIGINT AS success,
       (SELECT count(*) FROM chk WHERE bad)::BIGINT AS failed,
       avg(n_results)::DOUBLE AS avg_results,
       avg(CASE WHEN self_first THEN 1.0 ELSE 0.0 END)::DOUBLE AS self_hit_rate
FROM per_q
"""


QUERIES = {
    "search_topk_single": (search_topk_single, SQL_SEARCH_TOPK_SINGLE),
    "search_topk_batch": (search_topk_batch, SQL_SEARCH_TOPK_BATCH),
    "search_topk_blocked": (search_topk_blocked, SQL_SEARCH_TOPK_BATCH),
    "search_topk_pruned": (search_topk_pruned, SQL_SEARCH_TOPK_BATCH),
    "search_plans_agree": (search_plans_agree, SQL_SEARCH_PLANS_AGREE),
    "search_topk_per_query_k": (search_topk_per_query_k, SQL_SEARCH_TOPK_PER_QUERY_K),
    "search_query_rejects": (search_query_rejects, SQL_SEARCH_QUERY_REJECTS),
    "search_k_exceeds_catalog": (search_k_exceeds_catalog, SQL_SEARCH_K_EXCEEDS_CATALOG),
    "search_empty_catalog": (search_empty_catalog, SQL_SEARCH_EMPTY_CATALOG),
    "search_text_topk": (search_text_topk, SQL_SEARCH_TEXT_TOPK),
    "search_text_store": (search_text_store, SQL_SEARCH_TEXT_TOPK),
    "search_quality_report": (search_quality_report, SQL_SEARCH_QUALITY_REPORT),
    "search_print": (search_print, SQL_SEARCH_PRINT),
}
