"""Fixture tables -> engine inputs (FIXTURES.md part C), shared by the queries.

Fixture keys start at 0 and id 0 is invalid for a catalog, so catalog ids are
``key + 1`` throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simcat.operators.embed import HashingEmbedder
from simcat.operators.partitioning import spread
from simcat.session import shared_dir
from simcat.sources.store import CatalogStore

HASH_DIM = 64
# The fixture tables are single files of one row group.
FIXTURE_TASKS = 8
SAMPLE_SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hashing_embedder() -> HashingEmbedder:
    return HashingEmbedder(dim=HASH_DIM)


def embeddings_catalog(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """Catalog (id, vector, label) from ``embeddings``; with ``with_text`` also the text
    of the document with the same key (an outer join, so only when needed)."""
    emb = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") + 1).alias("id"), F.col("embedding").alias("vector"), F.col("label"))
    if not with_text:
        return emb
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("id"), F.col("text"))
    return emb.join(docs, "id", "left").select("id", "text", "vector", "label")


def documents_catalog(spark: SparkSession, sf_dir: str, embedder=None) -> DataFrame:
    """Catalog (id, text, vector) from ``documents`` through the hashing embedder."""
    embedder = embedder or hashing_embedder()
    docs = spread(table(spark, sf_dir, "documents"), FIXTURE_TASKS).select((F.col("doc_id") + 1).alias("id"), "text")
    return embedder.embed(docs, "text", "vector")


def docs_store(spark: SparkSession, sf_dir: str) -> CatalogStore:
    """The documents catalog written as a store of eight buckets."""
    cat = documents_catalog(spark, sf_dir)
    full = cat.select("id", "text", "vector", F.size("vector").alias("dim"), F.lit(1).cast("long").alias("count"),
                      F.lit(0).cast("long").alias("created_at"), F.lit(0).cast("long").alias("updated_at"))
    store = CatalogStore(spark, shared_dir(spark, "docs"), buckets=8)
    store.write(full)
    return store


def benchmark_queries(spark: SparkSession, sf_dir: str, embedder=None, k=None) -> DataFrame:
    """Queries (qid, text, top_k) from ``benchmark``; text is not stripped (as in search)."""
    b = spread(table(spark, sf_dir, "benchmark"), FIXTURE_TASKS)
    return b.select(F.col("item_id").alias("qid"), F.col("text"),
                    (F.lit(k) if k is not None else F.lit(None)).cast("int").alias("top_k"))


# DuckDB fragments reproducing the same inputs (views are pre-registered by name).
SQL_EMB_CATALOG = """
  SELECT e.vec_id + 1 AS id, e.embedding::DOUBLE[] AS v, e.label AS label FROM embeddings e
"""


def sql_hash_vectors(src: str, id_expr: str, text_expr: str, dim: int = HASH_DIM, max_tokens: int | None = None) -> str:
    """SELECT id, v (DOUBLE[] of float32 values) -- the hashing embedder in SQL, over whole texts."""
    cut = f"[1:{max_tokens}]" if max_tokens else ""
    return f"""
  WITH src AS (SELECT {id_expr} AS id, {text_expr} AS text FROM {src}),
  tok AS (
    SELECT id, unnest(list_filter(string_split(lower(text), ' '), lambda t: t <> ''){cut}) AS t
    FROM src),
  h AS (SELECT id, md5(t) AS h FROM tok),
  cell AS (
    SELECT id,
           (('0x' || substr(h, 1, 8))::BIGINT % {dim})::INT AS b,
           SUM(CASE WHEN (('0x' || substr(h, 9, 1))::INT % 2) = 0 THEN 1 ELSE -1 END)::DOUBLE AS c
    FROM h GROUP BY ALL),
  nrm AS (SELECT id, sqrt(SUM(c * c)) AS n FROM cell GROUP BY id),
  dense AS (
    SELECT s.id,
           list_transform(range({dim}), lambda i:
             coalesce(map_extract_value(m.mp, i::INT), 0.0)) AS raw,
           coalesce(nrm.n, 0.0) AS n
    FROM src s
    LEFT JOIN (SELECT id, map_from_entries(list(struct_pack(k := b, v := c))) AS mp FROM cell GROUP BY id) m ON m.id = s.id
    LEFT JOIN nrm ON nrm.id = s.id)
  SELECT id, list_transform(raw, lambda x: (x / greatest(n, 1e-12))::FLOAT::DOUBLE) AS v FROM dense
"""
