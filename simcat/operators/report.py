"""Run reports (A-2..A-5): one-pass aggregates over job outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simcat import params as P
from simcat.session import shared_dir


def load_report(outcomes: DataFrame) -> DataFrame:
    """A-2: total (parsed records), success, failed -- one pass; all zero when empty.

    ``outcomes`` has one row per parsed record with a nullable ``reason``."""
    ok = F.col("reason").isNull()
    return outcomes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("success"),
        F.count_if(~ok).alias("failed"),
    ).select(F.col("total").cast("long"), F.col("success").cast("long"), F.col("failed").cast("long"))


def batch_progress(outcomes: DataFrame, batch_size: int = P.LOAD_BATCH_SIZE) -> DataFrame:
    """A-3: records in fixed-size batches in file order (``line_no``), per batch counts.

    The batch number is a pure function of the line number, so no global window
    (which would pull every row into one task) is needed; lines are dense 1..N
    over parsed records because ``record_no`` is assigned by the scan."""
    batch = F.floor((F.col("record_no") - 1) / F.lit(batch_size)).cast("long") + 1
    return (outcomes.groupBy(batch.alias("batch"))
            .agg(F.count(F.lit(1)).alias("records"),
                 F.count_if(F.col("reason").isNull()).alias("success"),
                 F.count_if(F.col("reason").isNotNull()).alias("failed")))


def failure_sample(outcomes: DataFrame, n: int = P.FAILURE_SAMPLE) -> DataFrame:
    """A-4: the first ``n`` failures in file order (top-k, no full sort) + how many more.

    The failures (record_no, id, reason) are written below the shared folder first, in one
    pass over ``outcomes``; the count and the top-k read that narrow table."""
    spark, path = outcomes.sparkSession, shared_dir(outcomes.sparkSession, "failures")
    failed = outcomes.filter(F.col("reason").isNotNull()).select("record_no", "id", "reason")
    failed.write.parquet(path)
    failed = spark.read.schema(failed.schema).parquet(path)
    more = failed.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0))).scalar()
    return failed.orderBy("record_no").limit(n).select("record_no", "id", "reason", more.cast("long").alias("more"))


def search_run_report(catalog: DataFrame, embedder, n: int = P.SEARCH_RUN_SIZE, k: int = P.SEARCH_RUN_K) -> DataFrame:
    """A-5: the first ``n`` catalog rows by id query the catalog with their own text.

    queries, success, failed, mean results per successful query (null when none),
    and the share of queries whose best hit is the query row itself."""
    from simcat.operators.search import prepare_queries, search

    # The query set feeds three plans (the size-checked query fetch, the per-query
    # join and the rejects); it is at most ``n`` rows, written after one top-n.
    spark, path = catalog.sparkSession, shared_dir(catalog.sparkSession, "search-run")
    first = catalog.select("id", "text").orderBy("id").limit(n)
    first.write.parquet(path)
    first = spark.read.schema(first.schema).parquet(path)
    q = first.select(F.col("id").alias("qid"), "text", F.lit(k).cast("int").alias("top_k"))
    valid, rejects = prepare_queries(q)
    qv = embedder.embed(valid, "text", "vector")
    hits = search(qv, catalog.select("id", "vector"))
    per_q = (valid.select("qid").join(hits, "qid", "left")
             .groupBy("qid")
             .agg(F.count("id").alias("n_results"),
                  F.coalesce(F.max((F.col("rank") == 1) & (F.col("id") == F.col("qid"))), F.lit(False)).alias("self_first"))
             .withColumn("ok", F.lit(True)))
    bad = rejects.select("qid", F.lit(None).cast("long").alias("n_results"),
                         F.lit(None).cast("boolean").alias("self_first"), F.lit(False).alias("ok"))
    outcomes = per_q.unionByName(bad)
    ok = F.col("ok")
    return outcomes.agg(
        F.count(F.lit(1)).cast("long").alias("queries"),
        F.count_if(ok).cast("long").alias("success"),
        F.count_if(~ok).cast("long").alias("failed"),
        F.avg(F.when(ok, F.col("n_results"))).cast("double").alias("avg_results"),
        F.avg(F.when(ok, F.when(F.col("self_first"), 1.0).otherwise(0.0))).cast("double").alias("self_hit_rate"))
