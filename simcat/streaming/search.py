"""Streaming search (ST-3): a stream of queries answered against the current catalog.

Each micro-batch runs the batch search plan (``search``) inside ``foreachBatch``
and writes its hits to a per-batch path in overwrite mode, so a replayed batch
rewrites the same answer. The catalog is re-read per batch, so searches see the
latest committed snapshot (one snapshot per batch). Queries come as vectors, or as
texts with an embedder: these are validated first, and every query that gets no
search is written to the rejects with its reason.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simcat import params as P
from simcat.operators.catalog import vector_reason
from simcat.operators.search import prepare_queries, release_broadcasts, search


def run_search_stream(queries: DataFrame, catalog: Callable[[], DataFrame], out_dir: str, checkpoint: str,
                      params: P.Params = P.DEFAULT, with_text: bool = False, embedder=None):
    """``queries`` is a streaming DataFrame of (qid, k, vector), or with an ``embedder`` of
    (qid, text, top_k); ``catalog()`` returns the catalog (id, vector[, text]) to search in
    this batch. Hits go to ``out_dir/batch_id=n``; for text queries to
    ``out_dir/hits/batch_id=n``, and rejects (qid, reason) to ``out_dir/rejects/batch_id=n``."""

    def answer(batch: DataFrame, path: str) -> None:
        cat = catalog()
        hits = search(batch, cat.select("id", "vector"), params,
                      catalog_text=cat.select("id", "text") if with_text else None)
        hits.write.mode("overwrite").parquet(path)
        release_broadcasts()

    def per_text_batch(batch: DataFrame, batch_id: int) -> None:
        valid, rejects = prepare_queries(batch, params)
        embedded = embedder.embed(valid, "text", "vector").withColumn("reason", vector_reason(F.col("vector"), embedder.dim))
        embedded = embedded.persist()
        try:
            late = embedded.filter(F.col("reason").isNotNull())
            rejects.select("qid", "reason").unionByName(late.select("qid", "reason")).write.mode("overwrite").parquet(f"{out_dir}/rejects/batch_id={batch_id}")
            answer(embedded.filter(F.col("reason").isNull()), f"{out_dir}/hits/batch_id={batch_id}")
        finally:
            embedded.unpersist()

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if embedder is not None:
            per_text_batch(batch, batch_id)
        else:
            answer(batch, f"{out_dir}/batch_id={batch_id}")

    q = (queries.writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
