"""Streaming upsert (ST-1), per-id stateful acks (ST-2) and per-batch metrics (ST-4).

ST-1 runs the batch upsert plan once per micro-batch inside ``foreachBatch``:
validate -> embed -> acks against the catalog before the merge -> fold -> merge
into a new snapshot version. The store records (stream, batch id) and the batch's
counts in its commit, so a micro-batch replayed after a failure is merged once
(``count + n`` is not idempotent), while acks, rejects and metrics are written to
per-batch paths in overwrite mode, so a replay rewrites the same files. The final catalog
equals the batch fold of the same rows, whatever the split into micro-batches.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from simcat.functions.text import integral_id, py_strip
from simcat.operators import catalog as C
from simcat.operators.partitioning import kept, spread
from simcat.sources.store import CatalogStore, write_rejects

ACK_SCHEMA = "seq long, id long, action string, running_count long"
METRICS = ("batch_id", "rows", "success", "failed", "catalog_count")
ACK_CHUNK = 65536  # rows per emitted ack frame


def _write_metrics(store: CatalogStore, out_dir: str, done: dict) -> None:
    row = [F.lit(done[n]).cast("long").alias(n) for n in METRICS]
    store.spark.range(1).select(*row).write.mode("overwrite").parquet(f"{out_dir}/metrics/batch_id={done['batch_id']}")


def upsert_batch(batch: DataFrame, batch_id: int, store: CatalogStore, embedder,
                 out_dir: str | None = None, dim: int | None = None, stream: str = "default") -> None:
    """One micro-batch of ST-1. ``batch`` holds (seq, id, text, ts) rows.

    Every row ends as one ack or one reject: events whose vector is missing or has
    another dimension than ``dim`` are rejected with that reason like any invalid one,
    so rows = success + failed and acks = success. The counts go into the store's commit
    record with the merge; a replay after the commit writes the metrics row from there,
    and changes nothing else."""
    done = store.last_batch(stream)
    if done is not None and done["batch_id"] >= batch_id:
        if out_dir and done["batch_id"] == batch_id and "rows" in done:
            _write_metrics(store, out_dir, done)
        return
    prev = store.latest()
    # Validated once, by all cores however few files the batch came in: every step below reads the kept rows.
    tagged = kept(_tagged(spread(batch, batch.sparkSession.sparkContext.defaultParallelism)))
    judged = None
    try:
        readable = tagged.filter(F.col("reason").isNull()).drop("reason", "_raw_id")
        invalid = tagged.filter(F.col("reason").isNotNull()).select("seq", F.col("_raw_id").alias("id"), "reason")
        if embedder.total and dim in (None, embedder.dim):
            # No event can fail to get its vector: fold first, embed the winners.
            valid, rejects, late = readable, invalid, embedder
            outcome = tagged.select("id", "reason")
        else:
            # Judged once. Stored vectors are fetched again for the winners only, others are kept with their events.
            judged = embedder.judge(readable, "text", dim) if embedder.stored else embedder.embed(readable, "text", "vector").withColumn(
                "reason", C.vector_reason(F.col("vector"), dim))
            judged = kept(judged)
            valid, late = judged.filter(F.col("reason").isNull()).drop("reason"), embedder if embedder.stored else None
            bad = judged.filter(F.col("reason").isNotNull())
            rejects = invalid.unionByName(bad.select("seq", F.col("id").cast("string"), "reason"))
            outcome = judged.select("id", "reason").unionByName(tagged.filter(F.col("reason").isNotNull()).select("id", "reason"))
        # Existence is tested against the buckets this batch touches only (the
        # ones the merge rewrites), so a batch costs what its feed costs, not a
        # scan of every catalog id. One pass finds them and counts the rejects.
        bucket = F.when(F.col("reason").isNull(), store.layout.of(F.col("id")))
        per = {r["bucket"]: r["n"] for r in outcome.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()}
        failed, touched = per.pop(None, 0), set(per)
        counts = None
        if out_dir:
            acks = C.upsert_actions(valid, store.known_ids(prev, touched))
            acks.write.mode("overwrite").parquet(f"{out_dir}/acks/batch_id={batch_id}")
            write_rejects(rejects, f"{out_dir}/rejects/batch_id={batch_id}")
            rows = sum(per.values()) + failed if judged is None else tagged.count()
            counts = {"rows": rows, "success": rows - failed, "failed": failed}
        store.merge(C.fold_upserts(valid, late, dim), batch_id=batch_id, touched=touched, stream=stream, counts=counts)
        if out_dir:
            _write_metrics(store, out_dir, store.last_batch(stream))
    finally:
        if judged is not None:
            judged.unpersist()
        tagged.unpersist()


def _tagged(batch: DataFrame) -> DataFrame:
    """``batch`` with its ``reason``; valid rows with ``id`` as bigint and ``text`` stripped, the others with ``_raw_id``."""
    ok = F.col("reason").isNull()
    tagged = batch.withColumn("reason", C.upsert_reason(F.col("id"), F.col("text"), None, None))
    return tagged.withColumns({"_raw_id": F.when(~ok, F.col("id").cast("string")), "id": F.when(ok, integral_id(F.col("id"))),
                               "text": F.when(ok, py_strip("text"))})


def stream_identity(store: CatalogStore, checkpoint: str) -> str:
    """The id Spark gave the stream when it made its checkpoint: it outlives restarts, and a
    fresh checkpoint, whose batches are numbered from 0 again, has another one."""
    return json.loads(store.read_text(f"{checkpoint}/metadata"))["id"]


def run_upsert_stream(stream: DataFrame, store: CatalogStore, embedder, checkpoint: str,
                      out_dir: str | None = None, dim: int | None = None):
    """ST-1: start the stream (all available files, then stop) and wait for it."""
    q = (stream.writeStream
         .foreachBatch(lambda df, bid: upsert_batch(df, bid, store, embedder, out_dir, dim,
                                                    stream_identity(store, checkpoint)))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return q


# ---------------------------------------------------------------- ST-2

def stateful_acks(valid_stream: DataFrame, initial_counts: DataFrame | None = None) -> DataFrame:
    """ST-2: one ack per event with the id's running upsert count.

    State lives in the RocksDB state store (checkpointed with the query). A group
    holds one id's events of one micro-batch, bounded by the trigger size
    (``maxFilesPerTrigger``). ``initial_counts`` is ``(id, count)``, e.g. the
    catalog's counts when the stream starts."""
    chunk = ACK_CHUNK  # a closure value: travels with the pickled processor
    # Defined here, not at module level: the streaming Python runner of
    # transformWithStateInPandas does not see files added with addPyFile, so the
    # processor must travel by value (cloudpickle does that for local classes).
    class RunningAcks(StatefulProcessor):
        """Per id: the running upsert count, kept in value state across micro-batches.

        The optional initial state is the catalog's ``(id, count)``, so an id the
        catalog already holds is ``updated`` from its first streamed event on."""

        def init(self, handle) -> None:
            self.count = handle.getValueState("count", "count long")

        def handleInitialState(self, key, initialState, timerValues) -> None:
            self.count.update((int(initialState["count"].iloc[0]),))

        def handleInputRows(self, key, rows, timerValues):
            (uid,) = key
            seen = self.count.get()[0] if self.count.exists() else 0
            # Only the event numbers are kept (8 bytes per event of this id in this
            # trigger); acks go out in bounded chunks, in seq order.
            seqs = np.concatenate([r["seq"].to_numpy(dtype=np.int64) for r in rows])
            seqs.sort(kind="stable")
            self.count.update((int(seen + len(seqs)),))
            for lo in range(0, len(seqs), chunk):
                part = seqs[lo:lo + chunk]
                running = seen + lo + np.arange(1, len(part) + 1, dtype=np.int64)
                yield pd.DataFrame({
                    "seq": part,
                    "id": np.full(len(part), uid, dtype=np.int64),
                    "action": np.where(running == 1, "inserted", "updated"),
                    "running_count": running,
                })

        def close(self) -> None:
            pass

    spark = valid_stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    init = initial_counts.select("id", "count").groupBy("id") if initial_counts is not None else None
    return (valid_stream.select("seq", "id").groupBy("id")
            .transformWithStateInPandas(statefulProcessor=RunningAcks(), outputStructType=ACK_SCHEMA,
                                        outputMode="Append", timeMode="None", initialState=init))
