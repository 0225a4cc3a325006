"""The bulk load job: JSON lines -> formatted, validated and embedded products -> catalog, with its reports.

The scan, the formatting and the validation run once: their outcome, one row per parsed
record, is written below the shared folder, and the catalog merge, the rejects and the
reports read it from there. Records of one id fold like repeated upserts, in file order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simcat import params as P
from simcat.operators import catalog as C
from simcat.operators.products import load_outcomes
from simcat.operators.report import batch_progress, failure_sample, load_report
from simcat.session import shared_dir
from simcat.sources.jsonl import read_products
from simcat.sources.store import CatalogStore, write_rejects


@dataclass
class LoadRun:
    """What one load did: ``outcomes`` (record_no, line_no, id, text, reason) and ``malformed`` (line_no, line)."""

    outcomes: DataFrame
    malformed: DataFrame
    params: P.Params

    def report(self) -> DataFrame:
        return load_report(self.outcomes)

    def progress(self) -> DataFrame:
        return batch_progress(self.outcomes, self.params.load_batch_size)

    def failures(self) -> DataFrame:
        return failure_sample(self.outcomes, self.params.failure_sample)


def load_products(spark: SparkSession, path: str, store: CatalogStore, embedder, params: P.Params = P.DEFAULT,
                  ts: Column | None = None, rejects_path: str | None = None) -> LoadRun:
    """Load a file or folder of JSON lines into ``store``. ``ts``: epoch seconds of the upserts
    (default: now). Records whose embedding is missing or has another dimension than the
    embedder's are failures like any other."""
    run_dir = shared_dir(spark, "load")
    records, malformed = read_products(spark, path)
    malformed.write.parquet(f"{run_dir}/malformed")
    outcomes = load_outcomes(records, params, keep=["line_no"])
    if not embedder.total:
        made = embedder.embed(outcomes, "text", "vector")
        late = F.when(F.col("reason").isNull(), C.vector_reason(F.col("vector"), embedder.dim))
        outcomes = made.withColumn("reason", F.coalesce("reason", late))
    outcomes.write.parquet(f"{run_dir}/outcomes")
    outcomes = spark.read.schema(outcomes.schema).parquet(f"{run_dir}/outcomes")
    good = outcomes.filter(F.col("reason").isNull())
    payload = [] if embedder.total else ["vector"]
    events = good.select(F.col("record_no").alias("seq"), "id", "text", *payload, (C.now_seconds() if ts is None else ts).alias("ts"))
    store.merge(C.fold_upserts(events, embedder if embedder.total else None))
    if rejects_path:
        write_rejects(outcomes.filter(F.col("reason").isNotNull()).select("record_no", "line_no", "id", "reason"), rejects_path)
    return LoadRun(outcomes.drop("vector"), spark.read.schema(malformed.schema).parquet(f"{run_dir}/malformed"), params)
