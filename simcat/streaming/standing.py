"""Standing queries (ST-3): the answers of fixed queries kept up to date as the catalog is upserted.

For every query the state holds its best ``k + spare`` rows and a floor, the place in the ranking after which every other
row of the catalog comes. An upsert brings changed rows: they leave the kept rows and are scored anew, those that rank before
the floor enter, and the best ``k + spare`` stay, which raises the floor. So a refresh reads the kept rows and the
changed ones, never the catalog. Only a query that has fewer than k rows left while others may stand below its
floor (it lost more hits than it had to spare) is searched again, over the catalog.

The state of every catalog version is a folder of its own, written from the one before it; a batch replayed after a crash
writes the same folder again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simcat import params as P
from simcat.functions.vector import round_score, tie_key
from simcat.operators import catalog as C
from simcat.operators.partitioning import kept
from simcat.operators.search import release_broadcasts, search
from simcat.sources.store import CatalogStore
from simcat.streaming.upsert import stream_identity, upsert_batch

_HITS = "qid long, id long, score double"
_FLOORS = "qid long, k int, floor double, floor_id long, rescanned boolean"
_NONE = float("-inf")


class StandingQueries:
    """State below ``root``: ``queries`` (qid, k, vector) as given first, ``state/<version>/{hits,floors}``."""

    def __init__(self, spark: SparkSession, root: str, queries: DataFrame | None = None, params: P.Params = P.DEFAULT, spare: int = 5):
        """``queries``: (qid, k, vector), one row per qid, for new state; later handles read the stored ones."""
        self.spark, self.root, self.params, self.spare = spark, root.rstrip("/"), params, spare
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if queries is not None:
            queries.select(F.col("qid").cast("long").alias("qid"), F.coalesce(F.col("k").cast("int"), F.lit(params.default_top_k)).alias("k"), "vector").write.parquet(f"{self.root}/queries")
        self.queries = spark.read.parquet(f"{self.root}/queries")

    def _path(self, text: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)

    def versions(self) -> list[int]:
        """Catalog versions whose state is whole (floors are written last)."""
        where = self._path(f"{self.root}/state")
        names = [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(int(n) for n in names if self._fs.exists(self._path(f"{self.root}/state/{n}/floors/_SUCCESS")))

    def _read(self, version: int, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/state/{version}/{name}")

    def _search(self, queries: DataFrame, catalog: DataFrame) -> DataFrame:
        """(qid, id, score) of each query's best ``k + spare`` rows, scores unrounded."""
        wide = queries.withColumn("k", F.col("k") + F.lit(self.spare))
        return search(wide, catalog.select("id", "vector"), self.params, keep_raw=True).select("qid", "id", F.col("_raw_score").alias("score"))

    def _write(self, version: int, hits: DataFrame, floors: DataFrame) -> None:
        hits.select("qid", "id", "score").write.mode("overwrite").parquet(f"{self.root}/state/{version}/hits")
        floors.select("qid", "k", "floor", "floor_id", "rescanned").write.mode("overwrite").parquet(f"{self.root}/state/{version}/floors")

    def _ranked(self, hits: DataFrame) -> DataFrame:
        order = Window.partitionBy("qid").orderBy(tie_key(F.col("score")).desc(), F.col("id"))
        return hits.withColumn("n", F.row_number().over(order))

    def _floors(self, ranked: DataFrame, before: DataFrame) -> DataFrame:
        """The place of each query's last kept row where it has all its rows, else its place before."""
        last = ranked.join(self.queries.select(F.col("qid"), "k"), "qid").filter(F.col("n") == F.col("k") + self.spare)
        last = last.select("qid", tie_key(F.col("score")).alias("_floor"), F.col("id").alias("_floor_id"))
        joined = before.join(last, "qid", "left")
        return joined.select("qid", "k", F.coalesce("_floor", "floor").alias("floor"), F.when(F.col("_floor").isNotNull(), F.col("_floor_id")).otherwise(F.col("floor_id")).alias("floor_id"), "rescanned")

    def refresh(self, version: int, changed: DataFrame, catalog: Callable[[], DataFrame]) -> None:
        """Bring the answers to catalog ``version``: ``changed`` (id, vector) has the rows upserted since the state before
        it, as they are now; ``catalog()`` (id, vector) the whole of it, read only if a query must be searched again."""
        earlier = [v for v in self.versions() if v < version]
        if not earlier:
            none = self.queries.select("qid", "k", F.lit(_NONE).alias("floor"), F.lit(0).cast("long").alias("floor_id"), F.lit(True).alias("rescanned"))
            hits = self._staged(self._search(self.queries, catalog()), version, "first")
            self._write(version, hits, self._floors(self._ranked(hits), none))
            return
        hits, floors = self._read(earlier[-1], "hits", _HITS), self._read(earlier[-1], "floors", _FLOORS).withColumn("rescanned", F.lit(False))
        scored = self._search(self.queries, changed)
        together = hits.join(changed.select("id"), "id", "left_anti").unionByName(scored)
        tie = tie_key(F.col("score"))
        above = together.join(floors.select("qid", "k", "floor", "floor_id"), "qid").filter((tie > F.col("floor")) | (tie == F.col("floor")) & (F.col("id") <= F.col("floor_id")))
        kept = self._ranked(above).filter(F.col("n") <= F.col("k") + self.spare).select("qid", "id", "score")
        kept = self._staged(kept, version, "kept")
        counts = kept.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
        short = floors.filter(F.col("floor") > F.lit(_NONE)).join(counts, "qid", "left").filter(F.coalesce("n", F.lit(0)) < F.col("k")).select("qid")
        again = self.queries.join(short, "qid", "left_semi")
        if not again.isEmpty():
            fresh = self._search(again, catalog())
            kept = self._staged(kept.join(again.select("qid"), "qid", "left_anti").unionByName(fresh), version, "again")
            known = again.select("qid", F.lit(True).alias("_again"))
            floors = floors.join(known, "qid", "left").select("qid", "k", F.when(F.col("_again"), F.lit(_NONE)).otherwise(F.col("floor")).alias("floor"), "floor_id", F.coalesce("_again", F.lit(False)).alias("rescanned"))
        self._write(version, kept, self._floors(self._ranked(kept), floors))

    def _staged(self, hits: DataFrame, version: int, name: str) -> DataFrame:
        """``hits`` written beside the state: read several times, computed once."""
        path = f"{self.root}/staged/{version}/{name}"
        hits.write.mode("overwrite").parquet(path)
        release_broadcasts()
        return self.spark.read.schema(_HITS).parquet(path)

    def answers(self, version: int | None = None) -> DataFrame:
        """(qid, rank, id, score_rate) as ``search`` would give on that catalog version (default: the latest)."""
        version = self.versions()[-1] if version is None else version
        ranked = self._ranked(self._read(version, "hits", _HITS)).join(self.queries.select("qid", "k"), "qid").filter(F.col("n") <= F.col("k"))
        return ranked.select("qid", F.col("n").alias("rank"), "id", round_score(F.col("score"), self.params.score_decimal_places).alias("score_rate"))

    def rescans(self) -> dict[int, int]:
        """Queries searched over the whole catalog, per version."""
        return {v: self._read(v, "floors", _FLOORS).filter("rescanned").count() for v in self.versions()}


def run_standing_stream(stream: DataFrame, store: CatalogStore, embedder, standing: StandingQueries, checkpoint: str, dim: int | None = None):
    """Upsert a feed (ST-1) and refresh the standing queries after every micro-batch, from the batch's ids only."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(batch, batch_id, store, embedder, dim=dim, stream=stream_identity(store, checkpoint))
        now = store.latest()
        if now is None:
            return
        valid, _ = C.validate_upserts(batch, vector_col=None)
        # the ids and the changed rows are read by several jobs, the feed and the catalog once
        ids = kept(valid.select("id").distinct())
        changed = kept(store.read(now, buckets=store.touched_buckets(ids)).join(ids, "id", "left_semi").select("id", "vector"))
        try:
            standing.refresh(now["version"], changed, lambda: store.read(now))
        finally:
            changed.unpersist()
            ids.unpersist()

    q = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
