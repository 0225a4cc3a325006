"""Versioned catalog snapshots (S-2 read, K-1 write, K-3 rejects) on plain Parquet.

Layout under ``root``::

    data/v000003-1f2e.../bucket=17/part-*.parquet   rows of bucket 17 written by version 3
    _commits/000003.json                            {"version", "buckets", "level", "split", "dim", "streams", "rows", "manifest"}

The manifest has, per bucket, the folder of its base, the folders of its deltas in commit order, its
rows and the rows of its deltas. A commit is one small file that a reader opens first, so a version is
seen whole or not at all, and older versions stay readable until ``vacuum`` removes them.

* **Writes.** Every attempt writes to its own data directory, so a job that died halfway leaves only
  unreferenced files. The rows written are read back as counts per bucket and vector dimensions before
  the commit: a table of mixed or missing dimensions, or of another one than the store's, is refused
  with the ids, and its files go (V-9). The commit file appears under a name that must not exist yet.
* **Merges.** Without ``delta_share`` a merge rewrites the buckets its feed touches. With it, a merge appends
  one delta per touched bucket, of one row per id of the feed; each row knows its version and
  whether the id was new. Reads fold the deltas per id and lay them over the base: the base is scanned in
  place and joined with the (small) fold, new ids are added from the fold alone. A bucket whose deltas have
  more than ``delta_share`` of its rows, or more than ``max_deltas`` folders, is compacted by a commit of its own.
* **Buckets that grow.** Buckets follow linear hashing: with ``n`` buckets at a level, of which ``split`` are
  split already, an id lies in ``pmod(xxhash64(id), n)``, or in ``pmod(xxhash64(id), 2 n)`` where that is below
  ``split``. With ``rows_per_bucket`` a merge is followed by commits that split the next buckets in turn; a
  split reads and writes those buckets only.

Rows are sorted by id inside a bucket, and an id lookup reads one bucket. ``streams`` holds, per
stream feeding the store, its last merged batch and that batch's counts; every commit carries it on, so
streams don't shadow one another and an un-numbered merge forgets no batch. The commit also records the
version's row count, so the catalog size needs no scan.

Object stores without an atomic rename need a conditional put for the commit file.
"""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simcat.operators.catalog import CATALOG_COLUMNS, check_dimension, empty_table, merge_upserts
from simcat.operators.partitioning import kept

BOOKKEEPING = ["first_seq", "last_seq"]
DEFAULT_BUCKETS = 16
MAX_DELTAS = 16
_SUBSET_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
_SCHEMA = ("id bigint, text string, vector array<float>, dim int, count bigint, "
           "created_at bigint, updated_at bigint, first_seq bigint, last_seq bigint")
_DELTA_SCHEMA = f"{_SCHEMA}, fresh boolean, version bigint"
_EARLIEST = -(1 << 63)
# The setting is the session's: one merge at a time changes it.
_SETTING = threading.Lock()


@dataclass(frozen=True)
class Layout:
    """Linear hashing: ``base * 2^level`` buckets, the first ``split`` of them split once more."""

    base: int
    level: int = 0
    split: int = 0

    @property
    def whole(self) -> int:
        return self.base << self.level

    @property
    def buckets(self) -> int:
        return self.whole + self.split

    def of(self, id_col: Column) -> Column:
        h = F.xxhash64(id_col)
        bucket = F.pmod(h, F.lit(self.whole))
        if self.split:
            bucket = F.when(bucket < self.split, F.pmod(h, F.lit(2 * self.whole))).otherwise(bucket)
        return bucket.cast("int")

    def after(self, n: int) -> "Layout":
        """The layout once ``n`` more buckets are split, within this level."""
        if self.split + n == self.whole:
            return Layout(self.base, self.level + 1, 0)
        return Layout(self.base, self.level, self.split + n)

    def grown(self, buckets: int) -> "Layout":
        """The layout of ``buckets`` in all, levels away if need be."""
        level = self.level
        while self.base << (level + 1) <= buckets:
            level += 1
        return Layout(self.base, level, buckets - (self.base << level))

    def _modulus(self, bucket: int) -> int:
        """What the hashes in a bucket agree by."""
        return 2 * self.whole if bucket < self.split or bucket >= self.whole else self.whole

    def changed(self, new: "Layout") -> set[int]:
        """The buckets whose rows lie in others too by the later layout ``new``."""
        return {b for b in range(self.buckets) if self._modulus(b) != new._modulus(b)}


def fold_deltas(rows: DataFrame) -> DataFrame:
    """One row per id of delta rows, as a feed for ``merge_upserts``, with ``fresh``: whether the id was new.

    The later event wins, of equal ones the earlier version; counts add up."""
    newest = F.struct(F.coalesce("last_seq", F.lit(_EARLIEST)), -F.col("version"))
    payload = F.max_by(F.struct("text", "vector", "updated_at"), newest)
    folded = rows.groupBy("id").agg(
        F.sum("count").alias("n"), payload.alias("_p"), F.min_by("created_at", F.struct("first_seq", "version")).alias("t0"),
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.max("fresh").alias("fresh"))
    return folded.select("id", "n", "_p.text", "_p.vector", "t0", F.col("_p.updated_at").alias("t1"), "first_seq", "last_seq", "fresh")


def _as_catalog(folded: DataFrame, *more: Column) -> DataFrame:
    """Rows of a folded feed as rows of the catalog."""
    return folded.select("id", "text", "vector", F.size("vector").cast("int").alias("dim"), F.col("n").alias("count"),
                         F.col("t0").alias("created_at"), F.col("t1").alias("updated_at"), *BOOKKEEPING, *more)


class CatalogStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, delta_share: float | None = None,
                 rows_per_bucket: int | None = None, max_deltas: int = MAX_DELTAS):
        """``buckets``: number for a new store (default 16); an existing store keeps its own. The others are this
        writer's policy: ``delta_share`` (merges append deltas up to this share of a bucket; None: they rewrite
        the buckets), ``rows_per_bucket`` (buckets are split beyond it; None: their number stays)."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.delta_share, self.rows_per_bucket, self.max_deltas = delta_share, rows_per_bucket, max_deltas
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._Path(self.root).getFileSystem(self._conf)
        self.layout = Layout(buckets or DEFAULT_BUCKETS)
        prev = self.latest()
        if prev is not None and buckets is not None and buckets != prev["buckets"]:
            raise ValueError(f"{self.root} has {prev['buckets']} buckets, opened with {buckets}")

    @property
    def buckets(self) -> int:
        """Buckets at present."""
        return self.layout.buckets

    # ------------------------------------------------------------ commits

    def read_text(self, path: str) -> str:
        """The first line of a small file."""
        where = self._Path(path)
        stream = where.getFileSystem(self._conf).open(where)
        try:
            jvm = self.spark.sparkContext._jvm
            return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
        finally:
            stream.close()

    def _names(self, folder: str) -> list[str]:
        path = self._Path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        """Versions that can be read."""
        return sorted(int(n[:-5]) for n in self._names("_commits") if n.endswith(".json") and not n.startswith("."))

    def commit_of(self, version: int) -> dict:
        return json.loads(self.read_text(f"{self.root}/_commits/{version:06d}.json"))

    def latest(self) -> dict | None:
        versions = self.versions()
        if not versions:
            return None
        commit = self.commit_of(versions[-1])
        self.layout = self.layout_of(commit)  # another writer may have made or split buckets
        return commit

    @staticmethod
    def layout_of(commit: dict) -> Layout:
        """The buckets of a version."""
        return Layout(commit["buckets"], commit["level"], commit["split"])

    def last_batch(self, stream: str, commit: dict | None = None) -> dict | None:
        """``{"batch_id", ...counts}`` of the last batch of ``stream`` merged into the store."""
        commit = commit if commit is not None else self.latest()
        return (commit or {}).get("streams", {}).get(stream)

    def _commit(self, prev: dict | None, manifest: dict, layout: Layout | None = None, streams: dict | None = None, dim: int | None = None) -> int:
        """Make the next version visible; raises if another writer made it first."""
        version = prev["version"] + 1 if prev else 1
        layout = layout or self.layout
        rows = sum(e["rows"] for e in manifest.values())
        streams = dict((prev or {}).get("streams", {}) if streams is None else streams)
        for done in streams.values():
            done.setdefault("catalog_count", rows)  # the batch merged just now gets the catalog's size after it
        body = json.dumps({"version": version, "buckets": layout.base, "level": layout.level, "split": layout.split, "streams": streams,
                           "rows": rows, "dim": dim if dim is not None else (prev or {}).get("dim"), "manifest": {str(k): v for k, v in sorted(manifest.items())}})
        self._fs.mkdirs(self._Path(f"{self.root}/_commits"))
        tmp = self._Path(f"{self.root}/_commits/.tmp-{uuid.uuid4().hex}")
        final = self._Path(f"{self.root}/_commits/{version:06d}.json")
        out = self._fs.create(tmp, False)
        out.write(bytearray(body.encode("utf-8")))
        out.close()
        if not self._publish(tmp, final):
            raise RuntimeError(f"version {version} was committed concurrently")
        self.layout = layout
        return version

    def _publish(self, tmp, final) -> bool:
        """Give a whole file its final name; False if that name is taken. A local file system renames over
        existing files, so there a hard link claims the name."""
        jvm = self.spark.sparkContext._jvm
        try:
            if self._fs.getScheme() == "file":
                link, target = (jvm.java.io.File(p.toUri().getPath()).toPath() for p in (final, tmp))
                jvm.java.nio.file.Files.createLink(link, target)
                return True
            return not self._fs.exists(final) and self._fs.rename(tmp, final)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        finally:
            self._fs.delete(tmp, False)

    # ------------------------------------------------------------ read (S-2)

    @staticmethod
    def _manifest(commit: dict | None) -> dict[int, dict]:
        return {int(b): e for b, e in (commit or {}).get("manifest", {}).items()}

    def _scan(self, schema: str, folders: list[tuple[int, str]]) -> DataFrame | None:
        if not folders:
            return None
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{d}/bucket={b}" for b, d in sorted(folders)])

    def read(self, commit: dict | None = None, buckets: set | None = None, bookkeeping: bool = False) -> DataFrame:
        """The catalog as of ``commit`` (default: latest); empty when nothing is committed."""
        commit = commit if commit is not None else self.latest()
        mine = {b: e for b, e in self._manifest(commit).items() if buckets is None or b in buckets}
        columns = CATALOG_COLUMNS + (BOOKKEEPING if bookkeeping else [])
        parts = []
        clean = self._scan(_SCHEMA, [(b, e["base"]) for b, e in mine.items() if e["base"] and not e["deltas"]])
        if clean is not None:
            parts.append(clean.select(*columns))
        deltas = self._scan(_DELTA_SCHEMA, [(b, d) for b, e in mine.items() for d in e["deltas"]])
        if deltas is not None:
            folded = fold_deltas(deltas)
            base = self._scan(_SCHEMA, [(b, e["base"]) for b, e in mine.items() if e["base"] and e["deltas"]])
            if base is not None:
                # the base stays where it is as long as the fold is small enough to be broadcast
                parts.append(merge_upserts(base, folded.filter(~F.col("fresh")), how="left").select(*columns))
            parts.append(_as_catalog(folded.filter("fresh")).select(*columns))
        if not parts:
            return empty_table(self.spark, _SCHEMA).select(*columns)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def count(self, commit: dict | None = None) -> int:
        """Rows in the catalog as of ``commit`` (default: latest), from the commit record."""
        commit = commit if commit is not None else self.latest()
        return int(commit["rows"]) if commit else 0

    def buckets_of(self, ids: list[int], commit: dict | None = None) -> set[int]:
        layout = self.layout_of(commit) if commit else self.layout
        return {r[0] for r in self.spark.createDataFrame([(int(i),) for i in ids], "id bigint").select(layout.of(F.col("id"))).collect()}

    def lookup(self, ids: list[int], commit: dict | None = None) -> DataFrame:
        """Rows for a few ids, reading only their buckets (S-3 point form)."""
        commit = commit if commit is not None else self.latest()
        return self.read(commit, buckets=self.buckets_of(ids, commit)).filter(F.col("id").isin([int(i) for i in ids]))

    def texts_of(self, hits: DataFrame, commit: dict | None = None) -> DataFrame:
        """``hits`` (with an ``id``) joined with the catalog's text, read from the buckets of these ids only (J-3). ``hits``
        is read twice: pass a written table."""
        commit = commit if commit is not None else self.latest()
        layout = self.layout_of(commit) if commit else self.layout
        buckets = {r[0] for r in hits.select(layout.of(F.col("id")).alias("b")).distinct().collect()}
        return hits.join(self.read(commit, buckets=buckets).select("id", "text"), "id")

    # ------------------------------------------------------------ write (K-1)

    def _write_buckets(self, df: DataFrame, data_dir: str, layout: Layout | None = None) -> None:
        """Write ``df`` by bucket, sorted by id."""
        staged = df
        if "bucket" not in df.columns:  # else its rows already lie by bucket
            staged = df.withColumn("bucket", (layout or self.layout).of(F.col("id"))).repartition("bucket")
        staged.sortWithinPartitions("bucket", "id").write.mode("errorifexists").partitionBy("bucket").parquet(f"{self.root}/data/{data_dir}")

    def _checked(self, data_dir: str, prev: dict | None, schema: str = _SCHEMA) -> tuple[dict[int, tuple[int, int]], int | None]:
        """({bucket: (rows, new ids)}, dimension) of a folder just written; raises, and removes the folder, when a
        vector is missing or has another dimension than the others or the store's."""
        if not any(n.startswith("bucket=") for n in self._names(f"data/{data_dir}")):
            return {}, None
        written = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.root}/data/{data_dir}")
        fresh = F.count_if("fresh") if "fresh" in written.columns else F.lit(0)
        per = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), fresh.cast("long").alias("fresh"), F.min("dim").alias("low"), F.max("dim").alias("high"),
                                            F.count("dim").alias("dims"), F.min_by("dim", "id").alias("first")).collect()
        dim = (prev or {}).get("dim") or next(r["first"] for r in sorted(per, key=lambda r: r["bucket"]))
        if any(r["low"] != dim or r["high"] != dim or r["dims"] != r["n"] for r in per):
            try:
                check_dimension(written, dim or 0)
            finally:
                self._fs.delete(self._Path(f"{self.root}/data/{data_dir}"), True)
        return {r["bucket"]: (r["n"], r["fresh"]) for r in per}, dim

    def _folder(self, prev: dict | None) -> str:
        return f"v{prev['version'] + 1 if prev else 1:06d}-{uuid.uuid4().hex}"

    @staticmethod
    def _base_entry(data_dir: str, rows: int) -> dict:
        return {"base": data_dir, "deltas": [], "rows": rows, "base_rows": rows, "delta_rows": 0}

    def write(self, catalog: DataFrame) -> int:
        """Replace the whole catalog with ``catalog`` as a new version."""
        prev = self.latest()
        missing = {c: F.lit(None).cast("bigint") for c in BOOKKEEPING if c not in catalog.columns}
        data_dir = self._folder(prev)
        self._write_buckets(catalog.withColumns(missing).select(*CATALOG_COLUMNS, *BOOKKEEPING), data_dir)
        rows, dim = self._checked(data_dir, None)
        return self._commit(prev, {b: self._base_entry(data_dir, n) for b, (n, _) in rows.items()}, dim=dim)

    def touched_buckets(self, df: DataFrame) -> set[int]:
        """Buckets holding the ids of ``df``; at most ``buckets`` values, so fine to
        bring to the driver."""
        return {r[0] for r in df.select(self.layout.of(F.col("id")).alias("b")).distinct().collect()}

    def known_ids(self, commit: dict | None, buckets: set[int]) -> DataFrame:
        """Catalog ids of ``commit`` in ``buckets`` only: an existence test for a feed
        reads the buckets its ids hash to, not the whole catalog. Every id is in a base or
        new in one delta, so nothing is folded."""
        mine = {b: e for b, e in self._manifest(commit).items() if b in buckets}
        base = self._scan(_SCHEMA, [(b, e["base"]) for b, e in mine.items()])
        if base is None:
            return empty_table(self.spark, "id bigint")
        new = self._scan(_DELTA_SCHEMA, [(b, d) for b, e in mine.items() for d in e["deltas"]])
        return base.select("id") if new is None else base.select("id").unionByName(new.filter("fresh").select("id"))

    def merge(self, folded: DataFrame, batch_id: int | None = None, touched: set[int] | None = None,
              stream: str = "default", counts: dict | None = None) -> int | None:
        """J-2 into a new version: touched buckets are rewritten, or get a delta each.

        ``touched`` (optional) is ``touched_buckets`` of the feed, when the caller
        has it already. A feed batch is known by (``stream``, ``batch_id``): returns
        the new version, or None when that stream's batch was already committed (a
        replayed micro-batch: ``count + n`` must not be applied twice). ``counts``
        of the batch are kept in the commit record. A merge without a batch id is
        always applied. Compactions and splits that are due follow as commits of their own."""
        prev = self.latest()
        done = self.last_batch(stream, prev)
        if batch_id is not None and done is not None and done["batch_id"] >= int(batch_id):
            return None
        streams = dict((prev or {}).get("streams", {}))
        if batch_id is not None:
            streams[stream] = {"batch_id": int(batch_id), **(counts or {})}
        step = self._rewrite if self.delta_share is None else self._append
        if touched is not None and self.delta_share is None:
            version = step(prev, folded, streams, touched)
        else:
            # The fold (one row per feed id) feeds several jobs, the touched-bucket list, the test for
            # known ids and the write: keep it so the feed is scanned, embedded and folded once.
            folded = kept(folded)
            try:
                version = step(prev, folded, streams, self.touched_buckets(folded) if touched is None else touched)
            finally:
                folded.unpersist()
        if self.delta_share is not None:
            self.compact_due()
        if self.rows_per_bucket is not None:
            self.grow()
        return version

    def _rewrite(self, prev: dict | None, folded: DataFrame, streams: dict, touched: set) -> int:
        manifest = self._manifest(prev)
        current = self.read(prev, buckets={b for b in touched if b in manifest}, bookkeeping=True)
        # Both sides are dealt by bucket once: the join on (bucket, id) and the write by
        # bucket then need no further exchange. Spark must be told that a partitioning
        # by part of the join keys will do.
        by_bucket = self.layout.of(F.col("id"))
        merged = merge_upserts(*[x.withColumn("bucket", by_bucket).repartition("bucket") for x in (current, folded)])
        data_dir = self._folder(prev)
        conf = self.spark.conf
        with _SETTING:
            was = conf.get(_SUBSET_KEYS)
            conf.set(_SUBSET_KEYS, "false")
            try:
                self._write_buckets(merged, data_dir)
            finally:
                conf.set(_SUBSET_KEYS, was)
        rows, dim = self._checked(data_dir, prev)
        manifest.update({b: self._base_entry(data_dir, n) for b, (n, _) in rows.items()})
        return self._commit(prev, manifest, streams=streams, dim=dim)

    def _append(self, prev: dict | None, folded: DataFrame, streams: dict, touched: set) -> int:
        """One delta per touched bucket: a row per id of the feed, whatever the size of the catalog."""
        manifest = self._manifest(prev)
        # which ids are new: the ids of the touched buckets meet the feed's, not the other way round
        known = self.known_ids(prev, {b for b in touched if b in manifest}).join(folded.select("id"), "id", "left_semi")
        fresh = folded.join(known.withColumn("known", F.lit(True)), "id", "left")
        version = F.lit(prev["version"] + 1 if prev else 1).cast("long")
        delta = _as_catalog(fresh, F.col("known").isNull().alias("fresh"), version.alias("version"))
        data_dir = self._folder(prev)
        self._write_buckets(delta, data_dir)
        rows, dim = self._checked(data_dir, prev, _DELTA_SCHEMA)
        for b, (n, new) in rows.items():
            e = manifest.get(b)
            if e is None:  # the first rows of a bucket are its base
                manifest[b] = self._base_entry(data_dir, n)
                continue
            manifest[b] = {**e, "deltas": [*e["deltas"], data_dir], "rows": e["rows"] + new, "delta_rows": e["delta_rows"] + n}
        return self._commit(prev, manifest, streams=streams, dim=dim)

    # ------------------------------------------------------------ upkeep

    def compact(self, buckets: set[int] | None = None) -> int | None:
        """Fold the deltas of ``buckets`` (default: all) into their bases, as a version of its own."""
        prev = self.latest()
        manifest = self._manifest(prev)
        due = {b for b, e in manifest.items() if e["deltas"] and (buckets is None or b in buckets)}
        if not due:
            return None
        data_dir = self._folder(prev)
        self._write_buckets(self.read(prev, buckets=due, bookkeeping=True), data_dir)
        rows, _ = self._checked(data_dir, prev)
        manifest.update({b: self._base_entry(data_dir, n) for b, (n, _) in rows.items()})
        return self._commit(prev, manifest)

    def compact_due(self) -> int | None:
        """Compact the buckets whose deltas exceed this writer's share of their base, or its number."""
        due = {b for b, e in self._manifest(self.latest()).items()
               if e["delta_rows"] > (self.delta_share or 0) * e["base_rows"] or len(e["deltas"]) > self.max_deltas}
        return self.compact(due) if due else None

    def split(self, n: int = 1) -> int | None:
        """Split the next ``n`` buckets (up to the end of the level) in one commit; all others keep their files."""
        prev = self.latest()
        if prev is None:
            return None
        return self._relay(prev, self.layout.after(min(n, self.layout.whole - self.layout.split)))

    def _relay(self, prev: dict, new: Layout) -> int:
        """Rewrite the buckets that the layout ``new`` splits, in one commit."""
        due = self.layout.changed(new)
        manifest = self._manifest(prev)
        data_dir = self._folder(prev)
        if due & set(manifest):
            self._write_buckets(self.read(prev, buckets=due, bookkeeping=True), data_dir, new)
        rows, _ = self._checked(data_dir, prev)
        for b in due:
            manifest.pop(b, None)
        manifest.update({b: self._base_entry(data_dir, k) for b, (k, _) in rows.items()})
        return self._commit(prev, manifest, layout=new)

    def grow(self) -> None:
        """Split buckets until none holds more than ``rows_per_bucket`` on average, in one commit: every row
        is written once, however many times the buckets double."""
        prev = self.latest()
        wanted = -(-self.count(prev) // self.rows_per_bucket)
        if prev is not None and wanted > self.buckets:
            self._relay(prev, self.layout.grown(wanted))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove all versions but the last ``keep``, and the data folders that no kept version names: those of
        removed versions, and of attempts that were never committed. An attempt under way for the next version
        keeps its folder. Readers of a removed version fail; returns the folders removed."""
        versions = self.versions()
        kept = [self.commit_of(v) for v in versions[-keep:]]
        if not kept:
            return []
        for v in versions[:-keep]:
            self._fs.delete(self._Path(f"{self.root}/_commits/{v:06d}.json"), False)
        used = {d for c in kept for e in self._manifest(c).values() for d in [e["base"], *e["deltas"]]}
        gone = [n for n in self._names("data") if n not in used and int(n[1:7]) <= versions[-1]]
        for name in gone:
            self._fs.delete(self._Path(f"{self.root}/data/{name}"), True)
        return sorted(gone)


def write_rejects(rejects: DataFrame, path: str) -> None:
    """K-3: every rejected record with its reason, partitioned by reason."""
    (rejects.withColumn("reason_key", F.regexp_replace(F.col("reason"), "[^A-Za-z0-9]+", "_"))
     .write.mode("overwrite").partitionBy("reason_key").parquet(path))
