"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

State, below one folder, in numbered versions:

* ``counts``: digest of a line's key (128 bits) -> number of documents that hold it;
* ``filters``: per shard of the digests, layers of a cuckoo filter with the digests found in
  at least ``threshold`` documents, and beside each layer the digests it holds, which only
  ``insert`` and ``delete`` read;
* ``state``: version, threshold and number of shards, written last. A version without it was never finished, and
  a handle opened on the folder goes on from the last one that has it.

``insert`` adds a batch's documents to the counts and puts digests that reach the threshold
into their shard's filter; ``delete`` subtracts documents and takes digests that fall below it
out again, which cuckoo filters allow and Bloom filters don't. ``apply`` drops lines: filters
pick candidates while the documents are scanned, the counts confirm them exactly, so a false
positive never drops a line.

Counting aggregates inside each task before the shuffle, so a line that a third of the
documents hold is one row per batch. Filters are built shard by shard, and sent to the tasks in
bundles of at most ``BUNDLE`` bytes, one pass over the candidates' documents per bundle. Only
(text hash, digest) pairs are shuffled for the confirmation, then each text meets its confirmed
digests in one join by text hash. Equal texts share these; two texts with the same 64-bit hash
would share a superset, which changes nothing, since a confirmed digest is dropped everywhere.

Defined results: null and empty texts are one empty line; empty keys are never counted or
dropped; a row is a document (repeated rows count each); an empty table stays empty; extra
columns pass through, but for those with a result's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, shared_dir, tmp_names, without

THRESHOLD = 10
#: Bytes of filters that are broadcast at once.
BUNDLE = 32 << 20
#: Digests a shard is planned for.
PER_SHARD = 1 << 15
_STATE = "version long, threshold long, shards long"
_SLOTS = 4
_KICKS = 500


def line_keys(line: bytes) -> bytes:
    """Stripped of ASCII white space at both ends, A-Z lower-cased."""
    return line.strip().lower()


def key_digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _digests(text: str | None) -> set[bytes]:
    keys = {line_keys(x) for x in (text or "").encode().split(b"\n")}
    keys.discard(b"")
    return {key_digest(k) for k in keys}


class Cuckoo:
    """One layer of a cuckoo filter: ``table`` is (buckets, 4) of 16-bit marks, 0 is free.

    A digest's mark and first bucket come from its own bytes; the other bucket is the first
    one xor a hash of the mark, so a mark can be moved, and removed, without its digest."""

    def __init__(self, buckets: int, table: bytes | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, _SLOTS), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(buckets, _SLOTS).copy()

    @staticmethod
    def marks(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marks and bucket hashes of (n, 2) unsigned 64-bit digests."""
        return (digests[:, 1] >> np.uint64(48)).astype(np.uint64) % np.uint64(65535) + np.uint64(1), digests[:, 1] & np.uint64(0xFFFFFFFFFF)

    @staticmethod
    def other(bucket, mark, buckets):
        return (bucket ^ ((mark * np.uint64(0x5BD1E995)) & np.uint64(buckets - 1))) & np.uint64(buckets - 1)

    def add(self, mark: int, bucket: int, rng: np.random.Generator) -> bool:
        """False if no place was found; the table then is as before."""
        b, undo = bucket & (self.buckets - 1), []
        alt = int(self.other(np.uint64(b), np.uint64(mark), self.buckets))
        for x in (b, alt):
            free = np.flatnonzero(self.table[x] == 0)
            if len(free):
                self.table[x, free[0]] = mark
                return True
        for _ in range(_KICKS):
            slot = int(rng.integers(_SLOTS))
            undo.append((alt, slot, int(self.table[alt, slot])))
            mark, self.table[alt, slot] = int(self.table[alt, slot]), mark
            alt = int(self.other(np.uint64(alt), np.uint64(mark), self.buckets))
            free = np.flatnonzero(self.table[alt] == 0)
            if len(free):
                self.table[alt, free[0]] = mark
                return True
        for x, slot, old in reversed(undo):
            self.table[x, slot] = old
        return False

    def remove(self, mark: int, bucket: int) -> bool:
        b = bucket & (self.buckets - 1)
        for x in (b, int(self.other(np.uint64(b), np.uint64(mark), self.buckets))):
            at = np.flatnonzero(self.table[x] == mark)
            if len(at):
                self.table[x, at[0]] = 0
                return True
        return False


def _as_words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2) if digests else np.zeros((0, 2), np.uint64)


def update_layers(layers: list[tuple[int, bytes]], added: list[bytes], removed: list[bytes], members: list[set[bytes]] | None = None) -> list[tuple[int, bytes]]:
    """A shard's filter after removals and additions; a full layer is followed by one twice its size.

    ``members`` are the digests of each layer, kept up to date in place. A mark in an earlier layer may
    be another digest's, so a digest is removed from the layer that holds it; without ``members`` that
    is taken to be the first layer that shows its mark."""
    own = [Cuckoo(n, t) for n, t in layers]
    rng = np.random.default_rng(1)
    marks, hashes = Cuckoo.marks(_as_words(removed))
    for d, m, b in zip(removed, marks.tolist(), hashes.tolist()):
        if members is None:
            any(layer.remove(m, b) for layer in own)
        else:
            at = next(i for i, held in enumerate(members) if d in held)
            own[at].remove(m, b)
            members[at].discard(d)
    marks, hashes = Cuckoo.marks(_as_words(added))
    if len(added) and not own:
        own.append(Cuckoo(1 << max(4, int(np.ceil(np.log2(len(added) / _SLOTS / 0.8 + 1))))))
    if members is not None:
        members += [set() for _ in range(len(own) - len(members))]
    for d, m, b in zip(added, marks.tolist(), hashes.tolist()):
        at = next((i for i, layer in enumerate(own) if layer.add(m, b, rng)), len(own))
        if at == len(own):
            own.append(Cuckoo(own[-1].buckets * 2))
            own[-1].add(m, b, rng)
            if members is not None:
                members.append(set())
        if members is not None:
            members[at].add(d)
    return [(x.buckets, x.table.tobytes()) for x in own]


class Bundle:
    """Layers of several shards laid end to end, probed for many digests at once."""

    def __init__(self, rows: list[tuple[int, int, bytes]], shards: int):
        self.shards, self.levels = shards, []
        by_shard: dict[int, list[tuple[int, bytes]]] = {}
        for shard, buckets, table in rows:
            by_shard.setdefault(shard, []).append((buckets, table))
        for level in range(max((len(x) for x in by_shard.values()), default=0)):
            start, size, tables, at = np.zeros(shards, np.int64), np.zeros(shards, np.int64), [], 0
            for shard, layers in by_shard.items():
                if level < len(layers):
                    start[shard], size[shard] = at, layers[level][0]
                    at += layers[level][0]
                    tables.append(np.frombuffer(layers[level][1], np.uint16).reshape(-1, _SLOTS))
            self.levels.append((start, size, np.concatenate(tables)))

    def maybe(self, digests: list[bytes]) -> np.ndarray:
        words = _as_words(digests)
        found = np.zeros(len(words), bool)
        if not len(words):
            return found
        marks, hashes = Cuckoo.marks(words)
        shard = (words[:, 0] % np.uint64(self.shards)).astype(np.int64)
        for start, size, table in self.levels:
            here = np.flatnonzero(size[shard] > 0)
            n = size[shard[here]].astype(np.uint64)
            first = hashes[here] & (n - np.uint64(1))
            second = (first ^ (marks[here] * np.uint64(0x5BD1E995) & (n - np.uint64(1)))) & (n - np.uint64(1))
            want = marks[here].astype(np.uint16)[:, None]
            for bucket in (first, second):
                found[here] |= (table[start[shard[here]] + bucket.astype(np.int64)] == want).any(axis=1)
        return found


def count_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, n): in how many rows each line key occurs, summed per batch before any shuffle."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            counts: dict[bytes, int] = {}
            for t in batch.column(0):
                for d in _digests(t.as_py()):
                    counts[d] = counts.get(d, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "n"])

    return docs.select(text).mapInArrow(compute, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))


class LineDedup:
    """Line dedup state in a folder of its own; each insert or delete makes a new version. Shards are doubled, and
    the filters built anew from the counts, when they hold more than ``per_shard`` digests on average."""

    def __init__(self, spark: SparkSession, threshold: int | None = None, path: str | None = None, shards: int | None = None, per_shard: int = PER_SHARD):
        """``path``: a new folder, or one with state, which keeps its threshold and shards."""
        self.spark, self.threshold, self.shards, self.per_shard = spark, threshold or THRESHOLD, shards or 16, per_shard
        self.path, self.version = path or shared_dir(spark, "llm", "line-dedup"), 0
        if path and (versions := self._versions()):
            kept = spark.read.schema(_STATE).json(self._at("state", versions[-1])).first()
            if threshold is not None and threshold != kept.threshold:
                raise ValueError(f"{path} counts lines to a threshold of {kept.threshold}, opened with {threshold}")
            self.version, self.threshold, self.shards = kept.version, kept.threshold, kept.shards

    def _versions(self) -> list[int]:
        """The versions that were finished."""
        context = self.spark.sparkContext
        hadoop = context._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(self.path).getFileSystem(context._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(hadoop(self.path))] if fs.exists(hadoop(self.path)) else []
        return sorted(int(n[1:]) for n in names if n[1:].isdigit() and fs.exists(hadoop(self._at("state/_SUCCESS", int(n[1:])))))

    def _at(self, name: str, version: int | None = None) -> str:
        return f"{self.path}/v{self.version if version is None else version}/{name}"

    @property
    def counts(self) -> DataFrame:
        return self.spark.read.schema("digest binary, n long").parquet(self._at("counts"))

    @property
    def filters(self) -> DataFrame:
        return self.spark.read.schema("shard int, layer int, buckets int, marks binary").parquet(self._at("filters"))

    def insert(self, docs: DataFrame, text: str = "text") -> LineDedup:
        return self._change(count_lines(docs, text))

    def delete(self, docs: DataFrame, text: str = "text") -> LineDedup:
        """Take documents out again; they must be as they were inserted."""
        return self._change(count_lines(docs, text).select("digest", (-F.col("n")).alias("n")))

    def _change(self, delta: DataFrame) -> LineDedup:
        limit, new = self.threshold, self.version + 1
        if self.version:
            old = self.counts.select("digest", F.col("n").alias("had"))
            both = old.join(delta, "digest", "full").select("digest", F.coalesce("had", F.lit(0)).cast("long").alias("had"), F.coalesce("n", F.lit(0)).alias("d"))
        else:
            both = delta.select("digest", F.lit(0).cast("long").alias("had"), F.col("n").alias("d"))
        # overwrite: an attempt at this version that was never finished leaves its files
        both.select("digest", (F.col("had") + F.col("d")).alias("n"), "had").write.mode("overwrite").parquet(self._at("changed", new))
        changed = self.spark.read.schema("digest binary, n long, had long").parquet(self._at("changed", new))
        changed.filter("n > 0").select("digest", "n").write.mode("overwrite").parquet(self._at("counts", new))
        crossed = changed.filter((F.col("n") >= limit) != (F.col("had") >= limit)).select("digest", (F.col("n") >= limit).alias("up"))
        hot, shards = changed.filter(F.col("n") >= limit), self.shards
        held = hot.count()
        while held > self.per_shard * shards:
            shards *= 2
        grown = shards != self.shards
        if grown:
            crossed = hot.select("digest", F.lit(True).alias("up"))

        def shard_of(digest: pd.Series) -> pd.Series:
            return pd.Series((_as_words(list(digest))[:, 0] % np.uint64(shards)).astype(np.int32))

        def rebuild(key, filters: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
            filters = filters.sort_values("layer")
            layers = [(int(n), bytes(m)) for n, m in filters[["buckets", "marks"]].itertuples(index=False)]
            members = [{bytes(x[i : i + 16]) for i in range(0, len(x), 16)} for x in filters.digests]
            moves = moves.sort_values("digest")
            up = moves.up.to_numpy(bool)
            out = update_layers(layers, [bytes(x) for x in moves.digest[up]], [bytes(x) for x in moves.digest[~up]], members)
            return pd.DataFrame({"shard": [key[0]] * len(out), "layer": range(len(out)), "buckets": [n for n, _ in out], "marks": [m for _, m in out], "digests": [b"".join(sorted(x)) for x in members]})

        shard = F.pandas_udf(shard_of, "int")
        moves = crossed.withColumn("shard", shard("digest"))
        schema = "shard int, layer int, buckets int, marks binary, digests binary"
        had = self.spark.read.schema(schema).parquet(self._at("filters")) if self.version and not grown else self.spark.createDataFrame([], schema)
        made = had.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(rebuild, schema)
        made.write.mode("overwrite").parquet(self._at("filters", new))
        self.version, self.shards = new, shards
        state = self.spark.range(1).select(*[F.lit(x).cast("long").alias(n) for n, x in (("version", new), ("threshold", limit), ("shards", shards))])
        state.write.mode("overwrite").json(self._at("state", new))
        return self

    def _bundles(self) -> Iterator[Bundle]:
        """The filters, at most BUNDLE bytes at a time."""
        sizes = self.filters.select("shard", F.octet_length("marks").alias("b")).groupBy("shard").agg(F.sum("b").alias("b")).orderBy("shard")
        start, size, spans = 0, 0, []
        for shard, b in sizes.toLocalIterator():
            if size and size + b > BUNDLE:
                spans.append((start, shard))
                start, size = shard, 0
            size += b
        if size:
            spans.append((start, self.shards))
        for a, b in spans:
            rows = self.filters.filter((F.col("shard") >= a) & (F.col("shard") < b)).orderBy("shard", "layer").select("shard", "buckets", "marks").collect()
            yield Bundle([(s, n, bytes(m)) for s, n, m in rows], self.shards)

    def _confirmed(self, docs: DataFrame, text: str) -> DataFrame:
        """(hash of a text, digests of its lines that are over the threshold)."""
        path = shared_dir(self.spark, "llm", "line-candidates")
        schema = "t long, digest binary"
        source = docs.select(F.xxhash64(text).alias("t"), F.col(text).alias("text"))
        self.spark.createDataFrame([], schema).write.parquet(path)
        for bundle in self._bundles():
            sent = self.spark.sparkContext.broadcast(bundle)

            def probe(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                let_go()
                for batch in batches:
                    seen, keys, owner = set(), [], []
                    for t, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                        if t not in seen:
                            seen.add(t)
                            own = list(_digests(x.as_py()))
                            keys += own
                            owner += [t] * len(own)
                    hit = np.flatnonzero(sent.value.maybe(keys))
                    yield pa.RecordBatch.from_arrays([pa.array([owner[i] for i in hit], pa.int64()), pa.array([keys[i] for i in hit], pa.binary())], names=["t", "digest"])

            source.mapInArrow(probe, schema).write.mode("append").parquet(path)
            sent.unpersist()
        pairs = self.spark.read.schema(schema).parquet(path)
        hot = self.counts.filter(F.col("n") >= self.threshold).select("digest")
        return pairs.join(hot, "digest").groupBy("t").agg(F.collect_set("digest").alias("digests"))

    def apply(self, docs: DataFrame, text: str = "text", lines: str = "n_lines", dropped: str = "n_dropped") -> DataFrame:
        """``docs`` with the text cut down to its other lines, their number before and the number dropped."""
        docs = without(docs, lines, dropped)
        t, digests = tmp_names([*docs.columns, lines, dropped], "t", "digests")
        hits = self._confirmed(docs, text).select(F.col("t").alias(t), F.col("digests").alias(digests))
        joined = docs.withColumn(t, F.xxhash64(text)).join(hits, t, "left").drop(t)
        keep = [c for c in docs.columns if c != text]
        schema = docs.select(*keep, text).withColumns({lines: F.lit(0).cast("long"), dropped: F.lit(0).cast("long")}).schema

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            let_go()
            for batch in batches:
                texts, n_lines, n_dropped = [], [], []
                for x, d in zip(batch.column(len(keep)), batch.column(len(keep) + 1)):
                    x, hot = x.as_py(), d.as_py()
                    if not hot:
                        n_lines.append((x or "").count("\n") + 1)
                        n_dropped.append(0)
                        texts.append(x)
                        continue
                    hot = set(hot)
                    rows = x.encode().split(b"\n")
                    stay = [r for r in rows if not (k := line_keys(r)) or key_digest(k) not in hot]
                    n_lines.append(len(rows))
                    n_dropped.append(len(rows) - len(stay))
                    texts.append(b"\n".join(stay).decode())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*keep, text, lines, dropped])

        return joined.select(*keep, text, digests).mapInArrow(cut, schema)
