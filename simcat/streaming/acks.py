"""Stateful acks (ST-2) for hot ids, late events and repeated deliveries: two chained stateful steps.

1. ``count_ranges`` counts the events of every (id, range of ``SEQ_RANGE`` seqs). Its state is one bit per seq: whether it
   was seen. A first delivery is an event and gets its place among the pair's events of the micro-batch, any other delivery
   is a repeat; per pair one row says how many events there were. The pairs of ``BLOCK_SEQS`` neighbouring seqs are dealt over
   ``LANES`` groups by their hash, so an id with a third of the feed is spread over its ranges, a group is one call
   for some thousand events and not for each pair, and a block that is past is not read again. With ``expiry_ms`` a
   range's bits count as unset that long after they were last set, when the range is next met.
2. ``total_counts`` groups these count rows by id (one per range and micro-batch, not one per event), lays them one after
   another and keeps the id's count, created_at and last seq. It answers with the count before each range.

An event's running count is the count before its range plus its place. Events of one micro-batch count in the order of their
seqs, later micro-batches after earlier ones, so a late event counts when it arrives, as the service would count it.
A repeat changes nothing and is acked as ``repeated``. The steps are two streams with a Parquet sink between them, which
hands every row on exactly once; the acks are a join of their outputs on (id, range, arrival).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

SEQ_RANGE = 4096
# Seqs of a block, groups of a block.
BLOCK_SEQS, LANES = 1 << 18, 64
# State partitions per core, unless the session's shuffles have fewer: each costs a state store and a Python start per run.
_PARTITIONS_PER_CORE = 3
_PARTITIONS = "spark.sql.shuffle.partitions"
RANGE_SCHEMA = "kind string, id long, range long, arrival long, seq long, ts long, place long, n long"
OFFSET_SCHEMA = "id long, range long, arrival long, base long, count long, created_at long, last_seq long"
_COLUMNS = [c.split()[0] for c in RANGE_SCHEMA.split(", ")]


def _state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def count_ranges(valid: DataFrame, size: int = SEQ_RANGE, expiry_ms: int | None = None) -> DataFrame:
    """Step 1 over a stream of (seq, id, ts): rows of kind ``event`` (with their place), ``repeat`` and ``count``."""
    columns, wide = _COLUMNS, -(-size // 8)  # closure values travel with the pickled processor, as the class itself does

    class Ranges(StatefulProcessor):
        def init(self, handle) -> None:
            # of the group's pairs by (id, range): 64-bit integers, and one row of bits each
            self.seen = handle.getValueState("seen", "ids binary, ranges binary, ats binary, bits binary")

        def handleInputRows(self, key, rows, timerValues):
            part = pd.concat(list(rows), ignore_index=True)
            arrival = int(part["arrival"].iloc[0])  # the same in the whole micro-batch
            part = part.astype({"id": "int64", "seq": "int64"}).sort_values(["id", "seq"], kind="stable", ignore_index=True)
            uid, seq, ts = part["id"].to_numpy(), part["seq"].to_numpy(), part["ts"].astype("Int64").array
            number = seq // size
            place = seq - number * size
            starts = np.r_[True, (np.diff(uid) != 0) | (np.diff(number) != 0)]
            pair = np.cumsum(starts) - 1

            known = self.seen.get() if self.seen.exists() else (b"", b"", b"", b"")
            ids, ranges, ats = (np.frombuffer(x, "<i8") for x in known[:3])
            old = len(ids)
            # the pairs of the state and of the rows, laid together
            ids, ranges = np.concatenate([ids, uid[starts]]), np.concatenate([ranges, number[starts]])
            order = np.lexsort((ranges, ids))
            new = np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(ranges[order]) != 0)]
            slot = np.empty(len(order), np.int64)
            slot[order] = np.cumsum(new) - 1
            ids, ranges = ids[order][new], ranges[order][new]
            bits, at = np.zeros((len(ids), wide), np.uint8), np.zeros(len(ids), np.int64)
            bits[slot[:old]], at[slot[:old]] = np.frombuffer(known[3], np.uint8).reshape(old, wide), ats
            met = slot[old:]
            if expiry_ms is not None:
                bits[met[arrival - at[met] > expiry_ms]] = 0

            where, byte, bit = met[pair], place >> 3, (128 >> (place & 7)).astype(np.uint8)
            first = np.r_[True, (np.diff(uid) != 0) | (np.diff(seq) != 0)]
            event = first & (bits[where, byte] & bit == 0)

            def frame(kind, take, place, n):
                made = {"kind": kind, "id": uid[take], "range": number[take], "arrival": arrival, "seq": seq[take], "ts": ts[take], "place": place, "n": n}
                return pd.DataFrame({c: pd.Series(made[c], index=range(len(uid[take])), dtype="object" if c == "kind" else "Int64") for c in columns})

            again = np.flatnonzero(~event)
            if len(again):
                yield frame("repeat", again, None, None)
            made = np.flatnonzero(event)
            if len(made):
                np.bitwise_or.at(bits, (where[made], byte[made]), bit[made])
                at[where[made]] = arrival
                self.seen.update((ids.tobytes(), ranges.tobytes(), at.tobytes(), bits.tobytes()))
                heads = np.flatnonzero(np.r_[True, np.diff(pair[made]) != 0])
                n = np.diff(np.r_[heads, len(made)])
                yield frame("event", made, np.arange(len(made)) - np.repeat(heads, n) + 1, None)
                counts = frame("count", made[heads], None, n)  # with the first event's ts and the last one's seq
                counts["seq"] = pd.Series(seq[made[heads + n - 1]], dtype="Int64")
                yield counts

        def close(self) -> None:
            pass

    _state_store(valid.sparkSession)
    # the time of a micro-batch is one value, and ascends from batch to batch
    number = F.floor(F.col("seq") / F.lit(size)).cast("long")
    ranged = valid.select("seq", "id", "ts", F.floor(F.col("seq") / F.lit(max(size, BLOCK_SEQS // size * size))).cast("long").alias("block"),
                          F.pmod(F.xxhash64("id", number), F.lit(LANES)).cast("int").alias("lane"), F.unix_millis(F.current_timestamp()).alias("arrival"))
    return ranged.groupBy("block", "lane").transformWithStateInPandas(
        statefulProcessor=Ranges(), outputStructType=RANGE_SCHEMA, outputMode="Append", timeMode="None")


def total_counts(counts: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Step 2 over the stream of count rows: per (id, range, arrival) the id's count before it, and its state after the
    micro-batch. ``initial``: (id, count, created_at, last_seq), e.g. the catalog's, when the stream starts."""

    class Totals(StatefulProcessor):
        def init(self, handle) -> None:
            self.total = handle.getValueState("total", "count long, created_at long, last_seq long")

        def handleInitialState(self, key, initialState, timerValues) -> None:
            first = initialState.iloc[0]
            self.total.update(tuple(None if pd.isna(first[c]) else int(first[c]) for c in ("count", "created_at", "last_seq")))

        def handleInputRows(self, key, rows, timerValues):
            frame = pd.concat(list(rows)).sort_values(["arrival", "range"], kind="stable")
            count, created, last = self.total.get() if self.total.exists() else (0, None, None)
            n = frame["n"].to_numpy(np.int64)
            first_ts = frame["ts"].iloc[0]
            if not count and not pd.isna(first_ts):
                created = int(first_ts)
            top = int(frame["seq"].max())
            after = int(count + n.sum())
            last = top if last is None else max(int(last), top)
            self.total.update((after, created, last))
            yield pd.DataFrame({"id": frame["id"].to_numpy(np.int64), "range": frame["range"].to_numpy(np.int64), "arrival": frame["arrival"].to_numpy(np.int64),
                                "base": count + np.cumsum(n) - n, "count": after, "created_at": pd.Series([created] * len(n), dtype="Int64"), "last_seq": last})

        def close(self) -> None:
            pass

    _state_store(counts.sparkSession)
    grouped = initial.select("id", "count", "created_at", "last_seq").groupBy("id") if initial is not None else None
    return counts.select("id", "range", "arrival", "seq", "ts", "n").groupBy("id").transformWithStateInPandas(
        statefulProcessor=Totals(), outputStructType=OFFSET_SCHEMA, outputMode="Append", timeMode="None", initialState=grouped)


def run_ack_stream(valid: DataFrame, out_dir: str, checkpoint: str, initial: DataFrame | None = None, size: int = SEQ_RANGE, expiry_ms: int | None = None) -> None:
    """Run both steps over what has arrived of ``valid`` (a stream of seq, id, ts), then stop."""
    spark = valid.sparkSession
    held = spark.conf.get(_PARTITIONS)

    def run(df: DataFrame, name: str, partition: list[str]) -> None:
        writer = df.writeStream.format("parquet").outputMode("append").partitionBy(*partition) if partition else df.writeStream.format("parquet").outputMode("append")
        writer.option("path", f"{out_dir}/{name}").option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start().awaitTermination()

    # read by a stream at its first start; its checkpoint keeps it
    spark.conf.set(_PARTITIONS, str(min(int(held), _PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism)))
    try:
        run(count_ranges(valid, size, expiry_ms), "ranges", ["kind"])
        counts = spark.readStream.schema(RANGE_SCHEMA).parquet(f"{out_dir}/ranges").filter("kind = 'count'")
        run(total_counts(counts, initial), "offsets", [])
    finally:
        spark.conf.set(_PARTITIONS, held)


def read_acks(spark: SparkSession, out_dir: str) -> DataFrame:
    """(seq, id, action, running_count) of every delivery so far: ``inserted``, ``updated`` or ``repeated`` (no count)."""
    rows = spark.read.schema(RANGE_SCHEMA).parquet(f"{out_dir}/ranges")
    offsets = spark.read.schema(OFFSET_SCHEMA).parquet(f"{out_dir}/offsets").select("id", "range", "arrival", "base")
    running = F.col("base") + F.col("place")
    events = rows.filter("kind = 'event'").join(offsets, ["id", "range", "arrival"]).select(
        "seq", "id", F.when(running == 1, "inserted").otherwise("updated").alias("action"), running.alias("running_count"))
    repeats = rows.filter("kind = 'repeat'").select("seq", "id", F.lit("repeated").alias("action"), F.lit(None).cast("long").alias("running_count"))
    return events.unionByName(repeats)


def read_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """(id, count, created_at, last_seq): the state of every id that had events, as of its last ones."""
    offsets = spark.read.schema(OFFSET_SCHEMA).parquet(f"{out_dir}/offsets")
    return offsets.groupBy("id").agg(F.max_by(F.struct("count", "created_at", "last_seq"), F.struct("arrival", "count")).alias("s")).select("id", "s.*")
