"""Chained stateful acks (ST-2): hot ids, late events, repeats, expiry, initial state."""

import os

from pyspark.sql import functions as F

from simcat.session import shared_dir
from simcat.streaming import acks as A
from simcat.streaming.feed import deliver, read_feed_stream

SCHEMA = "seq long, id long, ts long"


def run(spark, batches, **more):
    out = shared_dir(spark, "t-acks")
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    deliver(spark, frames, lambda src: A.run_ack_stream(read_feed_stream(spark, src, frames[0].schema), out, f"{out}-ckpt", **more))
    return out


def test_hot_late_and_repeated(spark):
    first = [(s, 1 if s % 3 else s % 5 + 2, 100 + s) for s in range(0, 300, 2)]
    second = [(s, 1 if s % 3 else s % 5 + 2, 100 + s) for s in range(1, 300, 2)] + first[::5] + [(400, 99, None)]  # late, repeated, new
    out = run(spark, [first + first[:20], second], size=16)
    want, state = [], {}
    for batch, again in ((first, first[:20]), (second[:150] + [second[-1]], first[::5])):
        for s, i, t in sorted(batch):
            count, created, last = state.get(i, (0, t, s))
            state[i] = count + 1, created, max(last, s)
            want.append((s, i, "updated" if count else "inserted", count + 1))
        want += [(s, i, "repeated", None) for s, i, _ in again]
    key = lambda r: (r[0], r[2], r[3] or 0)
    assert sorted((tuple(r) for r in A.read_acks(spark, out).collect()), key=key) == sorted(want, key=key)
    assert {r.id: (r["count"], r.created_at, r.last_seq) for r in A.read_totals(spark, out).collect()} == state
    # no group of the hot id holds more than a range of seqs
    rows = spark.read.parquet(f"{out}/ranges")
    assert rows.filter("kind = 'event'").groupBy("id", "range").count().agg(F.max("count")).first()[0] <= 16
    assert rows.filter("kind = 'count' and id = 1").groupBy("arrival").count().agg(F.max("count")).first()[0] == 19


def test_counts_go_on_from_the_catalog(spark):
    initial = spark.createDataFrame([(1, 10, 5, 50), (2, 1, 7, 3)], "id long, count long, created_at long, last_seq long")
    out = run(spark, [[(40, 1, 900), (60, 1, 901), (61, 3, 902)]], initial=initial)
    assert sorted(map(tuple, A.read_acks(spark, out).collect())) == [(40, 1, "updated", 11), (60, 1, "updated", 12), (61, 3, "inserted", 1)]
    assert {r.id: tuple(r)[1:] for r in A.read_totals(spark, out).collect()} == {1: (12, 5, 60), 3: (1, 902, 61)}


def test_expired_bits_make_a_repeat_an_event_again(spark):
    out = run(spark, [[(1, 7, 1)], [(1, 7, 2)]], expiry_ms=1)
    assert sorted(r.action for r in A.read_acks(spark, out).collect()) == ["inserted", "updated"]


def test_pairs_share_groups_and_state_partitions_follow_the_cores(spark):
    """Each pair was a group of its own, and a stream had a state store per shuffle partition, whatever the cores."""
    rows = [(s, s % 97 + 1, s) for s in range(1200)]
    valid = spark.createDataFrame(rows, SCHEMA)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        out = run(spark, [rows, rows[::3]], size=16)
        state = f"{out}-ckpt/ranges/state/0"
        assert len([n for n in os.listdir(state) if n.isdigit()]) <= 3 * spark.sparkContext.defaultParallelism
        assert spark.conf.get("spark.sql.shuffle.partitions") == "60"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    acks = A.read_acks(spark, out).groupBy("action").count().collect()
    assert {r.action: r["count"] for r in acks} == {"inserted": 97, "updated": 1200 - 97, "repeated": 400}
    assert A.read_totals(spark, out).agg(F.sum("count")).first()[0] == valid.count()
