import zlib
from collections import Counter, defaultdict

import pytest
from helpers import documents
from pyspark.sql import functions as F

from simcat.llm import queries, sharding


def test_query_law_and_slots(spark, sf):
    rows = queries.op1_rendezvous_sharding(spark, sf).collect()
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(t) + 8, zlib.crc32(t), "key")
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.grown_shard == 24 for r in rows)
    assert 0 < moved < len(rows) / 8


def test_weights_set_the_shares_and_growth_moves_into_the_new_shard_only(spark):
    keys = spark.range(20000).withColumnRenamed("id", "k")
    weights = [1.0, 2.0, 5.0]
    a = sharding.shard_records(keys, weights, "k")
    both = sharding.shard_records(a, [*weights, 2.0], "k", shard="grown").collect()
    share = Counter(r.shard for r in both)
    for s, w in enumerate(weights):
        assert abs(share[s] / 20000 - w / 8) < 0.02
    assert all(r.grown in (r.shard, 3) for r in both)
    assert abs(sum(r.grown == 3 for r in both) / 20000 - 0.2) < 0.02


def test_hot_repeated_rows_null_keys_and_clashing_columns(spark):
    docs = documents(spark, extra=True)
    hot = docs.filter("doc_id = 5").select("doc_id", "text").limit(1).crossJoin(spark.range(9000)).drop("id")
    placed = sharding.number_slots(sharding.shard_records(docs.select("doc_id", "text", F.lit("x").alias("copies"), "kept").unionByName(hot.withColumns({"copies": F.lit("x"), "kept": F.lit(True)})), [1.0] * 5, "doc_id"), "shard", "doc_id")
    rows = placed.collect()
    assert placed.columns == ["doc_id", "text", "copies", "kept", "shard", "slot"] and len(rows) == docs.count() + 9000
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in rows if r.doc_id is None}) == 1


def test_a_hot_key_with_different_rows_is_split(spark, monkeypatch):
    """A third of the rows under one key: no window numbers more than a cell of them."""
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.concat(F.lit("text "), "id").alias("t"))
    df = sharding.shard_records(df, [1.0] * 3, "k")
    cells = df.groupBy("k", F.shiftrightunsigned(F.xxhash64("k", "t", "shard"), 64 - sharding.CELL_BITS)).count()
    assert cells.agg(F.max("count")).first()[0] < 100
    slots = defaultdict(list)
    for r in sharding.number_slots(df, "shard", "k").collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slots_do_not_depend_on_the_ranges(spark):
    df = sharding.shard_records(spark.range(500).withColumnRenamed("id", "k"), [1.0] * 3, "k")
    assert sorted(sharding.number_slots(df, "shard", "k", range_bits=2).collect()) == sorted(sharding.number_slots(df, "shard", "k", range_bits=9).collect())


def test_empty_and_bad_weights(spark):
    empty = spark.createDataFrame([], "doc_id long")
    assert sharding.number_slots(sharding.shard_records(empty, [1.0], "doc_id"), "shard", "doc_id").count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous_shard([1.0, 0.0], F.col("x"))
