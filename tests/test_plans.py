"""Plan shape: JVM-only text path, map-side partial aggregation, skew-safe keys, pruning."""

import random

from pyspark.sql import functions as F

from simcat.operators import catalog as C
from simcat.operators.products import load_outcomes
from simcat.plans import text_queries as TQ


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_and_validation_stay_in_the_jvm(spark, sf):
    prods = TQ.part_products(spark, sf, variants=True)
    p = plan(load_outcomes(prods, attributes=F.col("attrs")))
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_fold_combines_before_the_shuffle_and_survives_a_hot_id(spark):
    rnd = random.Random(11)
    # id 1 carries a third of the feed
    rows = [(s, 1 if s % 3 == 0 else rnd.randint(2, 50), f"t{s}", 1000 + s, [1.0, 0.0]) for s in range(3000)]
    feed = spark.createDataFrame(rows, "seq long, id long, text string, ts long, vector array<float>")
    folded = C.fold_upserts(feed)
    p = plan(folded)
    # a partial aggregate sits below the exchange on id
    assert p.index("Exchange hashpartitioning(id") < p.rindex("Aggregate")
    hot = folded.filter("id = 1").first()
    assert hot.n == 1000 and hot.text == "t2997" and hot.t0 == 1000 and hot.t1 == 3997


def test_actions_join_on_id_and_seq(spark):
    rows = [(s, 1, "t", s, [1.0]) for s in range(50)]
    feed = spark.createDataFrame(rows, "seq long, id long, text string, ts long, vector array<float>")
    acts = C.upsert_actions(feed, spark.createDataFrame([], "id long"))
    got = sorted((r.seq, r.action) for r in acts.collect())
    assert got[0] == (0, "inserted") and all(a == "updated" for _, a in got[1:])
    # The feed side is shuffled on (id, seq), never on id alone: a hot id is spread.
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(C.upsert_actions(feed, spark.createDataFrame([(5,)], "id long")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    feed_side = p.split("LeftOuter")[1].split("\n")[1:5]
    assert any("hashpartitioning(id#" in l and ", seq#" in l for l in feed_side), feed_side


def test_scan_reads_only_needed_columns(spark, sf):
    p = plan(TQ.category_path(spark, sf))
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_brand:string,p_type:string>" in p \
        or "p_retailprice" not in p.split("ReadSchema")[1].split("\n")[0]


def test_per_part_first_ten_uses_partial_window_limit(spark, sf):
    p = plan(TQ.part_attributes(spark, sf))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_feed_arrival_pushes_its_time_range_into_the_scan(spark, sf):
    from simcat.plans.stream_queries import _slice_feed

    p = plan(_slice_feed(spark, sf, 1))
    pushed = p.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(ts," in pushed and "LessThan(ts," in pushed, pushed


def test_fold_sorts_no_payload_and_embeds_winners_only(spark):
    from simcat.plans.fixtures import hashing_embedder

    rows = [(s, s % 3 + 1, f"t{s}", s) for s in range(60)]
    p = plan(C.fold_upserts(spark.createDataFrame(rows, "seq long, id long, text string, ts long"), hashing_embedder()))
    assert "SortAggregate" not in p and "ObjectHashAggregate" not in p
    assert p.index("ArrowEvalPython") < p.index("Window")  # printed top down: embedded after the winners are picked


def test_mean_pool_keeps_a_token_one_row(spark):
    from simcat.operators.embed import mean_pool

    df = spark.createDataFrame([(1, 0, 1, [1.0, 2.0]), (1, 1, 0, [9.0, 9.0]), (2, 0, 0, [3.0, 4.0])], "doc long, pos long, mask int, vec array<double>")
    pooled = mean_pool(df, "doc", "pos", "mask", "vec")
    p = plan(pooled)
    assert {r.doc: r.vector for r in pooled.collect()} == {1: [1.0, 2.0], 2: [0.0, 0.0]}
    # one partial row per document and task goes through the one shuffle
    assert "Generate" not in p and "Aggregate" not in p and p.count("MapInArrow") == 2 and p.count("Exchange") == 1


def test_merge_deals_each_side_once(spark, monkeypatch):
    from simcat.session import shared_dir
    from simcat.sources.store import CatalogStore

    rows = [(s, s % 40 + 1, f"t{s}", s, [1.0]) for s in range(80)]
    feed = C.fold_upserts(spark.createDataFrame(rows, "seq long, id long, text string, ts long, vector array<float>"))
    store = CatalogStore(spark, shared_dir(spark, "test-merge-plan"), buckets=4)
    store.merge(feed)
    plans, real = [], CatalogStore._write_buckets
    monkeypatch.setattr(CatalogStore, "_write_buckets", lambda self, df, *a: plans.append(plan(df)) or real(self, df, *a))
    feed = spark.createDataFrame(feed.collect(), feed.schema)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.merge(feed)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plans[0].count("Exchange") == 2 and "REPARTITION_BY_COL" in plans[0]
    assert store.count() == 40 and {r["count"] for r in store.read().collect()} == {4}
