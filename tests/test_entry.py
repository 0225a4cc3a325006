"""Driver contract: entry() runs on sf0.001; every query has a builder, most an oracle."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and df.columns == ["qid", "rank", "id", "score_rate", "text"]


def test_registry_shape():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 40
    assert all(callable(f) for f in qs.values())
