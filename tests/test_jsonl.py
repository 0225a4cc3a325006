"""S-1: the strict JSON-lines scan against Python's json module."""

import json
import os
import tempfile

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from simcat.operators.products import load_outcomes
from simcat.operators.report import batch_progress, failure_sample, load_report
from simcat.plans import load_queries
from simcat.sources.jsonl import read_products, write_jsonl

LINES = [
    '{"id": 7, "title": " Lamp ", "category": "Lamps", "rating": 4.5}',
    "",
    "   ",
    '{"id": 8, "title": "A"} trailing',
    "{'id': 9, 'title': 'single'}",
    '{"id": 10, "title": "first", "title": "second"}',
    "[1, 2]",
    '"just a string"',
    '{"id": 11, "title": "nan", "rating": NaN}',
    '{"id": 12} {"id": 13}',
    '{"id": 0, "title": "zero"}',
    '{"title": "no id"}',
    '{"id": 14}',
    '{"id": 15, "attributes": ["E27", 60], "description": "<p>x</p>"}',
    "{broken",
]


def py_parse(lines):
    records, malformed = [], []
    for n, line in enumerate(lines, 1):
        s = line.strip()
        if not s:
            continue
        try:
            records.append((n, json.loads(s)))
        except json.JSONDecodeError:
            malformed.append(n)
    return records, malformed


def test_strict_scan_matches_python(spark):
    d = tempfile.mkdtemp(prefix="simcat-jsonl-")
    path = os.path.join(d, "products.jsonl")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(LINES) + "\n")
    records, malformed = read_products(spark, path)
    exp_rec, exp_bad = py_parse(LINES)
    got = records.orderBy("record_no").collect()
    assert [r.line_no for r in got] == [n for n, _ in exp_rec]
    assert [r.record_no for r in got] == list(range(1, len(exp_rec) + 1))
    assert sorted(r.line_no for r in malformed.collect()) == exp_bad
    by_line = {r.line_no: r for r in got}
    for n, obj in exp_rec:
        r = by_line[n]
        assert r.not_object == (not isinstance(obj, dict))
        if isinstance(obj, dict):
            assert r.title == (obj.get("title") if obj.get("title") is None else str(obj["title"]))
    assert by_line[6].title == "second"  # duplicate key: last wins


def test_load_reports(spark):
    d = tempfile.mkdtemp(prefix="simcat-jsonl-")
    path = os.path.join(d, "products.jsonl")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(LINES) + "\n")
    records, _ = read_products(spark, path)
    o = load_outcomes(records)
    rep = load_report(o).first()
    assert rep.total == rep.success + rep.failed == len(py_parse(LINES)[0])
    reasons = {r.record_no: r.reason for r in o.collect()}
    assert reasons[1] is None
    sample = failure_sample(o, 2).collect()
    assert len(sample) == 2 and sample[0].more == rep.failed - 2
    assert sum(r.records for r in batch_progress(o, 3).collect()) == rep.total


def test_numbering_follows_file_order_across_files(spark):
    d = tempfile.mkdtemp(prefix="simcat-jsonl-")
    sizes = {"a.jsonl": 5, "b.jsonl": 400, "c.jsonl": 37}   # packed into tasks largest first
    n = 0
    expected = []
    for name in sorted(sizes):
        with open(os.path.join(d, name), "w") as f:
            for i in range(sizes[name]):
                n += 1
                f.write(json.dumps({"id": n, "title": f"{name}-{i}"}) + "\n")
                expected.append(n)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        records, _ = read_products(spark, d)
        got = [(r.record_no, int(r.id)) for r in records.orderBy("record_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(zip(range(1, n + 1), expected))


def test_non_object_records_are_rejected_not_fatal(spark):
    d = tempfile.mkdtemp(prefix="simcat-jsonl-")
    path = os.path.join(d, "p.jsonl")
    with open(path, "w") as f:
        f.write('[1, 2]\n"text"\n{"id": 3, "title": "ok"}\n')
    records, _ = read_products(spark, path)
    got = {r.record_no: r.reason for r in load_outcomes(records).collect()}
    assert got == {1: "Record is not a JSON object", 2: "Record is not a JSON object", 3: None}


def test_numbers_hold_over_many_splits_and_a_shuffled_join(spark, tmp_path):
    import json

    n, expect, line_no = 0, [], 0
    for part in range(4):
        rows = []
        for i in range(300 if part % 2 else 40):
            line_no += 1
            kind = (i + part) % 9
            if kind == 3:
                rows.append("{broken")
            elif kind == 5:
                rows.append("  ")
            else:
                n += 1
                expect.append((n, line_no, str(n)))
                rows.append(json.dumps({"id": n, "title": "t" * (i % 50)}))
        (tmp_path / f"part-{part:02d}.jsonl").write_text("\n".join(rows) + "\n")
    conf = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "100", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        records, malformed = read_products(spark, str(tmp_path))
        got = sorted((r.record_no, r.line_no, r.id) for r in records.collect())
        bad = malformed.count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == expect and bad == sum((i + p) % 9 == 3 for p in range(4) for i in range(300 if p % 2 else 40))


def test_offsets_are_broadcast_and_rows_stay_where_they_are(spark):
    """Without a broadcast the lines, however long, were shuffled and sorted for the join with one row per split."""
    d = tempfile.mkdtemp(prefix="simcat-jsonl-")
    spark.createDataFrame([(f'{{"id": {i}}}',) for i in range(50)], "value string").repartition(5).write.mode("overwrite").text(d)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records, _ = read_products(spark, d)
        plan = records._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan
        got = records.select("record_no", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert sorted(r.record_no for r in got) == list(range(1, 51)) and all(r.record_no == r.line_no for r in got)


def test_written_lines_are_compressed_and_read_back(spark):
    d = tempfile.mkdtemp(prefix="simcat-jsonl-")
    write_jsonl(spark.range(1, 201).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("lamp "), 4000).alias("title")), d)
    assert sum(os.path.getsize(os.path.join(d, n)) for n in os.listdir(d)) < 400_000  # of 4 MB
    records, malformed = read_products(spark, d)
    assert records.agg(F.count("id"), F.min(F.length("title"))).first()[:] == (200, 20000) and malformed.count() == 0


def test_load_input_is_sorted_before_its_lines_are_made(spark, sf, monkeypatch):
    """The sort held the long titles: the rows of a task looked a hundredth as large, shuffled, as they were."""
    seen = []
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, path, **kw: seen.append((self._df, kw)))
    load_queries._write_input(spark, sf, "unused")
    plan = seen[0][0]._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("repeat(") < plan.index("Sort ") and seen[0][1] == {"compression": "gzip"}
