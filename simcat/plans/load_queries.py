"""Registered queries of the bulk load job (S-1, V-1..V-5, K-1, K-3, A-2..A-4) and their oracles.

The input file is written by Spark from the product records: after every 17th record
stands a line that breaks off in the middle (malformed), after every 23rd a blank one, so line
and record numbers differ. One run per application and fixture feeds all queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simcat.operators.load import load_products
from simcat.plans.fixtures import HASH_DIM, hashing_embedder, sql_hash_vectors
from simcat.plans.text_queries import SQL_OUTCOMES, part_rows, product_columns
from simcat.session import shared_dir
from simcat.sources.store import CatalogStore

_RUNS: dict = {}
_FIELDS = ["id", "title", "greatgrandparent_category", "grandparent_category", "parent_category", "category", "description"]


def _write_input(spark: SparkSession, sf_dir: str, path: str) -> None:
    rows = part_rows(spark, sf_dir)
    no = F.col("p_partkey") + 1
    kinds = F.array(F.lit(0), F.when(no % 17 == 0, F.lit(1)), F.when(no % 23 == 0, F.lit(2)))
    # range-partitioned and sorted: part after part holds the lines in order. The joined rows are sorted and
    # the lines, up to a hundred times as long, made behind the sort: what a task sorts is as large as it looks shuffled.
    ordered = rows.withColumn("k", F.explode(F.array_compact(kinds))).orderBy(no, "k")
    record = F.to_json(F.struct(*_FIELDS, F.col("attrs").alias("attributes"), "seller", F.col("rating").cast("int").alias("rating")))
    broken = F.concat(F.lit('{"id": '), F.col("record_no").cast("string"), F.lit(', "title"'))
    value = F.when(F.col("k") == 0, record).when(F.col("k") == 1, broken).otherwise("  ")
    ordered.select(*product_columns(variants=True), "k").select(value.alias("value")).write.text(path, compression="gzip")


def _run(spark: SparkSession, sf_dir: str):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        root = shared_dir(spark, "load-job")
        _write_input(spark, sf_dir, f"{root}/input")
        store = CatalogStore(spark, f"{root}/catalog", buckets=8)
        run = load_products(spark, f"{root}/input", store, hashing_embedder(), ts=F.lit(0).cast("long"), rejects_path=f"{root}/rejects")
        _RUNS[key] = (store, run, f"{root}/rejects")
    return _RUNS[key]


_SQL_LINES = f"""{SQL_OUTCOMES},
  lines AS (
    SELECT *, row_number() OVER (ORDER BY record_no, k)::BIGINT AS line_no FROM (
      SELECT record_no, 0 AS k, NULL AS line FROM outcomes
      UNION ALL SELECT record_no, 1, '{{"id": ' || record_no || ', "title"' FROM outcomes WHERE record_no % 17 = 0
      UNION ALL SELECT record_no, 2, '  ' FROM outcomes WHERE record_no % 23 = 0))
"""


def load_job_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog after the load: one row per id, its text, vector and number of upserts."""
    store, _, _ = _run(spark, sf_dir)
    return store.read().select("id", F.md5("text").alias("text_md5"), F.transform("vector", lambda x: x.cast("double")).alias("vector"), "dim", "count")


SQL_LOAD_JOB_CATALOG = f"""{SQL_OUTCOMES},
  folded AS (SELECT id, arg_max(text, record_no) AS text, count(*)::BIGINT AS count FROM outcomes WHERE reason IS NULL GROUP BY id),
  vec AS ({sql_hash_vectors("folded", "id", "text")})
SELECT folded.id, md5(text) AS text_md5, v AS vector, {HASH_DIM} AS dim, count FROM folded JOIN vec ON vec.id = folded.id
"""


def load_job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every parsed record with its dense record and line numbers, as scanned, and its reason."""
    _, run, _ = _run(spark, sf_dir)
    return run.outcomes.select("record_no", "line_no", "id", "reason", F.md5("text").alias("text_md5"))


SQL_LOAD_JOB_OUTCOMES = f"""{_SQL_LINES}
SELECT o.record_no, line_no, id, reason, md5(text) AS text_md5 FROM outcomes o JOIN lines l ON l.record_no = o.record_no AND k = 0
"""


def load_job_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-1: lines that are no JSON value, with their line numbers."""
    _, run, _ = _run(spark, sf_dir)
    return run.malformed.select("line_no", "line")


SQL_LOAD_JOB_MALFORMED = f"{_SQL_LINES} SELECT line_no, line FROM lines WHERE k = 1"


def load_job_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-3 read back: every rejected record with its line and reason."""
    _, _, path = _run(spark, sf_dir)
    return spark.read.parquet(path).select("record_no", "line_no", "id", "reason")


SQL_LOAD_JOB_REJECTS = f"""{_SQL_LINES}
SELECT o.record_no, line_no, id, reason FROM outcomes o JOIN lines l ON l.record_no = o.record_no AND k = 0 WHERE reason IS NOT NULL
"""


def load_job_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-2 of the run: parsed records, successes, failures."""
    return _run(spark, sf_dir)[1].report()


SQL_LOAD_JOB_REPORT = f"""{SQL_OUTCOMES}
SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE reason IS NULL)::BIGINT AS success,
       count(*) FILTER (WHERE reason IS NOT NULL)::BIGINT AS failed FROM outcomes
"""


def load_job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-3 on the scanned record numbers."""
    return _run(spark, sf_dir)[1].progress()


SQL_LOAD_JOB_PROGRESS = f"""{SQL_OUTCOMES}
SELECT ((record_no - 1) // 100 + 1)::BIGINT AS batch, count(*)::BIGINT AS records,
       count(*) FILTER (WHERE reason IS NULL)::BIGINT AS success,
       count(*) FILTER (WHERE reason IS NOT NULL)::BIGINT AS failed
FROM outcomes GROUP BY 1
"""


def load_job_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-4 on the scanned record numbers."""
    return _run(spark, sf_dir)[1].failures()


SQL_LOAD_JOB_FAILURES = f"""{SQL_OUTCOMES},
  f AS (SELECT * FROM outcomes WHERE reason IS NOT NULL)
SELECT record_no, id, reason, (SELECT greatest(count(*) - 10, 0) FROM f) AS more FROM f ORDER BY record_no LIMIT 10
"""


QUERIES = {
    "load_job_catalog": (load_job_catalog, SQL_LOAD_JOB_CATALOG),
    "load_job_outcomes": (load_job_outcomes, SQL_LOAD_JOB_OUTCOMES),
    "load_job_malformed": (load_job_malformed, SQL_LOAD_JOB_MALFORMED),
    "load_job_rejects": (load_job_rejects, SQL_LOAD_JOB_REJECTS),
    "load_job_report": (load_job_report, SQL_LOAD_JOB_REPORT),
    "load_job_progress": (load_job_progress, SQL_LOAD_JOB_PROGRESS),
    "load_job_failures": (load_job_failures, SQL_LOAD_JOB_FAILURES),
}
