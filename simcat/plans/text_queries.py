"""Registered text/product/load queries (P-1..P-8, V-1..V-7, S-1, A-2..A-4) and oracles.

Product records come from the fixture tables (FIXTURES.md part C): ``part`` gives
title, categories and rating, ``pages.html`` on the same key the description,
``supplier.s_name`` on the same key the seller, and the first ten line items of the
part (by order key, line number) the attributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simcat import params as P
from simcat.functions import text as T
from simcat.operators.partitioning import spread
from simcat.operators.products import format_products, load_outcomes
from simcat.operators.report import batch_progress, failure_sample, load_report
from simcat.plans.fixtures import FIXTURE_TASKS, table
from simcat.session import shared_dir
from simcat.sources.jsonl import read_products, write_jsonl

_CLS = T.PY_SPACE_CLASS


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_CLS}+|{_CLS}+$', '', 'g')"


def _sql_clean_desc(x: str) -> str:
    tags = f"regexp_replace({_sql_strip(x)}, '<[^>]+>', ' ', 'g')"
    runs = f"regexp_replace({tags}, '{_CLS}+', ' ', 'g')"
    return f"nullif(substring({_sql_strip(runs)}, 1, 2000), '')"


def _sql_categories(a: str, b: str, c: str, d: str) -> str:
    def keep(x, earlier):
        cond = " AND ".join([f"nullif({x}, '') IS NOT NULL"] + [f"{x} IS DISTINCT FROM {e}" for e in earlier])
        return f"CASE WHEN {cond} THEN {x} END"
    return f"concat_ws(' > ', {keep(a, [])}, {keep(b, [a])}, {keep(c, [a, b])}, {keep(d, [a, b, c])})"


def _sql_rating(r: str) -> str:
    return f"CASE WHEN TRY_CAST({r} AS DOUBLE) > 0 AND NOT isnan(TRY_CAST({r} AS DOUBLE)) THEN {r} END"


def _sql_product_text(title, cats, desc, attrs, seller, rating) -> str:
    lt, lc, ld, la, ls, lr = P.DEFAULT.labels
    return f"""concat_ws(' | ',
      CASE WHEN {_sql_strip(title)} <> '' THEN '{lt}' || {_sql_strip(title)} END,
      CASE WHEN {cats} <> '' THEN '{lc}' || {cats} END,
      CASE WHEN {desc} IS NOT NULL THEN '{ld}' || {desc} END,
      CASE WHEN {attrs} IS NOT NULL THEN '{la}' || {attrs} END,
      CASE WHEN {_sql_strip(seller)} <> '' THEN '{ls}' || {_sql_strip(seller)} END,
      CASE WHEN {_sql_rating(rating)} IS NOT NULL THEN '{lr}' || {rating} END)"""


# ---------------------------------------------------------------- fixture records

def part_attributes(spark: SparkSession, sf_dir: str, cap: int = P.ATTRIBUTE_CAP) -> DataFrame:
    """P-6 input: per part, the first ``cap`` line items by (order key, line number).

    ``row_number() <= cap`` plans a partial WindowGroupLimit before the shuffle, so
    a part holding a third of all line items ships at most ``cap`` rows per map task."""
    li = spread(table(spark, sf_dir, "lineitem"), FIXTURE_TASKS)
    # (order key, line number) is not unique in the fixture: the rendered value breaks ties.
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "v")
    first = (li.select("l_partkey", "l_orderkey", "l_linenumber",
                       F.concat("l_returnflag", "l_linestatus", F.lit("-"),
                                F.col("l_linenumber").cast("string")).alias("v"))
             .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= cap))
    agg = first.groupBy("l_partkey").agg(
        F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "v"))).alias("_a"))
    return agg.select("l_partkey", F.transform("_a", lambda s: s["v"]).alias("attrs"))


_SQL_ATTRS = """
  attrs AS (
    SELECT l_partkey, list(v ORDER BY l_orderkey, l_linenumber, v) AS attrs,
           string_agg(v, '; ' ORDER BY l_orderkey, l_linenumber, v) AS attributes
    FROM (SELECT l_partkey, l_orderkey, l_linenumber,
                 l_returnflag || l_linestatus || '-' || CAST(l_linenumber AS VARCHAR) AS v,
                 row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, v) AS rn
          FROM lineitem) WHERE rn <= 10
    GROUP BY l_partkey)
"""


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined fixture rows that ``product_columns`` makes a product record of."""
    # Spread the part scan: the formatting after the (broadcast) joins is CPU-bound.
    p = spread(table(spark, sf_dir, "part"), FIXTURE_TASKS)
    g = table(spark, sf_dir, "pages").select("page_id", "html")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    a = part_attributes(spark, sf_dir)
    return (p.join(g, p["p_partkey"] == g["page_id"], "left")
            .join(s, p["p_partkey"] == s["s_suppkey"], "left")
            .join(a, p["p_partkey"] == a["l_partkey"], "left"))


def product_columns(variants: bool = False) -> list[Column]:
    """The fields of a raw product record, over ``part_rows``.

    With ``variants`` the records also carry edge cases, assigned by part key over
    the whole table: 1 = every part blank, 2 = a title over 100,000 characters,
    3 = no id, 4 = negative id; key 0 itself is an invalid id."""
    key = F.col("p_partkey")
    v = F.pmod(key, F.lit(10)) if variants else F.lit(0)
    blank = v == 1
    rid = (F.when(v == 3, F.lit(None)).when(v == 4, F.concat(F.lit("-"), key.cast("string")))
           .otherwise(key.cast("string"))) if variants else (key + 1).cast("string")
    title = (F.when(blank, F.lit("\u2003")).when(v == 2, F.repeat(F.concat("p_name", F.lit(" ")), 10000))
             .otherwise(F.col("p_name")))
    nul = F.lit(None).cast("string")
    return [
        (key + 1).alias("record_no"),
        rid.alias("id"),
        title.alias("title"),
        F.when(blank, nul).otherwise(F.col("p_type")).alias("greatgrandparent_category"),
        F.when(blank, nul).otherwise(F.col("p_brand")).alias("grandparent_category"),
        F.when(blank, nul).otherwise(F.col("p_type")).alias("parent_category"),
        F.when(blank, nul).otherwise(F.col("p_name")).alias("category"),
        F.when(blank, nul).otherwise(F.col("html")).alias("description"),
        F.when(blank, F.lit(None)).otherwise(F.col("attrs")).alias("attrs"),
        F.when(blank, nul).otherwise(F.col("s_name")).alias("seller"),
        F.when(blank, F.lit("0")).otherwise((F.col("p_size") - 25).cast("string")).alias("rating"),
    ]


def part_products(spark: SparkSession, sf_dir: str, variants: bool = False) -> DataFrame:
    """Raw product records (string fields, ``attrs`` array, record_no) from the fixtures; ``variants``: with edge cases."""
    return part_rows(spark, sf_dir).select(*product_columns(variants))


def _sql_part_products(variants: bool) -> str:
    v = "(p.p_partkey % 10)" if variants else "0"
    rid = (f"CASE WHEN {v} = 3 THEN NULL WHEN {v} = 4 THEN '-' || CAST(p.p_partkey AS VARCHAR) "
           f"ELSE CAST(p.p_partkey AS VARCHAR) END") if variants else "CAST(p.p_partkey + 1 AS VARCHAR)"
    b = f"{v} = 1"
    return f"""
  prod AS (
    SELECT p.p_partkey + 1 AS record_no, {rid} AS id,
           CASE WHEN {b} THEN chr(8195) WHEN {v} = 2 THEN repeat(p.p_name || ' ', 10000) ELSE p.p_name END AS title,
           CASE WHEN {b} THEN NULL ELSE p.p_type END AS ggp,
           CASE WHEN {b} THEN NULL ELSE p.p_brand END AS gp,
           CASE WHEN {b} THEN NULL ELSE p.p_type END AS pc,
           CASE WHEN {b} THEN NULL ELSE p.p_name END AS cat,
           CASE WHEN {b} THEN NULL ELSE g.html END AS description,
           CASE WHEN {b} THEN NULL ELSE a.attributes END AS attributes,
           CASE WHEN {b} THEN NULL ELSE s.s_name END AS seller,
           CASE WHEN {b} THEN '0' ELSE CAST(p.p_size - 25 AS VARCHAR) END AS rating
    FROM part p LEFT JOIN pages g ON g.page_id = p.p_partkey
    LEFT JOIN supplier s ON s.s_suppkey = p.p_partkey
    LEFT JOIN attrs a ON a.l_partkey = p.p_partkey)
"""


_SQL_TEXT_OF_PROD = _sql_product_text("title", _sql_categories("ggp", "gp", "pc", "cat"),
                                      _sql_clean_desc("description"), "attributes", "seller", "rating")


def _sql_reason(text: str = "text") -> str:
    return f"""CASE WHEN id IS NULL OR trim(id) IN ('', '0') THEN 'Missing ''id'' field'
         WHEN {text} = '' THEN 'Empty text after formatting'
         WHEN TRY_CAST(id AS BIGINT) IS NULL OR TRY_CAST(id AS BIGINT) <= 0 THEN 'ID must be positive'
         WHEN length({text}) < 1 OR length({text}) > 100000 THEN 'text length must be within 1..100000' END"""


# ---------------------------------------------------------------- queries

def product_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-1..P-8: one document text per product record."""
    prods = part_products(spark, sf_dir)
    return prods.select(F.col("id").cast("bigint").alias("id"),
                        format_products(prods, attributes=F.col("attrs")).alias("text"))


SQL_PRODUCT_TEXT = f"""
WITH {_SQL_ATTRS}, {_sql_part_products(False)}
SELECT CAST(id AS BIGINT) AS id, {_SQL_TEXT_OF_PROD} AS text FROM prod
"""


def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-2 + P-3 + P-4 on every page: tags out, whitespace collapsed, 2000 code points."""
    pages = spread(table(spark, sf_dir, "pages"), FIXTURE_TASKS)
    return pages.select("page_id", T.empty_to_null(T.clean_description(F.col("html"))).alias("description"))


SQL_HTML_CLEAN = f"SELECT page_id, {_sql_clean_desc('html')} AS description FROM pages"


def unicode_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-1: every document padded with U+00A0 / U+2003 / U+001F / newline, then stripped."""
    docs = table(spark, sf_dir, "documents")
    padded = F.concat(F.lit("\u00a0\u2003\u001f "), F.col("text"), F.lit("\n\u3000\u001c"))
    s = T.py_strip(padded)
    return docs.select("doc_id", F.char_length(s).alias("n_chars"), (s == F.col("text")).alias("same"),
                       F.md5(s).alias("text_md5"))


SQL_UNICODE_STRIP = f"""
WITH s AS (SELECT doc_id, text,
  {_sql_strip("chr(160) || chr(8195) || chr(31) || ' ' || text || chr(10) || chr(12288) || chr(28)")} AS s
  FROM documents)
SELECT doc_id, length(s)::INTEGER AS n_chars, s = text AS same, md5(s) AS text_md5 FROM s
"""


def category_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-5 on every part: (type, brand, type, name), later duplicates dropped."""
    p = table(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") + 1).alias("id"),
                    T.category_path("p_type", "p_brand", "p_type", "p_name").alias("categories"))


SQL_CATEGORY_PATH = f"""
SELECT p_partkey + 1 AS id, {_sql_categories('p_type', 'p_brand', 'p_type', 'p_name')} AS categories FROM part
"""


def attribute_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-6: first ten line items of each part rendered and joined with '; '."""
    a = part_attributes(spark, sf_dir)
    return a.select(F.col("l_partkey").alias("p_partkey"), T.attribute_list(F.col("attrs")).alias("attributes"))


SQL_ATTRIBUTE_LIST = f"""
WITH {_SQL_ATTRS}
SELECT l_partkey AS p_partkey, attributes FROM attrs
"""


def rating_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-7: rating = p_size - 25, shown only when > 0."""
    p = table(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") + 1).alias("id"),
                    T.rating_text((F.col("p_size") - 25).cast("string")).alias("rating"))


SQL_RATING_LABEL = f"""
SELECT p_partkey + 1 AS id, {_sql_rating("CAST(p_size - 25 AS VARCHAR)")} AS rating FROM part
"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prods = part_products(spark, sf_dir, variants=True)
    return load_outcomes(prods, attributes=F.col("attrs"))


SQL_OUTCOMES = f"""
WITH {_SQL_ATTRS}, {_sql_part_products(True)},
  fmt AS (SELECT record_no, id, {_SQL_TEXT_OF_PROD} AS text FROM prod),
  outcomes AS (SELECT record_no, TRY_CAST(id AS BIGINT) AS id, text, {_sql_reason()} AS reason FROM fmt)
"""


def validate_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-2, V-3, V-4, V-5 per record (reason null = accepted)."""
    o = _outcomes(spark, sf_dir)
    return o.select("record_no", "id", "reason", F.char_length("text").alias("n_chars"),
                    F.md5("text").alias("text_md5"))


SQL_VALIDATE_PRODUCTS = f"""{SQL_OUTCOMES}
SELECT record_no, id, reason, length(text)::INTEGER AS n_chars, md5(text) AS text_md5 FROM outcomes
"""


def load_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-2: total, success, failed over all records."""
    return load_report(_outcomes(spark, sf_dir))


SQL_LOAD_REPORT = f"""{SQL_OUTCOMES}
SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE reason IS NULL)::BIGINT AS success,
       count(*) FILTER (WHERE reason IS NOT NULL)::BIGINT AS failed FROM outcomes
"""


def load_failure_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-4: first ten failures in record order, plus how many more failed."""
    return failure_sample(_outcomes(spark, sf_dir))


SQL_LOAD_FAILURE_SAMPLE = f"""{SQL_OUTCOMES},
  f AS (SELECT * FROM outcomes WHERE reason IS NOT NULL)
SELECT record_no, id, reason, (SELECT greatest(count(*) - 10, 0) FROM f) AS more
FROM f ORDER BY record_no LIMIT 10
"""


def load_batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-3: per batch of 100 records in order: records, success, failed."""
    return batch_progress(_outcomes(spark, sf_dir))


SQL_LOAD_BATCH_PROGRESS = f"""{SQL_OUTCOMES}
SELECT ((record_no - 1) // 100 + 1)::BIGINT AS batch, count(*)::BIGINT AS records,
       count(*) FILTER (WHERE reason IS NULL)::BIGINT AS success,
       count(*) FILTER (WHERE reason IS NOT NULL)::BIGINT AS failed
FROM outcomes GROUP BY 1
"""


def ingest_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-1 end to end: the product records are written as JSON lines (by Spark, to the
    shared folder), scanned back with the strict line parser, formatted and validated."""
    prods = part_products(spark, sf_dir, variants=True)
    raw = prods.select(
        "id", "title", "greatgrandparent_category", "grandparent_category", "parent_category",
        "category", "description", F.col("attrs").alias("attributes"), "seller",
        F.col("rating").cast("int").alias("rating"))
    path = shared_dir(spark, "jsonl")
    write_jsonl(raw, path)
    records, _ = read_products(spark, path)
    o = load_outcomes(records)
    return o.select("id", "reason", F.char_length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


SQL_INGEST_PRODUCTS = f"""{SQL_OUTCOMES}
SELECT id, reason, length(text)::INTEGER AS n_chars, md5(text) AS text_md5 FROM outcomes
"""


QUERIES = {
    "product_text": (product_text, SQL_PRODUCT_TEXT),
    "html_clean": (html_clean, SQL_HTML_CLEAN),
    "unicode_strip": (unicode_strip, SQL_UNICODE_STRIP),
    "category_path": (category_path, SQL_CATEGORY_PATH),
    "attribute_list": (attribute_list, SQL_ATTRIBUTE_LIST),
    "rating_label": (rating_label, SQL_RATING_LABEL),
    "validate_products": (validate_products, SQL_VALIDATE_PRODUCTS),
    "load_report": (load_report_query, SQL_LOAD_REPORT),
    "load_failure_sample": (load_failure_sample, SQL_LOAD_FAILURE_SAMPLE),
    "load_batch_progress": (load_batch_progress, SQL_LOAD_BATCH_PROGRESS),
    "ingest_products": (ingest_products, SQL_INGEST_PRODUCTS),
}
