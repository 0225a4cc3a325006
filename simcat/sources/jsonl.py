"""S-1: product JSON-lines scan.

Each line is stripped (Python rules); blank lines are skipped; a line is a record
only when it is exactly one JSON value. Spark's JSON reader would accept trailing
text and single quotes, so every line is wrapped in ``[...]`` and parsed as an
array with single quotes disallowed: a line holding ``{..} x`` or ``{..},{..}``
does not come back as an array of one element. Malformed lines are kept apart with
their line number and are not part of the load total (V-1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simcat.functions.text import py_strip
from simcat.session import shared_dir

PRODUCT_FIELDS = ["id", "title", "greatgrandparent_category", "grandparent_category",
                  "parent_category", "category", "description", "attributes", "seller", "rating"]
PRODUCT_SCHEMA = "array<struct<" + ", ".join(f"`{f}`: string" for f in PRODUCT_FIELDS) + ">>"
_JSON_OPTS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true", "mode": "PERMISSIVE"}


def dense_numbers(df: DataFrame, out_col: str, split_cols: list[str], order_cols: list[str] | None = None) -> DataFrame:
    """Number rows 1..N in file order without a global window or a driver loop.

    ``split_cols`` identify an input split, the file first; a split's rows sit contiguously
    in one task, in file order, so ``monotonically_increasing_id`` minus the split's
    smallest id is the position inside the split. Rows per split are counted (one small
    row per split) and turned into offsets in two levels, splits within their file by
    ``order_cols`` (default: the other split columns) and files by their path, so the
    only unpartitioned window holds one row per file; the offsets, one row per split, are
    broadcast, so the rows are neither shuffled nor sorted and stay in their order."""
    file, order = split_cols[0], order_cols or split_cols[1:]
    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    firsts = [F.min(c).alias(c) for c in order if c not in split_cols]
    splits = tagged.groupBy(*split_cols).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_mid0"), *firsts)

    def before(w):
        return F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    files = splits.groupBy(file).agg(F.sum("_n").alias("_n"))
    files = files.select(file, before(Window.orderBy(file)).alias("_base"))
    offsets = (splits.withColumn("_off", before(Window.partitionBy(file).orderBy(*order))).join(files, file)
               .select(*split_cols, "_mid0", (F.col("_base") + F.col("_off")).alias("_off")))
    return (tagged.join(F.broadcast(offsets), split_cols, "inner")
            .withColumn(out_col, F.col("_off") + (F.col("_mid") - F.col("_mid0")) + 1)
            .drop("_mid", "_mid0", "_off"))


def read_products(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Returns ``(records, malformed)``.

    Files are read in path order (a folder of parts keeps its part order). Lines are
    parsed once; the parsed lines are written below the shared folder, and records are
    counted, numbered and returned from there.
    records: record_no (1..N over parsed records in file order), line_no, then the
    product fields as raw strings; a valid JSON value that is not an object gets
    all-null fields and ``not_object = true``.
    malformed: line_no, line."""
    split = ["_file", "_block"]
    lines = spark.read.text(path).select(F.col("value").alias("raw"),
                                         F.col("_metadata.file_path").alias("_file"),
                                         F.col("_metadata.file_block_start").alias("_block"))
    lines = dense_numbers(lines, "line_no", split)
    stripped = lines.select("line_no", *split, py_strip("raw").alias("line"))
    nonblank = stripped.filter(F.col("line") != "")
    wrapped = F.concat(F.lit("["), F.col("line"), F.lit("]"))
    objs = F.from_json(wrapped, PRODUCT_SCHEMA, _JSON_OPTS)
    is_obj = F.col("line").startswith("{") & F.coalesce(F.size(objs) == 1, F.lit(False)) \
        & objs.getItem(0).isNotNull()
    # Generic parse only for lines that did not give exactly one object (Or short-circuits):
    # tells a valid non-object value from a malformed line.
    one_value = F.coalesce(F.size(F.from_json(wrapped, "array<string>", _JSON_OPTS)), F.lit(-1)) == 1
    parsed = nonblank.select("line_no", *split, "line", objs.getItem(0).alias("_rec"),
                             is_obj.alias("_is_obj"), (is_obj | one_value).alias("_valid"))
    parsed = parsed.withColumn("line", F.when(~F.col("_valid"), F.col("line")))
    target = shared_dir(spark, "parsed-lines")
    # Tasks write what they read, in its order: no sort or exchange stands before this write.
    parsed.write.parquet(target)
    parsed = spark.read.schema(parsed.schema).parquet(target)
    malformed = parsed.filter(~F.col("_valid")).select("line_no", "line")
    good = parsed.filter(F.col("_valid")).select(
        "line_no", *split, F.col("_metadata.file_path").alias("_part"),
        F.col("_metadata.file_block_start").alias("_part_block"), "_is_obj", "_rec")
    good = dense_numbers(good, "record_no", [*split, "_part", "_part_block"], ["_block", "line_no"])
    fields = [F.when(F.col("_is_obj"), F.col(f"_rec.`{f}`")).alias(f) for f in PRODUCT_FIELDS]
    records = good.select("record_no", "line_no", *fields, (~F.col("_is_obj")).alias("not_object"))
    return records, malformed


def write_jsonl(df: DataFrame, path: str) -> None:
    """Write each row of ``df`` as one JSON object per line (gzipped text files)."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path, compression="gzip")
