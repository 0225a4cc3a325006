"""A rank index for pages (S-4): the catalog in files of ascending ids, and how many rows lie before each file.

``build_ranked`` range-partitions a catalog by id, sorts it inside, and writes one file per partition, with an index table of
(file, rows, rows before it). ``page`` asks the index which files hold the wanted ranks and reads only these, so the
page at offset N/2 costs what the first one costs: no sort of the rows in front of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simcat.session import shared_dir

# Rows a file is planned for; files that one window numbers.
FILE_ROWS, _BLOCK = 1_000_000, 1024


@dataclass
class RankedCatalog:
    """A written layout: the folder of its files, its index, its columns."""

    spark: SparkSession
    path: str
    schema: object

    def index(self) -> DataFrame:
        return self.spark.read.schema("name string, file long, n long, before long").parquet(f"{self.path}/index")

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """``ORDER BY id LIMIT limit OFFSET offset``, from the files that hold these ranks."""
        if limit < 0 or offset < 0:
            raise ValueError("limit and offset must not be negative")
        inside = (F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)
        files = self.index().filter(inside).orderBy("file").select("name", "before").collect()  # bounded by the page, not the catalog
        if not files or not limit:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{r.name}" for r in files])
        return rows.orderBy("id").offset(offset - files[0].before).limit(limit)


def build_ranked(catalog: DataFrame, path: str | None = None, file_rows: int = FILE_ROWS) -> RankedCatalog:
    """Write the layout of a catalog whose ``id`` is unique; null ids come first."""
    spark = catalog.sparkSession
    path = path or shared_dir(spark, "ranked")
    files = 1 + catalog.count() // file_rows
    (catalog.repartitionByRange(files, "id").sortWithinPartitions("id").write.option("maxRecordsPerFile", 0).parquet(f"{path}/data"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    # file numbers ascend with the ids: parts are numbered by their partition
    written = spark.read.schema(catalog.schema).parquet(f"{path}/data").select(F.col("_metadata.file_path").alias("path"))
    counts = written.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select(name.alias("name"), "n")
    counts = counts.withColumn("file", F.regexp_extract("name", r"part-(\d+)", 1).cast("long")).withColumn("block", F.floor(F.col("file") / _BLOCK))
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))
    # one row per 1024 files in this window
    blocks = blocks.select("block", upto(Window.partitionBy(F.lit(0)).orderBy("block")).alias("block_before"))
    inside = counts.withColumn("inside", upto(Window.partitionBy("block").orderBy("file"))).join(blocks, "block")
    inside.select("name", "file", "n", (F.col("block_before") + F.col("inside")).alias("before")).coalesce(1).write.parquet(f"{path}/index")
    return RankedCatalog(spark, path, catalog.schema)
