"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simcat import session
from simcat.session import shared_dir

#: ASCII white space that separates words and is stripped from lines.
SPACES = " \t\n\x0b\x0c\r"
#: A word, in the regular expressions of Java, RE2 and Python alike.
WORD = r"[^\x20\x09-\x0D]+"

#: The white space of Unicode, for a character class.
UNICODE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

__all__ = ["SPACES", "UNICODE_SPACE", "WORD", "configure", "kept", "let_go", "materialise", "read_table", "shared_dir", "split_words", "tmp_names", "unit_hash", "without"]


def configure(spark: SparkSession) -> None:
    """Session settings of these operators: rows hold whole texts, so an Arrow batch is bounded in
    rows and in bytes."""
    session.configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts the lineage, and a lost
    executor costs a re-read, not a recomputation."""
    path = shared_dir(df.sparkSession, "llm", name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """The one large thing that a Python worker keeps from task to task."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """For tasks that need nothing kept: in a worker that served another operator before, its memory is free again."""
    if _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tmp_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names that clash with none of ``taken`` (compared as Spark does, without case)."""
    low = {c.lower() for c in taken}
    out = []
    for w in wanted:
        name = w
        while name.lower() in low:
            name = "_" + name
        low.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names: an operator's own columns replace them."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def split_words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def unit_hash(seed: int, *cols: Column) -> Column:
    """A double in (0, 1) that depends on the seed and the columns only."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), *cols), 11)
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
