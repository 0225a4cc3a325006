"""Sharding by rendezvous hashing over weighted shards.

Every record key draws one number per shard; the shard with the smallest
``-ln(u) / weight`` owns the key. A key's numbers for the old shards don't change when a
shard is added, so rows move only into the new shard, and a shard of weight w gets a
share of w. The choice is a pure expression: no shuffle, no state.

Slots number the rows of a shard from 0 without gaps, in the order of the key's hash.
Rows are summed into cells of one key and a range of the rows' own hashes, cells into ranges of the
keys' hashes, and ranges into shards; a row's slot is the sum of what lies before it on each level. A window
holds the rows of a cell, the cells of a range, or the ranges of a shard, so neither a shard nor a key
that a third of the rows share is one task's work. Equal rows are counted before they are numbered and expanded
afterwards, so a record repeated any number of times is one row in the window.

Defined results: a null key is a key like any other; equal keys go to one shard; equal
rows get consecutive slots; an empty table gives an empty table; columns of any name
pass through (helper columns take names that don't clash; results replace columns of their names).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tmp_names, unit_hash, without

#: Hash ranges of a shard: 2 ** RANGE_BITS. Slots don't depend on it.
RANGE_BITS = 10
#: Cells of one key: 2 ** CELL_BITS ranges of its rows' hashes.
CELL_BITS = 8
#: Copies of one row that one array expands.
_EXPAND = 4096


def rendezvous_shard(weights: Sequence[float], *key: Column) -> Column:
    """The shard (0 to len(weights) - 1) that owns a key; ties go to the smaller shard."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a weight above 0")
    draws = [F.struct((-F.log(unit_hash(s, *key)) / F.lit(float(w))).alias("cost"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return F.array_min(F.array(*draws))["shard"]


def number_slots(df: DataFrame, shard: str, *key: str, slot: str = "slot", range_bits: int = RANGE_BITS) -> DataFrame:
    """Add ``slot``: the row's place in its shard, in the order of (hash of key, hash of row, other columns)."""
    df = without(df, slot)
    n, part, h, own, cell, at, base, first, i = tmp_names([*df.columns, slot], "copies", "range", "hash", "own", "cell", "at", "base", "first", "i")
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(n))
    counted = counted.withColumn(h, F.xxhash64(*[F.col(k) for k in key])).withColumn(own, F.xxhash64(*df.columns))
    counted = counted.withColumn(part, F.shiftrightunsigned(F.col(h), 64 - range_bits)).withColumn(cell, F.shiftrightunsigned(F.col(own), 64 - CELL_BITS))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda what, window: F.coalesce(F.sum(what).over(window), F.lit(0))
    cells = counted.groupBy(shard, part, h, cell).agg(F.sum(n).alias(at))
    ranges = cells.groupBy(shard, part).agg(F.sum(at).alias(at)).select(shard, part, upto(at, before(shard).orderBy(part)).alias(base))
    cells = cells.withColumn(at, upto(at, before(shard, part).orderBy(h, cell))).join(ranges, [shard, part])
    cells = cells.select(shard, h, cell, (F.col(base) + F.col(at)).alias(base))
    placed = counted.withColumn(at, upto(n, before(shard, h, cell).orderBy(own, *df.columns))).join(cells, [shard, h, cell])
    runs = placed.select(*df.columns, n, (F.col(base) + F.col(at)).alias(slot), F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(_EXPAND).cast("long"))).alias(first))
    rows = runs.select(*df.columns, slot, F.explode(F.sequence(F.col(first), F.least(F.col(first) + _EXPAND - 1, F.col(n) - 1))).alias(i))
    return rows.select(*df.columns, (F.col(slot) + F.col(i)).alias(slot))


def shard_records(df: DataFrame, weights: Sequence[float], *key: str, shard: str = "shard") -> DataFrame:
    """``df`` with the owning shard of each row's key; no shuffle."""
    return df.withColumn(shard, rendezvous_shard(weights, *[F.col(k) for k in key]))
