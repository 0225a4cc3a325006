"""Partitioning helpers."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame

_CACHED_AQE = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
# The setting is the session's: one caller at a time changes it.
_SETTING = threading.Lock()


def spread(df: DataFrame, min_partitions: int) -> DataFrame:
    """Round-robin a small ``df`` over ``min_partitions`` tasks before a CPU-bound stage.

    For inputs that are known to be one or a few files of one row group, which no scan
    setting can split. The number is the caller's and doesn't follow the cluster: an input
    with as many splits is returned unchanged, so nothing large is ever shuffled by this.

    Call it on a scan (or a scan plus narrow projections/filters), where counting
    splits is free."""
    if df.isStreaming:
        return df  # a stream's partitioning is set per micro-batch by its source
    if df.rdd.getNumPartitions() >= min_partitions:
        return df
    return df.repartition(min_partitions)


def kept(df: DataFrame) -> DataFrame:
    """``df`` persisted, its plan adapted to what it holds: by default a cached plan has as many tasks as there are
    shuffle partitions, however few its rows, and a hot key's join in it is not split."""
    conf = df.sparkSession.conf
    with _SETTING:
        was = conf.get(_CACHED_AQE)
        conf.set(_CACHED_AQE, "true")
        try:
            return df.persist()
        finally:
            conf.set(_CACHED_AQE, was)
