"""A file feed that grows over time, and the streams that follow it.

A feed is a folder of Parquet files below the shared checkpoint folder. Data
arrives as a sequence of appends; each append is an ordinary distributed write
(one file per task, nothing funnelled through one task or the driver). After
every arrival the consuming stream is run once with ``availableNow``: it picks up
exactly the files that arrived since its last run as one micro-batch (or as
several when ``maxFilesPerTrigger`` bounds a batch), then stops. The stream's
checkpoint carries its progress from one run to the next, as it would across
restarts of a long-running query.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from simcat.session import shared_dir


def read_feed_stream(spark: SparkSession, source_dir: str, schema, max_files: int | None = None) -> DataFrame:
    """A file feed as a stream. ``max_files`` caps the files per micro-batch (the
    load-batch knob, and the bound on what one key brings to a stateful operator
    in one trigger); without it a run takes everything that has arrived."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(source_dir)


def deliver(spark: SparkSession, arrivals: Sequence[DataFrame],
            on_arrival: Callable[[str], None] | None = None) -> str:
    """Append each DataFrame of ``arrivals`` to a fresh feed folder, in order, and
    call ``on_arrival(folder)`` after each one. Returns the folder.

    Give each arrival as a filter on source columns (e.g. a time range) so the
    predicate reaches the scan and every append reads only its own rows."""
    path = shared_dir(spark, "feed")
    for df in arrivals:
        df.write.mode("append").parquet(path)
        if on_arrival is not None:
            on_arrival(path)
    return path
