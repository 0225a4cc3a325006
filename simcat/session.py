"""Session construction and the shared scratch location.

Everything a job writes between stages (snapshots, streamed feed files, streaming
checkpoints) goes below ``spark.checkpoint.dir``, the shared folder a cluster names.
Only when that setting is absent (local tests) do we point it at a fresh folder.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
}


def get_spark(master: str | None = None, app: str = "simcat", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``simcat`` importable in Python workers (once per SparkContext).

    The package is zipped in memory and written below the shared checkpoint
    folder (no machine-local scratch), then registered with ``addPyFile``."""
    import io
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    target = f"{shared_dir(spark, 'pyfiles')}/simcat.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(bytearray(buf.getvalue()))
    out.close()
    sc.addPyFile(target)
    _SHIPPED.add(key)


def configure(spark: SparkSession) -> None:
    """Session settings our plans rely on (idempotent)."""
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Per-row duplicate keys in JSON objects: keep the last one, like Python's json.
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")


def checkpoint_base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set on {master}: name a folder that the driver and all executors share")
        # One JVM (tests, a laptop): a fresh private folder is shared by definition.
        base = tempfile.mkdtemp(prefix="simcat-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A path below the shared checkpoint folder; unique per call by default."""
    tail = list(parts) + ([uuid.uuid4().hex] if unique else [])
    return "/".join([checkpoint_base(spark), "simcat", *tail])
