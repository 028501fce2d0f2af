"""Session defaults shared by the engine, the tests and the bench."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: ANSI stays on; timestamps are UTC; AQE coalesces, splits skew and switches joins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "verdara", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(frame: DataFrame) -> DataFrame:
    """The same rows dealt evenly over as many tasks as a shuffle has, for work that weighs more than a row: a file of one
    row group is one task, whatever is computed from it."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application, unless PYTHONPATH already names it."""
    root = Path(__file__).resolve().parents[1]
    if spark.sparkContext.applicationId in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    made = shutil.make_archive(os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="verdara-")), "verdara"), "zip", root, "verdara")
    spark.sparkContext.addPyFile(made)
    _SHIPPED.add(spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path of the folder that executors share: spark.checkpoint.dir, or a temporary one on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="verdara-")
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
