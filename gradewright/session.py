"""Session helpers: a local session for tests and the shared working folder."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "gradewright") -> SparkSession:
    """Local session for tests and the benchmark; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


@functools.cache
def _local_parent() -> str:
    parent = tempfile.mkdtemp(prefix="gradewright-")
    atexit.register(shutil.rmtree, parent, ignore_errors=True)
    return parent


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach, for checkpoints and written tables.

    The cluster names the parent in ``spark.checkpoint.dir``. Only a local session
    may leave it unset; it then uses one temporary folder, removed at exit.
    """
    parent = spark.conf.get("spark.checkpoint.dir", None)
    if not parent:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        parent = _local_parent()
    return os.path.join(parent, f"{purpose}-{uuid.uuid4().hex}")


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in a fresh shared folder: computed once, and kept if an executor is lost."""
    path = shared_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
