"""Folders for tables and checkpoints that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='foliant-')}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under a folder of our own, in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
    return f"{(base or _own_dir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"
