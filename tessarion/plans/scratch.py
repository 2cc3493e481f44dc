"""The shared folder for streaming checkpoints and intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the cluster's checkpoint folder, or in a temporary one where none is set and all runs on this machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
    return f"{root}/{tag}-{uuid.uuid4().hex}"
