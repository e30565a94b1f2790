"""New folders inside the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A path that isn't there yet, below spark.checkpoint.dir; where that is unset, below the temporary folder of a lone machine. A cluster without it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{root.rstrip('/')}/shoebox/{name}-{uuid.uuid4().hex}"
