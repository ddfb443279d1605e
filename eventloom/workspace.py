"""Tables that the engine derives and keeps: the full-text index and what else is written once and read often."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir; only a local session may go without that setting."""
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/store-{context.applicationId}"
