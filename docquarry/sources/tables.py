"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(frame: DataFrame) -> DataFrame:
    """The frame's rows, written once below spark.checkpoint.dir: what is built on them is planned and run without what went before, and a lost executor
    costs nothing. Only a session on one machine gets a folder of its own where none is set."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='docquarry-')}")
    return frame.checkpoint()
