"""Cutting lineage in a folder that every executor and the driver share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named is None:
        named = sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        named = tempfile.mkdtemp(prefix="voxloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back from there.

    The result survives lost executors: unlike a local checkpoint, no copy lives
    on one machine only.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
