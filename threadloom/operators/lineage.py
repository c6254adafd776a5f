"""Cutting lineage and keeping tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local master without one gets a folder of its own, a cluster is told to set it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not base and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="threadloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint."""
    shared(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared(spark).rstrip('/')}/{uuid.uuid4().hex}"
