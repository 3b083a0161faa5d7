"""Cutting lineage through the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a session of a single machine may leave that unset; a temporary folder
    is used then. On a cluster executors would not see each other's files there, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidebook-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def cut(frame: DataFrame) -> DataFrame:
    """The frame's rows, computed once and written as Parquet to the shared folder; later uses read the columns they need.

    The files are deleted when the driver ends, so results that read them must be written before.
    """
    spark = frame.sparkSession
    path = f"{shared_root(spark)}/kept-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(frame.schema).parquet(path)
