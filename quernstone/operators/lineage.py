"""Cutting lineage between the rounds of an iterative operator, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all of Spark is one process (tests)."""
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        known = spark.conf.get("spark.checkpoint.dir", None)
        if not known and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(known or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        known = spark.sparkContext.getCheckpointDir()
    return known


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder; what follows starts from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
