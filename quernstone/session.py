"""Session settings shared by tests, the benchmark and ad-hoc use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "quernstone", cpus: int | str | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the parity rules rely on (UTC, AQE).

    On a cluster the caller brings its own session; nothing in the package
    depends on this function having been used.
    """
    cpus = cpus or os.environ.get("QUERNSTONE_CPUS", "*")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
