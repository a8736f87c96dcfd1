"""Incremental ingest: a file stream whose batches replace what their sources had before."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F


def merged(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """Rows of re-processed sources give way to the new ones."""
    return old.join(new.select(source).distinct(), source, "left_anti").unionByName(new)


def latest_of_sources(rows: DataFrame, source: str, batch: str) -> DataFrame:
    """All rows of the last batch of each source."""
    last = rows.groupBy(source).agg(F.max(batch).alias(batch))
    return rows.join(last, [source, batch], "left_semi")


def ingest(spark: SparkSession, landing: str, table: str, state: str, schema: str, source: str) -> DataFrame:
    """Run the stream over all files that have landed since the last run and return the table's rows as of now.

    Each batch is written under its number, so that a batch that is run again
    overwrites itself; readers take the last batch of each source. ``state`` is
    the stream's checkpoint.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(landing)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return latest_of_sources(spark.read.option("basePath", table).parquet(table).drop("batch"), source, "_batch").drop("_batch")


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per type and window; works on a stream and on a table alike."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stored table as a stream of its files."""
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path.rstrip("/"))
    source = path if name.startswith("part-") or not name.endswith(".parquet") else folder
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", name).parquet(source) if source == folder else reader.parquet(path)
