"""Taking in files by what is in them: unchanged ones are passed over, changed ones replaced, vanished ones dropped.

A source is a folder under the landing folder. Its fingerprint is the digest of
the names and digests of its files, in the order of the names, and of the
version of the rules that read them. The fingerprints of the last run are a
table beside the rows made from the sources; both are published together, so a
run that fails leaves the state that matches the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import snapshots

STATE = "source string, fingerprint string"


def fingerprints(files: DataFrame, rules: str) -> DataFrame:
    """``source, fingerprint`` of files (``source, name, content``)."""
    each = F.struct("name", F.sha2(F.coalesce("content", F.lit(b"")), 256).alias("digest"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda f: F.concat_ws(":", f["name"], f["digest"])), "\n")
    return files.groupBy("source").agg(F.sha2(F.concat(F.lit(rules + "\n"), text), 256).alias("fingerprint"))


def landed(spark: SparkSession, landing: str, pattern: str = "*") -> DataFrame:
    """``source, name, content`` of the files ``<source>/<name>`` under a landing folder."""
    path = F.col("_metadata.file_path")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(landing)
    return files.select(F.url_decode(F.regexp_extract(path, "([^/]+)/[^/]+$", 1)).alias("source"), F.url_decode(F.regexp_extract(path, "([^/]+)$", 1)).alias("name"), "content")


def compared(now: DataFrame, before: DataFrame) -> DataFrame:
    """``source, fingerprint, status``: new, changed, unchanged or gone."""
    met = now.join(before.select("source", F.col("fingerprint").alias("_before")), "source", "full_outer")
    status = F.when(F.col("_before").isNull(), "new").when(F.col("fingerprint").isNull(), "gone").when(F.col("fingerprint") == F.col("_before"), "unchanged").otherwise("changed")
    return met.select("source", "fingerprint", status.alias("status"))


def take_in(spark: SparkSession, landing: str, root: str, rows_of: Callable[[DataFrame], DataFrame], rules: str = "1", pattern: str = "*") -> DataFrame:
    """Bring the published table ``rows`` up to what has landed, and return ``source, status`` of this run.

    ``rows_of`` makes rows (with ``source``) of files; it sees only the files
    of sources that are new or changed. If nothing is, nothing is published.
    """
    files = landed(spark, landing, pattern)
    before = snapshots.read(spark, root, "state") if snapshots.exists(spark, root, "state") else spark.createDataFrame([], STATE)
    report = compared(fingerprints(files, rules), before)

    def write(store: Callable[[DataFrame, str], None]) -> None:
        store(report, "report")
        told = spark.read.parquet(store.path("report"))
        fresh = rows_of(files.join(told.where("status in ('new', 'changed')").select("source"), "source", "left_semi"))
        if snapshots.exists(spark, root, "rows"):
            kept = snapshots.read(spark, root, "rows").join(told.where("status = 'unchanged'").select("source"), "source", "left_semi")
            fresh = kept.unionByName(fresh, allowMissingColumns=True)
        store(fresh, "rows")
        store(told.where("status <> 'gone'").select("source", "fingerprint"), "state")

    if report.where("status <> 'unchanged'").isEmpty():
        return report.select("source", "status")
    snapshots.publish(spark, root, write)
    return snapshots.read(spark, root, "report").select("source", "status")
