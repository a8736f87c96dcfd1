"""Tables published together: versions in folders of their own, and one pointer that is replaced in one step.

A root folder holds ``versions/<name>/<table>`` and the file ``current``,
which lists the published versions, the newest first. A writer fills a new
folder and then renames a new pointer over the old one, which the file systems
of clusters do atomically. So readers see the old tables or the new ones, whole,
and a writer that fails midway leaves nothing that a reader would find. There
is one writer at a time; of two, the one that renames last would win.

Versions are read under the columns that a table has now: one that an older
version lacks is filled with its default, one that it has stays as it is,
nulls included. Defaults are kept beside the tables and only ever added to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

KEPT_VERSIONS = 3


def _files(spark: SparkSession, root: str):
    """Hadoop's view of the folder, and the class of its paths."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = hadoop.Path(root)
    return hadoop.FileContext.getFileContext(path.toUri(), conf), path.getFileSystem(conf), hadoop


def _read(spark: SparkSession, root: str, name: str, none):
    _, files, hadoop = _files(spark, root)
    path = hadoop.Path(f"{root}/{name}")
    if not files.exists(path):
        return none
    stream = files.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _put(spark: SparkSession, root: str, name: str, value) -> None:
    """Write a small file whole, by renaming it over the one that is there."""
    context, files, hadoop = _files(spark, root)
    fresh = hadoop.Path(f"{root}/.{name}-{uuid.uuid4().hex}")
    stream = files.create(fresh, True)
    stream.write(bytearray(json.dumps(value).encode()))
    stream.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = getattr(spark.sparkContext._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    context.rename(fresh, hadoop.Path(f"{root}/{name}"), over)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all that is in it, if it is there."""
    _, files, hadoop = _files(spark, path)
    files.delete(hadoop.Path(path), True)


def versions(spark: SparkSession, root: str) -> list[str]:
    """Published versions, the current one first; none before the first publication."""
    return _read(spark, root, "current", [])


def publish(spark: SparkSession, root: str, write: Callable[[Callable[[DataFrame, str], None]], None], keep: int = KEPT_VERSIONS) -> str:
    """Run ``write``, which gets a function (frame, table) that stores a table of the new version (where ``path(table)`` of it says), then make that version current.

    Tables that it does not write are taken over from the current version. If
    it raises, nothing is published and what it stored is deleted. Versions
    beyond ``keep`` are deleted; readers that began with one must be done.
    """
    before, name, written = versions(spark, root), uuid.uuid4().hex, {}

    def store(df: DataFrame, table: str) -> None:
        path = f"versions/{name}/{table}"
        df.write.parquet(f"{root}/{path}")
        written[table] = path

    store.path = lambda table: f"{root}/{written[table]}"
    _, files, hadoop = _files(spark, root)
    try:
        write(store)
        tables = {**_tables(spark, root, before[0]), **written} if before else written
        _put(spark, root, f"tables-{name}", tables)
        _put(spark, root, "current", [name, *before][:keep])
    except BaseException:
        files.delete(hadoop.Path(f"{root}/versions/{name}"), True)
        raise
    _tidy(spark, root)
    return name


def _tables(spark: SparkSession, root: str, version: str) -> dict[str, str]:
    return _read(spark, root, f"tables-{version}", {})


def _tidy(spark: SparkSession, root: str) -> None:
    """Delete the versions that no published one uses."""
    _, files, hadoop = _files(spark, root)
    known = versions(spark, root)
    used = {path.split("/")[1] for v in known for path in _tables(spark, root, v).values()} | set(known)
    for status in files.listStatus(hadoop.Path(f"{root}/versions")):
        if status.getPath().getName() not in used:
            files.delete(status.getPath(), True)
    for status in files.listStatus(hadoop.Path(root)):
        name = status.getPath().getName()
        if name.startswith("tables-") and name.removeprefix("tables-") not in known:
            files.delete(status.getPath(), False)


def rollback(spark: SparkSession, root: str) -> str:
    """Make the version before the current one current again."""
    known = versions(spark, root)
    if len(known) < 2:
        raise ValueError("there is no version to go back to")
    _put(spark, root, "current", known[1:])
    return known[1]


def read(spark: SparkSession, root: str, table: str, version: str | None = None) -> DataFrame:
    """A table of the current version, or of the one named, under the table's columns of today."""
    version = version or next(iter(versions(spark, root)), None)
    path = _tables(spark, root, version).get(table) if version else None
    if path is None:
        raise ValueError(f"no published table {table}")
    rows = spark.read.parquet(f"{root}/{path}")
    for column, (kind, default) in _read(spark, root, f"columns-{table}", {}).items():
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(default).cast(kind))
    return rows


def exists(spark: SparkSession, root: str, table: str) -> bool:
    known = versions(spark, root)
    return bool(known) and table in _tables(spark, root, known[0])


def add_columns(spark: SparkSession, root: str, table: str, columns: dict[str, tuple[str, object]]) -> list[str]:
    """Give a table columns (name to type and default) and return those that it did not have; nothing is rewritten, a second call adds nothing."""
    known = _read(spark, root, f"columns-{table}", {})
    stored = set(read(spark, root, table).columns) if exists(spark, root, table) else set()
    new = {c: list(v) for c, v in columns.items() if c not in known and c not in stored}
    if new:
        _put(spark, root, f"columns-{table}", {**known, **new})
    return sorted(new)


def history(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All published versions of a table as one frame, with ``version`` (0 the oldest); columns that a version lacks have their defaults, or are null."""
    every = None
    for age, version in enumerate(reversed(versions(spark, root))):
        if table in _tables(spark, root, version):
            part = read(spark, root, table, version).withColumn("version", F.lit(age))
            every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    return every
