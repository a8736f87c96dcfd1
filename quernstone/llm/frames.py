"""What the ten operators share: row keys, lineage cuts, and text buffers.

Row keys. ``doc_id`` may be null or repeated, so operators that bring rows
back together do it by ``_row``, a number given to every row of the input.
``monotonically_increasing_id`` repeats its numbers when a scan is run again,
but not when the input comes out of a shuffle; ``keyed`` therefore writes such
an input to the checkpoint folder first.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

ROW = "_row"
_REPEATABLE = re.compile(r"^(Relation|LogicalRelation|LogicalRDD|LocalRelation|Project|Filter|SubqueryAlias|Union|View|OneRowRelation)\b")


def use_checkpoints(spark: SparkSession) -> None:
    """Point checkpoint() at ``spark.checkpoint.dir``; a temporary folder only where that is unset and all of Spark is one process (tests)."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder as a table of columns, which takes less room than ``cut``, and read again."""
    use_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def repeatable(df: DataFrame) -> bool:
    """True if another run of ``df`` gives the same rows in the same partitions: narrow steps over stored or checkpointed rows."""
    optimized = df._jdf.queryExecution().optimizedPlan()
    plan = optimized.toString()
    leaves = optimized.collectLeaves()
    made = [leaves.apply(i) for i in range(leaves.size())]
    if any(leaf.nodeName() == "LogicalRDD" and not leaf.rdd().isCheckpointed() for leaf in made):
        return False
    return all(_REPEATABLE.match(line.lstrip(" :+-")) for line in plan.splitlines() if line.strip())


def fixed(docs: DataFrame) -> DataFrame:
    """``docs`` itself if it is repeatable, else what the checkpoint folder keeps of it."""
    return docs if repeatable(docs) else cut(docs)


def keyed(docs: DataFrame, *more: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_row, doc_id, text`` and the columns ``more``; all else is left behind, so no names clash."""
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *[F.col(c) for c in more])
    return fixed(picked).withColumn(ROW, F.monotonically_increasing_id())


def keep_rows(docs: DataFrame, judge, *args) -> DataFrame:
    """``docs``, all columns, cut down to the ``_row`` numbers that ``judge(keyed docs, *args)`` returns."""
    stored, number = fixed(docs), ROW
    while number in docs.columns:
        number += "_"
    rows = stored.withColumn(number, F.monotonically_increasing_id())
    kept = judge(keyed(stored), *args).select(F.col(ROW).alias(number))
    return rows.join(kept, number, "left_semi").select(docs.columns)


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), ends
    return np.frombuffer(data, np.uint8), ends


def groups_of_rows(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row stands alone."""
    start, n = 0, len(ends) - 1
    while start < n:
        stop = int(np.searchsorted(ends, ends[start] + most, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop
