"""Sharding by sampled splitters.

Rows are ordered by (hash of the text, doc_id, row), so equal texts stand side
by side. A size-weighted sample of keys gives the quantile boundaries by which
rows are dealt into ranges; ranges that come out overfull are sampled again,
more densely, and divided. Running sums within the ranges and the ranges'
totals then give every row its exact place in the whole order, and the shards
are cut where the running size passes each n-th part of the total.

A cut that would fall inside a group of equal texts is moved to the group's
edge if the group is at most ``slack`` of a shard; a larger group is divided
by doc_id.

Law: ``bytes``; shard sizes differ by no more than a row, or by ``slack``.

Only the sample and the ranges' totals come to the driver: about PER_RANGE
keys and one row for each range. Ranges are as many as the input's size over
``range_bytes``, and MOST_RANGES at most: what is sorted in a range is a few
numbers for each document, not its text. The splitters are broadcast, and
found by binary search.

Defined cases: null text has size 1 and the crc32 of the empty string; rows
with null or repeated doc_ids are placed one by one (nulls first); an empty
table gives an empty result; a text of any length is one row, which no shard
divides; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .frames import ROW, cut, keyed

RANGE_BYTES = 128 << 20
LEAST_RANGES, MOST_RANGES = 64, 16_384
ATTEMPTS = 6
PER_RANGE = 32
OVERFULL = 2.0
SLACK = 0.005

Key = tuple[int, int, int]


def ranks(columns: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """For each row of ``columns``, how many of the sorted splitters are at or below it, compared column by column."""
    low, high = (np.searchsorted(splitters[0], columns[0], side) for side in ("left", "right"))
    if len(columns) == 1:
        return high
    out, tied = low.copy(), np.flatnonzero(high > low)
    for value in np.unique(columns[0][tied]):
        own = tied[columns[0][tied] == value]
        a, b = low[own[0]], high[own[0]]
        out[own] = a + ranks([c[own] for c in columns[1:]], [x[a:b] for x in splitters[1:]])
    return out


def _dealt(rows: DataFrame, splitters: list[Key]) -> DataFrame:
    """``rows`` with the number of their ``range``."""
    shared = rows.sparkSession.sparkContext.broadcast([np.array(c, np.int64) for c in zip(*splitters)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc_key", ROW)]
            at = ranks(own, shared.value) if shared.value else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], [*batch.schema.names, "range"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", range int")


def _sampled(rows: DataFrame, chance: Column, salt: int) -> list[Key]:
    """Keys drawn with the given chance each, by a hash of the key, so that the draw repeats."""
    draw = (F.xxhash64(F.lit(salt), "key", "doc_key", ROW).bitwiseAND(F.lit((1 << 40) - 1))) / float(1 << 40)
    return sorted(tuple(r) for r in rows.where(draw < chance).select("key", "doc_key", ROW).collect())


def _boundaries(sample: list[Key], parts: int) -> list[Key]:
    """Quantiles of the sample, moved to the start of their group unless one group fills whole quantiles."""
    picked = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    hot = {a[0] for a, b in zip(picked, picked[1:]) if a[0] == b[0]}
    least = -(1 << 63)
    return sorted({k if k[0] in hot else (k[0], least, least) for k in picked})


def placed(docs: DataFrame, shards: int, range_bytes: int = RANGE_BYTES, least_ranges: int = LEAST_RANGES, slack: float = SLACK) -> DataFrame:
    """``_row, doc_id, size, text_crc32, shard, slot`` for the rows of a ``keyed`` frame."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        ROW,
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 15), 16, 10).cast("long").alias("key"),
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_key"),
    )
    rows = cut(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = min(MOST_RANGES, max(least_ranges, -(-total // range_bytes)))
    splitters = _boundaries(_sampled(rows, F.col("size") * (parts * PER_RANGE / max(total, 1)), 0), parts)
    for attempt in range(1, ATTEMPTS + 1):
        dealt = _dealt(rows, splitters)
        sums = {r["range"]: r["s"] for r in dealt.groupBy("range").agg(F.sum("size").alias("s")).collect()}
        full = {k: s for k, s in sums.items() if s > OVERFULL * total / parts}
        if not full:
            break
        within = dealt.where(F.col("range").isin(list(full)))
        rate = parts * PER_RANGE * min(4.0**attempt / max(total, 1), 1 / sum(full.values()))  # no draw is expected to be larger than the first
        more = _sampled(within, F.col("size") * rate, attempt)
        extra: list[Key] = []
        bounds = [(-(1 << 63),) * 3, *splitters, ((1 << 63),) * 3]
        for k, s in full.items():
            own = more[bisect_left(more, bounds[k]) : bisect_left(more, bounds[k + 1])]
            extra += _boundaries(own, max(2, round(s * parts / total)))
        if set(extra) <= set(splitters):
            break  # what is left is one row, or a few, of great size
        splitters = sorted({*splitters, *extra})

    order = Window.partitionBy("range").orderBy("key", "doc_key", ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("range", "key")
    ranged = _dealt(rows, splitters).repartition(max(1, len(splitters) + 1), "range")
    totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("range").collect()
    offsets, before, index = [], 0, 0
    for r in totals:
        offsets.append((r["range"], before, index))
        before, index = before + r["bytes"], index + r["n"]
    offset = docs.sparkSession.createDataFrame(offsets, "range int, before long, first long")
    share = max(total, 1) / shards
    middle = F.col("before") + F.col("upto") - F.col("size") / 2
    group_middle = F.col("before") + (F.min(F.col("upto") - F.col("size")).over(group) + F.max("upto").over(group)) / 2
    small = (F.max("upto").over(group) - F.min(F.col("upto") - F.col("size")).over(group)) <= slack * share
    ordered = cut(
        ranged.withColumn("upto", F.sum("size").over(order))
        .withColumn("nth", F.row_number().over(order))
        .join(F.broadcast(offset), "range")
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.when(small, group_middle).otherwise(middle) / share)).cast("int"))
        .select(ROW, "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).alias("index"))
    )
    starts = ordered.groupBy("shard").agg(F.min("index").alias("start"))
    return ordered.join(F.broadcast(starts), "shard").select(ROW, "doc_id", "size", "text_crc32", "shard", (F.col("index") - F.col("start")).alias("slot"))


def shard(docs: DataFrame, shards: int = 8, **how) -> DataFrame:
    """One row per document: its size, its shard, and its gapless place within the shard."""
    return placed(keyed(docs), shards, **how).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
