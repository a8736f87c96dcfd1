"""Exact dedup by deterministic block naming, in DataFrame operations only.

A text's bytes are cut into blocks of fixed size. The distinct blocks are
sorted and numbered, so that two blocks have one number if and only if they
are equal. Then adjacent numbers are paired and the distinct pairs numbered
again, until every document is left with one number: its identity. Two
documents are equal if and only if they have as many blocks and the same
identity.

Only the first round moves text, and only once: distinct blocks meet under
(xxhash64, block), with map-side pre-aggregation, and documents then look
their blocks' numbers up by hash. Hashes under which two different blocks meet
are found by counting and looked up by hash and content instead, so that a
collision costs time but never joins two texts.

Defined cases: null text equals empty text; rows that share a doc_id are rows
like any others (of equal rows the one read last stays); a null doc_id counts
as the smallest; an empty table gives an empty result; a very long text is
many blocks, which are dealt out; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .frames import ROW, cut, keep_rows, keyed

BLOCK_BYTES = 8192


def _numbered(distinct: DataFrame, *by: str) -> DataFrame:
    """Sorted rows with a number each: unique, and the same when a task is run again."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def document_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES, digest=F.xxhash64) -> DataFrame:
    """``_row, blocks, name`` for the rows of a ``keyed`` frame; (blocks, name) is the identity of the text."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / block_bytes)).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.substring(F.col("data"), i * block_bytes + 1, F.lit(block_bytes)))
    blocks = (
        docs.select(ROW, data.alias("data"), F.coalesce(count, F.lit(1)).alias("blocks"))
        .select(ROW, "blocks", F.posexplode(cuts).alias("pos", "block"))
        .withColumn("h", digest("block"))
    )
    names = cut(_numbered(blocks.select("h", "block").distinct(), "h", "block").select("h", "name"))
    clashes = cut(names.groupBy("h").count().where("count > 1").select("h"))
    current = blocks.select(ROW, "blocks", "pos", "h").join(names, "h")
    if not clashes.isEmpty():
        clashed = blocks.join(clashes, "h", "left_semi")
        exact = cut(_numbered(clashed.select("h", "block").distinct(), "h", "block")).withColumn("name", -1 - F.col("name"))
        current = current.join(clashes, "h", "left_anti").unionByName(clashed.join(exact, ["h", "block"]).drop("block"))
    current = cut(current.select(ROW, "blocks", "pos", "name"))

    done, current = current.where("blocks = 1"), current.where("blocks > 1")
    widest = current.agg(F.max("blocks")).first()[0] or 1
    while widest > 1:
        half = (F.col("pos") / 2).cast("int")
        first, second = (F.max(F.when(F.col("pos") % 2 == side, F.col("name"))) for side in (0, 1))
        # A last name without a neighbour is paired with null.
        pairs = cut(current.groupBy(ROW, "blocks", half.alias("pos")).agg(first.alias("a"), second.alias("b")))
        named = cut(_numbered(pairs.select("a", "b").distinct(), "a", "b"))
        current = (
            pairs.alias("p")
            .join(named.alias("n"), F.col("p.a").eqNullSafe(F.col("n.a")) & F.col("p.b").eqNullSafe(F.col("n.b")))
            .select(ROW, "blocks", "pos", "name")
        )
        widest = (widest + 1) // 2
    return done.select(ROW, "blocks", "name").unionByName(current.select(ROW, "blocks", "name"))


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES, digest=F.xxhash64) -> DataFrame:
    """``_row, doc_id, keep_id, group_size, kept, text_sha256`` for the rows of a ``keyed`` frame."""
    about = docs.select(ROW, "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    members = cut(document_names(docs, block_bytes, digest).join(about, ROW))
    best: Column = F.max(F.struct("doc_id", ROW))
    groups = cut(members.groupBy("blocks", "name").agg(best.alias("best"), F.count("*").alias("group_size")))
    return members.join(groups, ["blocks", "name"]).select(
        ROW,
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col(ROW) == F.col(f"best.{ROW}")).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document with the group it belongs to and whether it stays (the largest doc_id does)."""
    return exact_groups(keyed(docs), block_bytes).drop(ROW)


def drop_exact_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs``, all columns, with one row of each group of equal texts."""
    return keep_rows(docs, lambda rows: exact_groups(rows, block_bytes).where("kept"))
