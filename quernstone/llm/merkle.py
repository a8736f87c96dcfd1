"""A Merkle manifest of a table: bottom-up build, top-down push of the proofs.

A row's leaf is the digest of its fields. Per group (a language), leaves in
the order of doc_id become a tree of runs of ``WIDTH``; the groups' roots, in
the order of the groups, become one more tree of the same kind. Every level is
written as a table with a row for each run: the run's place and the digests in
it. The next level up is made of the digests of these rows.

Proofs go the other way. The root's is empty; a run takes the proof of its
parent, and each of its children prepends its own siblings. What is shuffled
is one proof for each run of leaves, not one for each leaf; the leaves' own
proofs are made from it where they are used.

Places are numbered without a task for a whole group: rows are dealt into
ranges by (group, doc_id, leaf, row) and sorted there, and what stands before a
range in its group is counted per range. So a group may be of any size.

Defined cases: a null field is ``-``, any other its length in bytes, ``:`` and
itself, so that no two rows have one image; null groups and null doc_ids come
first; rows with one doc_id stand in the order of their leaves, and equal rows
have equal leaves, so their order does not show in the digests; an empty table
gives an empty result; a text may be of any length; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .frames import ROW, stored

WIDTH = 8
ROWS_PER_RANGE = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left: string, right: string>>"

def image(value: Column) -> Column:
    """A value with its length in bytes before it; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*[image(f) for f in fields]), 256)

def proof_text(proof: Column) -> Column:
    """All siblings of a proof, from the leaf's up to the root's children."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")

def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))

def places(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``place`` (from 0, by ``order`` within ``group``) and ``n``, the size of the group."""
    session = rows.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_RANGE))
    ranged = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    kept = stored(ranged.withColumn("at", F.monotonically_increasing_id())).withColumn("range", F.shiftright("at", 33))
    own = kept.groupBy(group, "range").agg(F.count("*").alias("own"), F.min("at").alias("start"))
    ranges = Window.partitionBy(group)  # a row for each range of a group
    shift = F.coalesce(F.sum("own").over(ranges.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("start")
    offsets = own.select(group, "range", shift.alias("shift"), F.sum("own").over(ranges).alias("n"))
    return kept.join(offsets, [group, "range"]).select(*rows.columns, (F.col("at") + F.col("shift")).alias("place"), "n")

def _digests(runs: DataFrame) -> DataFrame:
    """The nodes that runs make: a run's digest, or its only node's where a group has no other."""
    joined = F.array_join(F.col("kids.digest"), "")
    made = F.when(F.col("n") == 1, joined).otherwise(F.sha2(joined, 256))
    return runs.select("group", F.col("run").alias("place"), F.ceil(F.col("n") / WIDTH).alias("n"), made.alias("digest"))

def _build(leaves: DataFrame, *kept: str) -> tuple[list[DataFrame], DataFrame]:
    """Stored runs of every level, leaves first, and ``group, digest`` of the roots."""
    levels, roots, nodes, extra = [], None, leaves, kept
    most = WIDTH
    while most > 1:
        kid = F.struct("place", "digest", *extra)
        gathered = nodes.groupBy("group", "n", F.floor(F.col("place") / WIDTH).alias("run")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        levels.append(stored(gathered))
        made = _digests(levels[-1])
        done = made.where("n = 1").select("group", "digest")
        roots = done if roots is None else roots.union(done)
        most = made.agg(F.max("n")).first()[0] or 1
        nodes, extra = made.where("n > 1"), ()
    return levels, roots

def _push(levels: list[DataFrame], roots: DataFrame, *kept: str) -> DataFrame:
    """``kept``, ``digest``, ``subroot`` and ``proof`` of every leaf; ``roots`` has ``group, subroot, proof``."""
    above = None
    for k, runs in reversed(list(enumerate(levels))):
        parents = runs.where(F.col("n") <= WIDTH).join(roots, "group")
        if above is not None:
            parents = parents.unionByName(runs.where(F.col("n") > WIDTH).join(above, ["group", "run"]))
        others = lambda side: F.array_join(F.transform(F.filter("kids", side), lambda x: x["digest"]), "")
        at = F.col("kid.place")
        step = F.struct(others(lambda x: x["place"] < at).alias("left"), others(lambda x: x["place"] > at).alias("right"))
        proof = F.concat(F.array(step), "proof")
        if k == 0:
            proof = F.when(F.col("n") == 1, F.col("proof")).otherwise(proof)  # a lone leaf is its group's root
        each = parents.select("*", F.explode("kids").alias("kid"))
        if k == 0:
            return each.select(*[F.col(f"kid.{c}").alias(c) for c in kept], F.col("kid.digest").alias("digest"), "subroot", proof.alias("proof"))
        above = each.select("group", at.alias("run"), "subroot", proof.alias("proof"))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", more: dict[str, Column] | None = None) -> DataFrame:
    """``order, leaf, subroot, root, proof`` of every row, and what ``more`` makes of its columns.

    ``proof`` is an array of the siblings left and right of the leaf, of the
    node above it, and so on to the root.
    """
    more = more or {}
    picked = docs.select(F.col(order).alias("id"), image(F.col(group)).alias("group"), leaf(*[F.col(f) for f in fields]).alias("digest"), *[c.alias(f"more_{k}") for k, c in more.items()])
    leaves = stored(picked.withColumn(ROW, F.monotonically_increasing_id()))
    kept = ["id", *[f"more_{k}" for k in more]]
    levels, subroots = _build(places(leaves, "group", "id", "digest", ROW), *kept)
    named = subroots.select(F.lit(0).alias("group"), F.col("group").alias("member"), F.expr("if(`group` = '-', null, substr(`group`, instr(`group`, ':') + 1))").alias("name"), "digest")
    top, roots = _build(places(stored(named), "group", "name", "member"), "member")
    root = roots.first()
    whole = root["digest"] if root else None
    start = roots.select("group", F.col("digest").alias("subroot"), F.array().cast(PROOF).alias("proof"))
    proofs = stored(_push(top, start, "member").select(F.col("member").alias("group"), F.col("digest").alias("subroot"), "proof"))
    told = _push(levels, proofs, *kept)
    return told.select(F.col("id").alias(order), F.col("digest").alias("leaf"), "subroot", F.lit(whole).cast("string").alias("root"), "proof", *[F.col(f"more_{k}").alias(k) for k in more])
