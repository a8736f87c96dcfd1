"""MinHash near-dedup with odd sketches.

A document's set holds the hashes of its distinct word shingles. Documents
with one and the same set form a class, of which one member goes on. From
``SAMPLES`` MinHash samples come ``SAMPLES // ROWS`` band keys and an odd
sketch: a bitmap in which each sample flips one bit. Classes that share a band
are candidates; the population count of the XOR of two sketches estimates
their similarity, candidates far below the threshold are left out, and the
others are confirmed on their full sets. Components of the confirmed links are
the groups.

A second odd sketch is folded from the set itself. Its XOR never has more bits
than the sets differ in, so too many bits prove that a pair is below the
threshold; for sets of up to some thousand shingles this is nearly exact.

At the threshold of 0.8 a pair is missed by all 40 bands of 5 with probability
1.2e-7, and by the sketch (whose limit lies 6 standard deviations off) with
less.

A band's members are not paired with each other. First each is paired with
three pivots of the band: the one that shares bands with the most others, the
least, and one more; this links nearly all groups. Then only members of
different components can add to the result: those outside the band's largest
component are compared with all of the band, each pair in the first band that
it shares.

A band with many of those outside (``MOST_OUTSIDE``) is not compared in this
way. Its sets are put in one order, rare shingles first, and two that reach the
threshold then share one of their first shingles, of which the sizes of both
say how many count. So what such texts have in common, and brought them into
one band, is not met again unless it fills nearly all of them; the join on
these shingles loses no pair.

Defined cases: null and empty texts have empty sets and are linked with
nothing; of fewer words than a shingle the whole sequence is the one shingle;
rows with null or repeated doc_ids are documents of their own (null doc_ids
sort last; a group of null doc_ids only has a null component_id, and all of its
rows have it; of a group ``drop_near_copies`` keeps one row all the same); an empty
table gives an empty result; very long texts are sliced on their own, their set
in memory; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .frames import ROW, bytes_of, cut, groups_of_rows, keep_rows, keyed
from .hashing import LOWER, Words, mix

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 80
SAMPLES, ROWS = 200, 5
SKETCH_LONGS = 16
DEVIATIONS = 6.0
SLICE_BYTES = 1 << 18
SLICE_ROWS, SLICE_MEMBERS = 1024, 1 << 18
MOST_OUTSIDE = 512
FREQUENCY_BUCKETS = 1 << 18
SIZE_STEP = 1.05


def _sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of every text, in order."""
    data, ends = bytes_of(texts)
    for a, b in groups_of_rows(ends, SLICE_BYTES):
        words = Words(LOWER[data[ends[a] : ends[b]]], ends[a : b + 1] - ends[a])
        count = np.diff(words.first)
        full = words.runs(np.arange(max(0, len(words) - width + 1)), width)
        for i in range(b - a):
            first, n = words.first[i], int(count[i])
            if n >= width:
                yield a + i, np.unique(full[first : first + n - width + 1])
            elif n:
                yield a + i, words.runs(np.array([first]), n)
            else:
                yield a + i, np.zeros(0, np.uint64)


def _odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Documents x SKETCH_LONGS: every sample flips the bit that its number and value choose."""
    bits = SKETCH_LONGS * 64
    at = mix(samples + (np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]) % np.uint64(bits)
    sketch = np.zeros((samples.shape[1], bits), np.uint8)
    docs = np.arange(samples.shape[1])
    for row in at.astype(np.int64):
        sketch[docs, row] ^= 1
    return np.packbits(sketch, axis=1).view(np.int64)


def _odd_sets(members: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Documents x SKETCH_LONGS: every member of a set flips the bit that it chooses."""
    bits = SKETCH_LONGS * 64
    at = np.repeat(np.arange(len(sizes)) * bits, sizes) + (mix(members + np.uint64(2)) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=len(sizes) * bits) & 1).astype(np.uint8).reshape(-1, bits), axis=1).view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``_row, doc_id, n, k1, k2, bands, sketch, odd`` of a ``keyed`` frame; (n, k1, k2) names the set."""
    factors = np.random.default_rng(7).integers(1 << 62, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
    weights = np.random.default_rng(8).integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)

    def signed(part: pa.RecordBatch, own: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in own])
        filled = np.flatnonzero(sizes)
        k1, k2 = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        bands = np.zeros((len(own), SAMPLES // ROWS), np.uint64)
        sketch, odd = np.zeros((len(own), SKETCH_LONGS), np.int64), np.zeros((len(own), SKETCH_LONGS), np.int64)
        if len(filled):
            every = np.concatenate([own[i] for i in filled])
            at = np.concatenate([[0], np.cumsum(sizes[filled])[:-1]])
            k1[filled] = np.add.reduceat(mix(every), at).view(np.int64)
            k2[filled] = np.bitwise_xor.reduceat(mix(every + np.uint64(1)), at).view(np.int64)
            samples = np.empty((SAMPLES, len(filled)), np.uint64)
            for k in range(SAMPLES):
                samples[k] = np.minimum.reduceat(every * factors[k], at)
            for band in range(SAMPLES // ROWS):
                rows = mix(samples[band * ROWS : (band + 1) * ROWS]) * weights[:, None]
                bands[filled, band] = mix(rows.sum(axis=0, dtype=np.uint64) + np.uint64(band))
            sketch[filled], odd[filled] = _odd_sketch(samples), _odd_sets(every, sizes[filled])
        lists = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.reshape(-1).view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(sizes.astype(np.int64)), pa.array(k1), pa.array(k2), lists(bands), lists(sketch), lists(odd)],
            [ROW, "doc_id", "n", "k1", "k2", "bands", "sketch", "odd"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, own, held = 0, [], 0
            for at, members in _sets(batch.column(2), width):
                own.append(members)
                held += len(members)
                if at + 1 == batch.num_rows or len(own) == SLICE_ROWS or held >= SLICE_MEMBERS:  # the sets of a batch are never all held
                    yield signed(batch.slice(start, len(own)), own)
                    start, own, held = at + 1, [], 0

    return docs.select(ROW, "doc_id", "text").mapInArrow(run, f"{ROW} long, doc_id long, n long, k1 long, k2 long, bands array<long>, sketch array<long>, odd array<long>")


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    """``_row, members``: the set itself, for confirming links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.view(np.int64) for _, s in _sets(part.column(1), width)], pa.list_(pa.int64()))], [ROW, "members"])

    return docs.select(ROW, "text").mapInArrow(run, f"{ROW} long, members array<long>")


def most_bits(percent: int) -> int:
    """The highest XOR population count at which a pair may still reach the threshold."""
    bits, miss = SKETCH_LONGS * 64, 1 - percent / 100
    differing = SAMPLES * miss + DEVIATIONS * (SAMPLES * miss * (1 - miss)) ** 0.5
    expected = bits / 2 * (1 - (1 - 2 / bits) ** (2 * differing))
    return int(expected + DEVIATIONS * (bits / 4 * (1 - (1 - 4 / bits) ** (2 * differing))) ** 0.5) + 1


def _likely(a: str, b: str, percent: int) -> Column:
    """Sizes and sketches of two classes allow the threshold."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")

    def differing(sketch: str) -> Column:
        return sum((F.bit_count(F.get(f"{a}.{sketch}", i).bitwiseXOR(F.get(f"{b}.{sketch}", i))) for i in range(SKETCH_LONGS)), F.lit(0))

    possible = (100 + percent) * differing("odd") <= (100 - percent) * (small + large)
    return (100 * small >= percent * large) & possible & (differing("sketch") <= most_bits(percent))


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of rows whose full sets reach the threshold."""
    nodes = pairs.select(F.col("a").alias(ROW)).union(pairs.select(F.col("b").alias(ROW))).distinct()
    sets = _full_sets(docs.join(nodes, ROW, "left_semi"), width)
    both = pairs.join(sets.select(F.col(ROW).alias("a"), F.col("members").alias("ma")), "a").join(sets.select(F.col(ROW).alias("b"), F.col("members").alias("mb")), "b")
    common = F.size(F.array_intersect("ma", "mb"))
    return both.where(100 * common >= percent * (F.size("ma") + F.size("mb") - common)).select("a", "b")


def _first_shingles(members: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a set meets those of its size class and of each near one, and its side of them (0 smaller, 1 larger, 2 equal class)."""
    n = len(members)
    order = members[np.lexsort((members, counts[(mix(members) % np.uint64(len(counts))).astype(np.int64)]))]
    least = lambda k: max(1, math.ceil(SIZE_STEP**k - 1e-9))
    own = int(math.log(n) / math.log(SIZE_STEP) + 1e-9)
    while least(own + 1) <= n:  # rounding
        own += 1
    reach = math.ceil(math.log(100 / percent) / math.log(SIZE_STEP)) + 1
    keys, sides = [], []
    for other in range(max(0, own - reach), own + reach + 1):
        a, b = min(own, other), max(own, other)
        common = -(-percent * (least(a) + least(b)) // (100 + percent))
        if common <= n:
            keys.append(mix(order[: n - common + 1] + mix(np.array([a * 100_003 + b], np.uint64))))
            sides.append(np.full(len(keys[-1]), 2 if other == own else int(other < own), np.int8))
    return np.concatenate(keys), np.concatenate(sides)


def _alike(rows: DataFrame, docs: DataFrame, sketches: DataFrame, width: int, percent: int) -> DataFrame:
    """Likely pairs ``a, b`` among the rows (``_row, component``) of different components, by their first shingles in the order of frequency."""
    sets = _full_sets(docs.join(rows.select(ROW), ROW, "left_semi"), width)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(1).flatten().to_numpy().view(np.uint64)
            bucket, n = np.unique((mix(members) % np.uint64(FREQUENCY_BUCKETS)).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], ["bucket", "n"])

    told = sets.mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a number for each bucket
    counts = np.zeros(FREQUENCY_BUCKETS, np.int64)
    counts[told["bucket"].to_numpy()] = told["n"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_numpy(), []
            for i, own in enumerate(batch.column(1)):
                keys, sides = _first_shingles(own.values.to_numpy().view(np.uint64), shared.value, percent)
                out.append((np.full(len(keys), ids[i]), keys, sides))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1].view(np.int64)), pa.array(columns[2])], [ROW, "key", "side"])

    met = cut(sets.mapInArrow(first, f"{ROW} long, key long, side tinyint").join(rows, ROW))
    several = met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = met.join(several, "key")
    x, y = met.where("side <> 1").alias("x"), met.where("side <> 0").alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & ((F.col("x.side") == 0) | (F.col(f"x.{ROW}") < F.col(f"y.{ROW}")))
    pairs = cut(x.join(y, apart).select(F.least(f"x.{ROW}", f"y.{ROW}").alias("a"), F.greatest(f"x.{ROW}", f"y.{ROW}").alias("b")).distinct())
    both = pairs.join(sketches.alias("x"), F.col("a") == F.col(f"x.{ROW}")).join(sketches.alias("y"), F.col("b") == F.col(f"y.{ROW}"))
    return both.where(_likely("x", "y", percent)).select("a", "b")


def near_groups(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``_row, doc_id, n_shingles, component_id, kept`` for the rows of a ``keyed`` frame."""
    all_rows = cut(signatures(docs, width))
    filled = all_rows.where("n > 0")
    classes = cut(filled.groupBy("n", "k1", "k2").agg(F.min(ROW).alias("class")))
    heads = filled.join(classes.select(F.col("class").alias(ROW)), ROW, "left_semi")
    banded = heads.select(ROW, F.explode("bands").alias("band"))
    held = cut(banded.groupBy("band").agg(F.count("*").alias("held")).where("held > 1"))
    shared = cut(banded.join(held, "band"))
    central = cut(shared.groupBy(ROW).agg(F.sum("held").alias("reach")))
    top = F.max(F.struct("reach", ROW))
    any_ = F.min(F.struct(F.xxhash64(ROW).alias("h"), ROW))
    bands = cut(shared.join(central, ROW).groupBy("band").agg(F.min(ROW).alias("lo"), top.alias("top"), any_.alias("any")))

    sketches = heads.select(ROW, "n", "sketch", "odd")
    pivots = F.explode(F.array_distinct(F.array("lo", f"top.{ROW}", f"any.{ROW}")))
    stars = shared.join(bands, "band").select(ROW, pivots.alias("p")).where(f"{ROW} <> p").select(F.least(ROW, "p").alias("a"), F.greatest(ROW, "p").alias("b")).distinct()
    likely = stars.join(sketches.alias("x"), F.col("a") == F.col(f"x.{ROW}")).join(sketches.alias("y"), F.col("b") == F.col(f"y.{ROW}")).where(_likely("x", "y", percent))
    links = cut(_confirmed(cut(likely.select("a", "b")), docs, width, percent))
    labels = cut(components(links))

    # What is left to compare: members of one band that are not yet in one component.
    label = F.coalesce("component", ROW).alias("component")
    labelled = shared.join(labels.withColumnRenamed("node", ROW), ROW, "left").select("band", ROW, label)
    sizes = labelled.groupBy("band", "component").count()
    mixed = cut(sizes.groupBy("band").agg(F.count("*").alias("kinds"), F.max_by("component", F.struct("count", "component")).alias("main")).where("kinds > 1").select("band", "main"))
    if not mixed.isEmpty():
        open_rows = labelled.join(mixed, "band")
        outside = open_rows.where("component <> main").groupBy("band").agg(F.count("*").alias("outside"))
        open_rows = cut(open_rows.join(cut(outside), "band"))
        few = open_rows.where(F.col("outside") <= MOST_OUTSIDE).join(heads.select(ROW, "n", "sketch", "odd", "bands"), ROW)
        x, y = few.where("component <> main").alias("x"), few.alias("y")
        first_shared = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), True) == F.array_position("x.bands", F.col("x.band"))
        rest = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.component") != F.col("y.component")) & _likely("x", "y", percent) & first_shared)
        rest = rest.select(F.least(f"x.{ROW}", f"y.{ROW}").alias("a"), F.greatest(f"x.{ROW}", f"y.{ROW}").alias("b"))
        many = cut(open_rows.where(F.col("outside") > MOST_OUTSIDE).select(ROW, "component").distinct())
        if not many.isEmpty():
            rest = rest.union(_alike(many, docs, sketches, width, percent))
        rest = cut(rest.distinct())
        more = cut(_confirmed(rest, docs, width, percent))
        if not more.isEmpty():
            labels = cut(components(links.union(more)))

    member = all_rows.select(ROW, "doc_id", "n", "k1", "k2").join(classes, ["n", "k1", "k2"], "left")
    placed = cut(
        member.join(labels, F.col("class") == F.col("node"), "left").select(
            ROW, "doc_id", "n", F.coalesce("component", "class", ROW).alias("component")
        )
    )
    first = cut(placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW)).alias("first")))
    return placed.join(first, "component").select(
        ROW, "doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), (F.col(ROW) == F.col(f"first.{ROW}")).alias("kept")
    )


def near_dedup(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row per document: the size of its set, the least doc_id of its group, and whether it has that doc_id (several rows may)."""
    return near_groups(keyed(docs), width, percent).drop(ROW).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``docs``, all columns, with one row (the least doc_id) of each group of near copies."""
    return keep_rows(docs, lambda rows: near_groups(rows, width, percent).where("kept"))
