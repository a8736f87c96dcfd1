"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts elsewhere.

Among the hashes of the ``gram``-byte strings inside a window of LENGTH bytes
one is the least (the leftmost of equal ones); equal windows have equal least
grams at equal places. Consecutive windows that share their least gram form a
stretch, so windows can only equal windows of stretches of the same gram, and
a stretch whose gram occurs nowhere else holds no repeated window.

The other stretches are brought together gram by gram in collections of
bounded size, whose Burrows-Wheeler transform and common prefixes are built
column by column (``column_bwt``): suffixes with LENGTH bytes in common are
repeated windows, and nothing else makes a window one. Of stretches with equal
bytes two go in, and what is found in the first holds for all of them.

All stretches of a gram hold it, so it stands as one symbol, and the bytes
beside it, at most LENGTH - gram on either side, are taken in symbols of
``SYMBOL`` bytes. A window may begin at any byte, so each stretch is written
once for each remainder of the windows' starts; what the symbols leave over
next to the gram is part of the gram's symbol. A round inserts one symbol of
every text, and there are as many as one side has symbols, twice over.

Grams with more than ``GROUP`` different stretches are divided by what stands
next to them: their stretches are texts of their own to the same operator with
grams longer by half of what is missing to LENGTH. Stretches that have grams
of LENGTH bytes in common are equal, so this ends.

The published method keeps the lists in sequential files since its collection
is the whole corpus. Here they would be rewritten once a round by every task;
collections of bounded size pass over them in memory instead.

Grams and stretches are named by 128 bits; of strings as short as these no two
are known to share a name in both families.

Defined cases: null and empty texts have no bytes; rows with null or repeated
doc_ids are texts of their own; an empty table gives an empty result; very
long texts are read in overlapping blocks; other columns are ignored. What is
kept may begin or end inside a character, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .column_bwt import repeated_starts
from .frames import ROW, bytes_of, groups_of_rows, keyed, stored
from .hashing import Bytes

LENGTH = 400
GRAM = 302
SYMBOL = 7
GROUP = 4096
BLOCK_BYTES = 1 << 17
COLLECTION_BYTES = 1 << 18


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _blocks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row and offset of each text in them, n + 1 ends): texts together up to BLOCK_BYTES, longer ones in overlapping pieces."""
    data, ends = bytes_of(batch.column("text"))
    rows = _longs(batch.column(ROW))
    for a, b in groups_of_rows(ends, BLOCK_BYTES):
        if ends[b] - ends[a] <= BLOCK_BYTES:
            yield data[ends[a] : ends[b]], rows[a:b], np.zeros(b - a, np.int64), ends[a : b + 1] - ends[a]
        else:
            for at in range(0, int(ends[b] - ends[a]), BLOCK_BYTES):
                part = data[ends[a] + at : min(ends[b], ends[a] + at + BLOCK_BYTES + length - 1)]
                yield part, rows[a:b], np.array([at]), np.array([0, len(part)])


def _least_grams(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, the text of each, and the place of its least gram."""
    n = len(data) - gram + 1
    texts = np.repeat(np.arange(len(ends) - 1), np.maximum(np.diff(ends) - length + 1, 0))
    if not len(texts):
        return texts, texts, texts
    first = np.concatenate([[0], np.cumsum(np.maximum(np.diff(ends) - length + 1, 0))])
    starts = np.arange(len(texts)) - first[texts] + ends[texts]
    places = np.arange(n)
    value = (Bytes(data, 0).of(places, places + gram) >> np.uint64(21) << np.uint64(21)) | places.astype(np.uint64)
    width = length - gram + 1
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = value
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(table, axis=1).reshape(-1)
    least = np.minimum(ahead[starts], behind[starts + width - 1])
    return starts, texts, (least & np.uint64((1 << 21) - 1)).astype(np.int64)


def _stretches(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[tuple]:
    """Of each block: its bytes, and of every stretch the hash of its gram, the row, its start there and in the block, its windows, and the gram's place in it."""
    for data, rows, offsets, ends in _blocks(batch, length):
        starts, texts, places = _least_grams(data, ends, length, gram)
        if len(starts):
            new = np.ones(len(starts), bool)
            new[1:] = (places[1:] != places[:-1]) | (texts[1:] != texts[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(starts)))
            start, text, place = starts[at], texts[at], places[at]
            h = Bytes(data, 0).of(place, place + gram)
            yield data, h, rows[text], start - ends[text] + offsets[text], start, n, place - start


def shared_grams(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``h``: hashes of least grams that two stretches have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h, *_ in _stretches(batch, length, gram):
                names, k = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.minimum(k, 2).astype(np.int8))], ["h", "k"])

    return docs.select(ROW, "text").mapInArrow(run, "h long, k tinyint").groupBy("h").agg(F.sum("k").alias("k")).where("k > 1").select("h")


def stretches(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``h, c, _row, start, n, at``: every stretch of ``n`` windows. ``h`` names its gram, which begins ``at`` bytes on, ``c`` its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, h, row, start, begin, n, at in _stretches(batch, length, gram):
                c = Bytes(data, 1).of(begin, begin + n - 1 + length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), c.view(np.int64), row, start.astype(np.int32), n.astype(np.int32), at.astype(np.int32))], ["h", "c", ROW, "start", "n", "at"])

    return docs.select(ROW, "text").mapInArrow(run, f"h long, c long, {ROW} long, start int, n int, at int")


def _cut_out(docs: DataFrame, length: int, gram: int, whole: bool) -> DataFrame:
    """``h, g, c, first, n, at, bytes`` of the stretches listed in ``wanted``; ``g`` is the gram's second name, and the gram is left out of ``bytes`` unless ``whole``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = bytes_of(batch.column("text"))
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                wanted, count = part.column("wanted").flatten(), _longs(part.column("wanted").value_lengths())
                h, c, first, start, n, at = wanted.flatten()
                text = data[ends[a] : ends[a + part.num_rows]]
                begin = np.repeat(ends[a : a + part.num_rows], count) - ends[a] + _longs(start)
                stop, place = begin + _longs(n) - 1 + length, begin + _longs(at)
                g = pa.array(Bytes(text, 1).of(place, place + gram).view(np.int64))
                if whole:
                    bits = [text[x:y].tobytes() for x, y in zip(begin.tolist(), stop.tolist())]
                else:
                    bits = [text[x:p].tobytes() + text[p + gram : y].tobytes() for x, p, y in zip(begin.tolist(), place.tolist(), stop.tolist())]
                yield pa.RecordBatch.from_arrays([h, g, c, first, n, at, pa.array(bits, pa.binary())], ["h", "g", "c", "first", "n", "at", "bytes"])

    return docs.select(ROW, "text", "wanted").mapInArrow(run, "h long, g long, c long, first boolean, n int, at int, bytes binary")


def repeated_windows(data: np.ndarray, at: np.ndarray, n: np.ndarray, grams: np.ndarray, flank: int) -> list[np.ndarray]:
    """For each stretch, which of its windows occur twice in the collection.

    ``data`` has the stretches' bytes without their grams, ``at`` of them before the gram and as many as the last window
    needs behind it; ``grams`` numbers the grams, ``flank`` is how many bytes a window has beside its gram.
    """
    left_over = at - n + 1  # bytes before the gram in the last window
    offset = np.concatenate([[0], np.cumsum(at + flank - left_over)[:-1]])
    first = np.concatenate([[0], np.cumsum(n)])
    found = np.zeros(first[-1], bool)
    padded = np.append(data, np.zeros(SYMBOL, np.uint8))
    weight = (np.uint64(1) << (8 * np.arange(SYMBOL, dtype=np.uint64))).astype(np.uint64)

    def names(begin: np.ndarray, size: int) -> np.ndarray:
        return sum((padded[begin + i].astype(np.uint64) * weight[i] for i in range(size)), np.zeros(len(begin), np.uint64))

    for r in range(SYMBOL):
        who = np.flatnonzero(-(-(left_over - r) // SYMBOL) * SYMBOL + r <= at)
        if r > flank or not len(who):
            continue
        before = (at[who] - r) // SYMBOL  # symbols before the gram in the first of these windows, and in the last
        least = np.maximum(-(-(left_over[who] - r) // SYMBOL), 0)
        near = (flank - r) % SYMBOL
        after = (flank - r - near) // SYMBOL - least
        sizes = before + 1 + after
        text = np.repeat(np.arange(len(who)), sizes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = offset[who] + at[who]  # where the gram was
        begin = np.where(nth < before[text], place[text] - r - SYMBOL * (before[text] - nth), place[text] + near + SYMBOL * (nth - before[text] - 1))
        centre = nth == before[text]
        begin[centre] = 0
        symbol = np.unique(names(begin, SYMBOL), return_inverse=True)[1] + 1
        # The gram's own symbol: its number, and the bytes left over on its two sides.
        sides = np.stack([grams[who].astype(np.uint64), names(place - r, r), names(place, near)])
        own = np.lexsort(sides)
        change = np.ones(len(own), bool)
        change[1:] = np.any(sides[:, own[1:]] != sides[:, own[:-1]], axis=0)
        number = np.empty(len(own), np.int64)
        number[own] = np.cumsum(change)
        top = int(symbol.max())
        symbol[centre] = top + number
        kind = np.uint16 if top + int(change.sum()) < 1 << 16 else np.uint32
        repeated = repeated_starts(symbol.astype(kind), sizes, 1 + (flank - r - near) // SYMBOL)
        window = np.flatnonzero(nth <= (before - least)[text])
        number_in_stretch = at[who][text[window]] - (r + SYMBOL * (before[text[window]] - nth[window]))
        found[first[who][text[window]] + number_in_stretch] = repeated[window]
    return [found[a:b] for a, b in zip(first[:-1], first[1:])]


def _runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true values."""
    edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


def _transformed(pieces: DataFrame, flank: int) -> DataFrame:
    """``h, c, runs``: runs of repeated windows of stretches, which come sorted by gram within their partition."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))

    def settle(part: pa.Table) -> pa.RecordBatch:
        data, ends = bytes_of(part["bytes"])
        data = data[ends[0] : ends[-1]]
        h, g = _longs(part["h"]), _longs(part["g"])
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        first = part["first"].to_numpy()
        found = repeated_windows(data, _longs(part["at"]), _longs(part["n"]), np.cumsum(new), flank)
        lists = [(i, *_runs(f)) for i, f in enumerate(found) if first[i] and f.any()]
        kept = np.array([i for i, _, _ in lists], np.int64)
        ends_of = np.cumsum([0, *(len(s) for _, s, _ in lists)]).astype(np.int32)
        flat = [np.concatenate([*(x[k] for x in lists), np.zeros(0, np.int64)]).astype(np.int32) for k in (1, 2)]
        runs = pa.ListArray.from_arrays(ends_of, pa.StructArray.from_arrays([pa.array(x) for x in flat], fields=list(kind.value_type)))
        return pa.RecordBatch.from_arrays([pa.array(h[kept]), pa.array(_longs(part["c"])[kept]), runs], ["h", "c", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            h, weight = _longs(batch.column("h")), np.cumsum(_longs(pa.compute.binary_length(batch.column("bytes"))))
            edges = [0, *np.flatnonzero(h[1:] != h[:-1]) + 1, batch.num_rows]
            cut = 0
            for a, b in zip(edges[:-1], edges[1:]):
                done = weight[a - 1] - (weight[cut - 1] if cut else 0) if a else 0
                if size + done >= COLLECTION_BYTES and h[a] != last:
                    held.append(batch.slice(cut, a - cut))
                    yield settle(pa.Table.from_batches(held))
                    held, size, cut = [], 0, a
                last = h[b - 1]
            held.append(batch.slice(cut))
            size += weight[-1] - (weight[cut - 1] if cut else 0) if batch.num_rows else 0
        if sum(b.num_rows for b in held):
            yield settle(pa.Table.from_batches(held))

    return pieces.mapInArrow(run, "h long, c long, runs array<struct<start:int,n:int>>")


def _kept_bytes(docs: DataFrame, length: int) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` from the runs of repeated windows in ``runs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = bytes_of(batch.column("text"))
            runs = batch.column("runs")
            for a in range(0, batch.num_rows, 256):
                b = min(a + 256, batch.num_rows)
                removed, spans, kept = [], [], []
                for i in range(a, b):
                    own, gone, count, last, parts = runs.slice(i, 1).flatten(), 0, 0, 0, []
                    text = data[ends[i] : ends[i + 1]]
                    if len(own):
                        start, n = map(_longs, own.flatten())
                        by = np.argsort(start, kind="stable")
                        start, stop = start[by], np.maximum.accumulate((start + n - 1 + length)[by])
                        new = np.ones(len(start), bool)
                        new[1:] = start[1:] > stop[:-1]
                        begin, stop = start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]
                        gone, count = int((stop - begin).sum()), len(begin)
                        for s, e in zip(begin.tolist(), stop.tolist()):
                            parts.append(text[last:s].tobytes())
                            last = e
                    parts.append(text[last:].tobytes())
                    removed.append(gone)
                    spans.append(count)
                    kept.append(b"".join(parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(ends[a : b + 1])), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return docs.select(ROW, "doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeated_runs(texts: DataFrame, length: int, gram: int, group: int = GROUP) -> DataFrame:
    """``_row, start, n``: runs of ``n`` windows from ``start`` on that are repeated, of the rows ``_row, text``."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grams = stored(shared_grams(texts, length, gram))  # a table, so that the join deals both sides anew and can split a hot gram
    shared = stored(stretches(texts, length, gram).join(grams, "h", "left_semi"))
    place = F.struct(ROW, "start", "n", "at")
    classes = shared.groupBy("h", "c").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    members = F.when(F.col("first") == F.col("last"), F.array(F.struct(F.lit(True).alias("first"), F.col("first").alias("p")))).otherwise(
        F.array(F.struct(F.lit(True).alias("first"), F.col("first").alias("p")), F.struct(F.lit(False).alias("first"), F.col("last").alias("p")))
    )
    pieces = stored(classes.select("h", "c", F.explode(members).alias("m")).select("h", "c", "m.first", "m.p.*"))
    large = stored(pieces.groupBy("h").agg(F.count("*").alias("pieces")).where(F.col("pieces") > group).select("h"))
    divided = not large.isEmpty()

    def listed(some: DataFrame) -> DataFrame:
        wanted = some.groupBy(ROW).agg(F.collect_list(F.struct("h", "c", "first", "start", "n", "at")).alias("wanted"))
        return texts.join(wanted, ROW)

    ready = _cut_out(listed(pieces.join(large, "h", "left_anti") if divided else pieces), length, gram, False)
    found = _transformed(ready.repartition(parts, "h").sortWithinPartitions("h", "g"), length - gram)
    if divided:
        whole = stored(_cut_out(listed(pieces.join(large, "h", "left_semi")), length, gram, True).withColumn(ROW, F.monotonically_increasing_id()))
        inner = repeated_runs(whole.select(ROW, F.col("bytes").alias("text")), length, (gram + length + 1) // 2, group)
        found = found.unionByName(whole.where("first").join(inner, ROW).groupBy("h", "c").agg(F.collect_list(F.struct("start", inner["n"])).alias("runs")))
    met = shared.join(found, ["h", "c"]).select(ROW, F.col("start").alias("from"), F.explode("runs").alias("r"))
    return met.select(ROW, (F.col("from") + F.col("r.start")).alias("start"), F.col("r.n").alias("n"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int | None = None, group: int = GROUP) -> DataFrame:
    """One row per document: its bytes, what is removed, in how many runs, and the bytes that are kept."""
    texts = keyed(docs).select(ROW, "doc_id", "text")
    gram = gram or max(1, length * GRAM // LENGTH)
    runs = repeated_runs(texts, length, gram, group).groupBy(ROW).agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return _kept_bytes(texts.join(runs, ROW, "left"), length)
