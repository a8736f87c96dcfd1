"""Substring dedup of word windows with difference-cover anchors.

D = {0, 1, 3, 9} is a difference cover modulo 13: for any two positions i and
j some offset below 13 moves both onto positions whose remainder is in D. Two
equal windows of W words therefore contain an equal anchor of W - 12 words
that starts at a covered position of both documents. Only anchors at covered
positions are hashed and compared; around those that repeat, the windows that
contain them are extended to their full W words and compared by 128-bit names.
A window that also starts earlier (smaller doc_id, or earlier in the document)
is repeated, and the words it covers are removed.

Long copies are pre-aggregated: texts are cut into stretches of windows where
their own words say so (on average every ``STRETCH`` words), and of stretches
with the same words only the first goes on to be searched for anchors. All
windows of the others start earlier, in the first.

No comparison brings an unbounded group together: within a block of text
(``BLOCK_BYTES``) equal stretches, anchors and windows are settled on the spot
and one of them goes on to meet those of other blocks; the settled ones are
dealt out evenly.

Defined cases: null and empty texts have no words; texts of fewer than W words
have no windows and stay whole; a null doc_id sorts before all others, rows of
one doc_id are in the order of the table; an empty table gives an empty
result; a very long text is a block of its own; other columns are ignored,
whatever their names. ``W`` is at least 13.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .frames import ROW, bytes_of, cut, groups_of_rows, keyed
from .hashing import Words, mix

WINDOW_WORDS = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
STRETCH = 32
BLOCK_BYTES = 4 << 20
_NULL_FIRST = -(1 << 63)


def _blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray]]:
    """Rows of at most BLOCK_BYTES of text, their words, and the text (by number) of each word."""
    for batch in batches:
        data, ends = bytes_of(batch.column(text))
        for a, b in groups_of_rows(ends, BLOCK_BYTES):
            words = Words(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
            yield batch.slice(a, b - a), words, np.repeat(np.arange(b - a), np.diff(words.first))


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _firsts(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For rows with equal keys: whether a row is the first of them by ``order``, and whether it has others."""
    n = len(keys[0])
    by = np.lexsort((*reversed(order), *reversed(keys)))
    new = np.ones(n, bool)
    new[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
    first, many = np.empty(n, bool), np.empty(n, bool)
    first[by] = new
    group = np.cumsum(new) - 1
    many[by] = (np.bincount(group) > 1)[group] if n else new
    return first, many


def _ids(column: pa.Array) -> np.ndarray:
    return _longs(column.fill_null(_NULL_FIRST))


def _spread(row: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))


def _covered(words: Words, lists: pa.Array, more: int) -> np.ndarray:
    """Words that a (start, n) range of their text's list covers, each range longer by ``more``."""
    who = np.repeat(np.arange(len(lists)), _longs(lists.value_lengths().fill_null(0)))
    start, n = map(_longs, lists.flatten().flatten())
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, words.first[who] + start, 1)
    np.add.at(change, words.first[who] + start + n + more, -1)
    return np.cumsum(change)[:-1] > 0


def _starts(words: Words, text: np.ndarray, window: int) -> np.ndarray:
    """Whether a window starts at each word."""
    place = np.arange(len(words)) - words.first[text]
    return place + window <= np.diff(words.first)[text]


def stretches(docs: DataFrame, window: int) -> DataFrame:
    """``k1, k2, order, _row, start, n, settled``: stretches of ``n`` windows. ``settled``: an equal one is known to come before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, text in _blocks(batches, "text"):
            at = np.flatnonzero(_starts(words, text, window))
            place = at - words.first[text[at]]
            new = (place == 0) | (words.runs(at, 4) % np.uint64(STRETCH) == 0)
            first_of = np.flatnonzero(new)
            n = np.diff(np.append(first_of, len(at)))
            at, place = at[first_of], place[first_of]
            order, row = _ids(part.column("doc_id"))[text[at]], _longs(part.column(ROW))[text[at]]
            k1, k2 = words.runs(at, n + window - 1, 0), words.runs(at, n + window - 1, 1)
            first, _ = _firsts([k1, k2], [order, row, place])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(first, k1, _spread(row, place)).view(np.int64)), pa.array(k2.view(np.int64)), pa.array(order), pa.array(row), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(~first)],
                ["k1", "k2", "order", ROW, "start", "n", "settled"],
            )

    return docs.select(ROW, "doc_id", "text").mapInArrow(run, f"k1 long, k2 long, order long, {ROW} long, start int, n int, settled boolean")


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """``key, _row, at, settled``: the anchors at covered positions in windows outside ``known``. ``settled``: it is known to repeat."""
    length = window - PERIOD + 1
    covered = np.zeros(PERIOD, bool)
    covered[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, text in _blocks(batches, "text"):
            place = np.arange(len(words)) - words.first[text]
            inside = place + length <= np.diff(words.first)[text]
            open_ = np.concatenate([[0], np.cumsum(_starts(words, text, window) & ~_covered(words, part.column("known"), 0))])
            # An anchor counts if one of the windows that contain it is open.
            near = open_[1:] - open_[np.maximum(np.arange(len(words)) - PERIOD + 1, words.first[text])] > 0
            at = np.flatnonzero(covered[place % PERIOD] & inside & near)
            row, h = _longs(part.column(ROW))[text[at]], words.runs(at, length)
            first, many = _firsts([h], [at])
            key = np.where(first, h, _spread(row, place[at]))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(row), pa.array(place[at].astype(np.int32)), pa.array(many)], ["key", ROW, "at", "settled"])

    return docs.select(ROW, "doc_id", "text", "known").mapInArrow(run, f"key long, {ROW} long, at int, settled boolean")


def windows(docs: DataFrame, window: int) -> DataFrame:
    """``k1, k2, order, _row, start, settled``: the windows outside ``known`` around the anchors in ``hits``. ``settled``: an equal one is known to come before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, text in _blocks(batches, "text"):
            hits = part.column("hits")
            who = np.repeat(np.arange(part.num_rows), _longs(hits.value_lengths().fill_null(0)))
            at = _longs(hits.flatten())
            last = np.minimum(at, np.diff(words.first)[who] - window)
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, words.first[who] + np.maximum(at - PERIOD + 1, 0), 1)
            np.add.at(change, words.first[who] + last + 1, -1)
            start = np.flatnonzero((np.cumsum(change)[:-1] > 0) & ~_covered(words, part.column("known"), 0))
            place = start - words.first[text[start]]
            order, row = _ids(part.column("doc_id"))[text[start]], _longs(part.column(ROW))[text[start]]
            k1, k2 = words.runs(start, window, 0), words.runs(start, window, 1)
            first, _ = _firsts([k1, k2], [order, row, place])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(first, k1, _spread(row, place)).view(np.int64)), pa.array(k2.view(np.int64)), pa.array(order), pa.array(row), pa.array(place.astype(np.int32)), pa.array(~first)],
                ["k1", "k2", "order", ROW, "start", "settled"],
            )

    return docs.select(ROW, "doc_id", "text", "known", "hits").mapInArrow(run, f"k1 long, k2 long, order long, {ROW} long, start int, settled boolean")


def _kept_words(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` from the repeated windows in ``known`` and ``repeats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, _ in _blocks(batches, "text"):
            gone = _covered(words, part.column("known"), window - 1) | _covered(words, part.column("repeats"), window - 1)
            sums = np.concatenate([[0], np.cumsum(gone)])
            removed = sums[words.first[1:]] - sums[words.first[:-1]]
            data, kept = words.data.tobytes(), []
            spans = list(zip(words.start.tolist(), words.end.tolist()))
            for i in range(part.num_rows):
                a, b = words.first[i], words.first[i + 1]
                kept.append(b" ".join(data[s:e] for (s, e), g in zip(spans[a:b], gone[a:b].tolist()) if not g).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(words.first)), pa.array(removed), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"]
            )

    return docs.select(ROW, "doc_id", "text", "known", "repeats").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def substring_dedup(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` per document: ``kept`` has its words that no repeated window covers, joined by spaces."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    texts = keyed(docs).select(ROW, "doc_id", "text")  # each pass takes the same columns, so that texts are dealt out once
    ranges = F.collect_list(F.struct("start", "n"))
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("order", ROW, "start"))
    known = cut(stretches(texts, window).withColumn("nth", nth).where("settled or nth > 1").groupBy(ROW).agg(ranges.alias("known")))
    none = F.array().cast(known.schema["known"].dataType)
    marked = texts.join(known, ROW, "left").withColumn("known", F.coalesce("known", none))
    found = anchors(marked, window).withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("settled or n > 1")
    hits = found.groupBy(ROW).agg(F.collect_list("at").alias("hits"))
    candidates = windows(marked.join(hits, ROW), window)
    repeats = candidates.withColumn("nth", nth).where("settled or nth > 1").withColumn("n", F.lit(1)).groupBy(ROW).agg(ranges.alias("repeats"))
    return _kept_words(marked.join(repeats, ROW, "left").withColumn("repeats", F.coalesce("repeats", none)), window)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
