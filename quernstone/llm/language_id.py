"""Language ID by prediction by partial matching over bytes.

Learning counts, for every language, which byte follows which three bytes
(with their escapes to two, one and none), over all learnable documents. Every
context that was counted is kept, whatever the size of its language; what was
never seen escapes to the next shorter context and in the end to a uniform
distribution over all bytes. The statistics are then frozen: every context and
byte get an exact code length in each language (escape method C with
exclusion), a text's code length is the sum over its bytes, and the language
with the shortest one is predicted. A caller can prune the trees to the
``max_contexts`` contexts that are most frequent in all languages together.

The trees are sorted arrays of what was seen, 12 bytes for each byte seen after
a context of a language and for each context. They are counted in tasks, merged
by key, frozen on the driver and broadcast, so they have to fit in the memory
of both; they grow with the distinct four bytes of each language, not with the
text.

Code lengths are rounded to 2^-16 bit and summed as integers, so predictions
do not depend on how rows are dealt into batches.

Defined cases: null texts and texts without a letter get ``und`` and score 0;
ties go to the language that sorts first; without any learnable document all
rows get ``und``; repeated rows and null doc_ids are predicted like any
others (a null doc_id is never held out and never learned from); an empty
table gives an empty result; a very long text is one row of a task; languages
may be many, each has a tree of its own and every text is scored by all; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import bytes_of, groups_of_rows

ORDER = 3
SLICE_BYTES = 1 << 20
UNIT = 1 << 16
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % parts == part, F.lit(False))


def _grams(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every byte the four bytes that end in it, packed; bytes before the start of a document are 0."""
    packed = data.astype(np.uint32)
    grams = packed.copy()
    for back in range(1, ORDER + 1):
        grams[back:] |= packed[:-back] << np.uint32(8 * back)
    starts = ends[:-1][ends[:-1] < ends[1:]] - ends[0]
    for offset in range(ORDER):  # near the start, what stands before it is cleared
        at = starts + offset
        at = at[at < len(grams)]
        inside = np.searchsorted(starts, at, "right") == np.searchsorted(starts, at - offset, "right")
        grams[at[inside]] &= np.uint32((1 << (8 * (offset + 1))) - 1)
    return grams


def _tables(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last, bytes, relative offsets) of slices of at most SLICE_BYTES, a longer row alone."""
    for a, b in groups_of_rows(ends, SLICE_BYTES):
        yield a, b, data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]


def count_contexts(labelled: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all rows of ``lang, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def merged(lang: str, grams: np.ndarray, n: np.ndarray) -> None:
            if lang in kept:
                grams, n = np.concatenate([kept[lang][0], grams]), np.concatenate([kept[lang][1], n])
                grams, at = np.unique(grams, return_inverse=True)
                n = np.bincount(at, n).astype(np.int64)
            kept[lang] = grams, n

        for batch in batches:
            langs = batch.column(0)
            for lang in langs.unique().to_pylist():
                data, ends = bytes_of(batch.filter(pa.compute.equal(langs, lang)).column(1))
                for _, _, part, own in _tables(data, ends):
                    grams = np.sort(_grams(part, own))
                    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, int)
                    merged(lang, grams[first], np.diff(np.append(first, len(grams))))
        for lang, (grams, n) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    return labelled.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Tree:
    """Frozen code lengths of one language, from its counted grams; sorted arrays for every order.

    ``seen[k]`` are the contexts of k bytes with the byte that followed them and
    ``bits[k]`` their code lengths; ``contexts[k]`` are the contexts alone and
    ``escapes[k]`` what a byte never seen there costs beyond the next shorter one.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, kept: list[np.ndarray] | None) -> None:
        self.seen, self.bits, self.contexts, self.escapes = [], [], [], []
        below = np.full(256, 1 / 256)  # probabilities after the next shorter context of what was seen
        symbols = np.arange(256, dtype=np.uint32)
        for k in range(ORDER + 1):
            keys, at = np.unique(grams & _low(k + 1), return_inverse=True)
            counts = np.bincount(at, n)
            shorter = below[np.searchsorted(symbols, keys & _low(max(k, 1)))]
            if kept is not None:
                of = np.isin(keys >> np.uint32(8), kept[k])
                keys, counts, shorter = keys[of], counts[of], shorter[of]
            contexts, first, at = np.unique(keys >> np.uint32(8), return_index=True, return_inverse=True)
            kinds = np.diff(np.append(first, len(keys)))
            total = np.bincount(at, counts, len(contexts)) + np.where(kinds < 256, kinds, 0)
            below, symbols = counts / total[at], keys
            rest = np.where(kinds < 256, 1 - np.bincount(at, shorter, len(contexts)), 1.0)
            self.seen.append(keys)
            self.bits.append(-np.log2(below))
            self.contexts.append(contexts)
            self.escapes.append(np.where(kinds < 256, np.log2(rest) - np.log2(np.where(kinds < 256, kinds, 1) / total), 0.0))

    def lengths(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each of the sorted ``grams``, in units of 1 / UNIT bit."""
        bits, left = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(ORDER, -1, -1):
            keys = grams[left] & _low(k + 1)
            at, met = _find(self.seen[k], keys)
            bits[left[met]] += self.bits[k][at[met]]
            left, keys = left[~met], keys[~met]
            at, met = _find(self.contexts[k], keys >> np.uint32(8))
            bits[left[met]] += self.escapes[k][at[met]]
        bits[left] += 8
        return np.round(bits * UNIT).astype(np.int64)


def _low(n: int) -> np.uint32:
    return np.uint32((1 << (8 * n)) - 1)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys are in the sorted table, and whether they are."""
    if not len(table):
        return np.zeros(len(keys), int), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Trees:
    """The trees of all languages, in the order of ``langs``."""

    def __init__(self, langs: list[str], trees: list[Tree]) -> None:
        self.langs, self.trees = langs, trees

    def lengths(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows x languages: code lengths in units of 1 / UNIT bit."""
        total = np.zeros((len(ends) - 1, len(self.langs)), np.int64)
        for a, b, part, own in _tables(data, ends):
            filled = np.flatnonzero(own[:-1] < own[1:])
            if len(filled):
                grams, at = np.unique(_grams(part, own), return_inverse=True)
                for k, tree in enumerate(self.trees):
                    total[a + filled, k] = np.add.reduceat(tree.lengths(grams)[at], own[filled])
        return total


def _most_frequent(grams: np.ndarray, n: np.ndarray, max_contexts: int) -> list[np.ndarray]:
    """The contexts of every order among the most frequent of all orders; of equal ones the shorter, then the lesser."""
    found = []
    for k in range(ORDER + 1):
        contexts, at = np.unique((grams >> np.uint32(8)) & _low(k), return_inverse=True)
        found.append((np.full(len(contexts), k), contexts, np.bincount(at, n)))
    order, contexts, total = map(np.concatenate, zip(*found))
    best = np.lexsort((contexts, order, -total))[:max_contexts]
    return [contexts[best[order[best] == k]] for k in range(ORDER + 1)]


def grow_trees(counts: DataFrame, max_contexts: int | None = None) -> Trees | None:
    """Freeze the code lengths of all counted contexts, or of the ``max_contexts`` most frequent ones."""
    found = counts.select("lang", "gram", "n").toArrow()
    if not found.num_rows:
        return None
    lang = found["lang"].combine_chunks().dictionary_encode()
    at, grams, n = lang.indices.to_numpy(), found["gram"].to_numpy().astype(np.uint32), found["n"].to_numpy()
    kept = None if max_contexts is None else _most_frequent(grams, n, max_contexts)
    names = lang.dictionary.to_pylist()
    langs = sorted(names)
    return Trees(langs, [Tree(grams[own], n[own], kept) for own in (at == names.index(x) for x in langs)])


def learn(docs: DataFrame, learnable: Column, max_contexts: int | None = None) -> Trees | None:
    """Trees from the rows of ``docs`` that have a language and text and are ``learnable``."""
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return grow_trees(count_contexts(rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))), max_contexts)


def _told(trees: Trees | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text."""
    lettered = np.array([bool(t and _LETTER.search(t)) for t in (x.as_py() for x in texts)], bool)  # one text at a time is a Python string
    if trees is None or not len(lettered):
        return np.full(len(lettered), UNDETERMINED, object), np.zeros(len(lettered))
    bits = trees.lengths(*bytes_of(texts)) / UNIT
    pick = bits.argmin(axis=1)
    share = 1 / np.exp2(np.maximum(bits[np.arange(len(pick)), pick][:, None] - bits, -1000.0)).sum(axis=1)
    return np.where(lettered, np.array(trees.langs, object)[pick], UNDETERMINED), np.where(lettered, share, 0.0)


def predict(docs: DataFrame, trees: Trees | None, *keys: str) -> DataFrame:
    """The columns ``keys``, and ``lang_pred`` and ``score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    names = [*keys, "lang_pred", "score"]
    texts = docs.select(*keys, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, score = _told(shared.value, batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(told.tolist(), pa.string()), pa.array(score)], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    return texts.mapInArrow(run, f"{schema}, lang_pred string, score double")


def keep_predicted(docs: DataFrame, trees: Trees | None, least_score: float = 0.0) -> DataFrame:
    """``docs``, all columns, without the rows whose language is undetermined or told with a lower score."""
    place, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, score = _told(shared.value, batch.column(place))
            yield batch.filter(pa.array((told != UNDETERMINED) & (score >= least_score)))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, parts: int = 3, part: int = 1, max_contexts: int | None = None) -> DataFrame:
    """One row per document: whether its fold was held out from learning, its language and score."""
    out = held_out(F.col("doc_id"), parts, part)
    trees = learn(docs, ~out & F.col("doc_id").isNotNull(), max_contexts)
    folds = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text")
    return predict(folds, trees, "doc_id", "held_out")
