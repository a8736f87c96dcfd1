"""Cross-tokenizer alignment by elementary intervals.

A byte-level BPE (A) and a BPE of pieces with byte fallback (B) cut the same
bytes, a space and then the text. The union of both sides' token ends cuts
them into elementary intervals; ``searchsorted`` gives the token of each side
that owns an interval, and each interval is the overlap of one token of A with
one of B: a link. Where both sides end, a group of tokens closes; its product
(every token of A with every one of B) is counted, and ``products`` expands it.

Both tokenizers cut at a space that follows something else than white space:
the byte-level pattern begins a match there, and no piece of B has a space
after another character (checked when the file is read; else texts stay
whole). So a text is aligned word by word, and each distinct word once in a
worker, as long as it is among the ``KEPT_WORDS`` met last; words not met
before are encoded and aligned many at a time.

Counts of id pairs over all rows decide which links are a B id's best. They
are counted per batch first, then by Spark. The most frequent pairs, up to
``BROADCAST_PAIRS``, are broadcast and looked up where the links are; the
others, each of which is rarer than any of those, are joined. The highest
count of each B id is broadcast: one number for each piece of the vocabulary.

Defined cases: a text that is null or empty, or whose bytes do not come back
from the tokens of either side (U+2581 in a text comes back as a space), has
no tokens: zeros, and '' for the digest; such rows add nothing to the counts;
rows are told apart by a number of their own, so null and repeated doc_ids and
repeated rows are rows like others; ties for a B id's best all count; an empty
table gives an empty result; a text or a word of it may be of any length, and
is in memory as one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import byte_characters
from .frames import ROW, bytes_of, groups_of_rows, stored

KEPT_WORDS = 150_000  # of two generations each
LONGEST_KEPT = 200  # characters; longer words hardly come twice
ENCODED_AT_ONCE = 1 << 14  # characters
ROWS_BYTES = 1 << 21
BROADCAST_PAIRS = 1_000_000
_CUT = re.compile(r"(?<=\S)(?= )")
_IRREGULAR = re.compile(r"\s ")


def intervals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ends of the elementary intervals, the numbers of the tokens that own them, and whether they close a group."""
    ends = np.union1d(a_ends, b_ends)
    a, b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return ends, a, b, (a_ends[a] == ends) & (b_ends[b] == ends)


class Word(NamedTuple):
    """An aligned word: its counts, its links, and its groups as text. ``links`` is None if its bytes do not come back."""

    n_a: int
    n_b: int
    n_groups: int
    n_products: int
    links: bytes | None
    text: str


_UNTRUE = Word(0, 0, 0, 0, None, "")


class Aligner:
    """Both tokenizers, and the words aligned so far."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        code = {c: k for k, c in enumerate(byte_characters())}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            self.a_bytes[k] = bytes(map(code.__getitem__, entry)) if all(c in code for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in own]) for own in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = (list(map(str, range(len(own)))) for own in (self.a_bytes, self.b_bytes))
        self.apart = not any(re.search("[^▁]▁", p) for p in pieces)
        self.space = self.b.piece_to_id("▁")
        self.kind = "<u4" if len(self.a_bytes) * len(self.b_bytes) <= 1 << 32 else "<i8"
        self.kept: dict[str, Word] = {}
        self.older: dict[str, Word] = {}

    def words(self, text: str) -> list[str]:
        """The space and the text, cut where both tokenizers cut."""
        whole = " " + text
        if not self.apart:
            return [whole]
        return _CUT.split(whole) if _IRREGULAR.search(whole) else [" " + w for w in text.split(" ")]

    def _tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        return a, [x or [self.space] for x in self.b.encode([t[1:] for t in texts], num_threads=1)]  # B adds the space

    def _aligned(self, words: list[str], texts: list[str]) -> dict[str, Word] | None:
        """The words, whose tokens are those of the texts they make up; None if the bytes or the words' ends do not come back."""
        a, b = ([k for own in side for k in own] for side in self._tokens(texts))
        sizes = np.array([len(w.encode()) for w in words])
        raw = "".join(words).encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        ends, i, j, close = intervals(np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids]))
        last = np.searchsorted(ends, np.cumsum(sizes))
        if not (ends[last] == np.cumsum(sizes)).all() or not close[last].all():
            return None
        links = (a_ids[i] * len(self.b_bytes) + b_ids[j]).astype(self.kind)
        closes = np.flatnonzero(close)
        to_a, to_b = i[closes] + 1, j[closes] + 1
        products = np.diff(to_a, prepend=0) * np.diff(to_b, prepend=0)
        group = np.searchsorted(closes, last) + 1  # groups up to the end of each word
        in_all = np.concatenate([[0], np.cumsum(products)])[np.concatenate([[0], group])]
        a_show, b_show = list(map(self.a_text.__getitem__, a)), list(map(self.b_text.__getitem__, b))
        out, at, g, p, q, ga, gb = {}, 0, 0, 0, 0, to_a.tolist(), to_b.tolist()
        for word, stop, upto, times in zip(words, (last + 1).tolist(), group.tolist(), np.diff(in_all).tolist()):
            parts, n_a, n_b = [], -p, -q
            for k in range(g, upto):
                parts.append(f"{','.join(a_show[p : ga[k]])}|{','.join(b_show[q : gb[k]])}")
                p, q = ga[k], gb[k]
            out[word] = Word(n_a + p, n_b + q, upto - g, times, links[at:stop].tobytes(), ";".join(parts))
            at, g = stop, upto
        return out

    def _learn(self, words: list[str]) -> dict[str, Word]:
        """Words that end in a character are encoded in one text with others, which both tokenizers cut again; the rest by themselves."""
        joined, alone = [], []
        for w in words:
            (joined if self.apart and not w[-1].isspace() and "▁" not in w else alone).append(w)
        out: dict[str, Word] = {}
        if joined:
            texts, size, own = [], 0, []
            for w in joined:
                own.append(w)
                size += len(w)
                if size >= ENCODED_AT_ONCE:
                    texts.append("".join(own))
                    size, own = 0, []
            found = self._aligned(joined, [*texts, "".join(own)] if own else texts)
            if found is None:
                alone += joined
            else:
                out = found
        for w in alone:
            out.update(self._aligned([w], [w]) or {w: _UNTRUE})
        return out

    def align(self, texts: list[str | None]) -> list[list[Word]]:
        """The aligned words of each text; none if it has no tokens."""
        cut = [self.words(t) if t else [] for t in texts]
        distinct = {w for words in cut for w in words}
        known = {w: x for w in distinct if (x := self.kept.get(w) or self.older.get(w))}
        known.update(learnt := self._learn([w for w in distinct if w not in known]))
        if len(self.kept) > KEPT_WORDS:
            self.kept, self.older = {}, self.kept
        if len(learnt) <= KEPT_WORDS:
            self.kept.update((w, x) for w, x in known.items() if len(w) <= LONGEST_KEPT)
        out = []
        for words in cut:
            own = [known[w] for w in words]
            out.append([] if _UNTRUE in own else own)
        return out


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _each(df: DataFrame, rows, schema: str) -> DataFrame:
    """``rows(values of the last column)``, a tuple for each, beside the other columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names, types = arrow.names, arrow.types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in groups_of_rows(bytes_of(batch.column(batch.num_columns - 1))[1], ROWS_BYTES):
                part = batch.slice(start, stop - start)
                before = part.columns[:-1]
                out = rows(part.column(len(before)).to_pylist())
                made = [pa.array([r[i] for r in out], t) for i, t in enumerate(types[len(before) :])]
                yield pa.RecordBatch.from_arrays([*before, *made], names)

    return df.mapInArrow(run, schema)


def aligned(docs: DataFrame, a_path: str, b_path: str, kind: str) -> DataFrame:
    """``_row, doc_id``, counts, the digest of the groups, and ``links``: (A id x size of B + B id) as integers of that kind."""

    def rows(texts: list[str | None]) -> list[tuple]:
        out = []
        for words in aligner(a_path, b_path).align(texts):
            if not words:
                out.append((0, 0, 0, 0, 0, "", b""))
                continue
            n_a, n_b, n_groups, n_products, links, shown = zip(*words)
            links = b"".join(links)
            out.append((sum(n_a), sum(n_b), sum(n_groups), len(links) // int(kind[-1]), sum(n_products), hashlib.sha256(";".join(shown).encode()).hexdigest(), links))
        return out

    texts = docs.select(F.monotonically_increasing_id().alias(ROW), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _each(texts, rows, f"{ROW} long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_products long, groups_sha256 string, links binary")


def pair_counts(rows: DataFrame, kind: str) -> DataFrame:
    """``pair, n``: how many links over all rows hold each pair of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], ["pair", "n"])

    return rows.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _least_broadcast(counts: DataFrame, most: int) -> int:
    """The least power of two such that no more than ``most`` pairs have that count or a higher one."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()
    held, least = 0, 1 << 62
    for k, n in sorted(map(tuple, sizes), reverse=True):
        held += n
        if held > most:
            break
        least = 1 << k
    return 1 if held <= most else least


def scored(rows: DataFrame, counts: DataFrame, pieces: int, kind: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``rows`` with ``n_best`` and ``count_sum`` in place of ``links``."""
    session = rows.sparkSession
    b_id = (F.col("pair") % pieces).cast("int")
    tops = np.zeros(pieces, np.int64)
    for k, n in counts.groupBy(b_id.alias("b")).agg(F.max("n")).collect():
        tops[k] = n
    least = _least_broadcast(counts, broadcast_pairs)
    table = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(keys := table.column("pair").to_numpy())
    shared = session.sparkContext.broadcast((keys[order], table.column("n").to_numpy()[order], tops))

    def looked_up(links: bytes) -> tuple:
        keys, n, tops = shared.value
        pairs = np.frombuffer(links, kind).astype(np.int64)
        at = np.searchsorted(keys, pairs)
        at[at == len(keys)] = 0
        held = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
        found = n[at[held]]
        rest = pairs[~held]
        return int((found == tops[pairs[held] % pieces]).sum()), int(found.sum()), rest.tolist() if len(rest) else None

    names = [c for c in rows.columns if c != "links"]
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in names) + ", n_best long, count_sum long"
    first = _each(rows.select(*names, "links"), lambda lists: [looked_up(x) for x in lists], schema + ", rest array<bigint>")
    if least == 1:
        return first.drop("rest")
    first = stored(first)
    best = session.sparkContext.broadcast(tops)

    @F.arrow_udf("bigint")
    def top(ids: pa.Array) -> pa.Array:
        return pa.array(best.value[ids.to_numpy(zero_copy_only=False)])

    links = first.select(ROW, F.explode("rest").alias("pair")).groupBy(ROW, "pair").agg(F.count("*").alias("links"))
    rare = counts.where(F.col("n") < least).withColumn("best", F.col("n") == top(b_id))
    more = links.join(rare, "pair").groupBy(ROW).agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    told = first.join(more, ROW, "left")
    return told.select(*names, *[(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))])


def cross_alignment(docs: DataFrame, a_path: str, b_path: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: its tokens, groups and links of both tokenizers, and how usual its links are in the whole table."""
    own = aligner(a_path, b_path)
    rows = stored(aligned(docs, a_path, b_path, own.kind))
    return scored(rows, stored(pair_counts(rows, own.kind)), len(own.b_bytes), own.kind, broadcast_pairs).drop(ROW)


def products(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, a_id, b_id, group``: the groups of every text expanded into the products of their tokens."""

    def rows(texts: list[str | None]) -> list[tuple]:
        out = []
        for words in aligner(a_path, b_path).align(texts):
            pairs, groups = [], [g.split("|") for w in words for g in w.text.split(";")]
            for k, (own_a, own_b) in enumerate(groups):
                pairs += [{"a_id": int(a), "b_id": int(b), "group": k} for a in own_a.split(",") for b in own_b.split(",")]
            out.append((pairs,))
        return out

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _each(texts, rows, "doc_id long, pairs array<struct<a_id: int, b_id: int, group: long>>").select("doc_id", F.explode("pairs").alias("pair")).select("doc_id", "pair.*")
