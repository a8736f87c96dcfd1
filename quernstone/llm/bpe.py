"""Byte-level BPE encoding and decoding over Arrow batches, with the tokenizers library.

The tokenizer is built once per Python worker from a file of ranks: every byte
is mapped to one printable character, every way to split a token into two
tokens becomes a merge in the order of ranks, and the pre-tokenizer cuts a
text into the matches of the pattern.

Texts are cut at spaces that follow a character other than white space. The
pattern always begins a match there and never looks behind, so the pieces can
be encoded apart; each distinct piece is encoded once and kept, up to
``KEPT_PIECES`` of them in a worker.

Where two merges of one rank overlap, the library takes the one listed first
and the rank rule the one further left. Pieces that hold such an overlap are
therefore merged by ``merge_by_rank``, in the time of a heap of its pairs.

Decoding reverses the byte table. A token may end inside a character; the
bytes of consecutive tokens are joined before they are read as UTF-8, and what
is then still broken becomes U+FFFD.

Defined cases: a null text is encoded as an empty one (no ids); rows are
independent, so null or repeated doc_ids, repeated rows and other columns have
no influence, whatever their names; an empty table gives an empty result; a
text or a piece of it may be of any length, and is in memory as one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KEPT_PIECES = 300_000
LONGEST_KEPT = 1_000  # characters; longer pieces hardly come twice
#: A space after something else than white space begins a match of the pattern.
_CUT = re.compile(r"(?<=\S) ")
_IRREGULAR = re.compile(r"\s ")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, spare = [], 256
    for byte in range(256):
        table.append(chr(byte if byte in printable else spare))
        spare += byte not in printable
    return table


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: the pair of lowest rank is merged, of equal ranks the leftmost, until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(ranks[pair], i) for i in range(len(parts) - 1) if (pair := parts[i] + parts[i + 1]) in ranks]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if not parts[i] or j == len(parts) or ranks.get(parts[i] + parts[j]) != rank:
            continue  # one of the two has been merged meanwhile
        parts[i], parts[j] = parts[i] + parts[j], b""
        after[i] = k = after[j]
        if k < len(parts):
            before[k] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < len(parts) and (found := ranks.get(parts[a] + parts[after[a]])) is not None:
                heapq.heappush(heap, (found, a))
    return [ranks[p] for p in parts if p]


class Codec:
    """An encoder and decoder for one file of ranks and one pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import ahocorasick
        import regex
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        chars = byte_characters()
        shown = {token: "".join(map(chars.__getitem__, token)) for token in self.ranks}
        merges, self.overlaps = [], ahocorasick.Automaton()
        for token in sorted(self.ranks, key=self.ranks.get):
            splits = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in self.ranks and token[i:] in self.ranks]
            merges += [(shown[a], shown[b]) for a, b in sorted(splits, key=lambda s: (self.ranks[s[0]], self.ranks[s[1]]))]
            for a, b in splits:
                for c, d in splits:
                    if b == c and (a, b) != (c, d):
                        self.overlaps.add_word((a + b + d).decode("latin-1"), 1)
        self.overlaps.make_automaton()
        self.tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in self.ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.matches = regex.compile(pattern)
        most = max(self.ranks.values()) + 1
        self.token_bytes = [b""] * most
        for token, rank in self.ranks.items():
            self.token_bytes[rank] = token
        self.kept: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces not met before; ids are kept as little-endian unsigned 32-bit integers."""
        if len(self.kept) + len(pieces) > KEPT_PIECES:
            self.kept.clear()
        for piece, found in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)):
            ids = found.ids
            if next(self.overlaps.iter(piece.encode().decode("latin-1")), None):
                ids = [i for m in self.matches.findall(piece) for i in merge_by_rank(m.encode(), self.ranks)]
            self.kept[piece] = np.array(ids, "<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        if _IRREGULAR.search(text):
            head, *rest = _CUT.split(text)
        else:
            head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]]

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian, four bytes each."""
        pieces = self.pieces(text)
        new = [p for p in set(pieces) if p not in self.kept]
        if not new:
            return b"".join(map(self.kept.__getitem__, pieces))
        if len(new) >= KEPT_PIECES:  # one text with more pieces than are kept
            return b"".join(self.encode("".join(pieces[i : i + KEPT_PIECES // 2])) for i in range(0, len(pieces), KEPT_PIECES // 2))
        known = {p: self.kept[p] for p in set(pieces) if p in self.kept} if len(self.kept) + len(new) > KEPT_PIECES else {}
        self._learn(new)
        self.kept.update(known)
        ids = b"".join(map(self.kept.__getitem__, pieces))
        for piece in new:
            if len(piece) > LONGEST_KEPT:
                del self.kept[piece]
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> np.ndarray:
        """The character in which each token begins; a token that begins inside a character counts from that one."""
        sizes = np.fromiter((len(self.token_bytes[i]) for i in ids.tolist()), np.int64, len(ids))
        starts = np.cumsum(sizes) - sizes
        lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        return (np.cumsum(lead) - 1)[starts] if len(ids) else starts


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _each_batch(df: DataFrame, path: str, pattern: str, row, schema: str) -> DataFrame:
    """``row(codec, value)`` of every (doc_id, value) row; ``schema`` has doc_id and what ``row`` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out = [row(own, value.as_py()) for value in part.column(1)]
                columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names, types = arrow.names, arrow.types[1:]
    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, starts``: the ids of every whole text and the character at which each token begins."""

    def row(own: Codec, text: str | None) -> tuple:
        ids = np.frombuffer(own.encode(text or ""), "<u4")
        return ids.astype(np.int32), own.offsets(text or "", ids).astype(np.int32)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _each_batch(texts, path, pattern, row, "doc_id long, ids array<int>, starts array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, text`` of a frame with ``doc_id, ids``; null ids count as none."""

    def row(own: Codec, ids: list[int] | None) -> tuple:
        return (own.decode(np.array(ids or [], "<u4").tobytes()).decode("utf-8", "replace"),)

    ids = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return _each_batch(ids, path, pattern, row, "doc_id long, text string")


def tokenise(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: the ids of every whole text, proven by the digest of what they decode to."""

    def row(own: Codec, text: str | None) -> tuple:
        ids = own.encode(text or "")
        return len(ids) // 4, np.frombuffer(ids, "<u4").astype(np.int32), hashlib.sha256(own.decode(ids)).hexdigest()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _each_batch(texts, path, pattern, row, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the ids of every whole text, and of the bytes that come back from them."""

    def row(own: Codec, text: str | None) -> tuple:
        ids = own.encode(text or "")
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _each_batch(texts, path, pattern, row, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
