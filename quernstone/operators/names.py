"""Many names sought at once: one automaton over all of them, one pass over each text.

The automaton (Aho-Corasick) is broadcast if the names take at most
``NAMES_BYTES``; more names are dealt into blocks of that size, and the texts
are read once for each. A text's time depends on its length and on what is
found in it, not on how many names there are.

Of mentions that overlap, the longest stays, then the one further left, then
the name that comes first. That is what replacing the names one after the
other, longest first, gives, but what has been put in is not searched again.
"""

from __future__ import annotations

import bisect
import string
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .lineage import cut

NAMES_BYTES = 32 << 20
Mention = tuple[int, int, str, str]
_WORD = frozenset(string.ascii_letters + string.digits)


def folded(text: str) -> str:
    """Lower case, character for character; what would change its length stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def automaton(names: Iterable[tuple[str, str]], fold: bool):
    """All names with what they stand for; of a name that is there twice, the least value."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for name, value in sorted(names, reverse=True):
        key = folded(name) if fold else name
        if key:
            found.add_word(key, (len(key), name, value))
    found.make_automaton()
    return found


def occurrences(own, text: str, fold: bool, whole: bool) -> list[Mention]:
    """``start, end, name, value`` of every mention, overlapping ones too; ``whole``: no ASCII letter or digit touches it."""
    if not len(own):
        return []
    last, found = len(text) - 1, own.iter(folded(text) if fold else text)
    if whole:
        return [(e + 1 - n, e + 1, name, value) for e, (n, name, value) in found if (e == last or text[e + 1] not in _WORD) and (e + 1 == n or text[e - n] not in _WORD)]
    return [(e + 1 - n, e + 1, name, value) for e, (n, name, value) in found]


def _longest(mentions: list[Mention]) -> list[Mention]:
    """The mentions that stay: longest first, then left, then by name; those that meet no other are not compared."""
    kept, group, reach = [], [], 0
    for m in [*sorted(mentions), None]:
        if m is None or m[0] >= reach:
            if len(group) > 1:
                own: list[Mention] = []
                for x in sorted(group, key=lambda x: (x[0] - x[1], x[0], x[2])):
                    at = bisect.bisect_left(own, x[:1])
                    if (not at or own[at - 1][1] <= x[0]) and (at == len(own) or own[at][0] >= x[1]):
                        own.insert(at, x)
                group = own
            kept += group
            group = []
        if m is not None:
            group.append(m)
            reach = max(reach, m[1])
    return kept


def apart(mentions: Iterable[Mention], taken: Iterable[tuple[int, int]] = (), once: bool = False) -> list[Mention]:
    """The mentions that stay, in the order of the text: longest first, none inside ``taken``, each name one time if ``once``."""
    taken = sorted(taken)
    if not once:
        free = mentions if not taken else [m for m in mentions if not _meets(taken, m)]
        return _longest(list(free))
    kept: list[Mention] = []
    spans, seen = [tuple(t) for t in taken], set()
    for m in sorted(mentions, key=lambda m: (m[0] - m[1], m[2], m[0])):
        if m[2] not in seen and not _meets(spans, m):
            bisect.insort(spans, (m[0], m[1]))
            kept.append(m)
            seen.add(m[2])
    return sorted(kept)


def _meets(spans: list[tuple[int, int]], m: Mention) -> bool:
    """Whether one of the spans, which lie apart and in order, overlaps the mention."""
    at = bisect.bisect_right(spans, (m[0], m[1]))
    return bool(at and spans[at - 1][1] > m[0]) or (at < len(spans) and spans[at][0] < m[1])


def replaced(text: str, mentions: list[Mention]) -> str:
    out, at = [], 0
    for start, end, _, value in mentions:
        out += [text[at:start], value]
        at = end
    return "".join([*out, text[at:]])


def blocks(names: DataFrame, most: int) -> Iterator[list[tuple[str, str]]]:
    """The names (``name, value``) in lists of about ``most`` bytes; one empty list if there are none."""
    told = names.where("name is not null and name <> ''").select(F.col("name").cast("string"), F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value")).distinct()
    told = cut(told.withColumn("bytes", F.octet_length("name") + F.octet_length("value") + 16))
    count = -(-(told.agg(F.sum("bytes")).first()[0] or 0) // most) or 1
    for k in range(count):
        yield [(r["name"], r["value"]) for r in told.where(F.pmod(F.xxhash64("name"), F.lit(count)) == k).select("name", "value").collect()]


def mentions(texts: DataFrame, names: DataFrame, id: str, text: str, fold: bool = True, whole: bool = False, most: int = NAMES_BYTES) -> DataFrame:
    """``id, start, stop, name, value`` of every mention in every text, overlapping ones too; positions count characters from 0."""
    every = None
    for own in blocks(names, most):
        shared = texts.sparkSession.sparkContext.broadcast(automaton(own, fold))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(i, *m) for i, t in zip(batch["id"], batch["text"]) if t for m in occurrences(shared.value, t, fold, whole)]
                yield pd.DataFrame(rows, columns=["id", "start", "stop", "name", "value"])

        part = texts.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {dict(texts.dtypes)[id]}, start int, stop int, name string, value string")
        every = part if every is None else every.union(part)
    return every.withColumnRenamed("id", id)


def rewrite(texts: DataFrame, names: DataFrame, text: str, fold: bool = True, whole: bool = False, once: bool = False, spare: str | None = None, most: int = NAMES_BYTES) -> DataFrame:
    """``texts`` with the values of the names in place of their mentions, and ``n_replaced``.

    ``names``: name, value. ``once``: only the first mention of a name. ``spare``:
    a pattern whose matches stay as they are. A null text stays null.
    """
    import re

    guard = re.compile(spare) if spare else None

    def done(value: str | None, found: Iterable[Mention]) -> tuple[str | None, int]:
        if value is None:
            return None, 0
        kept = apart(found, (m.span() for m in guard.finditer(value)) if guard else (), once)
        return replaced(value, kept), len(kept)

    parts = list(blocks(names, most))
    if len(parts) == 1:
        shared = texts.sparkSession.sparkContext.broadcast(automaton(parts[0], fold))

        @F.pandas_udf("struct<text: string, n: int>")
        def change(column: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([done(v, occurrences(shared.value, v, fold, whole) if v else ()) for v in column], columns=["text", "n"])

        told = texts.withColumn("_done", change(F.col(text)))
    else:
        rows = cut(texts.withColumn("_id", F.monotonically_increasing_id()))
        found = mentions(rows, names, "_id", text, fold, whole, most).groupBy("_id").agg(F.collect_list(F.struct("start", "stop", "name", "value")).alias("_found"))

        @F.pandas_udf("struct<text: string, n: int>")
        def merge(column: pd.Series, lists: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([done(v, [(m["start"], m["stop"], m["name"], m["value"]) for m in (own if own is not None else ())]) for v, own in zip(column, lists)], columns=["text", "n"])

        told = rows.join(found, "_id", "left").withColumn("_done", merge(F.col(text), F.col("_found"))).drop("_id", "_found")
    return told.withColumn(text, F.col("_done.text")).withColumn("n_replaced", F.col("_done.n")).drop("_done")
