r"""Personal data: base patterns, and information-theoretic sanitisation of what reveals it.

Base spans are e-mail addresses, IP addresses, card numbers (Luhn) and phone
numbers. Their values are the protected entities. A term (a word of letters)
that stands within ``NEAR`` words of an entity, whole stretches between white
space of any length, may reveal it: over the whole corpus, with N documents, n(e) and n(t) with the entity and the term and n(e, t)
with the term near the entity, the term discloses

    log2(N * n(e, t) / (n(e) * n(t))) / log2(N / n(e))

of the entity's information. Terms that disclose at least ``DISCLOSURE`` of it,
by at least ``SUPPORT`` documents, are spans of the kind ``term`` wherever they
occur in documents that hold the entity. A term that is met with one document
only is no evidence that it reveals anything; from two documents on, only the
threshold decides.

Spans count code points, with exclusive ends. ``sanitise`` replaces base spans
by their kind and generalises terms to ``[TERM]``, or removes both.

Defined cases: null and empty texts have no spans; every row counts as a
document of its own, with null or repeated doc_ids too; an empty table gives
an empty result; a text of any length is searched in time that grows with its
length, as a match is tried only where one can begin; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import ROW, cut, keyed

KINDS = ("email", "ip", "card", "phone")
NEAR = 8
DISCLOSURE = 0.8
SUPPORT = 2
_PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOT = re.compile(r"(?<=[0-9])\.(?=[0-9])")
_DIGITS = frozenset("0123456789")
_NEEDED = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"\S+")
_TERM = re.compile(r"[^\W\d_]{3,}")


def _luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _holds(kind: str, value: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in value.split(".")))
    if kind == "card":
        digits = _NOT_DIGIT.sub("", value)
        return 14 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 10 <= len(_NOT_DIGIT.sub("", value)) <= 15
    return True


def _emails(text: str) -> Iterator[re.Match]:
    """The matches of the pattern, tried only in runs of its characters that an @ follows, which is where one can begin."""
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and _LOCAL.fullmatch(text, begin - 1, begin):
            begin -= 1
        found = _PATTERNS["email"].match(text, begin) if begin < at else None
        if found:
            yield found
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[re.Match]:
    """The matches of the pattern, tried only at the first digit of a run that a dot and a digit follow, which is where one can begin."""
    done = 0
    for dot in _DOT.finditer(text):
        begin = dot.start()
        while begin > done and text[begin - 1] in _DIGITS:
            begin -= 1
        found = _PATTERNS["ip"].match(text, begin) if begin < dot.start() else None
        if found:
            yield found
            done = found.end()


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, index of the kind, end) of the base spans, sorted by start and kind."""
    if not text or not _NEEDED.search(text):
        return []
    spans = []
    for k, kind in enumerate(KINDS):
        if kind == "email":
            found = _emails(text)
        elif kind == "ip":
            found = _addresses(text)
        elif kind == "phone" and "+" not in text:
            continue
        else:
            found = _PATTERNS[kind].finditer(text)
        spans += [(m.start(), k, m.end()) for m in found if _holds(kind, m.group())]
    return sorted(spans)


def _entity(kind: int, value: str) -> str:
    return f"{KINDS[kind]}:{value.lower() if kind == 0 else value if kind == 1 else _NOT_DIGIT.sub('', value)}"


def _near(text: str, spans: list[tuple[int, int, str]], near: int) -> Iterator[tuple[str, set[str]]]:
    """Each entity with the terms within ``near`` words of its spans; a word that a span cuts counts as far as the span."""
    words = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    places: dict[str, list[tuple[int, int]]] = {}
    for start, kind, end in spans:
        places.setdefault(_entity(kind, text[start:end]), []).append((start, end))
    for entity, own in places.items():
        met = set()
        for start, end in own:
            last, first = bisect_left(starts, start), bisect_right(ends, end)
            reach = [(a, min(b, start)) for a, b in words[max(0, last - near) : last]] + [(max(a, end), b) for a, b in words[first : first + near]]
            for a, b in reach:
                met.update(_TERM.findall(text[a:b].lower()))
        yield entity, met


def _counted(docs: DataFrame, near: int) -> DataFrame:
    """``entity, term, n``: in how many documents the term is near the entity; a null term counts the entity itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                for entity, terms in _near(text, spans, near) if (spans := base_spans(text)) else ():
                    counts.update((entity, term) for term in (None, *terms))
                    if len(counts) > 200_000:
                        yield _pairs(counts)
                        counts.clear()
        if counts:
            yield _pairs(counts)

    def _pairs(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e for e, _ in counts], pa.string()), pa.array([t for _, t in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["entity", "term", "n"])

    return docs.select("text").mapInArrow(run, "entity string, term string, n long").groupBy("entity", "term").agg(F.sum("n").alias("n"))


def _term_counts(docs: DataFrame) -> DataFrame:
    """``term, nt``: in how many documents each term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if text:
                    counts.update(set(_TERM.findall(text.lower())))
            if len(counts) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
                counts.clear()
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("nt"))


def revealing_terms(docs: DataFrame, holders: DataFrame, near: int = NEAR, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``entity, term, disclosed`` for the terms that reveal at least ``disclosure`` of an entity.

    ``holders`` are the rows of ``docs`` with base spans; terms are counted in all of ``docs``.
    """
    total = docs.count()
    counted = _counted(holders, near)
    pairs = counted.where(F.col("term").isNotNull() & (F.col("n") >= support))
    entities = counted.where("term is null").select("entity", F.col("n").alias("ne"))
    met = pairs.join(entities, "entity").join(_term_counts(docs), "term")
    information = F.log2(F.lit(float(max(total, 1))) / F.col("ne"))
    disclosed = F.log2(F.lit(float(max(total, 1))) * F.col("n") / (F.col("ne") * F.col("nt"))) / F.nullif(information, F.lit(0.0))
    return met.select("entity", "term", disclosed.alias("disclosed")).where(F.col("disclosed") >= disclosure)


def find_pii(docs: DataFrame, near: int = NEAR, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``_row, doc_id, text, base, terms``: arrays of ``start, kind, end`` structs, for the rows of a ``keyed`` frame."""
    span = "array<struct<start:int,kind:string,end:int>>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if spans := base_spans(text):
                    rows.append((row, text, [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans], sorted({_entity(k, text[s:e]) for s, k, e in spans})))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], spans_type), pa.array(columns[3], pa.list_(pa.string()))], [ROW, "text", "base", "entities"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, terms, base in zip(batch.column(1), batch.column(2), batch.column(3)):
                text, wanted, taken = text.as_py(), set(terms.as_py()), [(b["start"], b["end"]) for b in base.as_py()]
                spans = [m.span() for m in _TERM.finditer(text) if m.group().lower() in wanted]
                starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max, initial=0))
                # Sorted by start, a span that begins before the term's end touches it if one of them ends behind the term's start.
                out.append([{"start": s, "kind": "term", "end": e} for s, e in spans if reach[bisect_left(starts, e)] <= s])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, spans_type)], [ROW, "terms"])

    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
    found = cut(docs.select(ROW, "text").mapInArrow(find, f"{ROW} long, text string, base {span}, entities array<string>"))
    terms = revealing_terms(docs, found, near, disclosure, support).select("entity", "term")
    known = found.select(ROW, F.explode("entities").alias("entity")).join(terms, "entity").groupBy(ROW).agg(F.collect_set("term").alias("wanted"))
    marked = found.join(known, ROW).select(ROW, "text", "wanted", "base").mapInArrow(mark, f"{ROW} long, terms {span}")
    none = F.array().cast(span)
    return (
        docs.join(found.select(ROW, "base").join(marked, ROW, "left"), ROW, "left")
        .select(ROW, "doc_id", "text", F.coalesce("base", none).alias("base"), F.coalesce("terms", none).alias("terms"))
    )


def span_list(spans: Column | str) -> Column:
    """``kind:start:end`` of each span in order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def pii_report(docs: DataFrame, **how) -> DataFrame:
    """One row per document: counts of base spans, their digest, and all spans."""
    rank = lambda s: F.when(s.kind == "term", 4).otherwise(F.array_position(F.array(*map(F.lit, KINDS)), s.kind) - 1)
    everything = F.transform(F.array_sort(F.transform(F.concat("base", "terms"), lambda s: F.struct(s.start.alias("start"), rank(s).cast("int").alias("rank"), s.kind.alias("kind"), s.end.alias("end")))), lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return find_pii(keyed(docs), **how).select("doc_id", *map(count, KINDS), F.sha2(span_list("base"), 256).alias("base_sha256"), span_list(everything).alias("spans"))


def sanitise(docs: DataFrame, remove: bool = False, **how) -> DataFrame:
    """``doc_id, text``: base spans replaced by their kind and terms by a general word, or all of them removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, base, terms in zip(*(batch.column(i) for i in (1, 2, 3))):
                text, parts, last = text.as_py(), [], 0
                for s in sorted(base.as_py() + terms.as_py(), key=lambda s: (s["start"], -s["end"])):
                    if text is not None and s["end"] > last:
                        parts += [text[last : max(last, s["start"])], "" if remove or s["start"] < last else f"[{s['kind'].upper()}]"]
                        last = s["end"]
                out.append(None if text is None else "".join([*parts, text[last:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return find_pii(keyed(docs), **how).select("doc_id", "text", "base", "terms").mapInArrow(run, "doc_id long, text string")
