"""Chunks of bounded size: by headings, then by segments, then at a paragraph, else at a line, else at a character."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

# The mark of a page that goes on with the entry before it, the name of what stands before the first
# heading, what continued chunks are marked with, and the segments that never leave their entry's first chunk.
CONTINUED_MARK = "<!--CONT-->"
PREFACE = "前言"
CONTINUED = "（续）"
WEAPON_SEGMENTS = ("### 远程武器", "### 近战武器")


def _pieces(text: str, budget: int) -> list[str]:
    """Greedy pieces of at most ``budget`` characters. Each cut depends on the one before, which no built-in expresses."""
    out, at = [], 0
    while len(text) - at > budget:
        end = max(text.rfind("\n\n", at, at + budget), at)
        if end == at:
            end = max(text.rfind("\n", at, at + budget), at)
        if end == at:
            end = at + budget
        out.append(text[at:end].rstrip("\n"))
        at = end
        while at < len(text) and text[at] == "\n":
            at += 1
    return out + [text[at:]] if at < len(text) else out


def size_pieces(text: Column, budget: int) -> Column:
    """The text's pieces in order; null for a null text, none for an empty one."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _pieces(t, budget))

    return cut(text)


def headed_chunks(sections: DataFrame, heading: str, body: str, budget: int) -> DataFrame:
    """``part, chunk`` for every row: its body in pieces of bounded size, each under its heading, later ones marked as continued."""
    cut = sections.select("*", F.posexplode(size_pieces(F.col(body), budget)).alias("part", "_piece"))
    return cut.withColumn("chunk", F.concat(F.lit("## "), heading, F.when(F.col("part") > 0, CONTINUED).otherwise(""), F.lit("\n"), "_piece")).drop("_piece")


def entries(pages: DataFrame, book: str, page: str, text: str) -> DataFrame:
    """``book, entry, page, heading, body``: what stands under each ``## `` heading of a book, over its pages, from the page of the heading on.

    What stands before the first heading is entry 0, if it is not blank, and
    has the book's ``# `` title for a heading. A window holds the lines of one
    book.
    """
    lines = pages.where(F.col(text) != "").select(F.col(book).alias("book"), F.col(page).alias("page"), F.posexplode(F.split(F.regexp_replace(text, "(\\r\\n|\\n|\\r)$", ""), "\\r\\n|\\n|\\r")).alias("at", "line"))
    lines = lines.where(F.trim("line") != CONTINUED_MARK)
    is_heading = F.col("line").startswith("## ")
    order = Window.partitionBy("book").orderBy("page", "at")
    placed = lines.withColumn("entry", F.sum(is_heading.cast("int")).over(order)).withColumn("at", F.row_number().over(order)).withColumn("is_heading", is_heading)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("at", "line")))), lambda x: x["line"]), "\n")
    named = F.max(F.when(F.col("is_heading"), F.trim(F.substring("line", 4, 1 << 30))))
    title = F.min_by(F.when(F.col("line").startswith("# "), F.trim(F.substring("line", 3, 1 << 30))), F.when(F.col("line").startswith("# "), F.col("at")))
    kept = placed.groupBy("book", "entry").agg(F.min_by("page", "at").alias("page"), F.when(F.col("entry") > 0, named).otherwise(F.coalesce(title, F.lit(PREFACE))).alias("heading"), body.alias("body"))
    return kept.where((F.col("entry") > 0) | F.col("body").rlike("\\S"))


def _packed(segments: Column, budget: int, first: Column) -> Column:
    """Segments joined into parts, a new one begun where the budget would be passed; ``first`` stands alone before them if it is not null."""
    state = F.struct(F.when(first.isNotNull(), F.array(first)).otherwise(F.array().cast("array<string>")).alias("parts"), F.lit("").alias("open"))

    def step(s: Column, segment: Column) -> Column:
        full = (s["open"] != "") & (F.length(s["open"]) + F.length(segment) > budget)
        joined = F.when(s["open"] == "", segment).otherwise(F.concat(s["open"], F.lit("\n"), segment))
        return F.struct(F.when(full, F.concat(s["parts"], F.array(s["open"]))).otherwise(s["parts"]).alias("parts"), F.when(full, segment).otherwise(joined).alias("open"))

    return F.aggregate(segments, state, step, lambda s: F.when(s["open"] == "", s["parts"]).otherwise(F.concat(s["parts"], F.array(s["open"]))))


def section_chunks(pages: DataFrame, book: str, page: str, text: str, budget: int = 2000) -> DataFrame:
    """``book, entry, part, page, heading, chunk``: the entries of books, those over the budget in parts that repeat the heading.

    Parts are packed from the ``### `` segments of an entry. The first segment
    and the weapon segments stay together in the first part, however long; an
    entry without weapons only begins with its first segment. An entry without
    segments is cut where ``size_pieces`` cuts.
    """
    body = F.col("body")
    segments = F.split(body, "\n(?=### )")
    weapon = lambda x: F.exists(F.array(*map(F.lit, WEAPON_SEGMENTS)), lambda p: x.startswith(p))
    rest = F.slice(segments, 2, F.size(segments))
    guns = F.filter(rest, weapon)
    with_guns = _packed(F.filter(rest, lambda x: ~weapon(x)), budget, F.array_join(F.concat(F.slice(segments, 1, 1), guns), "\n"))
    long_ = F.length(body) > budget
    plain = long_ & ~F.concat(F.lit("\n"), body).contains("\n### ")
    parts = F.when(~long_, F.array(body)).when(plain, F.col("_pieces")).when(F.size(guns) > 0, with_guns).otherwise(_packed(segments, budget, F.lit(None).cast("string")))
    cut = entries(pages, book, page, text).withColumn("_pieces", size_pieces(F.when(plain, body), budget)).select("book", "entry", "page", "heading", F.posexplode(parts).alias("part", "_part"))
    head = F.concat(F.lit("## "), "heading", F.when(F.col("part") > 0, CONTINUED).otherwise(""))
    whole = F.when(F.col("_part") == "", head).otherwise(F.concat(head, F.lit("\n"), "_part"))
    return cut.select("book", "entry", "part", "page", "heading", F.regexp_replace(whole, "^\\s+|\\s+$", "").alias("chunk"))
