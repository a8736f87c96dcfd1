"""Text normalisers and parsers as Column functions. All are null-preserving unless stated."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Typographic signs and their plain forms.
CURLY, STRAIGHT = "‘’“”", "''\"\""
DASHES = "–—−"
INCH_SIGNS = "[\"”“″′'寸吋 ]"
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def _replace_all(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def plain_quotes(c: Column) -> Column:
    """Curly quotes made straight, trimmed."""
    return F.trim(F.translate(c, CURLY, STRAIGHT))


def match_key(c: Column) -> Column:
    return F.lower(plain_quotes(c))


def compare_key(c: Column) -> Column:
    """For statistics of two sources: inch signs and spaces do not count."""
    return _replace_all(plain_quotes(c), (('"', ""), (" ", "")))


def guard_key(c: Column) -> Column:
    """For compare-and-set guards: signs of length and spaces do not count, + and - do."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), INCH_SIGNS, "")


def stat_key(c: Column) -> Column:
    return F.replace(guard_key(c), F.lit("+"), F.lit(""))


def text_key(c: Column) -> Column:
    """For fingerprints: no tags, plain quotes and dashes, single spaces, lower case."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", " ")
    c = F.translate(F.translate(c, CURLY, STRAIGHT), DASHES, "---")
    return F.lower(F.trim(F.regexp_replace(c, "[ \\t\\n\\r]+", " ")))


def fingerprint(c: Column) -> Column:
    return F.sha2(text_key(c), 256)


def unit_key(c: Column) -> Column:
    """A name's key: single spaces, without one trailing s."""
    squashed = F.trim(F.regexp_replace(F.lower(c), "[ \\t\\n\\r]+", " "))
    return F.when(squashed.endswith("s"), F.substring(squashed, F.lit(1), F.length(squashed) - 1)).otherwise(squashed)


def heading_key(c: Column) -> Column:
    """Upper case, only letters, digits, apostrophes, hyphens and spaces."""
    c = F.upper(F.translate(F.translate(c, CURLY, STRAIGHT), DASHES, "---"))
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[^A-Z0-9' -]", ""), " +", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.replace(c, F.lit("'"), F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def heading_scripts(c: Column) -> tuple[Column, Column]:
    """The Chinese and the Latin part of a bilingual heading, null where absent."""
    chinese = F.nullif(F.trim(F.regexp_extract(c, "([\\x{4e00}-\\x{9fff}][\\x{4e00}-\\x{9fff}·，、 ]*)", 1)), F.lit(""))
    latin = F.nullif(F.trim(F.regexp_extract(c, "([A-Za-z][A-Za-z0-9' -]*)", 1)), F.lit(""))
    return chinese, latin


def clean_html(c: Column, gap: str = " ") -> Column:
    """Text of an HTML fragment: tags give way to ``gap``, entities are resolved, spaces squashed."""
    return F.trim(F.regexp_replace(_replace_all(F.regexp_replace(c, "<[^>]*>", gap), ENTITIES), "[ \\t\\n\\r]+", " "))


def strip_code_fence(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), "^```[a-zA-Z]*\\n", ""), "\\n```$", "")


def strip_links(c: Column) -> Column:
    """``[[path|name]]`` reads name, ``[[name]]`` reads name."""
    return F.regexp_replace(F.regexp_replace(c, "\\[\\[[^\\]|]*\\|([^\\]]*)\\]\\]", "$1"), "\\[\\[([^\\]|]*)\\]\\]", "$1")


def link_targets(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit("\\[\\[([^\\]|]+)"), F.lit(1)), F.trim)


def escape_pipes(c: Column) -> Column:
    """Pipes inside links, which would end a table cell, are escaped."""
    return F.regexp_replace(c, "(\\[\\[[^\\]|\\\\]*)\\|", "$1\\\\|")


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))


def latin_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def cjk_bigrams(c: Column) -> Column:
    """Tokens of mixed text: Latin words, and pairs of neighbouring Chinese characters (single ones as they are)."""
    runs = F.regexp_extract_all(c, F.lit("[\\x{4e00}-\\x{9fff}]+"), F.lit(0))
    pairs = F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(latin_tokens(c), F.flatten(pairs))


def summary(body: Column, most: int = 80) -> Column:
    """The start of the first line that is neither a heading, a table, a quote nor empty."""
    lines = F.filter(F.transform(F.split(strip_links(body), "\\n"), F.trim), lambda x: (x != "") & ~x.rlike("^[#|>]"))
    return F.substring(F.try_element_at(lines, F.lit(1)), 1, most)


def file_of_url(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(c, "[?#].*$", ""), "([^/]*)$", 1)


def folder_of(c: Column) -> Column:
    """The first folder of a relative path, null for a file at the top."""
    return F.when(F.instr(c, "/") > 0, F.split_part(c, F.lit("/"), F.lit(1)))


def verdict(c: Column) -> Column:
    """Verdict of a judgement: signs before words, partial if neither is there."""
    return (
        F.when(c.contains("✅"), "correct")
        .when(c.contains("❌"), "wrong")
        .when(c.contains("⚠"), "partial")
        .when(F.lower(c).contains("incorrect") | F.lower(c).contains("wrong"), "wrong")
        .when(F.lower(c).contains("correct"), "correct")
        .otherwise("partial")
    )


def stat_token(c: Column) -> Column:
    """The value of a statistic as it is compared: number with sign, dice or plain text."""
    c = F.regexp_replace(F.lower(F.trim(c)), INCH_SIGNS, "")
    found = F.regexp_extract(c, "([0-9]*d[0-9]+(?:[+-][0-9]+)?|-?[0-9]+\\+?)", 1)
    return F.when(found != "", F.regexp_replace(found, "\\+$", "")).otherwise(c)


def bottleneck(retrieval: Column, generation: Column) -> Column:
    """Which stage of an answer failed."""
    return (
        F.when(generation == "correct", "ok")
        .when(retrieval == "wrong", "retrieval")
        .when(retrieval == "correct", "generation")
        .otherwise("mixed")
    )


def as_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "on"), F.lit(False))


def positive_int(c: Column, most: int | None = None) -> Column:
    n = c.try_cast("int")
    return F.when((n >= 1) & ((n <= most) if most else F.lit(True)), n)


def loadout(c: Column) -> Column:
    """``name:count,name:count`` as an array of structs; null if any part is malformed."""
    parts = F.transform(F.split(c, ","), F.trim)
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, "^(.*?)(?::([0-9]+))?$", 1)).alias("name"), F.coalesce(F.nullif(F.regexp_extract(p, ":([0-9]+)$", 1), F.lit("")).try_cast("int"), F.lit(1)).alias("count")))
    return F.when(F.forall(pairs, lambda p: (p["name"] != "") & ~p["name"].contains(":") & (p["count"] > 0)), pairs)


def version_rank(stem: Column) -> tuple[Column, Column]:
    """Kind (4 date, 3 V number, 2 decimal, 1 four digits, 0 none) and number of the version in a file name."""
    date = F.regexp_extract(stem, "(20[0-9]{6})", 1)
    marked = F.regexp_extract(stem, "[vV]([0-9]+(?:\\.[0-9]+)?)", 1)
    decimal = F.regexp_extract(stem, "([0-9]+\\.[0-9]+)", 1)
    short = F.regexp_extract(stem, "(?:^|[^0-9])([0-9]{4})(?:[^0-9]|$)", 1)
    kind = F.when(date != "", 4).when(marked != "", 3).when(decimal != "", 2).when(short != "", 1).otherwise(0)
    text = F.when(date != "", date).when(marked != "", marked).when(decimal != "", decimal).when(short != "", short)
    return kind, text.try_cast("double")


def edition_layer(edition: Column, layer: Column) -> Column:
    label = F.when(layer == "rules", "rules").when(layer == "faction", "faction").otherwise("other")
    return F.concat(F.lit("["), F.coalesce(edition, F.lit("?")), F.lit("/"), label, F.lit("]"))
