"""URL filters: a trie over reversed host labels and path segments, with the longest entry deciding.

A rule (host, path, verdict) fits a url if the url's host is the rule's or a
subdomain of it and the url's path starts with the rule's. Of the rules that
fit, the longest decides (characters of host and path together, then of the
host); of equal rules that differ in verdict, the block. Where none fits, the
verdict is ``default``.

The trie is walked label by label from the top domain down; every label at
which rules end has a second trie over path segments. The last segment of a
rule may be a part of one, so it is looked up by the lengths that occur there.
A step's time depends on the url, not on the number of rules.

The trie is broadcast up to ``TRIE_BYTES`` of rules (``octet_length``, counted
before anything is brought together). Beyond that the same walk is two equal
joins: the host's suffixes meet the lengths of the paths that rules have there,
and the cut paths meet the rules. Neither side of the second is larger than
the rules or the urls' own (suffix, length) rows, and a hot host is divided by
the skew join.

Defined cases: a null url, or one without ``://``, has an empty host and path;
an empty path starts with no ``/``; rows are judged one by one, so null and
repeated page_ids, repeated rows and other columns have no influence, whatever
their names; urls may be of any length; an empty table gives an empty result,
and without rules ``default`` holds. A rule's host is lower-cased as urls are;
a null or empty host stands for every host, a null path for an empty one; rows
whose verdict is neither ``allow`` nor ``block`` are no rules.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import ROW, fixed

TRIE_BYTES = 16 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _PARTS, 2)


class Trie:
    """Rules by reversed host labels, then by path segments."""

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        self.hosts: dict = {}
        for host, path, verdict in rules:
            node = self.hosts
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            place = node.setdefault(0, {})  # labels and segments are strings, so 0 and 1 are free for what ends here
            *whole, part = path.split("/")
            for segment in whole:
                place = place.setdefault(segment, {})
            place.setdefault(1, {}).setdefault(len(part), {})[part] = (host + path, verdict, len(host))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """Rule and verdict of the longest rule that fits."""
        best, segments, node = None, path.split("/"), self.hosts
        labels = iter(reversed(host.split("."))) if host else iter(())
        while node is not None:
            place = node.get(0)
            for segment in segments:
                if place is None:
                    break
                for length, parts in place.get(1, {}).items():
                    found = parts.get(segment[:length]) if length <= len(segment) else None
                    if found and (best is None or (len(found[0]), found[2]) > (len(best[0]), best[2])):
                        best = found
                place = place.get(segment)
            label = next(labels, None)
            node = node.get(label) if label is not None else None
        return best and best[:2]


def _rules(rules: DataFrame) -> DataFrame:
    """Distinct rules, one verdict each."""
    host, path = F.translate(F.coalesce(F.col("host").cast("string"), F.lit("")), _UPPER, _LOWER), F.coalesce(F.col("path").cast("string"), F.lit(""))
    told = rules.where(F.col("verdict").isin("allow", "block")).select(host.alias("host"), path.alias("path"), "verdict")
    return told.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" is the greater word


def _walker(trie) -> Callable[[Column, Column], Column]:
    """A column of rule and verdict by the broadcast trie."""

    @F.arrow_udf("struct<rule: string, verdict: string>")
    def walk(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        own = trie.value
        found = [own.find(h, p) or (None, None) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["rule", "verdict"])

    return walk


def _joined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (``_row, host, path`` and more) with ``rule, verdict``, by two equal joins."""
    labels = F.split("host", r"\.")
    suffixes = F.when(F.col("host") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    )
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    cut = (
        urls.select(ROW, "path", F.explode(suffixes).alias("host"))
        .join(lengths, "host")
        .select(ROW, "host", "path", F.explode("lengths").alias("n"))
        .where(F.length("path") >= F.col("n"))
        .select(ROW, "host", F.substring("path", F.lit(1), F.col("n")).alias("path"))
    )
    rule = F.concat("host", "path")
    fits = cut.join(rules, ["host", "path"]).groupBy(ROW).agg(F.max_by(F.struct(rule.alias("rule"), "verdict"), F.struct(F.length(rule), F.length("host"))).alias("found"))
    return urls.join(fits, ROW, "left").select(*urls.columns, "found.rule", "found.verdict")


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page; ``rules`` has the columns of ``RULES``."""
    stored = _rules(fixed(rules))
    size = stored.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 8).alias("n")).first()["n"] or 0
    urls = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if size > trie_bytes:
        told = _joined(fixed(urls).withColumn(ROW, F.monotonically_increasing_id()), stored).drop(ROW)
    else:
        trie = Trie([tuple(r) for r in stored.select("host", "path", "verdict").collect()])
        walk = _walker(pages.sparkSession.sparkContext.broadcast(trie))
        told = urls.withColumn("found", walk("host", "path")).select("page_id", "host", "path", "found.rule", "found.verdict")
    return told.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def keep_allowed(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The rows of ``pages``, all columns, whose url is allowed."""
    stored, number = fixed(pages), ROW
    while number in pages.columns:
        number += "_"
    rows = stored.withColumn(number, F.monotonically_increasing_id())
    kept = url_filter(rows.select(F.col(number).alias("page_id"), F.col(url).alias("url")), rules, default, trie_bytes=trie_bytes).where("verdict = 'allow'")
    return rows.join(kept.select(F.col("page_id").alias(number)), number, "left_semi").select(pages.columns)
