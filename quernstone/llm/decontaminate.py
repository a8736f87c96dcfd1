r"""Benchmark decontamination with a broadcast set of item windows, in DataFrame operations only.

Words are the runs of letters, digits and non-ASCII characters of the text
with A-Z lower-cased. Every run of ``n`` consecutive item words is a window
(an item of fewer words is one window). The distinct windows are numbered and
broadcast if their bytes are few enough; the hash of every run of document
words is probed, and each probe that meets a window is compared with the
window's words themselves.

The benchmark does not grow with the corpus; still its windows' bytes are
counted, and above ``BROADCAST_BYTES`` the probe is an ordinary shuffled join.
Items are looked up by the number of the window after the hits are told apart,
so that a window of many items is one row. Texts are not shuffled: what may be
hit is brought to them, broadcast under the same limit.

Defined cases: null and empty texts have no words and no hits; an empty
benchmark hits nothing; repeated items are separate items; rows with a null or
repeated doc_id are judged each on its own; items without words and items with
a null id and no words hit nothing, a null item_id is left out of the list of
ids; a very long text's words and runs are held as one row; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .frames import ROW, cut, keep_rows, keyed

WINDOW_WORDS = 10
BROADCAST_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_GAP, _ANY_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Normalised words; null for a null text."""
    spaced = F.translate(text, _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN))
    return F.array_remove(F.split(spaced, " "), "")


def _runs(length: int) -> Column:
    """Start and hash of every run of ``length`` words of the column ``words``."""
    w = F.col("words")
    starts = F.when(F.size(w) >= length, F.sequence(F.lit(0), F.size(w) - length)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.xxhash64(F.lit(length), F.slice(w, i + 1, length)).alias("h")))


def _size(words: str, n: int) -> Column:
    return F.least(F.size(words), F.lit(n))


def item_windows(benchmark: DataFrame, n: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame]:
    """``w, k, h, seq``: the distinct windows of ``k`` words, numbered; and ``w, item_id``: the items that have them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.size("words") - _size("words", n))
    found = cut(items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, _size("words", n)))).alias("seq")).distinct())
    distinct = cut(found.select("seq").distinct()).select(F.monotonically_increasing_id().alias("w"), F.size("seq").alias("k"), "seq")
    windows = cut(distinct.select("w", "k", F.xxhash64(F.col("k"), "seq").alias("h"), "seq"))
    return windows, cut(found.join(windows, "seq").select("w", "item_id"))


def _broadcast(df: DataFrame, bytes_: Column, most: int) -> DataFrame:
    """``df``, to be broadcast if it has no more than ``most`` bytes."""
    held = df.agg(F.sum(bytes_)).first()[0] or 0
    return F.broadcast(df) if held <= most else df


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``_row, doc_id, text, n_words, hit, items`` for the rows of a ``keyed`` frame: ``hit`` lists the positions of hit words."""
    windows, members = item_windows(benchmark, n)
    lengths = sorted(r[0] for r in windows.select("k").distinct().collect())  # n values at most
    near = _broadcast(windows.select("w", "h"), F.lit(32), broadcast_bytes)
    probe = docs.select(ROW, words(F.coalesce("text", F.lit(""))).alias("words"))
    runs = F.concat(*[_runs(k) for k in lengths]) if lengths else F.array().cast("array<struct<start:int,h:bigint>>")
    probes = probe.select(ROW, F.explode(runs).alias("run")).select(ROW, "run.start", "run.h")
    found = cut(probes.join(near.select("w", "h"), "h").select(ROW, "start", "w"))

    # The words that may be hit, compared with the windows' own.
    sequences = _broadcast(windows.select("w", "seq"), F.length(F.array_join("seq", " ")) + 24 * F.size("seq"), broadcast_bytes)
    listed = found.join(sequences, "w").groupBy(ROW).agg(F.collect_list(F.struct("start", "w", "seq")).alias("found"))
    listed = _broadcast(cut(listed), F.aggregate("found", F.lit(0), lambda a, c: a + 32 + 24 * F.size(c.seq) + F.length(F.array_join(c.seq, " "))), broadcast_bytes)
    told = docs.withColumn("words", words(F.coalesce("text", F.lit("")))).join(listed, ROW, "left")
    true = F.filter(F.coalesce("found", F.array().cast(listed.schema["found"].dataType)), lambda c: F.slice("words", c.start + 1, F.size(c.seq)) == c.seq)
    covered = F.array_distinct(F.flatten(F.transform("true", lambda c: F.sequence(c.start, c.start + F.size(c.seq) - 1))))
    told = told.select(ROW, "doc_id", "text", F.size("words").alias("n_words"), true.alias("true")).select(ROW, "doc_id", "text", "n_words", covered.alias("hit"))

    rows_hit = docs.join(listed, ROW).withColumn("words", words("text")).select(ROW, true.alias("true")).select(ROW, F.explode(F.array_distinct(F.transform("true", lambda c: c.w))).alias("w"))
    items = rows_hit.join(members, "w").groupBy(ROW).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    items = _broadcast(cut(items), F.length(F.array_join("items", ",")) + 24 * F.size("items") + 32, broadcast_bytes)
    return told.join(items, ROW, "left").select(ROW, "doc_id", "text", "n_words", "hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """One row per document: its word count, hit words, and the items whose windows occur in it."""
    return contamination(keyed(docs), benchmark, n).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.col("items").alias("item_ids"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def remove_hit_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """``docs``, all columns, without the documents that hold a window of an item."""
    return keep_rows(docs, lambda rows: contamination(rows, benchmark, n).where(F.size("hit") == 0))


def remove_hit_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """``doc_id, text``: each text without its hit words; what stands between words stays."""
    pieces = F.regexp_extract_all("text", F.lit(_GAP + _ANY_WORD), F.lit(0))
    # The separators in front of a removed word stay, so that its neighbours do not run together.
    rest = F.transform("pieces", lambda p, i: F.when(F.array_contains("hit", i), F.regexp_extract(p, f"^{_GAP}", 0)).otherwise(p))
    whole = F.concat(F.array_join(rest, ""), F.regexp_extract("text", rf"{_GAP}\z", 0))
    return (
        contamination(keyed(docs), benchmark, n)
        .withColumn("pieces", pieces)
        .select("doc_id", F.when(F.size("hit") == 0, F.col("text")).otherwise(whole).alias("text"))
    )
