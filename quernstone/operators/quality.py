"""Text graph, lint and answer scoring."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx
from . import names as name_search, resolve
from .lineage import cut


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links (``source, target``) whose target, with or without its ending, is no known page (``path``)."""
    known = pages.select(F.col("path").alias("target")).union(pages.select(F.regexp_replace("path", "\\.md$", ""))).distinct()
    return links.join(known, "target", "left_anti")


LINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"


def repaired_links(pages: DataFrame, known: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """``page, text, n_repaired``: links (``[[target]]`` or ``[[target|shown]]``) to no known page (``path``) lead to the page whose path is most like theirs.

    A link that no path is ``cutoff`` like stays as it is.
    """
    targets = pages.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(LINK), F.lit(1)))).alias("target")).distinct()
    broken = broken_links(targets, known).select(F.col("target").alias("name"))
    found = resolve.closest(broken, known.select(F.col("path").alias("name")), cutoff)
    ends = F.explode(F.array(F.lit("]]"), F.lit("|"))).alias("end")
    changes = found.select("name", "match", ends).select(F.concat(F.lit("[["), "name", "end").alias("name"), F.concat(F.lit("[["), "match", "end").alias("value"))
    return name_search.rewrite(pages.select("page", "text"), changes, "text", fold=False).withColumnRenamed("n_replaced", "n_repaired")


def structure(rows: DataFrame, key: str, lists: str) -> DataFrame:
    """``key, shape``: the canonical form of each row's lists (``array<array<string>>``), sorted, empty ones too; rows with empty lists only are left out.

    A key that comes twice is an error.
    """
    told = rows.where(F.exists(lists, lambda x: F.size(x) > 0))
    once = told.groupBy(key).agg(F.count("*").alias("_n"), F.min(F.to_json(F.array_sort(F.transform(lists, lambda x: F.coalesce(x, F.array().cast("array<string>")))))).alias("shape"))
    twice = F.raise_error(F.concat(F.lit("a key comes twice: "), F.col(key).cast("string")))
    return once.select(key, F.when(F.col("_n") > 1, twice).otherwise(F.col("shape")).alias("shape"))


def aligned_verdict(gold: Column, required: Column, answer: Column) -> Column:
    """correct, partial or wrong by the fields asked for, of which an answer may have several records.

    ``gold``: map of field to value. ``required``: the fields asked for.
    ``answer``: map of field to ``struct<many: boolean, tokens: array<string>>``;
    the i-th tokens of fields with many belong to one record, null where it has
    none, and a field with one counts for all records. A field without a token
    is missing, one whose tokens are all other values is wrong. An answer is
    correct if nothing is wrong or missing and one record has all gold values.
    """
    own = F.transform(required, lambda f: F.struct(F.try_element_at(gold, f).alias("gold"), F.try_element_at(answer, f).alias("told")))
    tokens = lambda x: F.coalesce(x["told"]["tokens"], F.array().cast("array<string>"))
    many = lambda x: F.coalesce(x["told"]["many"], F.lit(False))
    given = lambda x: F.exists(tokens(x), lambda t: t.isNotNull())
    hit = lambda x: F.exists(tokens(x), lambda t: t.isNotNull() & t.eqNullSafe(x["gold"]))
    wrong, missing, matched = F.exists(own, lambda x: given(x) & ~hit(x)), F.exists(own, lambda x: ~given(x)), F.exists(own, hit)
    records = F.array_max(F.transform(own, lambda x: F.when(many(x), F.size(tokens(x))).otherwise(1)))
    of_record = lambda i: F.forall(own, lambda x: F.get(tokens(x), F.when(many(x), i).otherwise(0)).eqNullSafe(x["gold"]))
    one = F.exists(F.sequence(F.lit(0), F.greatest(records, F.lit(1)) - 1), of_record)
    return F.when(wrong | ~matched, "wrong").when(missing, "partial").when(one, "correct").otherwise("partial")


def name_conflicts(names: DataFrame) -> DataFrame:
    """``name, pages``: names that more than one page claims, in any case."""
    claimed = names.groupBy(F.lower("name").alias("name")).agg(F.countDistinct("page").alias("pages"))
    return claimed.where("pages > 1")


def lint(rules: dict[str, DataFrame | Callable[[], DataFrame]]) -> DataFrame:
    """``rule, subject``: the findings of all rules (each a frame with ``subject``, or what makes one).

    Each rule runs by itself. One that fails, when it is made or when it runs,
    is a finding of the rule ``lint_error`` about it, and the others go on.
    """
    found = []
    for rule, made in rules.items():
        try:
            rows = made() if callable(made) else made
            found.append(cut(rows.select(F.lit(rule).alias("rule"), F.col("subject").cast("string").alias("subject"))))
        except PySparkException:
            spark = SparkSession.active()
            found.append(spark.range(1).select(F.lit("lint_error").alias("rule"), F.lit(rule).alias("subject")))
    return reduce(DataFrame.unionByName, found)


def fragments(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """``entity_id, n, text``: the texts of the pages that an entity names (``entity_id, book, pages``), in the order of the pages; pages that are not there count for nothing."""
    named = entities.select("entity_id", "book", F.posexplode(F.array_sort("pages")).alias("at", "page"))
    met = named.join(pages.where("text is not null"), ["book", "page"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "at", "text"))), lambda x: x["text"])
    return met.groupBy("entity_id").agg(F.count("*").alias("n"), F.array_join(ordered, "\n").alias("text"))


def affected(pages: DataFrame, changed: DataFrame) -> DataFrame:
    """``page``: the pages one of whose references (``page, raw``: array<string>) has one of the changed paths (``path``) in it."""
    references = pages.select("page", F.explode("raw").alias("reference"))
    sought = changed.select(F.col("path").alias("name"), F.lit("").alias("value"))
    return name_search.mentions(references, sought, "page", "reference", fold=False).select("page").distinct()


def layered_summary(results: DataFrame) -> DataFrame:
    """One row: how often retrieval hit and generation was right, generation given a hit, and where answers failed.

    ``results``: retrieval, generation (each correct, partial or wrong). Shares are per cent; null where nothing is counted.
    """
    hit, right = F.col("retrieval") == "correct", F.col("generation") == "correct"
    share = lambda n, d: F.round(F.try_divide(100.0 * n, d), 1)
    stage = tx.bottleneck(F.col("retrieval"), F.col("generation"))
    return results.agg(
        F.count("*").alias("total"),
        *[F.count_if(stage == s).alias(f"stage_{s}") for s in ("ok", "generation", "retrieval", "mixed")],
        share(F.count_if(hit), F.count("*")).alias("retrieval_accuracy"),
        share(F.count_if(right), F.count("*")).alias("generation_accuracy"),
        share(F.count_if(hit & right), F.count_if(hit)).alias("conditional_accuracy"),
    )


def ambiguous_versions(files: DataFrame, group: list[str], kind: str) -> DataFrame:
    """Per group its highest kind of version, and whether that is a plain number of four digits which two files or more have."""
    top = files.groupBy(*group).agg(F.max(kind).alias("kind"), F.count("*").alias("files"))
    many = files.groupBy(*group, kind).agg(F.count("*").alias("_n"))
    return top.join(many, [*group, kind]).select(*group, "files", kind, ((F.col(kind) == 1) & (F.col("_n") > 1)).alias("ambiguous"))


def invented(output: Column, source: Column) -> Column:
    """Numbers of the output that the source does not have, as a set."""
    return F.array_sort(F.array_except(F.array_distinct(tx.numbers(output)), tx.numbers(source)))


def exceeding(df: DataFrame, key: str, output: str, source: str) -> DataFrame:
    """``key, tok, surplus``: numbers that the output has more often than the source."""
    count = lambda c, name: df.select(key, F.explode(tx.numbers(F.col(c))).alias("tok")).groupBy(key, "tok").agg(F.count("*").alias(name))
    met = count(output, "n_out").join(count(source, "n_in"), [key, "tok"], "left")
    return met.withColumn("surplus", F.col("n_out") - F.coalesce("n_in", F.lit(0))).where("surplus > 0").select(key, "tok", "surplus")


def page_state(source_chars: Column, out_chars: Column, fallback: Column, stale: Column, warned: Column) -> Column:
    """The state of a refined page; the first that applies."""
    return (
        F.when(source_chars < 20, "skipped")
        .when(out_chars.isNull(), "missing")
        .when(fallback, "fallback")
        .when(stale, "stale")
        .when((source_chars >= 300) & (out_chars < 0.3 * source_chars), "truncated")
        .when(warned, "verify_warn")
        .otherwise("ok")
    )


def classified(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The category of the first rule whose pattern the text matches."""
    out = F.lit(other)
    for category, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), category).otherwise(out)
    return out


def gold_fields(gold: Column) -> Column:
    """``NAME value`` pairs of a gold answer as a map, null if a name comes twice."""
    pairs = F.regexp_extract_all(gold, F.lit("([A-Z]+) ?[:=] ?[0-9Dd+-]+"), F.lit(0))
    names = F.transform(pairs, lambda p: F.regexp_extract(p, "^([A-Z]+)", 1))
    values = F.transform(pairs, lambda p: tx.stat_token(F.regexp_extract(p, "[:=] ?([0-9Dd+-]+)$", 1)))
    return F.when(F.size(F.array_distinct(names)) == F.size(names), F.map_from_arrays(names, values))


def mechanical(gold: Column, answer: Column) -> Column:
    """correct if every gold field is answered alike, partial if some are, wrong if none is, unknown without fields."""
    keys = F.map_keys(gold)
    hits = F.size(F.filter(keys, lambda k: F.try_element_at(answer, k).eqNullSafe(F.element_at(gold, k))))
    return F.when(gold.isNull() | (F.size(keys) <= 0), "unknown").when(answer.isNull(), "wrong").when(hits == F.size(keys), "correct").when(hits > 0, "partial").otherwise("wrong")


def zipped(left: DataFrame, right: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """k-th with k-th value of two lists per key, only where both are of one length."""

    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"]).alias(name))

    both = listed(left, "l").join(listed(right, "r"), key).where(F.size("l") == F.size("r"))
    pairs = both.select(key, F.posexplode(F.arrays_zip("l", "r")).alias("pos", "p"))
    return pairs.select(key, "pos", F.col("p.l").alias("left_value"), F.col("p.r").alias("right_value"))


def link_names(pages: DataFrame, names: DataFrame) -> DataFrame:
    """``page, text, linked``: the first mention of each name (``name, target``) as a whole word becomes a link; longest first, never inside a link.

    Only ASCII letters and digits count as neighbours of a word.
    """
    links = names.select("name", F.concat(F.lit("[["), "target", F.lit("|"), "name", F.lit("]]")).alias("value"))
    done = name_search.rewrite(pages.select("page", "text"), links, "text", fold=False, whole=True, once=True, spare=r"\[\[[^\]]*\]\]")
    return done.select("page", "text", F.col("n_replaced").alias("linked"))
