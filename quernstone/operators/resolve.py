"""Entity resolution: a cascade of exact, qualified and alias matches, and fuzzy matches within blocks."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from ..functions.text import match_key
from . import overlay
from .lineage import cut


def resolve(names: DataFrame, canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """``name_id, how, entity_id``: the first way that tells one entity.

    ``names``: name_id, name. ``canonical``: entity_id, name, faction.
    ``aliases``: alias, entity_id. Ways: exact, qualified (``Name (faction)``),
    alias, else ambiguous (several by name) or none.
    """
    known = canonical.select("entity_id", match_key(F.col("name")).alias("key"), match_key(F.col("faction")).alias("faction"))

    def unique(df: DataFrame, *by: str, prefix: str) -> DataFrame:
        return df.groupBy(*by).agg(F.countDistinct("entity_id").alias(f"{prefix}_n"), F.min("entity_id").alias(f"{prefix}_id"))

    split = "^(.*?) *\\(([^()]*)\\)$"
    wanted = names.withColumn("key", match_key(F.col("name"))).withColumn("base", F.regexp_extract("key", split, 1)).withColumn("of", F.regexp_extract("key", split, 2))
    met = (
        wanted.join(unique(known, "key", prefix="exact"), "key", "left")
        .join(unique(known, "key", "faction", prefix="qualified").withColumnsRenamed({"key": "base", "faction": "of"}), ["base", "of"], "left")
        .join(unique(aliases.select(match_key(F.col("alias")).alias("key"), "entity_id"), "key", prefix="alias"), "key", "left")
    )
    way = (
        F.when(F.col("exact_n") == 1, "exact")
        .when(F.col("qualified_n") == 1, "qualified")
        .when((F.col("exact_n") > 1) | (F.col("qualified_n") > 1), "ambiguous")
        .when(F.col("alias_n") == 1, "alias")
        .when(F.col("alias_n") > 1, "ambiguous")
        .otherwise("none")
    )
    entity = F.when(way == "exact", F.col("exact_id")).when(way == "qualified", F.col("qualified_id")).when(way == "alias", F.col("alias_id"))
    return met.select("name_id", way.alias("how"), entity.alias("entity_id"))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, which no built-in function gives."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)])


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: it is shuffled, however small its file makes it look, never sent whole to the driver."""
    return df.hint("merge")


def _lengths(name: str, cutoff: F.Column) -> F.Column:
    """The lengths that a name at least ``cutoff`` like this one can have; none for an empty name."""
    n, times = F.length(name), (2 - cutoff) / cutoff
    return F.when(n > 0, F.sequence(F.ceil(n / times - 1e-9).cast("int"), F.floor(n * times + 1e-9).cast("int")))


def fuzzy(names: DataFrame, canonical: DataFrame, block: str, cutoff: float = 0.85) -> DataFrame:
    """``name_id, match, ratio``: the most similar canonical name of the same block (null is one too), the last by name of equal ones.

    A name that many rows of a block have is sought once.
    """
    wanted = names.select("name_id", F.struct(F.col(block).alias("of")).alias("_of"), match_key(F.col("name")).alias("a"))
    near = nearest_names(names.select(block, match_key(F.col("name")).alias("name")), canonical.select(block, match_key(F.col("name")).alias("name")), cutoff, 1, block)
    best = wanted.join(_dealt(near), ["_of", "a"]).groupBy("name_id").agg(F.max(F.struct("ratio", "b")).alias("_best"))
    return best.select("name_id", F.col("_best.b").alias("match"), F.round("_best.ratio", 6).alias("ratio"))


def _letters(df: DataFrame, column: str) -> DataFrame:
    """``_of, column, token``: each character of a string with the number of its occurrence, so that common characters are common tokens."""
    upto = F.substring(F.col(column), F.lit(1), F.col("i"))
    each = df.select("_of", column, F.explode(F.sequence(F.lit(1), F.length(column))).alias("i")).withColumn("c", F.substring(F.col(column), F.col("i"), F.lit(1)))
    return each.select("_of", column, F.concat(F.col("c"), (F.length(upto) - F.length(F.replace(upto, F.col("c"), F.lit("")))).cast("string")).alias("token"))


GUESSES, RARE_GRAMS, HELD = 16, 3, 256  # first guesses only: what they miss, the index finds


def _grams(df: DataFrame, column: str) -> DataFrame:
    """``_of, column, gram``: the distinct runs of three characters of a string, or the whole of a shorter one."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(column) - 2, F.lit(1))), lambda i: F.substring(F.col(column), i, F.lit(3)))
    return df.select("_of", column, F.explode(F.array_distinct(runs)).alias("gram"))


def _beside(df: DataFrame, column: str) -> DataFrame:
    """``_of, column, key``: hashes of a string and of what is left of it without one of its characters; two strings that are alike but for one character of each share one."""
    rest = lambda i: F.concat(F.substring(F.col(column), F.lit(1), i - 1), F.substring(F.col(column), i + 1, F.lit(1 << 30)))
    keys = F.transform(F.sequence(F.lit(1), F.length(column)), lambda i: F.when(rest(i) != "", F.xxhash64(rest(i))))
    return df.select("_of", column, F.explode(F.array_distinct(F.array_compact(F.concat(F.array(F.xxhash64(column)), keys)))).alias("key"))


def nearest_names(names: DataFrame, pool: DataFrame, cutoff: float, k: int, block: str | None = None) -> DataFrame:
    """``_of, a, b, ratio, nth``: for each distinct name the ``k`` most similar strings of the pool (``name`` in both) that are ``cutoff`` like it; of equal ones the last.

    With a ``block`` (in both, null is one too), names meet the pool of their
    block only; ``_of`` is a struct of it.

    First, a name meets the strings from which it differs by at most one
    character on either side; these share what is left without it. Any other
    string is at most n / (n + 1) like a name of n characters. If the ``k``-th
    best so far is more, the name is settled; the others go to an index.

    Strings meet there by an inverted index of their
    characters (with the number of the occurrence). Two strings as much alike
    as the cutoff have so many characters in common that, put in the order of
    rarity, their first ones share one; how many first ones that are follows
    from both lengths. So the index finds every such pair. It holds the
    strings of lengths that may be near enough. Bitmaps of the
    characters bound the similarity of a pair from above; only pairs whose
    bound reaches the ``k``-th best of some first guesses (those before, and
    strings that share one of the name's rarest runs of three characters, if at
    most HELD * k strings have that run) are compared, and a name is sought under as few characters as that similarity
    asks for, so a name that many are like costs little more. Null and
    empty strings are like nothing.
    """
    c = float(cutoff)
    of = F.struct((F.col(block) if block else F.lit(0)).alias("of")).alias("_of")
    wanted, known = (cut(df.where("name <> ''").select(of, F.col("name").alias(x)).distinct()) for df, x in ((names, "a"), (pool, "b")))

    def kth(rated: DataFrame) -> DataFrame:
        return rated.groupBy("_of", "a").agg(F.get(F.sort_array(F.collect_list("ratio"), asc=False), k - 1).alias("least"))

    met = _beside(wanted, "a").join(_dealt(_beside(known, "b")), ["_of", "key"]).select("_of", "a", "b").distinct()
    met = cut(met.withColumn("ratio", similarity("b", "a")).where(F.col("ratio") >= c))
    settled = F.coalesce(F.col("least") > F.length("a") / (F.length("a") + 1) + 1e-9, F.lit(False))
    told = cut(wanted.join(_dealt(kth(met)), ["_of", "a"], "left").select("_of", "a", F.coalesce("least", F.lit(c)).alias("least"), settled.alias("settled")))
    open_ = told.where(~F.col("settled")).drop("settled")
    lengths = open_.select("_of", F.explode(_lengths("a", F.col("least"))).alias("n")).distinct()
    known = cut(known.withColumn("n", F.length("b")).join(_dealt(lengths) if block else lengths, ["_of", "n"], "left_semi").select("_of", "b"))

    in_grams = _grams(known, "b")
    usual = in_grams.groupBy("_of", "gram").agg(F.count("*").alias("held"))
    rarest = Window.partitionBy("_of", "a").orderBy("held", "gram")
    own = _grams(open_, "a").join(_dealt(usual.where(F.col("held") <= HELD * k)), ["_of", "gram"]).withColumn("nth", F.row_number().over(rarest)).where(F.col("nth") <= RARE_GRAMS).select("_of", "a", "gram")
    by_slot = F.min_by("b", F.struct(F.levenshtein("a", "b"), "b")).alias("b")
    guessed = own.join(_dealt(in_grams), ["_of", "gram"]).groupBy("_of", "a", F.pmod(F.xxhash64("b"), F.lit(GUESSES * k)).alias("slot")).agg(by_slot)
    ratios = kth(guessed.withColumn("ratio", similarity("b", "a")).where(F.col("ratio") >= c))
    open_ = cut(open_.join(_dealt(ratios.withColumnRenamed("least", "guess")), ["_of", "a"], "left").select("_of", "a", F.greatest("least", "guess").alias("least")))

    in_pool = _letters(known, "b")
    rarity = in_pool.groupBy("token").agg(F.count("*").alias("held"))
    bit = F.pmod(F.xxhash64("token"), F.lit(256)).cast("int")
    maps = [F.bit_xor(F.when(F.shiftright(bit, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in range(4)]

    def ordered(letters: DataFrame, column: str) -> DataFrame:
        ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "token")))
        return letters.join(rarity, "token", "left").groupBy("_of", column).agg(F.transform(ranked, lambda x: x["token"]).alias("tokens"), F.struct(*maps).alias(f"{column}_map"))

    alike = lambda ratio, x, y: F.ceil(ratio * (x + y) / 2 - 1e-9).cast("int")
    n, least = F.length("b"), F.col("least")
    index = ordered(in_pool, "b").select("_of", "b", "b_map", n.alias("n"), F.explode(F.slice("tokens", 1, n - alike(c, F.ceil(n * c / (2 - c) - 1e-9), n) + 1)).alias("token"))
    asked = ordered(_letters(open_, "a"), "a").join(_dealt(open_), ["_of", "a"]).withColumn("n", F.explode(_lengths("a", least)))
    first = F.length("a") - alike(least, F.length("a"), F.col("n")) + 1
    asked = asked.where(first > 0).select("_of", "a", "a_map", "least", "n", F.explode(F.slice("tokens", 1, first)).alias("token"))
    index, asked = cut(index), cut(asked)
    both = F.length("a") + F.col("n")
    most = (both - sum((F.bit_count(F.col(f"a_map.m{w}").bitwiseXOR(F.col(f"b_map.m{w}"))) for w in range(4)), F.lit(0))) / both
    near = asked.join(_dealt(index), ["_of", "token", "n"]).where(most >= least - 1e-9).select("_of", "a", "b").distinct()
    rated = near.withColumn("ratio", similarity("b", "a")).where(F.col("ratio") >= c)
    rated = rated.unionByName(met.join(_dealt(told.where("settled").select("_of", "a")), ["_of", "a"], "left_semi"))
    return rated.withColumn("nth", F.row_number().over(Window.partitionBy("_of", "a").orderBy(F.desc("ratio"), F.desc("b")))).where(F.col("nth") <= k)


def closest(names: DataFrame, pool: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """``name, match, ratio``: for each distinct name the most similar string of the pool, if one is ``cutoff`` like it; of equal ones the last."""
    return nearest_names(names, pool, cutoff, 1).select(F.col("a").alias("name"), F.col("b").alias("match"), F.round("ratio", 6).alias("ratio"))


MOST_HITS = 3


def cascade(names: DataFrame, canonical: DataFrame, local: DataFrame, nicknames: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """``name_id, how, entity_id, candidates``: the first step that says something of a name.

    ``names``: name_id, name. ``canonical``: entity_id, name, faction.
    ``local``: name, entity_id (names in another language; of several entities
    the least). ``nicknames``: alias, name.

    Steps: the local name; ``Name (faction)``; the canonical name in any case;
    the same for what a nickname stands for; the near names, of which the
    MOST_HITS most similar local and canonical ones count. A canonical name of
    several entities is ``ambiguous``, with ``Name (faction)`` for each; so are
    several near names, which are then the candidates. One near name is
    ``fuzzy``; none, ``none``.
    """
    key = F.upper(F.trim("name"))
    shown = F.concat("name", F.lit(" ("), F.coalesce("faction", F.lit("?")), F.lit(")"))
    keys = canonical.groupBy(key.alias("key")).agg(F.countDistinct("entity_id").alias("n"), F.min("entity_id").alias("key_id"), F.array_sort(F.collect_set(shown)).alias("shown"))
    inside = canonical.groupBy(key.alias("base"), F.upper("faction").alias("of")).agg(F.min("entity_id").alias("inside_id"))
    foreign = local.where("name <> ''").groupBy(F.col("name").alias("t")).agg(F.min("entity_id").alias("local_id"))
    split = "^(.*?) *\\(([^()]*)\\)$"

    def exactly(asked: DataFrame) -> DataFrame:
        wanted = asked.withColumn("key", F.upper("t")).withColumn("base", F.regexp_extract("key", split, 1)).withColumn("of", F.regexp_extract("key", split, 2))
        met = wanted.join(_dealt(foreign), "t", "left").join(_dealt(inside), ["base", "of"], "left").join(_dealt(keys), "key", "left")
        told = F.coalesce("local_id", "inside_id", F.when(F.col("n") == 1, F.col("key_id")))
        how = F.when(told.isNotNull(), "exact").when(F.col("n") > 1, "ambiguous")
        return met.select("name_id", "t", how.alias("how"), told.alias("entity_id"), F.when(how == "ambiguous", F.col("shown")).alias("candidates"))

    first = cut(exactly(names.select("name_id", F.trim("name").alias("t"))))
    meant = nicknames.groupBy(F.col("alias").alias("t")).agg(F.min("name").alias("meant"))
    open_ = first.where("how is null").select("name_id", "t")
    by_nick = exactly(open_.join(_dealt(meant), "t").select("name_id", F.trim("meant").alias("t"))).where("how = 'exact'").select("name_id", "how", "entity_id", "candidates")
    open_ = cut(open_.join(_dealt(by_nick), "name_id", "left_anti"))

    hits = lambda asked, pool, rank: nearest_names(asked, pool, cutoff, MOST_HITS).select("a", F.lit(rank).alias("kind"), "nth", "b")
    of_local = hits(open_.select(F.col("t").alias("name")), foreign.select(F.col("t").alias("name")), 0).withColumnRenamed("a", "t")
    upper = open_.select("t", F.upper("t").alias("a")).distinct()
    of_keys = hits(upper.select(F.col("a").alias("name")), keys.select(F.col("key").alias("name")), 1).join(_dealt(upper), "a").select("t", "kind", "nth", "b")
    found = of_local.select("t", "kind", "nth", "b").union(of_keys).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("kind", "nth", "b"))).alias("hits"))
    one = F.when(F.size("hits") == 1, F.get("hits", 0))
    met = open_.join(_dealt(found), "t", "left").withColumn("local_b", F.when(one["kind"] == 0, one["b"])).withColumn("key_b", F.when(one["kind"] == 1, one["b"]))
    met = met.join(_dealt(foreign.withColumnRenamed("t", "local_b")), "local_b", "left").join(_dealt(keys.withColumnRenamed("key", "key_b")), "key_b", "left")
    entity = F.coalesce("local_id", F.when(F.col("n") == 1, F.col("key_id")))
    how = F.when(F.col("hits").isNull(), "none").when(entity.isNotNull(), "fuzzy").otherwise("ambiguous")
    listed = F.when(F.col("n") > 1, F.col("shown")).when(F.size("hits") > 1, F.transform("hits", lambda h: h["b"]))
    last = met.select("name_id", how.alias("how"), entity.alias("entity_id"), listed.alias("candidates"))
    return first.where("how is not null").drop("t").unionByName(by_nick).unionByName(last)


def pair(entities: DataFrame, canonical: DataFrame, cutoff: float = 0.85) -> DataFrame:
    """``entity_id, how, canonical_id``: entities of books with the canonical entry that they are.

    ``entities``: entity_id (one row each), book, name. ``canonical``:
    canonical_id, faction, name. Ways: exact (one entry has the name), faction
    (several have, one of them in the book's faction), fuzzy (the nearest of the
    names that one entry of the book's faction has), else ambiguous or none. A
    book's faction is that of most of its exact entities, ties to the earliest;
    without one, names that one entry of all has are sought. Null names are none.
    """
    known = canonical.select("canonical_id", "faction", match_key(F.col("name")).alias("key"))
    whole = known.groupBy("key").agg(F.count("*").alias("n"), F.min("canonical_id").alias("id"), F.min("faction").alias("its"))
    inside = known.where("faction is not null").groupBy("key", F.col("faction").alias("of")).agg(F.count("*").alias("of_n"), F.min("canonical_id").alias("of_id"))
    named = entities.select("entity_id", "book", match_key(F.col("name")).alias("key")).join(_dealt(whole), "key", "left")
    votes = overlay.majority(named.where("n = 1 and its is not null").select("book", F.col("its").alias("of"), "entity_id"), ["book"], "of", "entity_id")
    told = cut(named.join(votes.select("book", "of"), "book", "left").join(_dealt(inside), ["key", "of"], "left"))

    pool = inside.where("of_n = 1").select("of", F.col("key").alias("b"), F.col("of_id").alias("canonical_id"))
    pool = pool.unionByName(whole.where("n = 1").select(F.lit(None).cast(pool.schema["of"].dataType).alias("of"), F.col("key").alias("b"), F.col("id").alias("canonical_id")))
    near = nearest_names(told.where("n is null").select("of", F.col("key").alias("name")), pool.select("of", F.col("b").alias("name")), cutoff, 1, "of")
    best = near.join(_dealt(pool.withColumn("_of", F.struct("of")).drop("of")), ["_of", "b"]).select("_of", F.col("a").alias("key"), F.col("canonical_id").alias("near_id"))
    way = F.when(F.col("n") == 1, "exact").when(F.col("of_n") == 1, "faction").when(F.col("n") > 1, "ambiguous").when(F.col("near_id").isNotNull(), "fuzzy").otherwise("none")
    found = F.when(way == "exact", F.col("id")).when(way == "faction", F.col("of_id")).when(way == "fuzzy", F.col("near_id"))
    return told.withColumn("_of", F.struct("of")).join(_dealt(best), ["_of", "key"], "left").select("entity_id", way.alias("how"), found.alias("canonical_id"))


def alias_map(*sources: DataFrame) -> DataFrame:
    """``alias, target`` of several sources; the first source that has an alias wins."""
    every = None
    for i, s in enumerate(sources):
        part = s.select("alias", "target", F.lit(i).alias("_source"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("alias").agg(F.min_by("target", F.struct("_source", "target")).alias("target"))
