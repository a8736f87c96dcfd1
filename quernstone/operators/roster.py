"""Roster rules, told in one pass over the units of each roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from . import ordered
from .lineage import cut

# Points by size of battle, the size taken for an unknown one, and the caps.
SIZE_LIMITS = {"incursion": 1000, "strike_force": 2000, "onslaught": 3000}
DEFAULT_SIZE = "strike_force"
MAX_ENHANCEMENTS, COPIES, EPIC_HERO_COPIES = 3, 3, 1
ERRORS = ("points_over", "warlord_count", "warlord_not_character", "rot_exceeded", "enh_too_many", "enh_duplicate", "enh_not_character", "enh_epic_hero", "enh_wrong_detachment")


def size_limit(size: Column) -> Column:
    limits = F.create_map(*[F.lit(x) for pair in SIZE_LIMITS.items() for x in pair])
    return F.coalesce(F.try_element_at(limits, size), F.lit(SIZE_LIMITS[DEFAULT_SIZE]))


def copy_limit(keywords: Column) -> Column:
    """How many copies of a unit are allowed; null is no limit."""
    return F.when(F.array_contains(keywords, "EPIC HERO"), EPIC_HERO_COPIES).when(~exempt(keywords), COPIES)


def exempt(keywords: Column) -> Column:
    return F.array_contains(keywords, "BATTLELINE") | F.array_contains(keywords, "DEDICATED TRANSPORT")


COMMON = 50_000  # of a unit that more rows name, the catalogue's entry is broadcast


def _with_entries(units: DataFrame, entries: DataFrame, parts: int) -> DataFrame:
    """``units`` with what ``entries`` (unit_id and more) say of them, if anything; a unit that very many rows name is not dealt to one task."""
    common = cut(units.groupBy("unit_id").agg(F.count("*").alias("_n")).where(F.col("_n") > COMMON).select(F.col("unit_id").alias("_id")))
    met = F.col("unit_id").eqNullSafe(F.col("_id"))
    often = units.join(F.broadcast(common.join(entries.withColumnRenamed("unit_id", "_entry"), F.col("_id") == F.col("_entry"), "left").drop("_entry")), met).drop("_id")
    rest = units.join(F.broadcast(common), met, "left_anti").repartition(parts, "unit_id").join(entries.repartition(parts, "unit_id").hint("merge"), "unit_id", "left")
    return often.unionByName(rest)


def _judged(rosters: DataFrame, units: DataFrame, catalogue: DataFrame, enhancements: DataFrame) -> DataFrame:
    """``roster_id, found``: the codes of every roster with units, each with how often it holds (0 too).

    All rules are told in one pass over the rows of a roster: the copy that is
    one too many stands for its unit, the second of an enhancement for that.
    """
    parts = ordered.parts_of(units)
    has = lambda word: F.array_contains("keywords", word)
    entries = catalogue.select("unit_id", "price", F.col("keywords").isNotNull().alias("known"), has("CHARACTER").alias("character"), has("EPIC HERO").alias("epic"), copy_limit(F.col("keywords")).alias("most"))
    listed = _with_entries(units.select("roster_id", "unit_id", "warlord", "enhancement"), entries, parts).withColumn("known", F.coalesce("known", F.lit(False)))
    about = rosters.select("roster_id", "detachment", size_limit(F.col("size")).alias("limit"), (~F.coalesce(F.col("size").isin(*SIZE_LIMITS), F.lit(False))).alias("unknown"))
    listed = listed.repartition(parts, "roster_id").join(about.repartition(parts, "roster_id").hint("merge"), "roster_id")
    costs = enhancements.select("detachment", "enhancement", F.col("cost").alias("enh_cost"), F.lit(True).alias("_listed"))
    listed = listed.join(F.broadcast(costs), ["detachment", "enhancement"], "left").join(F.broadcast(enhancements.select("detachment").distinct().withColumn("_covered", F.lit(True))), "detachment", "left")
    nth = lambda *of: F.row_number().over(Window.partitionBy("roster_id", *of).orderBy("roster_id"))
    listed = listed.withColumn("_copy", nth("unit_id", "known")).withColumn("_again", nth("enhancement"))

    with_enh, known = F.col("enhancement").isNotNull(), F.col("known")
    one_too_many = known & (F.col("_copy") == F.coalesce("most", F.lit(COPIES)) + 1)
    outside = with_enh & F.col("enh_cost").isNull() & F.col("_listed").isNull()
    per_row = {
        "unit_not_found": ~known,
        "unit_unpriced": known & F.col("price").isNull(),
        "warlord_not_character": F.col("warlord") & known & ~F.col("character"),
        "enh_unpriced": with_enh & F.col("enh_cost").isNull(),
        "enh_not_character": with_enh & known & ~F.col("character"),
        "enh_epic_hero": with_enh & known & F.col("character") & F.col("epic"),
        "rot_exceeded": one_too_many & F.col("most").isNotNull(),
        "rot_exempt_uncapped": one_too_many & F.col("most").isNull(),
        "enh_duplicate": with_enh & (F.col("_again") == 2),
        "enh_wrong_detachment": outside & F.col("_covered").isNotNull(),
        "enh_unverified": outside & F.col("_covered").isNull(),
    }
    army = listed.groupBy("roster_id").agg(
        *[F.count_if(broken).alias(code) for code, broken in per_row.items()],
        F.max("unknown").alias("unknown"),
        F.min("limit").alias("limit"),
        (F.sum(F.coalesce("price", F.lit(0))) + F.sum(F.coalesce("enh_cost", F.lit(0)))).alias("points"),
        F.count_if("warlord").alias("warlords"),
        F.count("enhancement").alias("enh"),
    )
    per_army = {
        "unknown_size": F.col("unknown"),
        "points_over": F.col("points") > F.col("limit"),
        "warlord_count": F.col("warlords") != 1,
        "enh_too_many": F.col("enh") > MAX_ENHANCEMENTS,
    }
    told = {**{code: F.col(code) for code in per_row}, **{code: F.when(broken, 1).otherwise(0).cast("bigint") for code, broken in per_army.items()}}
    return army.select("roster_id", F.array(*[F.struct(F.lit(code).alias("code"), n.alias("n")) for code, n in told.items()]).alias("found"))


def violations(rosters: DataFrame, units: DataFrame, catalogue: DataFrame, enhancements: DataFrame) -> DataFrame:
    """``roster_id, code, n``: how often each rule is broken.

    ``rosters``: roster_id, size, detachment. ``units``: roster_id, unit_id,
    warlord, enhancement. ``catalogue``: unit_id, price, keywords.
    ``enhancements``: detachment, enhancement, cost (a table of rules, which is
    broadcast). Prices come from the catalogue; codes outside ERRORS are gaps in
    the data, not offences.
    """
    return judged(rosters, units, catalogue, enhancements).drop("legal")


def judged(rosters: DataFrame, units: DataFrame, catalogue: DataFrame, enhancements: DataFrame) -> DataFrame:
    """``violations`` with ``legal``, which says of the whole roster whether it has no error."""
    found = _judged(rosters, units, catalogue, enhancements).withColumn("found", F.filter("found", lambda x: x["n"] > 0))
    error = F.exists("found", lambda x: x["code"].isin(*ERRORS))
    return found.select("roster_id", F.explode("found").alias("f"), (~error).alias("legal")).select("roster_id", "f.code", "f.n", "legal")


def legal(rosters: DataFrame, found: DataFrame) -> DataFrame:
    """``roster_id, legal``: no error; gaps do not count."""
    broken = found.where(F.col("code").isin(*ERRORS)).select("roster_id").distinct().withColumn("_broken", F.lit(True))
    return rosters.join(broken, "roster_id", "left").select("roster_id", F.col("_broken").isNull().alias("legal"))


# How many lines a loadout may have, and how many weapons of a name.
LOADOUT_LINES, WEAPON_COUNT = 40, 400


def merged_loadout(lines: Column, most_lines: int = LOADOUT_LINES, most: int = WEAPON_COUNT) -> Column:
    """A loadout (``array<struct<name, count>>``) with the counts of a name summed, in the order of first mention.

    It is null as a whole if it is empty or too long, or if a line has no name
    or no count from 1 to ``most``, or if a sum is beyond ``most``.
    """
    told = F.transform(lines, lambda x: F.struct(F.trim(x["name"]).alias("name"), x["count"].cast("int").alias("count")))
    good = (F.size(told) > 0) & (F.size(told) <= most_lines) & F.forall(told, lambda x: F.coalesce((x["name"] != "") & (x["count"] >= 1) & (x["count"] <= most), F.lit(False)))
    total = lambda name: F.aggregate(F.filter(told, lambda x: x["name"] == name), F.lit(0), lambda n, x: n + x["count"])
    merged = F.transform(F.array_distinct(F.transform(told, lambda x: x["name"])), lambda name: F.struct(name.alias("name"), total(name).alias("count")))
    return F.when(good & F.forall(merged, lambda x: x["count"] <= most), merged)


def matched_weapons(wanted: DataFrame, pool: DataFrame, ids: list[str]) -> DataFrame:
    """``ids``, ``how`` (one, several, none) and ``weapon_id``: the weapon of a unit's pool that a name means, in any case.

    ``wanted``: ids (one row each), unit_id, name, phase. ``pool``: unit_id,
    weapon_id, name, melee. If several profiles have the name and some are of
    the phase (``shooting`` or ``melee``), only those count.
    """
    key = F.lower(F.trim("name"))
    profiles = pool.groupBy("unit_id", key.alias("_key")).agg(
        F.count("*").alias("_n"), F.min("weapon_id").alias("_id"), *[f(F.when(F.col("melee") == m, F.col("weapon_id"))).alias(f"_{a}_{m}") for m in (True, False) for a, f in (("n", F.count), ("id", F.min))]
    )
    met = wanted.withColumn("_key", key).join(profiles, ["unit_id", "_key"], "left")
    pick = lambda a: F.when(F.col("phase") == "melee", F.col(f"_{a}_True")).when(F.col("phase") == "shooting", F.col(f"_{a}_False"))
    narrowed = (F.col("_n") > 1) & (pick("n") > 0)
    n = F.when(narrowed, pick("n")).otherwise(F.coalesce("_n", F.lit(0)))
    found = F.when(narrowed, pick("id")).otherwise(F.col("_id"))
    return met.select(*ids, F.when(n == 1, "one").when(n > 1, "several").otherwise("none").alias("how"), F.when(n == 1, found).alias("weapon_id"))
