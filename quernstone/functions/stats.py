"""Statistics, keywords and prices as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stat_int(c: Column) -> Column:
    """``3+``, ``6"`` and ``-1`` as integers; anything else null."""
    return F.regexp_replace(F.trim(c), "[+\"″”]+$", "").try_cast("int")


def armour_piercing(c: Column) -> Column:
    return F.coalesce(F.replace(F.trim(c), F.lit("−"), F.lit("-")).try_cast("int"), F.lit(0))


def keyword(c: Column) -> Column:
    """``struct<name, value>`` of ``RAPID FIRE 2`` or ``ANTI-INFANTRY 4+``: a lower-case name and the number, if any."""
    c = F.lower(F.trim(c))
    name = F.regexp_replace(F.regexp_replace(c, " +(?:[0-9]*d)?[0-9]+\\+?$", ""), "[ -]+", "_")
    return F.struct(name.alias("name"), F.regexp_extract(c, "([0-9]+)\\+?$", 1).try_cast("int").alias("value"))


def cost(c: Column) -> Column:
    return F.trim(c).try_cast("int")
