"""Rollups of child rows into their parents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def ordered_list(*order: str, value: Column | str) -> Column:
    """Aggregate: the values of a group in a stated order (a shuffle leaves none by itself)."""
    packed = F.array_sort(F.collect_list(F.struct(*order, (F.col(value) if isinstance(value, str) else value).alias("_value"))))
    return F.transform(packed, lambda x: x["_value"])


def split_lists(df: DataFrame, key: Sequence[str], flag: Column, value: Column, order: str) -> DataFrame:
    """``yes, no``: the values of the rows for which the flag holds, and of the others, in order."""
    lists = [F.transform(F.array_sort(F.collect_list(F.when(f, F.struct(F.col(order), value.alias("_v"))))), lambda x: x["_v"]) for f in (flag, ~flag)]
    return df.groupBy(*key).agg(lists[0].alias("yes"), lists[1].alias("no"))


def first_child(parents: DataFrame, children: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Parents with the columns of their first child, null if they have none."""
    first = children.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_c"))
    return parents.join(first, key, "left").select(parents["*"], *[F.col(f"_c.{c}") for c in columns])


def child_counts(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str = "n", least: int = 1) -> DataFrame:
    """Parents with at least ``least`` children; children are counted before they are joined."""
    counts = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias(name)).where(F.col(name) >= least)
    return parents.join(counts, key)
