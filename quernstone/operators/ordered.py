"""Ordered, per-group operators: numbering, keep-first, keep-last, running headers, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "seq") -> DataFrame:
    """Rows numbered from 1 within their group; filter first what must not take a number."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


ROWS_PER_PART = 500_000


def parts_of(df: DataFrame) -> int:
    """How many parts of at most some ROWS_PER_PART rows ``df`` makes, so that no task's memory grows with it; no fewer than a shuffle has."""
    return max(1 + df.count() // ROWS_PER_PART, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return numbered(df, key, order, "_nth").where("_nth = 1").drop("_nth")


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: what a chain of INSERT OR REPLACE leaves."""
    return keep_first(df, key, [F.col(c).desc() for c in order])


def collisions(df: DataFrame, key: Sequence[str], value: str, order: Sequence[Column | str]) -> DataFrame:
    """Per key the first value, how many rows name another one, and how many repeat it."""
    first = F.first(value).over(Window.partitionBy(*key).orderBy(*order))
    return (
        df.withColumn("_first", first)
        .groupBy(*key, F.col("_first").alias(value))
        .agg(F.count_if(F.col(value) != F.col("_first")).alias("collisions"), (F.count_if(F.col(value) == F.col("_first")) - 1).alias("repeats"))
    )


def of_first_source(df: DataFrame, key: Sequence[str], priority: Sequence[Column | str]) -> DataFrame:
    """All rows of the key that come from its source of highest priority."""
    return df.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*key).orderBy(*priority))).where("_rank = 1").drop("_rank")


def under_headings(lines: DataFrame, group: Sequence[str], order: Sequence[str], is_heading: Column) -> DataFrame:
    """``section``: how many headings stand up to the line in its group (0 before the first)."""
    return lines.withColumn("section", F.sum(F.when(is_heading, 1).otherwise(0)).over(Window.partitionBy(*group).orderBy(*order)))


def carried(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``name``: the last value that is not null up to the row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order)))


def previous_tail(df: DataFrame, group: Sequence[str], order: Sequence[str], text: str, size: int = 500) -> DataFrame:
    before = F.lag(text).over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("tail", F.right(before, F.lit(size)))


def bin_starts(sizes: Column, budget: int) -> Column:
    """Greedy bins for an array of sizes: where each begins; a new bin is begun where the budget would be passed."""
    state = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, size: Column) -> Column:
        new = (acc["at"] == 0) | ((acc["used"] > 0) & (acc["used"] + size > budget))
        used = F.when(new, size).otherwise(acc["used"] + size).cast("long")
        return F.struct(used.alias("used"), (acc["at"] + 1).alias("at"), F.when(new, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"))

    return F.aggregate(sizes, state, step, lambda acc: acc["starts"])


def distinct_slugs(df: DataFrame, slug: Column, order: Sequence[str]) -> DataFrame:
    """``slug``: the second and later rows of a slug get -2, -3 and so on."""
    based = numbered(df.withColumn("_base", slug), ["_base"], order, "_n")
    return based.withColumn("slug", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_n").cast("string")))).drop("_base", "_n")
