"""Objects in noisy text, and text in nested data without a stated schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.lineage import cut
from .text import strip_code_fence

#: A string with its escapes (to the end of the text if it is not closed), a brace, or what lies between.
_MARKS = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"?|[{}]|[^"{}]++'


def first_object(text: Column) -> Column:
    """The text from the first ``{`` to the brace that closes it, null if there is none; braces in strings do not count.

    A stack machine, of whose stack only the depth matters: the marks of the
    text are folded in order, each with the depth after it.
    """
    start = F.instr(text, "{")
    rest = F.substring(text, start, F.length(text))
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end"))

    def step(s: Column, mark: Column) -> Column:
        depth = s["depth"] + F.when(mark == "{", 1).when(mark == "}", -1).otherwise(0)
        at = s["at"] + F.length(mark)
        open_ = s["end"].isNull()
        return F.struct(F.when(open_, depth).otherwise(0).alias("depth"), at.alias("at"), F.when(open_ & (depth == 0), at).otherwise(s["end"]).alias("end"))

    marks = F.regexp_extract_all(rest, F.lit(_MARKS), F.lit(0))
    end = F.aggregate(marks, state, step, lambda s: s["end"])
    return F.when(start > 0, F.when(end.isNotNull(), F.substring(rest, F.lit(1), end)))


def object_of(text: Column, field: str = "type") -> Column:
    """The first object of a text, with or without a code fence around it, as VARIANT; null if it is broken or lacks ``field``."""
    found = F.try_parse_json(first_object(strip_code_fence(text)))
    return F.when(F.try_variant_get(found, f"$.{field}", "variant").isNotNull(), found)


def text_leaves(rows: DataFrame, id: str, value: str, text: str = "text", content: str = "content") -> DataFrame:
    """``id, place, leaf``: all texts of a VARIANT column in the order of the document; ``place`` is the path by positions.

    A string is a leaf. Of an object count its ``text``, if that is a string,
    and then its ``content``; of an array all elements. Every level is one
    explode; levels go on until no row has a container, however deep.
    """
    text_of = F.try_variant_get("node", f"$.{text}", "variant")
    kind = F.schema_of_variant("node")
    step = lambda at, node: F.struct(at.alias("at"), node.alias("node"))
    of_object = F.array(step(F.lit(0), F.when(F.schema_of_variant(text_of) == "STRING", text_of)), step(F.lit(1), F.try_variant_get("node", f"$.{content}", "variant")))
    of_array = F.transform(F.expr("try_variant_get(node, '$', 'array<variant>')"), lambda x, i: step(i, x))
    inner = F.when(kind.startswith("OBJECT"), of_object).when(kind.startswith("ARRAY"), of_array)
    open_ = cut(rows.select(F.col(id), F.array().cast("array<int>").alias("place"), F.col(value).alias("node")).where("node is not null"))
    found = []
    while not open_.isEmpty():
        found.append(open_.where(kind == "STRING").select(id, "place", F.expr("variant_get(node, '$', 'string')").alias("leaf")))
        each = open_.select(id, "place", F.explode(inner).alias("x"))
        open_ = cut(each.select(id, F.concat("place", F.array("x.at")).alias("place"), F.col("x.node").alias("node")).where("node is not null"))
    return reduce(DataFrame.union, found) if found else open_.select(id, "place", F.lit("").alias("leaf"))
