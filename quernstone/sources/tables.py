"""Readers and writers: stored tables, delimited text, nested JSON, XML, HTML and Markdown.

Sources that the network or a PDF library would have to bring are read from a
landing folder; what they become is the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

SRC_ORD = "src_ord"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piped_text(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited text with a header row in each file and no quoting, all strings, with ``path`` and ``src_ord``.

    A byte order mark, blank lines and a trailing pipe are dropped, fields are
    trimmed. A field that a short row or its file's header lacks is empty;
    columns are those of all headers. Files are read whole: they are
    catalogues of a few megabytes, many of which are read in parallel.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(F.regexp_replace("value", "^\\x{feff}", ""), "\\r?\\n")).alias("line", "value")).where(F.trim("value") != "")
    fields = F.transform(F.split("value", "\\|"), lambda x: F.trim(x))
    headers = lines.groupBy("path").agg(F.min("line").alias("first"), F.min_by(fields, "line").alias("header"))
    names = [r["n"] for r in headers.select(F.posexplode("header").alias("k", "n")).where("n <> ''").groupBy("n").agg(F.min("k").alias("k")).orderBy("k", "n").collect()]
    rows = lines.join(headers, "path").where("line > first").withColumn("f", fields)
    return rows.select("path", F.col("line").alias(SRC_ORD), *[F.coalesce(F.get("f", F.array_position("header", n).cast("int") - 1), F.lit("")).alias(n) for n in names])


def quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents under a stated schema; what does not fit is null."""
    return spark.read.schema(schema).json(path, multiLine=True)


def patches(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """One kind of patches of a patch file, numbered in the order of the file."""
    return json_rows(spark, path, f"`{kind}` array<struct<{schema}>>").select(F.posexplode_outer(kind).alias("patch_id", "p")).where("p is not null").select("patch_id", "p.*")


def profiles_xml(spark: SparkSession, path: str, kind: str = "Unit") -> DataFrame:
    """``name, stat, value`` of every profile of a kind; the last profile of a name wins."""
    schema = "_name string, _typeName string, characteristics struct<characteristic array<struct<_VALUE string, _name string>>>"
    rows = spark.read.format("xml").option("rowTag", "profile").schema(schema).load(path).where(F.col("_typeName") == kind)
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("_name")).orderBy(F.monotonically_increasing_id().desc()))).where("_n = 1")
    return last.select(F.col("_name").alias("name"), F.explode("characteristics.characteristic").alias("c")).select("name", F.col("c._name").alias("stat"), F.col("c._VALUE").alias("value"))


def markdown_pages(spark: SparkSession, path: str) -> DataFrame:
    """``book, page, text`` of ``<book>/page_<n>.md`` files."""
    name = F.col("_metadata.file_path")
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(name, "([^/]+)/[^/]+$", 1).alias("book"), F.regexp_extract(name, "([0-9]+)\\.md$", 1).try_cast("int").alias("page"), F.col("value").alias("text")
    )


def frontmatter(text: Column) -> tuple[Column, Column]:
    """The YAML head and the body of a wiki page, null where there is no head."""
    head = F.regexp_extract(text, "(?s)^---\\n(.*?)\\n---", 1)
    return F.when(text.rlike("(?s)^---\\n.*?\\n---"), head), F.when(text.rlike("(?s)^---\\n.*?\\n---"), F.regexp_replace(text, "(?s)^---\\n.*?\\n---\\n?", ""))


def table_rows(pages: DataFrame, page: str, text: str) -> DataFrame:
    """``page, heading, line, cells`` of the rows of Markdown tables, each under the last ``### `` heading before it.

    Cells are trimmed; an escaped pipe is part of its cell. Lines that divide a
    header from its rows, and those headers, are no rows. Fences of code are
    not read.
    """
    lines = pages.select(F.col(page).alias("page"), F.posexplode(F.split(text, "\\r?\\n")).alias("line", "value")).withColumn("value", F.trim("value"))
    order = Window.partitionBy("page").orderBy("line")
    told = lines.withColumn("heading", F.last(F.when(F.col("value").startswith("### "), F.trim(F.substring("value", 5, 1 << 30))), True).over(order))
    divides = F.col("value").rlike("^\\|( *:?-+:? *\\|)+$")
    fenced = F.sum(F.col("value").startswith("```").cast("int")).over(order) % 2 == 1
    rows = told.withColumn("_skip", divides | F.coalesce(F.lead(divides).over(order), F.lit(False)) | fenced).where(F.col("value").rlike("^\\|.*\\|$") & (F.length("value") > 1) & ~F.col("_skip"))
    inner = F.substring("value", F.lit(2), F.length("value") - 2)
    cells = F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))
    return rows.select("page", F.coalesce("heading", F.lit("")).alias("heading"), "line", cells.alias("cells"))


def wiki_index(pages: DataFrame, page: str, text: str) -> DataFrame:
    """``page, line, path, title, faction, type, summary, updated``: the rows of an index whose second cell is a link; ``-`` for a date is none."""
    link = r"^\[(.+?)\]\((.+?)\)"
    rows = table_rows(pages, page, text).where((F.size("cells") >= 4) & F.get("cells", 1).rlike(link))
    cell = lambda i: F.get("cells", i)
    return rows.select(
        "page", "line", F.regexp_extract(cell(1), link, 2).alias("path"), F.regexp_extract(cell(1), link, 1).alias("title"), F.col("heading").alias("faction"),
        cell(0).alias("type"), cell(2).alias("summary"), F.when(cell(3) == "-", "").otherwise(cell(3)).alias("updated"),
    )


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "<title>([^<]*)</title>", 1))


# The marks by which a price page shows a unit (in two styles), a tier over its list, and a price.
PAGE_UNIT = ('<div class="[^"]*bg-slate-500[^"]*font-bold text-xl[^"]*">', '<span class="text-xl keep-all">')
PAGE_TIER = '<div class="bg-slate-200[^"]*font-bold[^"]*">'
PAGE_PRICE = "<li><span>([^<]+)</span><span[^>]*>(?:[▲▼] *\\([+-]?[0-9]+\\) *)?([0-9]+) pts</span></li>"


def price_rows(pages: DataFrame, html: str, *ids: str) -> DataFrame:
    """``ids, unit, tier, models, points`` of every price of a page, each once.

    The marks of a page are taken in its order; a price belongs to the tier
    whose list it stands in, and that to the unit above it.
    """
    unit, tier = f"(?:{'|'.join(PAGE_UNIT)})([^<]+)<", f"{PAGE_TIER}([^<]+)</div><ul"
    marks = F.regexp_extract_all(html, F.lit(f"{unit}|{tier}|{PAGE_PRICE}|</ul>"), F.lit(0))
    each = pages.withColumn("_page", F.monotonically_increasing_id()).select("_page", *ids, F.posexplode(marks).alias("_at", "_mark"))
    shown = lambda pattern, group: F.nullif(F.trim(F.regexp_extract("_mark", f"^{pattern}", group)), F.lit(""))
    above = Window.partitionBy("_page").orderBy("_at")
    headed = each.withColumn("unit", F.last(shown(unit, 1), True).over(above)).withColumn("_tier", shown(tier, 1))
    ends = F.when(F.col("_tier").isNotNull(), F.col("_tier")).when(F.col("_mark").startswith("<li>"), F.lit(None)).otherwise("")  # a unit or the end of a list ends the tier
    rows = headed.withColumn("tier", F.last(ends, True).over(above)).where(F.col("_mark").startswith("<li>") & (F.col("tier") != "") & F.col("unit").isNotNull())
    return rows.select(*ids, "unit", "tier", shown(PAGE_PRICE, 1).alias("models"), shown(PAGE_PRICE, 2).try_cast("int").alias("points")).distinct()


# The sections of a price page whose prices are the army's own.
KEPT_SECTIONS = ("UNITS", "FORTIFICATIONS")
# The marks of a streamed page, by which a script moves a hidden segment to its placeholder.
_SEGMENT = '(?s)<div hidden id="S:([0-9a-f]+)">(.*?)</div><script>[^<]*?\\$RS\\("S:\\1","P:\\1"\\)</script>'
_PLACEHOLDER = '<template id="P:[0-9a-f]+"></template>'


def filled_placeholders(html: Column, rounds: int = 10) -> Column:
    """A streamed page as a browser shows it: hidden segments move to their placeholders, and those without one are empty.

    Of several segments with one id the last fills.
    """
    ids, bodies = (F.regexp_extract_all(html, F.lit(_SEGMENT), F.lit(group)) for group in (1, 2))
    segments = F.reverse(F.arrays_zip(ids.alias("id"), bodies.alias("body")))
    body = F.regexp_replace(html, _SEGMENT, "")

    def fill(doc: Column, _: Column) -> Column:
        return F.aggregate(segments, doc, lambda d, s: F.replace(d, F.concat(F.lit('<template id="P:'), s["id"], F.lit('"></template>')), s["body"]))

    return F.regexp_replace(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), body, fill), _PLACEHOLDER, "")


def kept_sections(html: Column, kept: Sequence[str] = KEPT_SECTIONS) -> Column:
    """What stands under the headings that count; all of a page without headings."""
    parts = F.slice(F.split(html, "<h3[^>]*>"), 2, 1 << 30)
    title = lambda p: F.upper(F.trim(F.regexp_replace(F.substring_index(p, "</h3>", 1), "<[^>]+>", "")))
    own = F.filter(parts, lambda p: title(p).isin(*kept))
    under = F.transform(own, lambda p: F.substring(p, F.instr(p, "</h3>") + 5, F.length(p)))
    return F.when(F.size(parts) > 0, F.array_join(under, "")).otherwise(html)


def staged_write(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a table: the commit protocol moves the files in place only when all are written."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
