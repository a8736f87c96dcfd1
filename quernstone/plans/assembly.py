"""Queries q67 to q72: the whole resolver cascade, citations and contexts, fragments and affected pages, ability rows, loadouts, units from source files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import overlay, quality, resolve, retrieve, roster
from ..operators.lineage import shared_folder
from ..sources import tables
from ..sources.tables import table


def _line_order() -> Column:
    """A number by which the lines of an order stand in one order; line numbers repeat."""
    return F.col("l_linenumber") * 10**12 + F.col("l_partkey") * 10**5 + F.col("l_suppkey")


def q67_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of every fiftieth part: in capitals, with a faction, misspelt, as nicknames, in another language, and that misspelt, against all parts."""
    k, name = F.col("p_partkey"), F.concat("p_name", F.lit(" "), F.floor(F.col("p_partkey") / 3).cast("string"))
    parts = table(spark, sf_dir, "part").select(k, name.alias("name"), "p_brand")
    local, wrong, kind = F.concat(F.lit("单位编号第"), k.cast("string"), F.lit("号")), F.concat(F.substring("name", 1, 2), F.expr("substring(name, 4)")), F.floor(k / 50) % 6
    asked = F.when(kind == 0, F.upper("name")).when(kind == 1, F.concat("name", F.lit(" ("), "p_brand", F.lit(")"))).when(kind == 2, wrong).when(kind == 3, F.concat(F.lit("nick"), k.cast("string"))).when(kind == 4, local).otherwise(F.concat(local, F.lit("。")))
    nicknames = parts.where(k % 100 != 0).select(F.concat(F.lit("nick"), k.cast("string")).alias("alias"), "name")
    canonical = parts.select(k.alias("entity_id"), "name", F.col("p_brand").alias("faction"))
    told = resolve.cascade(parts.where("p_partkey % 50 = 0").select(k.alias("name_id"), asked.alias("name")), canonical, parts.select(local.alias("name"), k.alias("entity_id")), nicknames, 0.9)
    return told.select("name_id", "how", "entity_id", F.array_join("candidates", "|").alias("candidates"))


def q68_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of every order, of which some repeat and some have no book, numbered, and the context that they make."""
    book = F.when(F.col("l_suppkey") % 9 == 0, " ").when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("Book "), (F.col("l_suppkey") % 3).cast("string")))
    sources = table(spark, sf_dir, "lineitem").select("l_orderkey", _line_order().alias("ord"), book.alias("book"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey") % 2).alias("page"))
    numbered = retrieve.cited(sources, "l_orderkey", ["ord"], ["book", "page"])
    tagged = numbered.select("l_orderkey", "n", "book", "page", F.when(F.col("page") == 1, "e/core").alias("tag"), F.col("ord").cast("string").alias("text"))
    cites = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: F.concat_ws(":", x["n"].cast("string"), x["text"])), ",")
    told = tagged.groupBy("l_orderkey").agg(cites.alias("cites"), retrieve.context_of("n").alias("context"))
    return told.select("l_orderkey", "cites", F.sha2("context", 256).alias("context_sha256"))


def q69_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the pages that entities name, out of order and some of them missing, and whether a changed file affects the entity."""
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(k / 100).alias("book"), (k % 100).cast("int").alias("page"), "text")
    at = F.col("page")
    entities = docs.where("doc_id % 20 = 0").select(k.alias("entity_id"), "book", F.array(at + 3, at, at + 1, at + 200).alias("pages"))
    path = lambda book, page: F.concat(F.lit("book_"), book.cast("string"), F.lit("/page_"), page.cast("string"))
    raw = F.transform("pages", lambda p: F.concat(F.lit("data/"), path(F.col("book"), p), F.lit(".md#part")))
    hit = quality.affected(entities.select(F.col("entity_id").alias("page"), raw.alias("raw")), docs.where("doc_id % 50 = 1").select(path(F.col("book"), at).alias("path")))
    found = quality.fragments(entities, docs.select("book", "page", "text"))
    told = found.join(hit.select(F.col("page").alias("entity_id"), F.lit(True).alias("affected")), "entity_id", "left")
    return told.select("entity_id", "n", F.sha2("text", 256).alias("text_sha256"), F.coalesce("affected", F.lit(False)).alias("affected"))


def q70_ability_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abilities of parts, some repeated and some without an id, and those of the lines of orders, some without a name."""
    masters = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 9 != 0, F.concat(F.lit("m"), (F.col("p_partkey") % 500).cast("string"))).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("text"), F.col("p_partkey").alias("ord"))
    name = F.when(F.col("l_returnflag") == "N", " ").otherwise(F.concat(F.lit(" "), "l_returnflag", "l_linestatus"))
    links = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 50 != 0, F.col("l_orderkey").cast("string")).alias("owner"), name.alias("name"), (F.col("l_partkey") % 7).cast("string").alias("text"), _line_order().alias("ord"))
    return overlay.ability_rows(masters, links, ["ord"])


def q71_loadouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadouts of orders: names with spaces that repeat, counts that are none or too many, and the weapons of the unit's pool that they mean in a phase."""
    count = F.when(F.col("l_partkey") % 41 == 0, 0).otherwise(F.col("l_quantity").cast("int"))
    line = F.struct("l_linenumber", F.concat(F.lit(" Gun"), (F.col("l_suppkey") % 5).cast("string"), F.lit(" ")).alias("name"), count.alias("count"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    own = lines.select("l_orderkey", roster.merged_loadout(F.transform("lines", lambda x: F.struct(x["name"], x["count"])), 6, 60).alias("loadout"))
    phase = F.when(F.col("l_orderkey") % 3 == 0, "melee").when(F.col("l_orderkey") % 3 == 1, "shooting")
    wanted = own.select("l_orderkey", (F.col("l_orderkey") % 10).alias("unit_id"), phase.alias("phase"), F.posexplode("loadout").alias("at", "w")).select("*", "w.name", "w.count")
    units = table(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("unit_id")).distinct()
    profile = lambda n, i, melee: F.struct(F.lit(f"gun{n}").alias("name"), F.concat("unit_id", F.lit(f"_w{i}")).alias("weapon_id"), F.lit(melee).alias("melee"))
    pool = units.select("unit_id", F.explode(F.array(profile(0, 0, False), profile(1, 1, True), profile(2, 2, True), profile(2, 3, False), profile(3, 4, False), profile(3, 5, False))).alias("p")).select("unit_id", "p.*")
    found = roster.matched_weapons(wanted, pool, ["l_orderkey", "at", "count"])
    told = found.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "count", "how", "weapon_id"))), lambda x: F.concat_ws(":", x["count"].cast("string"), x["how"], x["weapon_id"])), ",").alias("weapons"))
    return own.select("l_orderkey", F.col("loadout").isNotNull().alias("valid")).join(told, "l_orderkey", "left").select("l_orderkey", "valid", F.coalesce("weapons", F.lit("")).alias("weapons"))


def _piped(rows: DataFrame, bucket: Column, folder: str, *columns: str) -> None:
    """Rows as piped files of one bucket each, under a header, with a mark of byte order, blank lines and trailing pipes."""
    line = F.concat(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit("|"))
    lines = rows.select(bucket.alias("bucket"), line.alias("line")).groupBy("bucket").agg(F.array_join(F.array_sort(F.collect_list("line")), "\r\n\r\n").alias("lines"))
    lines.select("bucket", F.concat(F.lit("\ufeff" + "|".join(columns) + "|\r\n"), "lines").alias("value")).write.partitionBy("bucket").text(folder)


def q72_units_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasheets, models and costs as piped files, and terms as JSON, read back and brought together as units."""
    root = f"{shared_folder(spark)}/sources-{uuid.uuid4().hex}"
    k, size = F.col("p_partkey"), F.floor(F.col("p_partkey") / 2000)
    parts = table(spark, sf_dir, "part")
    sheets = parts.select(F.when(k % 13 != 0, k).alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("F"), F.substring_index("p_brand", "#", -1)).alias("faction_id"), size.alias("b"))
    models = parts.select(F.when(k % 11 != 0, k).alias("datasheet_id"), F.explode(F.sequence(F.lit(1), F.col("p_size") % 3 + 1)).alias("line"), F.col("p_size").alias("M"), size.alias("b"))
    costs = parts.select(k.alias("datasheet_id"), F.explode(F.sequence(F.lit(1), (k % 4).cast("int"))).alias("line"), F.col("p_retailprice").alias("price"), size.alias("b")).where("datasheet_id % 4 > 0")
    costs = costs.select("datasheet_id", "line", F.concat("line", F.lit(" models")).alias("description"), F.when(F.col("line") == 3, "free").otherwise(F.floor(F.col("price") / F.col("line")).cast("string")).alias("cost"), "b")
    _piped(sheets, F.col("b"), f"{root}/sheets", "id", "name", "faction_id")
    _piped(models, F.col("b"), f"{root}/models", "datasheet_id", "line", "M")
    _piped(costs, F.col("b"), f"{root}/costs", "datasheet_id", "line", "description", "cost")
    pairs = parts.where(k % 3 != 0).select(size.alias("b"), F.explode(F.array(*[F.struct(k.cast("string").alias("canonical_id"), F.concat(F.lit(w), k.cast("string")).alias("zh"), F.lit(o).alias("ord")) for o, w in ((1, "旧"), (2, "新"))])).alias("p"))
    pairs.groupBy("b").agg(F.to_json(F.struct(F.collect_list("p").alias("pairs"))).alias("value")).write.partitionBy("b").text(f"{root}/terms")
    terms = tables.json_rows(spark, f"{root}/terms", "pairs array<struct<canonical_id: string, zh: string, ord: int>>").select(F.explode("pairs").alias("p")).select("p.*")
    factions = table(spark, sf_dir, "nation").select(F.concat(F.lit("F"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    read = lambda name: tables.piped_text(spark, f"{root}/{name}/*/*.txt")
    units = overlay.unit_projection(read("sheets"), read("models"), read("costs"), terms, factions)
    shown = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["desc"], F.coalesce(x["cost"].cast("string"), F.lit("-")))), ",")
    return units.select("unit_id", "name", "name_zh", "faction_id", "faction", "points", shown.alias("items"), "models", "first_m")


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q") and name[1:3].isdigit()}

ORACLE_SQL = {
    "q68_citations": """
        with s as (
            select l_orderkey, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey as o, case when l_suppkey % 9 = 0 then ' ' when l_suppkey % 4 <> 0 then 'Book ' || (l_suppkey % 3) end as book, case when l_partkey % 3 <> 0 then l_partkey % 2 end as page from lineitem),
        f as (select l_orderkey, book, page, min(o) as ln from s where trim(book) <> '' group by all),
        n as (select *, row_number() over (partition by l_orderkey order by ln) as n from f)
        select l_orderkey, string_agg(n || ':' || ln, ',' order by n) as cites,
               sha256(string_agg('【档案 ' || n || case when page = 1 then '·e/core' else '' end || '】《' || book || '》' || coalesce('第' || page || '页', '') || chr(10) || ln, chr(10) || chr(10) || repeat('─', 40) || chr(10) || chr(10) order by n)) as context_sha256
        from n group by l_orderkey""",
    "q69_fragments": """
        with d as (select doc_id, doc_id // 100 as book, doc_id % 100 as page, text from documents),
        e as (select doc_id as entity_id, book, unnest([page + 3, page, page + 1, page + 200]) as page from d where doc_id % 20 = 0),
        c as (select 'book_' || book || '/page_' || page as path from d where doc_id % 50 = 1),
        a as (select distinct entity_id from e, c where contains('data/book_' || book || '/page_' || page || '.md#part', path))
        select e.entity_id, count(*) as n, sha256(string_agg(text, chr(10) order by e.page)) as text_sha256, e.entity_id in (select entity_id from a) as affected
        from e join d on d.book = e.book and d.page = e.page where text is not null group by e.entity_id""",
    "q70_ability_rows": """
        with m as (select 'm' || (p_partkey % 500) as id, null as owner, p_name as name, p_type as text from part where p_partkey % 9 <> 0 qualify row_number() over (partition by p_partkey % 500 order by p_partkey desc) = 1),
        l as (
            select l_orderkey || '_a' || row_number() over (partition by l_orderkey order by l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey) as id, l_orderkey::varchar as owner, l_returnflag || l_linestatus as name, (l_partkey % 7)::varchar as text
            from lineitem where l_orderkey % 50 <> 0 and l_returnflag <> 'N')
        select * from m union all select * from l""",
    "q71_loadouts": """
        with l as (select l_orderkey as k, l_linenumber as ln, 'Gun' || (l_suppkey % 5) as name, case when l_partkey % 41 = 0 then 0 else cast(trunc(l_quantity) as integer) end as n from lineitem),
        m as (select k, name, min(ln) as first, sum(n) as total from l group by all),
        v as (select k, count(*) <= 6 and bool_and(n between 1 and 60) as ok from l group by k),
        s as (select k, max(total) <= 60 as ok from m group by k),
        w as (select m.k, name, total, row_number() over (partition by m.k order by first, name) as nth, k % 10 as unit, k % 3 as phase from m join v using (k) join s using (k) where v.ok and s.ok),
        h as (
            select k, nth, total, case when name = 'Gun4' then 'none' when name = 'Gun3' or (name = 'Gun2' and phase = 2) then 'several' else 'one' end as how,
                   case when name = 'Gun0' then unit || '_w0' when name = 'Gun1' then unit || '_w1' when name = 'Gun2' and phase = 0 then unit || '_w2' when name = 'Gun2' and phase = 1 then unit || '_w3' end as id from w),
        t as (select k, string_agg(total || ':' || how || coalesce(':' || id, ''), ',' order by nth) as weapons from h group by k)
        select k as l_orderkey, v.ok and s.ok as valid, coalesce(weapons, '') as weapons from v join s using (k) left join t using (k)""",
    "q72_units_from_files": """
        with p as (select p_partkey as k, p_name, 'F' || string_split(p_brand, '#')[-1] as f, p_size, p_retailprice as price from part where p_partkey % 13 <> 0),
        c as (
            select k, n, case when n <> 3 then cast(floor(price / n) as integer) end as cost from (select k, price, unnest(range(1, k % 4 + 1)) as n from p)),
        i as (select k, min(cost) as points, string_agg(n || ' models:' || coalesce(cost::varchar, '-'), ',' order by n) as items from c group by k)
        select k::varchar as unit_id, p_name as name, case when k % 3 <> 0 then '新' || k end as name_zh, f as faction_id, n_name as faction, points, coalesce(items, '') as items,
               cast(case when k % 11 <> 0 then p_size % 3 + 1 else 0 end as bigint) as models, case when k % 11 <> 0 then p_size::varchar end as first_m
        from p left join i using (k) left join nation on 'F' || n_nationkey = f""",
}
