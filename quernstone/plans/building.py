"""Queries q33 to q41, q53 and q54: chunks, price pages and lists, imports, lint, summaries, rosters, guarded writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import stats, text as tx
from ..operators import chunk, overlay, quality, roster
from ..sources import tables
from ..sources.tables import table


def q33_size_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in pieces of at most 2000 characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), "text")
    cut = chunk.headed_chunks(docs, "name", "text", 2000)
    return cut.select("doc_id", F.col("part").cast("bigint").alias("part"), F.length("chunk").cast("bigint").alias("n_chars"), F.sha2("chunk", 256).alias("chunk_sha256"))


def _price_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A streamed page per brand: own prices in two sections, some in hidden segments, and borrowed ones under another heading."""
    k = F.col("p_partkey")
    plain = F.concat(F.lit('<div class="x bg-slate-500 font-bold text-xl">'), F.upper("p_name"), F.lit("</div>"))
    changed = F.concat(F.lit('<div class="bg-red-500 font-bold"><span class="text-xl keep-all">'), F.upper("p_name"), F.lit("</span><span>▲</span></div>"))
    price = lambda more: F.concat(
        F.lit("<li><span>"), F.col("p_size").cast("string"), F.lit(" models</span>"), F.when(k % 4 == 0, '<span class="up">▲ (+10) ').otherwise("<span>"), (F.floor("p_retailprice") + more).cast("string"), F.lit(" pts</span></li>")
    )
    tier = lambda name, more: F.concat(F.lit('<div class="bg-slate-200 font-bold p">'), F.lit(name), F.lit("</div><ul>"), price(more), F.lit("</ul>"))
    tiers = F.when(k % 3 == 0, F.concat(tier("YOUR 1ST UNIT COSTS ", 0), tier("YOUR 2ND + UNIT COSTS", 20))).otherwise(tier("YOUR UNIT COSTS", 0))
    item = F.concat(F.when(k % 4 == 0, changed).otherwise(plain), tiers, F.lit("<li><span>1 model</span><span>777 pts</span></li>"))  # the last stands in no list
    kind = F.when(k % 5 == 0, "hidden").when(k % 7 == 0, "borrowed").when(k % 3 == 0, "forts").otherwise("units")
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", item.alias("item"), kind.alias("kind"))
    listed = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == name, F.struct("p_partkey", "item")))), lambda x: x["item"]), "")
    html = F.concat(
        F.lit("<html><h3 class='x'>Units</h3>"), listed("units"), F.lit('<template id="P:1a"></template><h3><i>Every model has the keyword</i></h3>'), listed("borrowed"),
        F.lit("<h3>Fortifications</h3>"), listed("forts"), F.lit('<template id="P:2"></template><div hidden id="S:1a">an older one</div><script>$RS("S:1a","P:1a")</script><div hidden id="S:1a">'), listed("hidden"),
        F.lit('</div><script>$RS("S:1a","P:1a")</script></html>'),
    )
    return rows.groupBy("p_brand").agg(html.alias("html"))


def q34_price_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct prices of the sections that count, with unit and tier, hidden segments in their places."""
    own = tables.kept_sections(tables.filled_placeholders(F.col("html")))
    return tables.price_rows(_price_pages(spark, sf_dir).select("p_brand", own.alias("own")), "own", "p_brand")


def q35_price_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed names: exact, in the plural, by alias, and unknown."""
    parts, kind = table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    units = parts.select(F.col("p_partkey").alias("unit_id"), F.col("p_brand").alias("faction"), F.col("p_name").alias("name"))
    name = F.when(kind == 0, F.upper("p_name")).when(kind == 1, F.concat("p_name", F.lit("S"))).when(kind == 2, F.concat(F.lit("old "), "p_name")).otherwise(F.concat("p_name", F.lit(" x")))
    listed = parts.select(F.col("p_partkey").alias("list_id"), F.col("p_brand").alias("faction"), name.alias("name"))
    old = F.concat(F.lit("Old "), "p_name")
    shared = parts.where("p_partkey % 5 = 0").groupBy("p_brand").agg(F.min("p_name").alias("name"))  # an alias of a second name
    aliases = parts.where("p_partkey % 3 = 0").select(old.alias("alias"), F.col("p_name").alias("name"), "p_brand")
    aliases = aliases.select("alias", "name").union(aliases.where("p_partkey % 2 = 0").drop("name").join(shared, "p_brand").select("alias", "name"))
    found = overlay.price_lookup(listed, units, aliases)
    return found.groupBy("list_id", "how").agg(F.count("unit_id").alias("units"), F.min("unit_id").alias("first_unit"))


def q36_import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept and skipped for want of a key, and costs that are numbers."""
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    units = customers.select(F.when(F.col("c_custkey") % 13 == 0, F.lit(None)).when(F.col("c_custkey") % 17 == 0, " ").otherwise(F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("M"))
    costs = suppliers.select(F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "free").otherwise(F.floor("s_acctbal").cast("string")).alias("cost"))
    named = overlay.imported(units, "id", {"M": "m"})
    count = lambda rows, relation: overlay.import_counts(rows, "id").select(F.lit(relation).alias("relation"), "kept", "skipped")
    numbers = overlay.imported(costs, "id").agg(F.lit("costs").alias("relation"), F.count(stats.cost(F.col("cost"))).alias("kept"), (F.count("*") - F.count(stats.cost(F.col("cost")))).alias("skipped"))
    renamed = named.agg(F.lit("names").alias("relation"), F.countDistinct("m").alias("kept"), F.lit(0).cast("bigint").alias("skipped"))
    return count(units, "units").unionByName(count(costs, "enhancements")).unionByName(numbers).unionByName(renamed)


def q37_bulk_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of many ids at once, with a reason where there is none."""
    ids = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + F.col("l_linenumber") * 7).alias("unit_id")).distinct()
    units = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit_id"))
    items = table(spark, sf_dir, "lineitem").where("l_partkey % 6 <> 0").select(F.col("l_partkey").alias("unit_id"), F.floor("l_extendedprice").cast("bigint").alias("cost"))
    return overlay.priced(ids, units, items)


def q38_lint_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per rule: short pages, unreadable heads, names of several pages, links back to nothing, languages without a page, warnings; two rules fail, and the others go on."""
    docs, labels, pages = (table(spark, sf_dir, t) for t in ("documents", "labels", "pages"))
    titles = pages.select(tables.page_title(F.col("html")).alias("name"), F.col("page_id").alias("page"))
    indexed = pages.select(F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang")).distinct()
    found = quality.lint(
        {
            "missing_points": docs.where("n_chars < 300").select(F.col("doc_id").alias("subject")),
            "frontmatter": docs.where(~F.substring_index("text", "\n", 1).rlike("^[A-Z]")).select(F.col("doc_id").alias("subject")),
            "alias_conflict": quality.name_conflicts(titles).select(F.col("name").alias("subject")),
            "raw_backlink": labels.select((F.col("doc_id") + 3).alias("doc_id")).join(docs, "doc_id", "left_anti").select(F.col("doc_id").alias("subject")),
            "faction_index": docs.select(F.coalesce(F.nullif("lang", F.lit("en")), F.lit("xx")).alias("lang")).distinct().join(indexed, "lang", "left_anti").select(F.col("lang").alias("subject")),
            "verify_warn": labels.where("quality = 0").select(F.col("doc_id").alias("subject")),
            "no_such_column": lambda: labels.select(F.col("severity").alias("subject")),
            "no_such_number": lambda: docs.select(F.raise_error(F.lit("a rule that fails as it runs")).alias("subject")),
        }
    )
    severity = F.when(F.col("rule").isin("raw_backlink", "frontmatter", "lint_error"), "error").when(F.col("rule").isin("faction_index"), "info").otherwise("warning")
    return found.groupBy("rule", severity.alias("severity")).agg(F.count("*").alias("n"), F.min("subject").alias("first"))


def q39_stat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, armour piercing and keywords read from text."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    stat = F.when(k % 4 == 0, F.concat(size, F.lit("+"))).when(k % 4 == 1, F.concat(size, F.lit('"'))).when(k % 4 == 2, size).otherwise("N/A")
    word = stats.keyword(F.concat(F.upper(F.replace("p_type", F.lit(" "), F.lit("-"))), F.when(k % 3 == 0, F.concat(F.lit(" "), size, F.lit("+"))).otherwise("")))
    ap = F.when(k % 5 == 0, "x").otherwise(F.concat(F.lit("−"), (F.col("p_size") % 4).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", stats.stat_int(stat).alias("stat"), stats.armour_piercing(ap).alias("ap"), word["name"].alias("keyword"), word["value"].alias("value"))


def _rosters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    size = F.when(F.col("o_orderpriority") == "1-URGENT", "incursion").when(F.col("o_orderpriority") == "2-HIGH", "strike_force").when(F.col("o_orderpriority") == "3-MEDIUM", "onslaught")
    rosters = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("roster_id"), size.alias("size"), F.concat(F.lit("d"), (F.col("o_custkey") % 4).cast("string")).alias("detachment"))
    units = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("roster_id"),
        F.when(F.col("l_suppkey") % 9 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey") % 40 + 1).alias("unit_id"),
        (F.col("l_linenumber") == 1).alias("warlord"),
        F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("e"), (F.col("l_partkey") % 5).cast("string"))).alias("enhancement"),
    )
    words = F.split("p_type", " ")
    keywords = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, "CHARACTER"), F.when(F.col("p_size") % 10 == 0, "EPIC HERO"), F.when(F.col("p_size") % 3 == 0, "BATTLELINE")))
    catalogue = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit_id"), F.when(F.col("p_partkey") % 17 != 0, F.floor(F.col("p_retailprice") / 3).cast("bigint")).alias("price"), F.when(F.size(words) > 0, keywords).alias("keywords"))
    enhancements = spark.createDataFrame([(f"d{d}", f"e{e}", None if e == 3 else 10 * e + d) for d in range(3) for e in range(4)], "detachment string, enhancement string, cost int")
    return rosters, units, catalogue, enhancements


def q40_roster_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All violations, and whether the roster is legal."""
    return roster.judged(*_rosters(spark, sf_dir))


def q41_qa_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers judged on two axes, summed up."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    judge = lambda c, k: F.when(c % k == 0, "correct").when(c % k == 1, "partial").otherwise("wrong")
    return quality.layered_summary(turns.select(judge(F.length("text"), 3).alias("retrieval"), judge(F.length("text") + F.col("turn"), 4).alias("generation")))


def q53_version_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a host and language: the kind of their highest version, and whether the latest cannot be told."""
    k = F.col("page_id")
    stem = F.concat(F.lit("book_"), F.when(k % 50 == 0, F.concat(F.lit("2024"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("15"))).when(k % 20 == 0, F.concat(F.lit("V"), (k % 9).cast("string"))).otherwise((1000 + k % 9000).cast("string")))
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), stem.alias("stem"))
    found = quality.ambiguous_versions(pages.withColumn("kind", tx.version_rank(F.col("stem"))[0]), ["host", "lang"], "kind")
    return found.select("host", "lang", "files", F.col("kind").cast("int").alias("kind"), "ambiguous")


def q54_edit_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that may be written again, and those that a person or the publisher has the say over."""
    docs = table(spark, sf_dir, "documents")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    pages = docs.select(F.col("doc_id").alias("page"), sha.alias("sha256"), F.coalesce(F.col("source") == "src1", F.lit(False)).alias("official"))
    registered = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("page"), F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit("before"), 256)).otherwise(sha).alias("sha256"))
    return overlay.guarded_writes(pages, registered)


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q") and name[1:3].isdigit()}

_KEY = "case when ends_with({0}, 's') then substr({0}, 1, length({0}) - 1) else {0} end"

ORACLE_SQL = {
    "q33_size_chunks": """
        with recursive r as (
            select doc_id, cast(-1 as bigint) as part, text as rest, cast(null as varchar) as piece from documents where length(text) > 0
            union all
            select doc_id, part + 1, case when length(rest) <= 2000 then '' else ltrim(substr(rest, cut_at + 1), chr(10)) end,
                   case when length(rest) <= 2000 then rest else rtrim(substr(rest, 1, cut_at), chr(10)) end
            from (
                select *, case when two > 0 then two when one > 0 then one else 2000 end as cut_at from (
                    select *, case when strpos(back, chr(10) || chr(10)) > 0 then 2000 - strpos(back, chr(10) || chr(10)) - 1 else 0 end as two,
                           case when strpos(back, chr(10)) > 0 then 2000 - strpos(back, chr(10)) else 0 end as one
                    from (select *, reverse(substr(rest, 1, 2000)) as back from r where rest <> ''))))
        select doc_id, part, cast(length(c) as bigint) as n_chars, sha256(c) as chunk_sha256
        from (select doc_id, part, '## doc ' || doc_id || case when part > 0 then '（续）' else '' end || chr(10) || piece as c from r where part >= 0)""",
    "q34_price_page": """
        with p as (select p_brand, upper(p_name) as unit, p_size || ' models' as models, cast(floor(p_retailprice) as integer) as points, p_partkey % 3 = 0 as tiered from part where p_partkey % 5 = 0 or p_partkey % 7 <> 0)
        select distinct p_brand, trim(unit) as unit, case when tiered then 'YOUR 1ST UNIT COSTS' else 'YOUR UNIT COSTS' end as tier, models, points from p
        union select p_brand, trim(unit), 'YOUR 2ND + UNIT COSTS', models, points + 20 from p where tiered""",
    "q35_price_lookup": f"""
        with u as (select p_partkey as id, p_brand as f, lower(trim(p_name)) as n from part),
        nm as (select distinct f, n from u),
        sg as (select f, s, min(n) as n from (select f, n, {_KEY.format('n')} as s from nm) group by f, s having count(*) = 1),
        sh as (select p_brand, min(p_name) as name from part where p_partkey % 5 = 0 group by 1),
        al as (
            select lower(trim('Old ' || p_name)) as a, lower(trim(p_name)) as n from part where p_partkey % 3 = 0
            union select lower(trim('Old ' || p_name)), lower(trim(name)) from part join sh using (p_brand) where p_partkey % 6 = 0),
        l as (
            select p_partkey as list_id, p_brand as f, lower(trim(case p_partkey % 4 when 0 then p_name when 1 then p_name || 's' when 2 then 'old ' || p_name else p_name || ' x' end)) as k from part),
        m as (
            select list_id, l.f, case when nm.n is not null then 'exact' when several > 1 then 'ambiguous' when a2.n is not null then 'alias' when sg.n is not null then 'singular' else 'none' end as how,
                   case when nm.n is not null then nm.n when several > 1 then null else coalesce(a2.n, sg.n) end as n
            from l left join nm on nm.f = l.f and nm.n = k left join (select nm.f, a, min(al.n) as n, count(*) as several from al join nm using (n) group by all) a2 on a2.f = l.f and a2.a = k
                 left join sg on sg.f = l.f and sg.s = {_KEY.format('k')})
        select list_id, how, count(u.id) as units, min(u.id) as first_unit from m left join u on u.f = m.f and u.n = m.n group by list_id, how""",
    "q36_import_counts": """
        with u as (select c_custkey % 13 <> 0 and c_custkey % 17 <> 0 as has, c_name from customer), s as (select s_suppkey % 5 <> 0 as has, s_suppkey % 3 <> 0 as number from supplier)
        select 'units' as relation, count(*) filter (where has) as kept, count(*) filter (where not has) as skipped from u
        union all select 'enhancements', count(*) filter (where has), count(*) filter (where not has) from s
        union all select 'costs', count(*) filter (where has and number), count(*) filter (where has and not number) from s
        union all select 'names', count(distinct c_name) filter (where has), 0 from u""",
    "q37_bulk_prices": """
        with i as (select distinct l_partkey + l_linenumber * 7 as unit_id from lineitem),
        c as (select l_partkey as unit_id, cast(min(floor(l_extendedprice)) as bigint) as points, count(distinct floor(l_extendedprice)) as options from lineitem where l_partkey % 6 <> 0 group by 1)
        select i.unit_id, points, coalesce(options, 0) as options, case when p_partkey is null then 'unknown unit' when points is null then 'no price' else '' end as note
        from i left join part on p_partkey = i.unit_id left join c on c.unit_id = i.unit_id""",
    "q38_lint_rules": r"""
        with f as (
            select 'missing_points' as rule, doc_id::varchar as subject from documents where n_chars < 300
            union all select 'frontmatter', doc_id::varchar from documents where not regexp_matches(string_split(text, chr(10))[1], '^[A-Z]')
            union all select 'alias_conflict', name from (select lower(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))) as name, page_id from pages) group by name having count(distinct page_id) > 1
            union all select 'raw_backlink', (doc_id + 3)::varchar from labels where doc_id + 3 not in (select doc_id from documents)
            union all select distinct 'faction_index', l from (select coalesce(nullif(lang, 'en'), 'xx') as l from documents) where l not in (select regexp_extract(html, '<html lang="([a-z]+)"', 1) from pages)
            union all select 'verify_warn', doc_id::varchar from labels where quality = 0
            union all select 'lint_error', unnest(['no_such_column', 'no_such_number']))
        select rule, case when rule in ('raw_backlink', 'frontmatter', 'lint_error') then 'error' when rule = 'faction_index' then 'info' else 'warning' end as severity, count(*) as n, min(subject) as first from f group by rule""",
    "q39_stat_tokens": """
        select p_partkey, cast(case when p_partkey % 4 < 3 then p_size end as integer) as stat, cast(case when p_partkey % 5 <> 0 then -(p_size % 4) else 0 end as integer) as ap,
               replace(lower(p_type), ' ', '_') as keyword, cast(case when p_partkey % 3 = 0 then p_size end as integer) as value from part""",
    "q40_roster_validate": """
        with r as (
            select o_orderkey as rid, case o_orderpriority when '1-URGENT' then 'incursion' when '2-HIGH' then 'strike_force' when '3-MEDIUM' then 'onslaught' end as size, 'd' || (o_custkey % 4) as det from orders),
        u as (
            select l_orderkey as rid, case when l_suppkey % 9 = 0 then -l_partkey else l_partkey % 40 + 1 end as uid, l_linenumber = 1 as warlord, case when l_suppkey % 3 = 0 then 'e' || (l_partkey % 5) end as enh from lineitem),
        c as (
            select p_partkey as uid, case when p_partkey % 17 <> 0 then cast(floor(p_retailprice / 3) as bigint) end as price, p_size % 2 = 0 as chr, p_size % 10 = 0 as epic, p_size % 3 = 0 as bat from part),
        en as (select 'd' || d as det, 'e' || e as enh, case when e <> 3 then 10 * e + d end as cost from range(3) as x(d), range(4) as y(e)),
        l as (
            select r.rid, r.size, r.det, u.uid, u.warlord, u.enh, c.price, c.chr, c.epic, c.bat, c.uid is not null as known, en.cost, en.det is not null as listed
            from u join r using (rid) left join c on c.uid = u.uid left join en on en.det = r.det and en.enh = u.enh),
        a as (select rid, any_value(size) as size, sum(coalesce(price, 0)) + sum(coalesce(cost, 0)) as points, count(*) filter (where warlord) as wl, count(enh) as ne from l group by rid),
        cp as (select rid, uid, count(*) as n, any_value(epic) as epic, any_value(bat) as bat from l where known group by rid, uid),
        v as (
            select rid, 'unit_not_found' as code from l where not known
            union all select rid, 'unit_unpriced' from l where known and price is null
            union all select rid, 'warlord_not_character' from l where warlord and known and not chr
            union all select rid, 'enh_unpriced' from l where enh is not null and cost is null
            union all select rid, 'enh_not_character' from l where enh is not null and known and not chr
            union all select rid, 'enh_epic_hero' from l where enh is not null and known and chr and epic
            union all select rid, 'unknown_size' from a where size is null
            union all select rid, 'points_over' from a where points > case size when 'incursion' then 1000 when 'onslaught' then 3000 else 2000 end
            union all select rid, 'warlord_count' from a where wl <> 1
            union all select rid, 'enh_too_many' from a where ne > 3
            union all select rid, 'rot_exceeded' from cp where n > case when epic then 1 when not bat then 3 end
            union all select rid, 'rot_exempt_uncapped' from cp where not epic and bat and n > 3
            union all select rid, 'enh_duplicate' from (select rid, enh from l where enh is not null group by all having count(*) > 1)
            union all select rid, case when det in ('d0', 'd1', 'd2') then 'enh_wrong_detachment' else 'enh_unverified' end from l where enh is not null and not listed),
        e as (select rid, code, count(*) as n from v group by all)
        select rid as roster_id, code, n, not bool_or(code in ('points_over', 'warlord_count', 'warlord_not_character', 'rot_exceeded', 'enh_too_many', 'enh_duplicate', 'enh_not_character', 'enh_epic_hero', 'enh_wrong_detachment')) over (partition by rid) as legal
        from e""",
    "q41_qa_summary": """
        with j as (
            select case length(text) % 3 when 0 then 'correct' when 1 then 'partial' else 'wrong' end as r, case (length(text) + turn) % 4 when 0 then 'correct' when 1 then 'partial' else 'wrong' end as g
            from conversations where role = 'assistant')
        select count(*) as total, count(*) filter (where g = 'correct') as stage_ok, count(*) filter (where g <> 'correct' and r = 'correct') as stage_generation,
               count(*) filter (where g <> 'correct' and r = 'wrong') as stage_retrieval, count(*) filter (where g <> 'correct' and r = 'partial') as stage_mixed,
               round(100.0::double * count(*) filter (where r = 'correct') / count(*), 1) as retrieval_accuracy, round(100.0::double * count(*) filter (where g = 'correct') / count(*), 1) as generation_accuracy,
               round(100.0::double * count(*) filter (where r = 'correct' and g = 'correct') / count(*) filter (where r = 'correct'), 1) as conditional_accuracy
        from j""",
    "q53_version_groups": """
        with p as (select regexp_extract(url, '^https?://([^/]+)/', 1) as host, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang, case when page_id % 50 = 0 then 4 when page_id % 20 = 0 then 3 else 1 end as kind from pages),
        t as (select host, lang, count(*) as files, max(kind) as kind from p group by all)
        select host, lang, files, cast(kind as integer) as kind, kind = 1 and files > 1 as ambiguous from t""",
    "q54_edit_guard": """
        select doc_id as page, case when coalesce(source = 'src1', false) then 'official' when doc_id % 3 = 0 then 'new' when doc_id % 5 = 0 then 'edited' else 'write' end as status from documents""",
}
