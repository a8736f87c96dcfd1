"""Queries q01 to q18: relational build, overlays, patches, projections and reconciliation.

Each query runs an operator on a stand-in drawn from the given tables; its SQL
is written apart from it, for another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators import ordered, overlay, rollup
from ..sources.tables import table

LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def q01_seq_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic keys: numbers within the parent, not taken by rows that are skipped."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    keyed = ordered.numbered(lines, ["l_orderkey"], LINE_ORDER[1:], "seq")
    return keyed.select(F.concat(F.col("l_orderkey").cast("string"), F.lit("_w"), F.col("seq").cast("string")).alias("key"), "l_orderkey", "l_partkey", F.col("seq").cast("bigint").alias("seq"))


def q02_nested_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children rolled up into their parent: total, least, and a list in order."""
    lines = table(spark, sf_dir, "lineitem")
    parts = F.array_join(F.transform(rollup.ordered_list(*LINE_ORDER[1:], value="l_partkey"), lambda x: x.cast("string")), ",")
    return lines.groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.round(F.min("l_extendedprice"), 2).alias("least"), parts.alias("parts"))


def q03_split_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists by a flag."""
    lists = rollup.split_lists(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "click", F.upper("event_type"), "event_id")
    return lists.select("user_id", F.array_join("yes", ",").alias("clicks"), F.array_join("no", ",").alias("others"))


def q04_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = ordered.keep_last(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return last.select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


def q05_keep_first_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lower(F.substring_index("text", "\n", 1)).alias("alias"), "source", "doc_id")
    return ordered.collisions(docs, ["alias"], "source", ["doc_id"]).select("alias", "source", "collisions", "repeats")


def q06_first_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    first = rollup.first_child(orders, lines, "o_orderkey", LINE_ORDER[1:], ["l_partkey", "l_quantity"])
    return first.select("o_orderkey", "o_orderstatus", "l_partkey", "l_quantity")


def q07_parent_count_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    counted = rollup.child_counts(nations, table(spark, sf_dir, "customer"), "n_nationkey", "c_nationkey", "customers", 3)
    return counted.orderBy(F.desc("customers"), "n_name").select("n_nationkey", "n_name", "customers")


def q08_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of one statistic each compared field by field, with the rate of agreement."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("string").alias("total"), F.upper("o_orderstatus").alias("status"), F.year("o_orderdate").cast("string").alias("year"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.floor(F.sum("l_extendedprice")).cast("string").alias("total"), F.max("l_linestatus").alias("status"), F.min(F.year("l_shipdate")).cast("string").alias("year")
    )
    differences = overlay.stat_differences(orders, lines, "o_orderkey", ["total", "status", "year"], tx.compare_key)
    rates = differences.groupBy("field").agg(F.count("*").alias("compared"), F.count_if("agrees").alias("agree"))
    return rates.select("field", "compared", "agree", F.bround(F.try_divide(F.lit(100.0) * F.col("agree"), "compared"), 1).alias("rate"))


def _derived_prices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Catalogue prices, and a price list derived from them that differs here and there; names are ambiguous on purpose."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"), "p_brand", F.floor("p_retailprice").cast("int").alias("price"))
    listed = parts.where("p_partkey % 5 <> 0").select(
        "name",
        "p_brand",
        F.when(F.col("p_partkey") % 3 == 0, "YOUR 2ND UNIT COSTS").when(F.col("p_partkey") % 3 == 1, "your unit costs ").otherwise("YOUR 1ST TO 3RD UNITS COST").alias("tier"),
        (F.col("price") + F.when(F.col("p_partkey") % 7 == 0, 10).otherwise(0)).alias("points"),
        "p_partkey",
    )
    return parts, listed


def base_tier(tier: F.Column) -> F.Column:
    plain = F.upper(F.trim(tier))
    return (plain == "YOUR UNIT COSTS") | plain.rlike("^YOUR 1ST\\b")


def q09_price_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand: how many units were compared, agree, differ, are tiered, or stand in one source only."""
    parts, listed = _derived_prices(spark, sf_dir)
    base = listed.where(base_tier(F.col("tier"))).groupBy("p_brand", "name").agg(F.min("points").alias("listed"))
    tiered = listed.where(~base_tier(F.col("tier"))).groupBy("p_brand").agg(F.countDistinct("name").alias("tiered"))
    own = parts.groupBy("p_brand", "name").agg(F.min("price").alias("own"))
    met = own.join(base, ["p_brand", "name"], "left").groupBy("p_brand").agg(
        F.count("listed").alias("compared"), F.count_if(F.col("listed") == F.col("own")).alias("agree"), F.count_if(F.col("listed") != F.col("own")).alias("differ"), F.count_if(F.col("listed").isNull()).alias("only_left")
    )
    return met.join(tiered, "p_brand", "left").select("p_brand", "compared", "agree", "differ", "only_left", F.coalesce("tiered", F.lit(0).cast("bigint")).alias("tiered"))


def q10_price_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New prices: model counts that the list has are updated, those that a unit lacks are added; a count listed at several prices says nothing."""
    parts, listed = _derived_prices(spark, sf_dir)
    base = overlay.told_tiers(listed.where(base_tier(F.col("tier"))).withColumn("models", F.col("p_partkey") % 3 + 1), ["p_brand", "name"], "models", "points")
    own = F.array(*[F.struct(F.lit(k).alias("models"), (F.col("price") * k).cast("int").alias("cost")) for k in (1, 5)])
    out = parts.join(base, ["p_brand", "name"], "left").withColumn("items", overlay.merged_tiers(own, F.col("listed")))
    shown = F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["models"].cast("string"), i["cost"].cast("string"))), ",")
    return out.select("p_partkey", shown.alias("items"), F.array_min(F.col("items.cost")).alias("points"))


def _segment_patches(customers: DataFrame) -> DataFrame:
    """Patches of every kind: applying, done already, off the mark, incomplete, and without a row; some in chains, of which one comes too late."""
    kind = F.col("c_custkey") % 5
    own = customers.where("c_custkey % 10 < 5")
    first = own.select(
        (F.col("c_custkey") * 4).alias("patch_id"),
        F.when(kind == 4, -F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("c_custkey"),
        F.when(kind == 1, "OTHER").when(kind == 2, F.lit(None).cast("string")).otherwise(F.concat(F.lower("c_mktsegment"), F.lit(' "'))).alias("from"),
        F.when(kind == 3, F.col("c_mktsegment")).otherwise("PATCHED").alias("to"),
    )
    chain = own.where(kind == 0)
    second = chain.select((F.col("c_custkey") * 4 + 1).alias("patch_id"), "c_custkey", F.lit("patched").alias("from"), F.lit("TWICE").alias("to"))
    late = chain.select((F.col("c_custkey") * 4 + 2).alias("patch_id"), "c_custkey", F.col("c_mktsegment").alias("from"), F.lit("LATE").alias("to"))
    return first.unionByName(second).unionByName(late)


def q11_cas_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compare-and-set twice: the second run finds what the first has left."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    wanted = _segment_patches(customers)
    once, first = overlay.compare_and_set(customers, wanted, ["c_custkey"], "c_mktsegment", tx.guard_key)
    twice, second = overlay.compare_and_set(once, wanted, ["c_custkey"], "c_mktsegment", tx.guard_key)
    met = first.select("patch_id", "c_custkey", F.col("status").alias("first_run")).join(second.select("patch_id", F.col("status").alias("second_run")), "patch_id")
    return met.join(twice, "c_custkey", "left").select("patch_id", "first_run", "second_run", F.col("c_mktsegment").alias("value"))


def q12_list_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    edited = overlay.edit_list(F.split("p_type", " "), F.array(F.lit("standard"), F.lit("TIN")), F.array(F.lit("ADDED"), F.lit("brass")))
    return parts.select("p_partkey", F.array_join(edited, ",").alias("keywords"))


def q13_guarded_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are there already, clash with a key or a name, or are new; new ones come again under the same key or name, and with children."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    kind = F.col("s_suppkey") % 4
    own = suppliers.select(
        F.when(kind < 2, F.col("s_suppkey")).otherwise(F.col("s_suppkey") + 1_000_000).alias("s_suppkey"),
        F.when(kind.isin(0, 2), F.col("s_name")).otherwise(F.concat(F.lit("New "), "s_name")).alias("s_name"),
        "s_nationkey", kind.alias("kind"),
    )
    rows, other = own.withColumn("nth", F.lit(0)), F.concat(F.lit("Other "), "s_name")
    for nth, far, name in ((1, 0, F.col("s_name")), (2, 0, other), (3, 1_000_000, F.col("s_name")), (4, 1_000_000, other)):
        rows = rows.unionByName(own.where("kind = 3").select((F.col("s_suppkey") + far).alias("s_suppkey"), name.alias("s_name"), "s_nationkey", "kind", F.lit(nth).alias("nth")))
    merged, report = overlay.guarded_insert(suppliers, rows.drop("kind"), "s_suppkey", "s_name", "s_nationkey", ["nth"])
    counts = report.groupBy("nth", "status").agg(F.count("*").alias("n"))
    children = rows.select(F.col("s_suppkey").alias("parent"), F.explode(F.sequence(F.lit(1), F.col("s_nationkey") % 3 + 1)).alias("child")).distinct()
    stored = overlay.insert_children(children.limit(0), children, report, "s_suppkey", "parent")
    totals = merged.agg(F.lit(-1).alias("nth"), F.lit("total").alias("status"), F.count("*").alias("n")).unionByName(stored.agg(F.lit(-1).alias("nth"), F.lit("children").alias("status"), F.count("*").alias("n")))
    return counts.unionByName(totals)


def q14_fill_and_deactivate(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("name"))
    source = F.when(F.col("c_custkey") % 4 != 1, F.concat(F.lit("Name "), F.col("c_custkey").cast("string")))
    filled, status = overlay.fill_empty(F.col("name"), source)
    named = customers.select("c_custkey", filled.alias("name"), status.alias("fill_status"))
    marks = named.where("c_custkey % 6 = 0").select("c_custkey", F.when(F.col("c_custkey") % 12 == 0, F.upper("name")).otherwise("someone else").alias("name"), F.lit("removed").alias("mark"))
    marked, report = overlay.deactivate(named, marks, "c_custkey", "name")
    return marked.join(report.withColumnRenamed("status", "mark_status"), "c_custkey", "left").select("c_custkey", "name", "fill_status", "state", "mark_status")


def q15_fingerprint_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    print_ = F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(tx.fingerprint(F.col("text")))
    payloads = docs.where("doc_id % 3 <> 2").select("doc_id", print_.alias("fingerprint"), F.concat(F.lit("payload-"), F.col("doc_id").cast("string")).alias("payload"))
    return overlay.fingerprinted(docs, payloads, "doc_id", tx.fingerprint(F.col("text"))).select("doc_id", "payload", "status")


def q16_manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    new = docs.where("doc_id % 5 <> 1").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"))
    return overlay.manifest_diff(docs.where("doc_id % 5 <> 0"), new, "doc_id", "n_chars")


def q17_regression_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    guarded = overlay.regression_guard(events, events.where("event_type = 'view' or event_id % 3 = 0"), "event_type", 0.5)
    return guarded.select("event_type", "n_old", "n_new", "ok")


def q18_majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.majority(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source"], "lang", "doc_id").select("source", "lang", "votes")


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q") and name[1:3].isdigit()}

_TEXT_KEY = r"""lower(trim(regexp_replace(translate(translate(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), '‘’“”', '''''""'), '–—−', '---'), '[ \t\n\r]+', ' ', 'g')))"""
_PRICES = """
    parts as (select p_partkey, lower(p_name) as name, p_brand, cast(floor(p_retailprice) as integer) as price from part),
    listed as (
        select name, p_brand, p_partkey,
               case when p_partkey % 3 = 0 then 'YOUR 2ND UNIT COSTS' when p_partkey % 3 = 1 then 'your unit costs ' else 'YOUR 1ST TO 3RD UNITS COST' end as tier,
               cast(price + case when p_partkey % 7 = 0 then 10 else 0 end as integer) as points
        from parts where p_partkey % 5 <> 0),
    based as (select *, upper(trim(tier)) = 'YOUR UNIT COSTS' or regexp_matches(upper(trim(tier)), '^YOUR 1ST\\b') as base from listed)""".replace("\\\\", "\\")

ORACLE_SQL = {
    "q01_seq_keys": f"""
        select l_orderkey || '_w' || row_number() over w as key, l_orderkey, l_partkey, row_number() over w as seq
        from lineitem where l_returnflag <> 'N' window w as (partition by l_orderkey order by {_LINES[12:]})""",
    "q02_nested_rollup": f"""
        select l_orderkey, round(sum(l_extendedprice), 2) as total, round(min(l_extendedprice), 2) as least,
               string_agg(cast(l_partkey as varchar), ',' order by {_LINES[12:]}) as parts
        from lineitem group by l_orderkey""",
    "q03_split_collect": """
        select user_id, coalesce(string_agg(upper(event_type), ',' order by event_id) filter (where event_type = 'click'), '') as clicks,
               coalesce(string_agg(upper(event_type), ',' order by event_id) filter (where event_type <> 'click'), '') as others
        from events group by user_id""",
    "q04_keep_last": """
        select user_id, event_type, event_id, round(value, 6) as value from events
        qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1""",
    "q05_keep_first_collisions": """
        with d as (select lower(string_split(text, chr(10))[1]) as alias, source, doc_id from documents),
        f as (select *, first_value(source) over (partition by alias order by doc_id) as first from d)
        select alias, first as source, count(*) filter (where source <> first) as collisions, count(*) filter (where source = first) - 1 as repeats
        from f group by alias, first""",
    "q06_first_child": f"""
        with f as (select * from lineitem qualify row_number() over (partition by l_orderkey order by {_LINES[12:]}) = 1)
        select o_orderkey, o_orderstatus, l_partkey, l_quantity from orders left join f on l_orderkey = o_orderkey""",
    "q07_parent_count_having": """
        select n_nationkey, n_name, count(c_custkey) as customers from nation left join customer on c_nationkey = n_nationkey
        group by n_nationkey, n_name having count(c_custkey) >= 3 order by customers desc, n_name""",
    "q08_crosscheck": """
        with o as (select o_orderkey as k, cast(cast(floor(o_totalprice) as bigint) as varchar) as total, upper(o_orderstatus) as status, cast(year(o_orderdate) as varchar) as year from orders),
        l as (select l_orderkey as k, cast(cast(floor(sum(l_extendedprice)) as bigint) as varchar) as total, max(l_linestatus) as status, cast(min(year(l_shipdate)) as varchar) as year from lineitem group by 1),
        m as (select o.k, unnest([{'f': 'total', 'a': o.total, 'b': l.total}, {'f': 'status', 'a': o.status, 'b': l.status}, {'f': 'year', 'a': o.year, 'b': l.year}]) as p from o join l using (k))
        select p.f as field, count(*) as compared, count(*) filter (where p.a is not distinct from p.b) as agree,
               round_even(100.0::double * count(*) filter (where p.a is not distinct from p.b) / count(*), 1) as rate
        from m group by 1""",
    "q09_price_check": f"""
        with {_PRICES},
        b as (select p_brand, name, min(points) as listed from based where base group by all),
        t as (select p_brand, count(distinct name) as tiered from based where not base group by all),
        own as (select p_brand, name, min(price) as own from parts group by all)
        select p_brand, count(listed) as compared, count(*) filter (where listed = own) as agree, count(*) filter (where listed <> own) as differ,
               count(*) filter (where listed is null) as only_left, coalesce(any_value(tiered), 0) as tiered
        from own left join b using (p_brand, name) left join t using (p_brand) group by p_brand""",
    "q10_price_apply": f"""
        with {_PRICES},
        b as (select distinct p_brand, name, cast(p_partkey % 3 + 1 as integer) as m, points as c from based where base),
        u as (select p_brand, name, m, min(c) as c from b group by all having count(*) = 1),
        l as (select p_brand, name, list({{'m': m, 'c': c}} order by m, c) as l from u group by all),
        i as (select p_partkey, p_brand, name, unnest([{{'m': 1, 'c': price}}, {{'m': 5, 'c': price * 5}}]) as it from parts),
        n as (select i.p_partkey, it.m as m, coalesce(u.c, it.c) as c, it.m as o from i left join u on u.p_brand = i.p_brand and u.name = i.name and u.m = it.m
              union all select p_partkey, u.m, u.c, 10 + u.m from parts join u using (p_brand, name) where u.m not in (1, 5))
        select p_partkey, string_agg(m || ':' || c, ',' order by o) as items, cast(min(c) as integer) as points from n group by p_partkey""",
    "q11_cas_patch": r"""
        with recursive p as (
            select c_custkey * 4 as patch_id, case when c_custkey % 5 = 4 then -c_custkey else c_custkey end as k,
                   case when c_custkey % 5 = 1 then 'OTHER' when c_custkey % 5 = 2 then null else lower(c_mktsegment) || ' "' end as f,
                   case when c_custkey % 5 = 3 then c_mktsegment else 'PATCHED' end as t
            from customer where c_custkey % 10 < 5
            union all select c_custkey * 4 + 1, c_custkey, 'patched', 'TWICE' from customer where c_custkey % 10 = 0
            union all select c_custkey * 4 + 2, c_custkey, c_mktsegment, 'LATE' from customer where c_custkey % 10 = 0),
        o as (select *, row_number() over (partition by k order by patch_id) as nth, count(*) over (partition by k) as n from p),
        r as (
            select k, 0 as step, c_mktsegment as cur, cast(null as bigint) as patch_id, '' as status, c_custkey is not null as there
            from (select distinct k from p) left join customer on c_custkey = k
            union all
            select k, step + 1, case when s = 'applied' then t else cur end, pid, s, there
            from (
                select r.k, r.step, r.cur, o.patch_id as pid, o.t, r.there,
                       case when f is null or t is null then 'invalid' when not there then 'not_unique'
                            when lower(regexp_replace(cur, '[" ]', '', 'g')) = lower(regexp_replace(t, '[" ]', '', 'g')) then 'already'
                            when lower(regexp_replace(cur, '[" ]', '', 'g')) = lower(regexp_replace(f, '[" ]', '', 'g')) then 'applied' else 'mismatch' end as s
                from r join o on o.k = r.k and o.nth = case when r.step < o.n then r.step + 1 else r.step + 1 - o.n end
                where r.step < 2 * o.n))
        select a.patch_id, a.status as first_run, b.status as second_run, case when b.there then e.cur end as value
        from o join r a on a.k = o.k and a.step = o.nth join r b on b.k = o.k and b.step = o.nth + o.n join r e on e.k = o.k and e.step = 2 * o.n""",
    "q12_list_patch": """
        with k as (select p_partkey, list_filter(string_split(p_type, ' '), lambda x: lower(x) not in ('standard', 'tin')) as kept from part)
        select p_partkey, array_to_string(list_concat(kept, list_filter(['ADDED', 'brass'], lambda x: not list_contains(list_transform(kept, lambda y: lower(y)), lower(x)))), ',') as keywords from k""",
    "q13_guarded_insert": """
        with recursive r as (
            select s_suppkey as fam, case when s_suppkey % 4 < 2 then s_suppkey else s_suppkey + 1000000 end as k, case when s_suppkey % 4 in (0, 2) then s_name else 'New ' || s_name end as name, s_nationkey as nk from supplier),
        f as (
            select fam, 0 as nth, k, name, nk from r
            union all select fam, v.nth, k + v.far, v.o || name, nk from r, (values (1, 0, ''), (2, 0, 'Other '), (3, 1000000, ''), (4, 1000000, 'Other ')) as v(nth, far, o) where fam % 4 = 3),
        b as (
            select f.*, case when i.s_name = name then 'exists' when i.s_suppkey is not null then 'id_clash' when n.s_name is not null then 'name_clash' end as met
            from f left join supplier i on i.s_suppkey = k left join (select distinct s_name, s_nationkey from supplier) n on n.s_name = name and n.s_nationkey = nk),
        w as (
            select fam, nk, -1 as nth, [{'k': cast(-1 as bigint), 'n': ''}] as taken, '' as status, cast(-1 as bigint) as k from b where nth = 0
            union all
            select fam, nk, nth, case when s = 'inserted' then list_append(taken, {'k': k, 'n': name}) else taken end, s, k
            from (
                select w.fam, w.nk, b.nth, w.taken, b.k, b.name,
                       case when met is not null then met when len(list_filter(taken, lambda x: x.k = b.k and x.n = name)) > 0 then 'exists' when len(list_filter(taken, lambda x: x.k = b.k)) > 0 then 'id_clash'
                            when len(list_filter(taken, lambda x: x.n = name)) > 0 then 'name_clash' else 'inserted' end as s
                from w join b on b.fam = w.fam and b.nth = w.nth + 1)),
        d as (select * from w where nth >= 0)
        select cast(nth as integer) as nth, status, count(*) as n from d group by all
        union all select -1, 'total', (select count(*) from supplier) + (select count(*) from d where status = 'inserted')
        union all select -1, 'children', cast(coalesce(sum(nk % 3 + 1), 0) as bigint) from d where status = 'inserted'""",
    "q14_fill_and_deactivate": """
        with c as (select c_custkey, case when c_custkey % 3 = 0 then '' else c_name end as cur, case when c_custkey % 4 <> 1 then 'Name ' || c_custkey end as src from customer),
        f as (
            select c_custkey, case when trim(cur) = '' then coalesce(src, cur) else cur end as name,
                   case when src is null then 'no_source' when trim(cur) = '' then 'filled' when cur = src then 'already' else 'mismatch' end as fill_status from c)
        select c_custkey, name, fill_status, case when c_custkey % 12 = 0 then 'removed' end as state,
               case when c_custkey % 12 = 0 then 'applied' when c_custkey % 6 = 0 then case when lower(name) = 'someone else' then 'applied' else 'mismatch' end end as mark_status
        from f""",
    "q15_fingerprint_projection": f"""
        with d as (select doc_id, sha256({_TEXT_KEY}) as digest from documents),
        p as (select doc_id, case when doc_id % 7 = 0 then 'stale' else digest end as print from d where doc_id % 3 <> 2)
        select doc_id, case when print = digest then 'payload-' || doc_id end as payload, case when print is null then 'none' when print = digest then 'projected' else 'stale' end as status
        from d left join p using (doc_id)""",
    "q16_manifest_diff": """
        with o as (select doc_id, n_chars from documents where doc_id % 5 <> 0),
        n as (select doc_id, case when doc_id % 7 = 0 then n_chars + 1 else n_chars end as n_chars from documents where doc_id % 5 <> 1)
        select doc_id, case when o.doc_id is null then 'added' when n.doc_id is null then 'removed' when o.n_chars is not distinct from n.n_chars then 'unchanged' else 'changed' end as status
        from o full join n using (doc_id)""",
    "q17_regression_guard": """
        with o as (select event_type, count(*) as n_old, count(*) filter (where event_type = 'view' or event_id % 3 = 0) as n_new from events group by 1)
        select event_type, n_old, n_new, n_new >= 0.5 * n_old as ok from o""",
    "q18_majority_vote": """
        select source, lang, votes from (select source, lang, count(*) as votes, min(doc_id) as first from documents group by 1, 2)
        qualify row_number() over (partition by source order by votes desc, first) = 1""",
}
