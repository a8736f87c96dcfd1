"""Queries q56 to q66: names in texts, objects and leaves of nested data, published versions, fingerprints, section chunks, link repair, structures, records, indexes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import nested
from ..operators import chunk, names, overlay, quality
from ..operators.lineage import shared_folder
from ..sources import snapshots, tables
from ..sources.tables import table
from ..streaming import fingerprints


def q56_name_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one and two words (with which every fiftieth text begins) put in brackets wherever they stand as words, the longest first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = docs.where("doc_id % 50 = 0").select(F.explode(F.array(*[F.lower(F.regexp_extract("text", p, 0)) for p in ("^[^ \\n]+", "^[^ \\n]+ [^ \\n]+")])).alias("name")).where("name <> ''").distinct()
    done = names.rewrite(docs, first.withColumn("value", F.concat(F.lit("<"), F.upper("name"), F.lit(">"))), "text", whole=True)
    return done.select("doc_id", F.col("n_replaced").cast("bigint").alias("n_replaced"), F.sha2("text", 256).alias("text_sha256"))


def q57_noisy_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first whole object of a message: in a fence, among braces, cut off, or without a type."""
    kind = F.col("turn") % 4
    turns = table(spark, sf_dir, "conversations").withColumn("said", F.concat("text", F.lit(' "} { \\')))
    own = F.to_json(F.struct(F.when(kind != 3, "answer").alias("type"), F.col("said"), F.struct("turn", "role").alias("at")))
    message = F.when(kind == 0, F.concat(F.lit("```json\n"), own, F.lit("\n```"))).when(kind == 2, F.concat(F.lit('Here: '), F.substring(own, F.lit(1), F.length(own) - 1))).otherwise(F.concat(F.lit('As asked, "this": } '), own, F.lit(' and {"type": "other"} }')))
    found = turns.select("conv_id", "turn", nested.object_of(message).alias("o"))
    of = lambda path, kind: F.try_variant_get("o", path, kind)
    return found.select("conv_id", "turn", of("$.type", "string").alias("type"), F.sha2(of("$.said", "string"), 256).alias("said_sha256"), of("$.at.turn", "bigint").alias("at_turn"))


def q58_text_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of nested conversations, of three shapes, in order."""
    text = F.substring(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t"))), 6, 1 << 30)
    quoted, kind = F.substring(text, F.lit(1), F.length(text) - 1), F.col("turn") % 3
    inner = F.concat(F.lit('{"content":[{"text":'), quoted, F.lit(',"content":null},[[],["tail"]],7],"note":"not read"}'))
    node = F.when(kind == 0, quoted).when(kind == 1, F.concat(F.lit('{"role":"r","text":'), quoted, F.lit("}"))).otherwise(inner)
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", node.alias("node")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["node"]), ","), F.lit("]")).alias("json"))
    leaves = nested.text_leaves(whole.select("conv_id", F.parse_json("json").alias("doc")), "conv_id", "doc")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "leaf"))), lambda x: x["leaf"]), "|")
    return leaves.groupBy("conv_id").agg(F.count("*").alias("n_leaves"), F.sha2(joined, 256).alias("leaves_sha256"))


def _root(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def q59_published_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers see after a first publication, a writer that fails midway, a second publication, and a step back."""
    root, seen = _root(spark, "published"), []
    lines, nations = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), table(spark, sf_dir, "nation").select("n_nationkey")

    def look(step: str) -> None:
        for name, column in (("lines", "l_quantity"), ("nations", "n_nationkey")):
            seen.append(snapshots.read(spark, root, name).agg(F.lit(step).alias("step"), F.lit(name).alias("name"), F.count("*").alias("n"), F.round(F.sum(F.col(column).cast("double")), 2).alias("total")))

    def first(store) -> None:
        store(lines.where("l_orderkey % 2 = 0"), "lines")
        store(nations, "nations")

    def broken(store) -> None:
        store(lines.limit(0), "lines")
        raise RuntimeError("the second table cannot be written")

    snapshots.publish(spark, root, first)
    look("first")
    try:
        snapshots.publish(spark, root, broken)
    except RuntimeError:
        look("failed")
    snapshots.publish(spark, root, lambda store: store(lines, "lines"))
    look("second")
    snapshots.rollback(spark, root)
    look("back")
    return reduce(DataFrame.union, seen)


def q60_added_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a table, of which only the second was written with a column, read under the columns of today."""
    root, customers = _root(spark, "columns"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    snapshots.publish(spark, root, lambda store: store(customers.where("c_custkey % 2 = 0"), "customers"))
    added = [snapshots.add_columns(spark, root, "customers", {"state": ("string", "active"), "score": ("int", 0)}) for _ in range(2)]
    snapshots.publish(spark, root, lambda store: store(customers.withColumn("state", F.when(F.col("c_custkey") % 3 != 0, "removed")), "customers"))
    rows = snapshots.history(spark, root, "customers")
    return rows.groupBy("version", "state", "score").agg(F.count("*").alias("n"), F.lit("; ".join(",".join(a) for a in added)).alias("added"))


def q61_fingerprint_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over the documents as files of their sources: all new, some changed and one gone, none changed."""
    root, landing = _root(spark, "taken-in"), _root(spark, "landing")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_replace(F.coalesce("source", F.lit("none")), "[^A-Za-z0-9]", "_").alias("source"))

    def land(rows: DataFrame) -> None:
        lines = rows.select(F.to_json(F.struct("doc_id", "text")).alias("value"), "source")
        lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 5000).partitionBy("source").text(landing)

    def rows_of(files: DataFrame) -> DataFrame:
        lines = files.select("source", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
        read = lines.select("source", F.from_json("line", "doc_id long, text string").alias("r"))
        return read.select("source", F.col("r.doc_id").alias("doc_id"), F.length("r.text").cast("bigint").alias("n_chars"))

    runs, some = [], F.col("source").rlike("[37]$")
    for k in range(3):
        if k == 0:
            land(docs)
        elif k == 1:
            land(docs.where(some).withColumn("text", F.concat("text", F.lit(" changed"))))
            snapshots.delete(spark, f"{landing}/source=src5")
        report = fingerprints.take_in(spark, landing, root, rows_of, pattern="part-*")
        runs.append(report.groupBy(F.lit(k + 1).alias("run"), "status").agg(F.count("*").alias("n")).withColumn("chars", F.lit(0).cast("bigint")))
    whole = snapshots.read(spark, root, "rows").agg(F.lit(0).alias("run"), F.lit("rows").alias("status"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return reduce(DataFrame.union, [*runs, whole])


def q62_section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as books: a heading in every third turn, then a page that goes on, then weapons and one more segment; chunks of at most 600 characters."""
    kind, text = F.col("turn") % 3, F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), text)
    goes_on = F.concat(F.lit("<!--CONT-->\n"), text, F.lit("\n### 技能\n"), text)
    last = F.concat(F.lit("### 远程武器\n"), F.substring(text, 1, 90), F.lit("\n### 单位构成\n"), text)
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(kind == 0, head).when(kind == 1, goes_on).otherwise(last).alias("page"))
    found = chunk.section_chunks(pages, "conv_id", "turn", "page", 600)
    return found.select(F.col("book").alias("conv_id"), F.col("entry").cast("bigint").alias("entry"), F.col("part").cast("bigint").alias("part"), "page", "heading", F.length("chunk").cast("bigint").alias("n_chars"), F.sha2("chunk", 256).alias("chunk_sha256"))


def q63_link_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every fiftieth page, one right, one without its third letter and one to nothing near, against the paths of all pages."""
    host = F.regexp_extract("url", "://(?:www\\.|blog\\.|m\\.)?([^./]+)\\.", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(host, F.lit("/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"))
    wrong = F.concat(F.substring("path", 1, 2), F.substring("path", 4, 1 << 30))
    text = F.concat(F.lit("See [["), "path", F.lit("]], [["), wrong, F.lit("|shown]], [["), wrong, F.lit("]] and [[0123456789]]."))
    return quality.repaired_links(pages.where("page_id % 50 = 0").select(F.col("page_id").alias("page"), text.alias("text")), pages, 0.8).select(F.col("page").alias("page_id"), "text", "n_repaired")


def q64_structure_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with conditions on their lines, as sorted lists, before and after a change of some: added, removed, changed or unchanged."""
    gate = F.when(F.col("l_returnflag") != "N", F.array("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(gate).alias("conditions"))
    key = F.col("l_orderkey")
    fewer = F.filter("conditions", lambda x: ~F.array_contains(x, F.lit("1")))
    new = rows.where(key % 11 != 0).withColumn("conditions", F.when(key % 7 == 0, fewer).when(key % 5 == 0, F.reverse("conditions")).otherwise(F.col("conditions")))
    old = quality.structure(rows.where(key % 13 != 0), "l_orderkey", "conditions")
    return overlay.manifest_diff(old, quality.structure(new, "l_orderkey", "conditions"), "l_orderkey", "shape")


def q65_record_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a record for each line of an order, judged by the fields asked for."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_partkey") % 7 != 0, (F.col("l_partkey") % 3).cast("string")).alias("s"), F.when(F.col("l_suppkey") % 5 != 0, (F.col("l_suppkey") % 3).cast("string")).alias("d"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("lines"))
    k = F.col("l_orderkey")
    told = lambda many, tokens: F.struct(F.lit(many).alias("many"), tokens.alias("tokens"))
    answer = F.create_map(
        F.lit("S"), told(True, F.transform("lines", lambda x: x["s"])), F.lit("D"), told(True, F.transform("lines", lambda x: x["d"])), F.lit("W"), told(False, F.array(F.when(k % 10 != 0, (F.floor(k / 7) % 2).cast("string"))))
    )
    gold = F.create_map(F.lit("S"), (k % 3).cast("string"), F.lit("D"), (F.floor(k / 3) % 3).cast("string"), F.lit("W"), F.lit("1"))
    required = F.when(k % 4 == 0, F.array(F.lit("S"))).when(k % 4 == 1, F.array(F.lit("W"))).when(k % 4 == 2, F.array(F.lit("S"), F.lit("D"))).otherwise(F.array(F.lit("S"), F.lit("D"), F.lit("W")))
    return lines.select("l_orderkey", quality.aligned_verdict(gold, required, answer).alias("verdict"))


def q66_wiki_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of index pages of twenty entries: links under running headings, escaped pipes, and dates that are missing."""
    k, label = F.col("page_id"), F.regexp_extract("url", "://(?:www\\.|blog\\.|m\\.)?([^./]+)\\.", 1)
    start = F.when(k % 5 == 0, F.concat(F.lit("\n### "), label, F.lit("\n| 类型 | 名称 | 摘要 | Updated |\n|---|:-:|---|---|\n"))).otherwise("")
    name = F.when(k % 7 == 0, label).otherwise(F.concat(F.lit("["), label, F.lit("](p/"), k.cast("string"), F.lit(".md)")))
    row = F.concat(start, F.lit("| unit | "), name, F.lit(" | a \\| b "), k.cast("string"), F.lit(" | "), F.when(k % 3 == 0, "-").otherwise("2026-01-02"), F.lit(" |"))
    rows = table(spark, sf_dir, "pages").select(F.floor(k / 20).alias("page"), F.struct("page_id", row.alias("row")).alias("r"))
    texts = rows.groupBy("page").agg(F.concat(F.lit("# Index\n"), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["row"]), "\n"), F.lit("\n```\n| a | [x](y) | c | d |\n```\n")).alias("text"))
    return tables.wiki_index(texts, "page", "text").drop("line")


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q") and name[1:3].isdigit()}

_LABEL = r"regexp_extract(url, '://(?:www\.|blog\.|m\.)?([^./]+)\.', 1)"

ORACLE_SQL = {
    "q57_noisy_objects": """
        select conv_id, turn, case when turn % 4 in (0, 1) then 'answer' end as type, case when turn % 4 in (0, 1) then sha256(text || ' "} { \\') end as said_sha256, case when turn % 4 in (0, 1) then turn end as at_turn
        from conversations""",
    "q58_text_leaves": """
        select conv_id, cast(sum(case when turn % 3 = 2 then 2 else 1 end) as bigint) as n_leaves,
               sha256(string_agg(case when turn % 3 = 2 then coalesce(text, '') || '|tail' else coalesce(text, '') end, '|' order by turn)) as leaves_sha256
        from conversations group by conv_id""",
    "q59_published_versions": """
        with s(step) as (values ('first'), ('failed'), ('second'), ('back')),
        l as (select count(*) filter (where l_orderkey % 2 = 0) as half, round(sum(l_quantity) filter (where l_orderkey % 2 = 0), 2) as part, count(*) as whole, round(sum(l_quantity), 2) as every from lineitem)
        select step, 'lines' as name, case when step = 'second' then whole else half end as n, cast(case when step = 'second' then every else part end as double) as total from l, s
        union all select step, 'nations', (select count(*) from nation), (select round(sum(n_nationkey), 2)::double from nation) from s""",
    "q60_added_columns": """
        with v as (
            select 0 as version, 'active' as state, c_custkey from customer where c_custkey % 2 = 0
            union all select 1, case when c_custkey % 3 <> 0 then 'removed' end, c_custkey from customer)
        select version, state, 0 as score, count(*) as n, 'score,state; ' as added from v group by version, state""",
    "q61_fingerprint_ingest": """
        with d as (select regexp_replace(coalesce(source, 'none'), '[^A-Za-z0-9]', '_', 'g') as source, text from documents),
        s as (select source, regexp_matches(source, '[37]$') as changed, source = 'src5' as gone from (select distinct source from d)),
        r as (
            select 1 as run, 'new' as status from s
            union all select 2, case when gone then 'gone' when changed then 'changed' else 'unchanged' end from s
            union all select 3, 'unchanged' from s where not gone)
        select run, status, count(*) as n, cast(0 as bigint) as chars from r group by all
        union all select 0, 'rows', count(*), cast(sum(length(text) + case when regexp_matches(source, '[37]$') then 8 else 0 end) as bigint) from d where source <> 'src5'""",
    "q62_section_chunks": """
        with recursive t as (select conv_id, turn, role, coalesce(text, '') as text from conversations),
        e as (select conv_id, turn // 3 as g, max(case when turn % 3 = 0 then role || ' ' || turn end) as heading, min(turn) as page, max(case when turn % 3 = 0 then text end) as a, max(case when turn % 3 = 1 then text end) as b, max(case when turn % 3 = 2 then text end) as c from t group by all),
        s as (
            select conv_id, cast(g + 1 as bigint) as entry, page, heading, list_filter([a || coalesce(chr(10) || b, ''), '### 技能' || chr(10) || b, '### 远程武器' || chr(10) || substr(c, 1, 90), '### 单位构成' || chr(10) || c], lambda x: x is not null) as seg, c is not null as guns
            from e),
        b as (select *, array_to_string(seg, chr(10)) as body from s),
        p as (
            select conv_id, entry, page, heading, 1 as nth, cast([] as varchar[]) as done, '' as open,
                   case when guns then [seg[1] || chr(10) || seg[3]] else cast([] as varchar[]) end as fixed, case when guns then [seg[2], seg[4]] else seg end as rest
            from b where length(body) > 600 and len(seg) > 1
            union all
            select conv_id, entry, page, heading, nth + 1, case when open <> '' and length(open) + length(rest[nth]) > 600 then list_append(done, open) else done end,
                   case when open = '' or length(open) + length(rest[nth]) > 600 then rest[nth] else open || chr(10) || rest[nth] end, fixed, rest
            from p where nth <= len(rest)),
        h as (
            select conv_id, entry, page, heading, cast(-1 as bigint) as part, body as rest, cast(null as varchar) as piece from b where length(body) > 600 and len(seg) = 1
            union all
            select conv_id, entry, page, heading, part + 1, case when length(rest) <= 600 then '' else ltrim(substr(rest, cut_at + 1), chr(10)) end,
                   case when length(rest) <= 600 then rest else rtrim(substr(rest, 1, cut_at), chr(10)) end
            from (
                select *, case when two > 0 then two when one > 0 then one else 600 end as cut_at from (
                    select *, case when strpos(back, chr(10) || chr(10)) > 0 then 600 - strpos(back, chr(10) || chr(10)) - 1 else 0 end as two,
                           case when strpos(back, chr(10)) > 0 then 600 - strpos(back, chr(10)) else 0 end as one
                    from (select *, reverse(substr(rest, 1, 600)) as back from h where rest <> '')))),
        parts as (
            select conv_id, entry, page, heading, cast(0 as bigint) as part, body as x from b where length(body) <= 600
            union all select conv_id, entry, page, heading, cast(i - 1 as bigint), l[i] from (select *, unnest(range(1, len(l) + 1)) as i from (select *, list_concat(fixed, list_append(done, open)) as l from p where nth = len(rest) + 1))
            union all select conv_id, entry, page, heading, part, piece from h where part >= 0),
        w as (select *, trim('## ' || heading || case when part > 0 then '（续）' else '' end || case when x = '' then '' else chr(10) || x end, chr(10) || ' ' || chr(9)) as chunk from parts)
        select conv_id, entry, part, page, heading, cast(length(chunk) as bigint) as n_chars, sha256(chunk) as chunk_sha256 from w""",
    "q64_structure_diff": """
        with g as (select l_orderkey as k, list_sort(list(case when l_returnflag <> 'N' then [l_returnflag, l_linestatus, l_linenumber::varchar] else cast([] as varchar[]) end)) as c from lineitem group by 1),
        o as (select k, c from g where k % 13 <> 0 and len(list_filter(c, lambda x: len(x) > 0)) > 0),
        n as (
            select k, c from (select k, case when k % 7 = 0 then list_filter(c, lambda x: not list_contains(x, '1')) else c end as c from g where k % 11 <> 0)
            where len(list_filter(c, lambda x: len(x) > 0)) > 0)
        select k as l_orderkey, case when o.k is null then 'added' when n.k is null then 'removed' when o.c = n.c then 'unchanged' else 'changed' end as status from o full join n using (k)""",
    "q65_record_alignment": """
        with l as (select l_orderkey as k, case when l_partkey % 7 <> 0 then l_partkey % 3 end as s, case when l_suppkey % 5 <> 0 then l_suppkey % 3 end as d, case when l_orderkey % 10 <> 0 then (l_orderkey // 7) % 2 end as w from lineitem),
        h as (
            select k, k % 4 <> 1 as ask_s, k % 4 in (2, 3) as ask_d, k % 4 in (1, 3) as ask_w, count(s) > 0 as has_s, count(d) > 0 as has_d, count(w) > 0 as has_w,
                   coalesce(bool_or(s = k % 3), false) as hit_s, coalesce(bool_or(d = (k // 3) % 3), false) as hit_d, coalesce(bool_or(w = 1), false) as hit_w,
                   coalesce(bool_or(coalesce(s = k % 3, false) and coalesce(d = (k // 3) % 3, false)), false) as together
            from l group by k)
        select k as l_orderkey,
               case when (ask_s and has_s and not hit_s) or (ask_d and has_d and not hit_d) or (ask_w and has_w and not hit_w) then 'wrong'
                    when not ((ask_s and hit_s) or (ask_d and hit_d) or (ask_w and hit_w)) then 'wrong'
                    when (ask_s and not has_s) or (ask_d and not has_d) or (ask_w and not has_w) then 'partial'
                    when ask_s and ask_d and not together then 'partial' else 'correct' end as verdict
        from h""",
    "q66_wiki_index": rf"""
        with p as (select page_id // 20 as page, page_id, {_LABEL} as label from pages),
        f as (select *, coalesce(last_value(case when page_id % 5 = 0 then label end ignore nulls) over (partition by page order by page_id), '') as faction from p)
        select page, 'p/' || page_id || '.md' as path, label as title, faction, 'unit' as type, 'a | b ' || page_id as summary, case when page_id % 3 = 0 then '' else '2026-01-02' end as updated
        from f where page_id % 7 <> 0""",
}
