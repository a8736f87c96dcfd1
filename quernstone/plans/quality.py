"""Queries q29 to q32 and q42 to q52: pages, links, numbers, answers, versions, carries, increments."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators import ordered, quality
from ..operators.lineage import shared_folder
from ..sources import tables
from ..sources.tables import table
from ..streaming import incremental

# Word edges are written out, since engines differ in what \\b takes for a letter.
RULES = [("fnp", "the[a-z]*n([^a-z]|$)"), ("stealth", "(^|[^a-z])in[a-z]+ble"), ("minus_hit", "tion[a-z]*tion"), ("aura", "(^|[^a-z])wh"), ("deployment", "(^|[^a-z])(que|der)([^a-z]|$)")]


def q29_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    body = F.regexp_replace(F.regexp_replace("html", "(?is)<script\\b.*?</script>", " "), "<style>[^<]*</style>", " ")
    return pages.select(
        "page_id",
        tables.page_title(F.col("html")).alias("title"),
        F.size(tables.hrefs(F.col("html"))).cast("bigint").alias("n_links"),
        F.sha2(tx.clean_html(body), 256).alias("text_sha256"),
    )


def q30_broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that lead to no known page, after host and query are settled."""
    pages = table(spark, sf_dir, "pages")
    path = F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)
    links = pages.select(F.col("page_id").alias("source"), F.explode(tables.hrefs(F.col("html"))).alias("target")).union(
        pages.where("page_id % 4 = 0").select("page_id", path)
    )
    broken = quality.broken_links(links, pages.select(path.alias("path")))
    return broken.groupBy("source").agg(F.count("*").alias("n_broken"), F.countDistinct("target").alias("n_targets"))


def q31_number_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a page's HTML that its address does not have: as a set, and by count."""
    pages = table(spark, sf_dir, "pages")
    sets = pages.select("page_id", F.array_join(quality.invented(F.col("html"), F.col("url")), ",").alias("invented"))
    surplus = quality.exceeding(pages, "page_id", "html", "url").groupBy("page_id").agg(F.sum("surplus").alias("surplus"))
    return sets.join(surplus, "page_id", "left").select("page_id", "invented", F.coalesce("surplus", F.lit(0)).cast("bigint").alias("surplus"))


def q32_page_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id")
    met = docs.join(labels, F.col("doc_id") == F.col("label_id"), "left")
    refined = F.when(F.col("label_id").isNotNull(), F.when(F.col("doc_id") % 11 == 0, F.floor(F.col("n_chars") / 10)).otherwise(F.col("n_chars")))
    state = quality.page_state(F.col("n_chars"), refined, F.col("toxic") == 1, F.col("doc_id") % 13 == 0, F.col("quality") == 0)
    counted = met.groupBy("source", state.alias("state")).agg(F.count("*").alias("pages"))
    total = met.groupBy("source").agg(F.count("*").alias("total"))
    return counted.join(total, "source").select("source", "state", "pages", F.round(F.col("pages") / F.col("total"), 6).alias("share"))


def q42_qa_mechanical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers scored against gold fields, verdicts read from text, and the turns of conversations by length."""
    k, size = F.col("p_partkey") % 7, F.col("p_size")
    field = lambda name, value: F.concat(F.lit(name), F.lit(": "), value.cast("string"), F.lit(" "))
    gold = F.when(k == 6, F.concat(field("M", size), field("M", size + 1))).when(k == 5, "no fields").otherwise(F.concat(field("M", size), field("T", size + 2), F.when(size % 2 == 0, field("LD", size % 9)).otherwise("")))
    answer = F.when(k == 1, F.concat(F.lit("M="), size.cast("string"), F.lit("+"))).when(k == 2, F.concat(field("M", size + 1), field("T", size))).when(k == 3, F.lit(None)).otherwise(gold)
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), gold.alias("gold"), answer.alias("answer"))
    scored = parts.select("id", quality.mechanical(quality.gold_fields(F.col("gold")), quality.gold_fields(F.col("answer"))).alias("verdict"))
    judged = table(spark, sf_dir, "labels").select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("id"), tx.verdict(F.when(F.col("quality") == 0, F.when(F.col("doc_id") % 3 == 0, "❌ correct").when(F.col("doc_id") % 3 == 1, "this is incorrect").otherwise("⚠ wrong")).otherwise(F.when(F.col("doc_id") % 3 == 0, "✅ fine but wrong").when(F.col("doc_id") % 3 == 1, "Correct.").otherwise("hm"))).alias("verdict"))
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("id"), tx.bottleneck(F.when(F.length("text") > 200, "correct").otherwise("wrong"), F.when(F.col("role") == "user", "correct").otherwise("partial")).alias("verdict"))
    return scored.unionByName(judged).unionByName(turns)


def q43_version_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pages of a host and language, the one of the latest version in its address."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("lang"), F.concat(tx.file_of_url(F.col("url")), F.lit("_V"), (F.col("page_id") % 7).cast("string"), F.lit(".5")).alias("stem"))
    kind, number = tx.version_rank(F.col("stem"))
    ranked = pages.withColumn("kind", kind).withColumn("number", number)
    return ordered.keep_first(ranked, ["lang"], [F.desc("kind"), F.desc("number"), F.desc("page_id")]).select("lang", "page_id", "stem", F.col("kind").cast("int").alias("kind"))


def q44_text_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the first rule that they match, and the total, which the categories add up to."""
    docs = table(spark, sf_dir, "documents").select(quality.classified(F.col("text"), RULES, "other").alias("category"))
    counted = docs.groupBy("category").agg(F.count("*").alias("n"))
    return counted.unionByName(docs.agg(F.lit("total").alias("category"), F.count("*").alias("n")))


def q45_prev_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.previous_tail(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text", 500).select("conv_id", "turn", "tail")


def q46_zip_and_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists per order compared place by place, where they are of one length."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.floor("l_quantity").cast("bigint").alias("v"))
    pairs = quality.zipped(lines.where("l_suppkey % 2 = 0"), lines.where("l_suppkey % 2 = 1"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "v")
    return pairs.select("l_orderkey", F.col("pos").cast("bigint").alias("pos"), "left_value", "right_value", (F.col("left_value") != F.col("right_value")).alias("drift"))


def q47_slug_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return ordered.distinct_slugs(parts, tx.slug(F.col("p_name")), ["p_partkey"]).select("p_partkey", "slug")


def q48_entity_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the last thing the user had said up to it."""
    turns = table(spark, sf_dir, "conversations")
    return ordered.carried(turns, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("text")), "topic").select("conv_id", "turn", "topic")


def q49_link_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(w, f"terms/{w}.md") for w in ("the", "que", "der", "license", "MIT License", "Released under", "under the", "las", "les")], "name string, target string")
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text")
    return quality.link_names(pages, names)


def q51_incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table taken in as a stream, after a first batch of some users with other values, which it replaces."""
    work = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    schema = events.schema.simpleString()[7:-1].replace(":", " ")
    for batch in (events.where("user_id % 3 = 0").withColumn("value", F.col("value") + 1), events):
        batch.write.mode("append").parquet(f"{work}/landing")
        rows = incremental.ingest(spark, f"{work}/landing", f"{work}/table", f"{work}/state", schema, "user_id")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("event_id").alias("last_event"))


def q52_ext_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition: events per type and day."""
    counts = incremental.windowed_counts(table(spark, sf_dir, "events"))
    return counts.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q") and name[1:3].isdigit()}

_ENTITIES = "html"
for _old, _new in tx.ENTITIES:
    _ENTITIES = f"replace({_ENTITIES}, '{_old}', '{_new.replace(chr(39), chr(39) * 2)}')"
_BODY = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '<style>[^<]*</style>', ' ', 'g')"

ORACLE_SQL = {
    "q29_html_extract": rf"""
        with p as (select page_id, html as raw, regexp_replace({_BODY}, '<[^>]*>', ' ', 'g') as html from pages)
        select page_id, trim(regexp_extract(raw, '<title>([^<]*)</title>', 1)) as title, cast(len(regexp_extract_all(raw, 'href="([^"]*)"')) as bigint) as n_links,
               sha256(trim(regexp_replace({_ENTITIES}, '[ \t\n\r]+', ' ', 'g'))) as text_sha256 from p""",
    "q30_broken_links": r"""
        with p as (select page_id, html, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) as path from pages),
        l as (select page_id as source, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as target from p union all select page_id, path from p where page_id % 4 = 0)
        select source, count(*) as n_broken, count(distinct target) as n_targets from l
        where target not in (select path from p) and target not in (select regexp_replace(path, '\.md$', '') from p) group by source""",
    "q31_number_verify": """
        with n as (select page_id, regexp_extract_all(html, '[0-9]+') as o, regexp_extract_all(url, '[0-9]+') as i from pages),
        oc as (select page_id, tok, count(*) as n from (select page_id, unnest(o) as tok from n) group by all),
        ic as (select page_id, tok, count(*) as n from (select page_id, unnest(i) as tok from n) group by all),
        s as (select page_id, sum(oc.n - coalesce(ic.n, 0)) as surplus from oc left join ic using (page_id, tok) where oc.n > coalesce(ic.n, 0) group by 1)
        select page_id, array_to_string(list_sort(list_filter(list_distinct(o), lambda x: not list_contains(i, x))), ',') as invented, cast(coalesce(surplus, 0) as bigint) as surplus
        from n left join s using (page_id)""",
    "q32_page_reconcile": """
        with m as (
            select source, n_chars, d.doc_id, quality, toxic, case when l.doc_id is not null then case when d.doc_id % 11 = 0 then floor(n_chars / 10) else n_chars end end as refined
            from documents d left join labels l using (doc_id)),
        s as (
            select source, case when n_chars < 20 then 'skipped' when refined is null then 'missing' when toxic = 1 then 'fallback' when doc_id % 13 = 0 then 'stale'
                   when n_chars >= 300 and refined < 0.3 * n_chars then 'truncated' when quality = 0 then 'verify_warn' else 'ok' end as state from m)
        select source, state, count(*) as pages, round(count(*)::double / sum(count(*)) over (partition by source), 6) as share from s group by source, state""",
    "q42_qa_mechanical": """
        select 'p' || p_partkey as id, case when p_partkey % 7 in (5, 6) then 'unknown' when p_partkey % 7 = 1 then 'partial' when p_partkey % 7 in (2, 3) then 'wrong' else 'correct' end as verdict from part
        union all select 'v' || doc_id, case when doc_id % 3 = 2 then 'partial' when quality = 0 then 'wrong' when quality = 1 then 'correct' end from labels
        union all select 'c' || conv_id || '.' || turn, case when role = 'user' then 'ok' when length(text) > 200 then 'generation' else 'retrieval' end from conversations""",
    "q43_version_latest": r"""
        with p as (
            select page_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) as lang,
                   regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) || '_V' || (page_id % 7) || '.5' as stem from pages)
        select lang, page_id, stem, 3 as kind from p qualify row_number() over (partition by lang order by page_id % 7 desc, page_id desc) = 1""",
    "q44_text_classify": r"""
        with c as (
            select case when regexp_matches(text, 'the[a-z]*n([^a-z]|$)') then 'fnp' when regexp_matches(text, '(^|[^a-z])in[a-z]+ble') then 'stealth' when regexp_matches(text, 'tion[a-z]*tion') then 'minus_hit'
                   when regexp_matches(text, '(^|[^a-z])wh') then 'aura' when regexp_matches(text, '(^|[^a-z])(que|der)([^a-z]|$)') then 'deployment' else 'other' end as category from documents)
        select category, count(*) as n from c group by 1 union all select 'total', count(*) from c""",
    "q45_prev_tail": "select conv_id, turn, right(lag(text) over (partition by conv_id order by turn), 500) as tail from conversations",
    "q46_zip_and_drift": """
        with l as (
            select l_orderkey, l_suppkey % 2 as side, list(cast(floor(l_quantity) as bigint) order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as v from lineitem group by all),
        b as (select a.l_orderkey, a.v as x, c.v as y from l a join l c using (l_orderkey) where a.side = 0 and c.side = 1 and len(a.v) = len(c.v)),
        p as (select l_orderkey, unnest(range(len(x))) as pos, unnest(x) as left_value, unnest(y) as right_value from b)
        select l_orderkey, pos, left_value, right_value, left_value <> right_value as drift from p""",
    "q47_slug_dedup": """
        with s as (select p_partkey, regexp_replace(regexp_replace(lower(replace(p_name, '''', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as base from part),
        n as (select *, row_number() over (partition by base order by p_partkey) as n from s)
        select p_partkey, case when n = 1 then base else base || '-' || n end as slug from n""",
    "q48_entity_carry": """
        select conv_id, turn, last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn) as topic from conversations""",
    "q51_incremental_ingest": "select user_id, count(*) as n, round(sum(value), 4) as total, max(event_id) as last_event from events group by user_id",
    "q52_ext_event_windows": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
}
