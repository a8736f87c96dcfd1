"""Queries q19 to q28, q50 and q55: resolution, retrieval and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import ordered, resolve, retrieve
from ..sources.tables import table

WEIGHTS = {"title": 10, "source": 10, "lang": 3, "text": 2}


def q19_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names are unique, part names are not; names with a brand are, or are not, told by it."""
    customers, parts = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    canonical = customers.select((F.col("c_custkey") * 2).alias("entity_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("faction")).union(
        parts.select(F.col("p_partkey") * 2 + 1, "p_name", "p_brand")
    )
    names = (
        customers.select((F.col("c_custkey") * 4).alias("name_id"), F.upper("c_name").alias("name"))
        .union(parts.select(F.col("p_partkey") * 4 + 1, F.col("p_name")))
        .union(parts.select(F.col("p_partkey") * 4 + 2, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))))
        .union(customers.select(F.col("c_custkey") * 4 + 3, F.concat(F.lit("nick"), F.col("c_custkey").cast("string"))))
    )
    aliases = customers.where("c_custkey % 3 = 0").select(F.concat(F.lit("NICK"), F.col("c_custkey").cast("string")).alias("alias"), (F.col("c_custkey") * 2).alias("entity_id"))
    return resolve.resolve(names, canonical, aliases)


def q20_fuzzy_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name_id"), "p_brand", F.col("p_name").alias("name"))
    misspelt = parts.select("name_id", "p_brand", F.concat(F.substring("name", 1, 2), F.expr("substring(name, 4)")).alias("name"))
    return resolve.fuzzy(misspelt, parts, "p_brand")


def q55_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries, a book per brand: names of one entry or of several, a fifth of them misspelt."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(k, "p_brand", F.when(k % 3 == 0, F.concat("p_name", F.lit(" of "), k.cast("string"))).otherwise(F.col("p_name")).alias("name"))
    wrong = F.concat(F.substring("name", 1, 2), F.expr("substring(name, 4)"))
    entities = parts.select(k.alias("entity_id"), F.col("p_brand").alias("book"), F.when(k % 5 == 0, wrong).when(k % 7 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"))
    return resolve.pair(entities, parts.select(k.alias("canonical_id"), F.col("p_brand").alias("faction"), "name"))


def q21_query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with what the aliases in them stand for, in the order of the aliases."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("word")).distinct()
    curated = words.select(F.substring("word", 1, 3).alias("alias"), F.upper("word").alias("target"))
    literal = spark.createDataFrame([("the", "ARTICLE"), ("tion", "SUFFIX"), ("ing", "SUFFIX")], "alias string, target string")
    aliases = resolve.alias_map(literal, curated)
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lower("text").alias("text"))
    met = retrieve.substring_matches(texts, aliases.select(F.col("alias").alias("name"))).join(aliases, F.col("name") == F.col("alias"))
    found = met.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "target"))), lambda x: x["target"]), "；").alias("more"))
    expanded = F.when(F.col("more").isNotNull(), F.concat("text", F.lit("（"), "more", F.lit("）"))).otherwise(F.col("text"))
    return texts.join(found, "id", "left").select(F.col("id").alias("item_id"), expanded.alias("expanded"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def q22_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.nearest(*_vectors(spark, sf_dir), 30)
    return found.select("query_id", "vec_id", "distance", F.col("rank").cast("bigint").alias("rank"))


def q23_dense_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest 200, of which those of one label stay, the first 30 of them."""
    rows, queries = _vectors(spark, sf_dir)
    near = retrieve.nearest(rows, queries, 200).join(rows.select("vec_id", "label"), "vec_id").where("label % 3 = 1").drop("rank")
    return retrieve.best(near, ["query_id"], ["distance", "vec_id"], 30).select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")


def q24_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.bm25(table(spark, sf_dir, "documents"), _questions(spark, sf_dir), 15)
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


def _hybrid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Dense and sparse lists of one question; the link doc_id = vec_id is synthetic."""
    sparse = retrieve.bm25(table(spark, sf_dir, "documents"), _questions(spark, sf_dir), 15)
    dense = retrieve.nearest(*_vectors(spark, sf_dir), 30).withColumnRenamed("vec_id", "doc_id")
    return dense.join(_questions(spark, sf_dir).select("query_id"), "query_id", "left_semi"), sparse


def q25_rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense, sparse = _hybrid(spark, sf_dir)
    return retrieve.fuse([dense, sparse], top=8).select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


def q26_layer_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules passages are sought among rules passages only, so there are some however far down the whole table they rank."""
    dense, sparse = _hybrid(spark, sf_dir)
    source = retrieve.layers(table(spark, sf_dir, "documents").select("doc_id", "source"), {"src10": "faction"}, [("src19", "rules"), ("src2", "supplement")], "other").select("doc_id", "layer")
    ranked = retrieve.fuse([dense, sparse]).join(source, "doc_id")
    rows, queries = _vectors(spark, sf_dir)
    rules = rows.join(source.where("layer = 'rules'").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    # A passage that a head of 8 already has is not added: 8 more than the 2 wanted are enough.
    near = retrieve.nearest(rules, queries.join(_questions(spark, sf_dir).select("query_id"), "query_id", "left_semi"), 8 + 2).withColumnRenamed("vec_id", "doc_id").join(source, "doc_id")
    return retrieve.layer_floor(ranked, near, "rules").select("query_id", "doc_id", "layer", F.col("rank").cast("bigint").alias("rank"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))


def q27_heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under their heading; a line of fewer than 40 characters is one."""
    sections = ordered.under_headings(_lines(spark, sf_dir), ["doc_id"], ["line"], F.length("body") < 40)
    heading = F.max(F.when(F.length("body") < 40, F.col("body")))
    return sections.groupBy("doc_id", F.col("section").cast("bigint").alias("section")).agg(heading.alias("heading"), F.count("*").alias("n_lines"), F.sum(F.length("body")).cast("bigint").alias("n_chars"))


def q28_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed in order into chunks of at most 2000 characters, a longer line alone."""
    sizes = F.transform(F.split("text", "\n"), lambda x: F.length(x))
    packed = table(spark, sf_dir, "documents").select("doc_id", F.size(sizes).alias("lines"), ordered.bin_starts(sizes, 2000).alias("starts"))
    bins = packed.select("doc_id", "lines", "starts", F.posexplode("starts").alias("bin", "first_line"))
    upto = F.coalesce(F.get("starts", F.col("bin") + 1), F.col("lines"))
    return bins.select("doc_id", F.col("bin").cast("bigint").alias("bin"), (upto - F.col("first_line")).cast("bigint").alias("n_lines"), F.col("first_line").cast("bigint").alias("first_line"))


def q50_weighted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "source", "lang", "text")
    terms = spark.createDataFrame([("src7",), ("tion",), ("license",), ("fr",)], "term string")
    found = retrieve.weighted_search(docs, terms, WEIGHTS)
    return found.select("term", "doc_id", F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank"))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q") and name[1:3].isdigit()}

_NEAR = """
    q as (select vec_id as query_id, embedding as qe from embeddings where vec_id % 50 = 0),
    dist as (
        select query_id, vec_id, round(list_sum(list_transform(list_zip(embedding, qe), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))), 6) as distance
        from embeddings, q),
    near as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from dist)"""
_BM25 = """
    tk as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as tok from documents),
    dl as (select doc_id, count(*) as dl from tk group by 1),
    st as (select count(*) as n, avg(dl) as avgdl from dl),
    tf as (select doc_id, tok, count(*) as tf from tk group by all),
    df as (select tok, count(*) as df from tf group by 1),
    idf as (select tok, ln((n - df + 0.5) / (df + 0.5)) as idf, n, avgdl from df, st),
    qt as (select item_id as query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as tok from benchmark where item_id % 50 = 0),
    qf as (select query_id, tok, count(*) as qtf from qt group by all),
    w as (select query_id, tok, avgdl, qtf * case when idf < 0 then 0.25 * (select avg(idf) from idf) else idf end as w from qf join idf using (tok)),
    sc as (select query_id, doc_id, round(sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from tf join w using (tok) join dl using (doc_id) group by all),
    sparse as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc) where rank <= 15)"""
_FUSED = f"""
    {_NEAR}, {_BM25},
    dense as (select query_id, vec_id as doc_id, rank from near where rank <= 30 and query_id in (select item_id from benchmark where item_id % 50 = 0)),
    both_ as (select query_id, doc_id, rank, 0 as list from dense union all select query_id, doc_id, rank, 1 from sparse),
    fs as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) as score, min(list * 1000 + rank) as first from both_ group by all),
    fused as (select *, row_number() over (partition by query_id order by score desc, first, doc_id) as rank from fs)"""

ORACLE_SQL = {
    "q19_resolver": """
        with known as (select c_custkey * 2 as id, lower(trim(c_name)) as key, lower(trim(c_mktsegment)) as faction from customer union all select p_partkey * 2 + 1, lower(trim(p_name)), lower(trim(p_brand)) from part),
        names as (
            select c_custkey * 4 as name_id, lower(c_name) as key, null as base, null as of from customer
            union all select p_partkey * 4 + 1, lower(trim(p_name)), null, null from part
            union all select p_partkey * 4 + 2, lower(p_name || ' (' || p_brand || ')'), lower(trim(p_name)), lower(trim(p_brand)) from part
            union all select c_custkey * 4 + 3, 'nick' || c_custkey, null, null from customer),
        e as (select key, count(distinct id) as n, min(id) as id from known group by 1),
        f as (select key, faction, count(distinct id) as n, min(id) as id from known group by all),
        a as (select 'nick' || c_custkey as key, c_custkey * 2 as id from customer where c_custkey % 3 = 0),
        m as (
            select name_id, case when e.n = 1 then 'exact' when f.n = 1 then 'qualified' when e.n > 1 or f.n > 1 then 'ambiguous' when a.id is not null then 'alias' else 'none' end as how,
                   e.id as eid, f.id as fid, a.id as aid
            from names left join e using (key) left join f on f.key = base and f.faction = of left join a on a.key = names.key)
        select name_id, how, case how when 'exact' then eid when 'qualified' then fid when 'alias' then aid end as entity_id from m""",
    "q21_query_expansion": """
        with w as (select distinct unnest(string_split(lower(p_type), ' ')) as word from part),
        c as (select substr(word, 1, 3) as alias, min(upper(word)) as target from w group by 1),
        l as (select * from (values ('the', 'ARTICLE'), ('tion', 'SUFFIX'), ('ing', 'SUFFIX')) as t(alias, target)),
        al as (select * from l union all select * from c where alias not in (select alias from l)),
        t as (select item_id, lower(text) as text from benchmark),
        m as (select item_id, string_agg(target, '；' order by alias, target) as more from t join al on contains(text, alias) where length(alias) >= 3 group by 1)
        select item_id, text || case when more is null then '' else '（' || more || '）' end as expanded from t left join m using (item_id)""",
    "q22_dense_topk": f"with {_NEAR} select query_id, vec_id, distance, rank from near where rank <= 30",
    "q23_dense_postfilter": f"""
        with {_NEAR}, l as (select near.* from near join embeddings using (vec_id) where rank <= 200 and label % 3 = 1)
        select * from (select query_id, vec_id, row_number() over (partition by query_id order by distance, vec_id) as rank from l) where rank <= 30""",
    "q24_bm25_topk": f"with {_BM25} select query_id, doc_id, score, rank from sparse",
    "q25_rrf_hybrid": f"with {_FUSED} select query_id, doc_id, score, rank from fused where rank <= 8",
    "q26_layer_floor": f"""
        with {_FUSED},
        lay as (select doc_id, case when source = 'src10' then 'faction' when starts_with(source, 'src19') then 'rules' when starts_with(source, 'src2') then 'supplement' else 'other' end as layer from documents),
        rk as (select query_id, doc_id, layer, rank from fused join lay using (doc_id)),
        head as (select * from rk where rank <= 8),
        miss as (select query_id from head group by 1 having count(*) filter (where layer = 'rules') = 0),
        rules as (
            select query_id, vec_id, layer, row_number() over (partition by query_id order by distance, vec_id) as rank
            from dist join lay on lay.doc_id = dist.vec_id where layer = 'rules'),
        cand as (
            select query_id, vec_id as doc_id, layer, row_number() over (partition by query_id order by rank) as k
            from rules where rank <= 10 and query_id in (select query_id from miss)
              and not exists (select 1 from head where head.query_id = rules.query_id and head.doc_id = rules.vec_id)),
        add_ as (select * from cand where k <= 2),
        room as (select query_id, count(*) as room from add_ group by 1)
        select query_id, doc_id, layer, rank from head left join room using (query_id) where rank <= 8 - coalesce(room, 0)
        union all select query_id, doc_id, layer, cast(8 - room + k as bigint) from add_ join room using (query_id)""",
    "q27_heading_chunks": """
        with l as (select doc_id, unnest(string_split(text, chr(10))) as body, generate_subscripts(string_split(text, chr(10)), 1) as line from documents),
        s as (select *, sum(case when length(body) < 40 then 1 else 0 end) over (partition by doc_id order by line) as section from l)
        select doc_id, cast(section as bigint) as section, max(body) filter (where length(body) < 40) as heading, count(*) as n_lines, cast(sum(length(body)) as bigint) as n_chars from s group by doc_id, section""",
    "q28_bin_packing": """
        with recursive l as (select doc_id, string_split(text, chr(10)) as parts from documents where text is not null),
        r as (
            select doc_id, parts, 1 as line, cast(length(parts[1]) as bigint) as used, cast(0 as bigint) as bin from l
            union all
            select doc_id, parts, line + 1, case when used > 0 and used + length(parts[line + 1]) > 2000 then length(parts[line + 1]) else used + length(parts[line + 1]) end,
                   bin + case when used > 0 and used + length(parts[line + 1]) > 2000 then 1 else 0 end
            from r where line < len(parts))
        select doc_id, bin, count(*) as n_lines, cast(min(line) - 1 as bigint) as first_line from r group by doc_id, bin""",
    "q50_weighted_search": """
        with d as (select doc_id, string_split(text, chr(10))[1] as title, source, lang, text from documents),
        t as (select unnest(['src7', 'tion', 'license', 'fr']) as term),
        s as (
            select term, doc_id, cast(case when contains(lower(title), term) then 10 else 0 end + case when contains(lower(source), term) then 10 else 0 end
                   + case when contains(lower(lang), term) then 3 else 0 end + case when contains(lower(text), term) then 2 else 0 end as bigint) as score from d, t)
        select * from (select term, doc_id, score, row_number() over (partition by term order by score desc, doc_id) as rank from s where score > 0) where rank <= 10""",
}
