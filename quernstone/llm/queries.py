"""The contract queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, bpe, merkle, substring_dedup
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .language_id import identify
from .near_dedup import near_dedup
from .pii import pii_report
from .sharding import shard
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity
from .url_filter import RULES, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.substring_dedup(_table(spark, sf_dir, "documents")))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), width=4)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: The rules of op11.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, RULES))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a third of the texts is lower-cased after the proofs were made; a null doc_id has no digest, so its row stays as it is
    touched = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(touched, merkle.leaf(*[lower if f == "text" else F.col(f) for f in merkle.FIELDS]))
    proven = merkle.manifest(_table(spark, sf_dir, "documents"), more={"tampered": tampered})
    told = proven.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return told.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op13_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.cross_alignment(_table(spark, sf_dir, "documents"), *paths)


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_substring_dedup,
        op3_benchmark_decontamination,
        op4_byte_bpe,
        op5_suffix_dedup,
        op6_language_id,
        op7_near_dedup,
        op8_pii,
        op9_sharding,
        op10_toxicity,
        op11_url_filter,
        op12_merkle_manifest,
        op13_cross_alignment,
    )
}

ORACLE_SQL = {
    "op1_exact_dedup": """
        with d as (select doc_id, coalesce(text, '') as t from documents)
        select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
        from d""",
    "op2_substring_dedup": r"""
        with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        win as (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from w where len(w) >= 20)),
        dup as (select doc_id, i from (select doc_id, i, row_number() over (partition by h order by doc_id, i) as n from win) where n > 1),
        gone as (select doc_id, list(distinct p) as gone from (select doc_id, unnest(range(i, i + 20)) as p from dup) group by doc_id),
        each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from w),
        kept as (
            select doc_id, string_agg(word, ' ' order by p) as t, count(*) as n from each anti join (select doc_id, unnest(gone) as p from gone) using (doc_id, p) group by doc_id)
        select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
        from w left join kept using (doc_id)""",
    "op3_benchmark_decontamination": r"""
        with dw as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        bw as (
            select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        bs as (select item_id, w, least(len(w), 10) as k, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from bw where len(w) > 0),
        win as (select distinct k, array_to_string(w[i:i + k - 1], ' ') as s, cast(item_id as varchar) as item_id from bs),
        ks as (select distinct k from win),
        ds as (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from dw, ks where len(w) >= k),
        dwin as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as s from ds),
        hits as (select doc_id, i, k, item_id from dwin join win using (k, s)),
        pos as (select distinct doc_id, unnest(range(i, i + k)) as p from hits),
        np as (select doc_id, count(*) as n_hit from pos group by doc_id),
        it as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hits group by doc_id)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from dw left join np using (doc_id) left join it using (doc_id)""",
    "op11_url_filter": r"""
        with rules(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        u as (
            select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path, row_number() over () as k from pages),
        fit as (select k, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v from u join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by k)
        select page_id, host, path, rule, coalesce(v, 'allow') as verdict from u left join fit using (k)""",
    "op12_merkle_manifest": r"""
        with recursive bits as (
            select i, i as c, 0 as k from range(256) t(i)
            union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
        crc as (select list(c order by i) as t from bits where k = 8),
        d as (
            select doc_id, lang, text, source, n_chars,
                   xor(list_reduce(list_transform(range(1, length(doc_id::varchar) + 1), lambda j: ord(substr(doc_id::varchar, j, 1))::bigint), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295), 4294967295) as sum
            from documents, crc),
        own as (
            select *, concat(coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                   coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-')) as head from d),
        low as (select *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_text from own),
        leaves as (
            select doc_id, lang, sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) as leaf,
                   case when sum % 3 = 0 then sha256(concat(head, coalesce(strlen(lower_text) || ':' || lower_text, '-'))) end as tampered from low),
        pos as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i from leaves),
        tree as (
            select lang, 0 as lv, list(leaf order by i) as l from pos group by lang
            union all
            select lang, lv + 1, list_transform(range(0, (len(l) + 7) // 8), lambda j: sha256(array_to_string(l[8 * j + 1:8 * j + 8], ''))) from tree where len(l) > 1),
        sub as (select lang, l[1] as subroot, max_lv from (select lang, l, lv as max_lv from tree where len(l) = 1)),
        subs as (select *, row_number() over (order by lang nulls first) - 1 as g from sub),
        top as (
            select 0 as lv, list(subroot order by g) as l from subs
            union all
            select lv + 1, list_transform(range(0, (len(l) + 7) // 8), lambda j: sha256(array_to_string(l[8 * j + 1:8 * j + 8], ''))) from top where len(l) > 1),
        rt as (select l[1] as root from top where len(l) = 1),
        steps as (
            select doc_id, leaf, coalesce(tampered, leaf) as start, subroot, max_lv, i, g, pos.lang from pos join subs on pos.lang is not distinct from subs.lang),
        fold as (
            select doc_id, leaf, subroot, max_lv, i as p, g, lang, start as node, '' as proof, 0 as lv, 0 as stage from steps
            union all
            select doc_id, leaf, subroot, max_lv,
                   case when stage = 0 and lv = max_lv then g else p // 8 end, g, lang,
                   case when stage = 0 and lv = max_lv then node else sha256(array_to_string(list_concat(list_concat(r[1:p % 8], [node]), r[p % 8 + 2:8]), '')) end,
                   case when stage = 0 and lv = max_lv then proof else proof || array_to_string(list_concat(r[1:p % 8], r[p % 8 + 2:8]), '') end,
                   case when stage = 0 and lv = max_lv then 0 else lv + 1 end,
                   case when stage = 0 and lv = max_lv then 1 else stage end
            from (
                select f.*, case when stage = 0 then t.l[8 * (p // 8) + 1:8 * (p // 8) + 8] else u.l[8 * (p // 8) + 1:8 * (p // 8) + 8] end as r, len(u.l) as wide
                from fold f left join tree t on t.lang is not distinct from f.lang and t.lv = f.lv and f.stage = 0 left join top u on u.lv = f.lv and f.stage = 1)
            where stage = 0 or wide > 1)
        select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, node as folded_root, node = root as verified
        from fold join top using (lv) cross join rt where stage = 1 and len(top.l) = 1""",
    "op9_sharding": r"""
        with recursive bits as (
            select i, i as c, 0 as k from range(256) t(i)
            union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
        crc as (select list(c order by i) as t from bits where k = 8),
        b as (select *, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint) as bytes from documents),
        d as (
            select doc_id, cast(strlen(coalesce(text, '')) + 1 as bigint) as size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::bigint as key,
                   xor(case when len(bytes) = 0 then 4294967295 else list_reduce(bytes, lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295) end, 4294967295) as text_crc32
            from b, crc),
        r as (
            select *, sum(size) over (order by key, doc_id rows unbounded preceding) as upto, sum(size) over () as total,
                   row_number() over (order by key, doc_id) - 1 as idx from d),
        g as (select *, min(upto - size) over (partition by key) as lo, max(upto) over (partition by key) as hi from r),
        s as (
            select *, cast(least(7, floor((case when hi - lo <= 0.005 * total / 8.0 then (lo + hi) / 2.0 else upto - size / 2.0 end) / (total / 8.0))) as integer) as shard from g)
        select doc_id, size, text_crc32, 'bytes' as law, shard, cast(idx - min(idx) over (partition by shard) as bigint) as slot, cast(null as integer) as grown_shard from s""",
}
