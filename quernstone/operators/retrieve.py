"""Retrieval: BM25, exact nearest neighbours, rank fusion, layer floor, chunking, expansion, weighted search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.text import latin_tokens
from . import names as name_search
from .ordered import keep_first, numbered, parts_of

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
QUERY_BLOCK = 2048
ROWS, PAIRS = 2048, 65_536  # how many rows meet a block of queries at once, and how many distances are worked out at once
TIE = 2e-6  # distances are rounded to six digits before ties are settled


def bm25(docs: DataFrame, queries: DataFrame, k: int = 15, tokens=latin_tokens) -> DataFrame:
    """``query_id, doc_id, score, rank``: the best ``k`` documents of each query.

    ``docs`` has ``doc_id, text``, ``queries`` has ``query_id, text``. A term
    in more than half of all documents weighs EPSILON of the mean weight. Only
    the query terms' postings are shuffled; statistics cover all documents.
    """
    words = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    df = words.select(F.explode(F.array_distinct("words")).alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))
    totals = words.agg(F.count_if(F.size("words") > 0).alias("n"), F.avg(F.when(F.size("words") > 0, F.size("words"))).alias("avgdl"))
    idf = df.join(F.broadcast(totals)).withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = idf.agg(F.avg("idf").alias("mean"))
    wanted = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("tok")).groupBy("query_id", "tok").agg(F.count("*").alias("qtf"))
    weights = idf.join(F.broadcast(mean)).join(wanted, "tok").withColumn("w", F.col("qtf") * F.when(F.col("idf") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf")))
    # A document is one row, so its words are counted after those that no query has are gone.
    postings = words.select("doc_id", F.size("words").alias("dl"), F.explode("words").alias("tok")).join(wanted.select("tok").distinct(), "tok", "left_semi")
    tf = postings.groupBy("doc_id", "dl", "tok").agg(F.count("*").alias("tf"))
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = tf.join(weights, "tok").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    return best(scores, ["query_id"], [F.desc("score"), "doc_id"], k)


def best(df: DataFrame, group: list[str], order: list[Column | str], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def _nearest_rows(batches: Iterator[pa.RecordBatch], ids: np.ndarray, matrix: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` nearest rows of all batches for each query, and those that tie with the last of them."""
    least = np.full(len(ids), np.inf)  # the distance of the k-th so far
    squares = np.square(matrix).sum(axis=1)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, row, distance = map(np.concatenate, zip(*held))
        by = np.lexsort((distance, query))
        query, row, distance = query[by], row[by], distance[by]
        first = np.searchsorted(query, np.arange(len(ids)))
        count = np.diff(np.append(first, len(query)))
        full = np.flatnonzero(count >= k)
        least[full] = np.minimum(least[full], distance[first[full] + k - 1])
        keep = distance <= least[query] + TIE
        return query[keep], row[keep], distance[keep]

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            rows = part.column(0).to_numpy(zero_copy_only=False)
            vectors = _matrix(part.column(1))
            about = squares[:, None] - 2 * matrix @ vectors.T + np.square(vectors).sum(axis=1)
            if len(rows) >= k:
                least = np.minimum(least, np.partition(about, k - 1, axis=1)[:, k - 1] + TIE)
            query, column = np.nonzero(about <= least[:, None] + TIE)
            # The product only chooses; the distance itself is worked out term by term.
            del about
            distance = np.empty(len(query))
            for i in range(0, len(query), PAIRS):
                some = slice(i, i + PAIRS)
                distance[some] = np.square(vectors[column[some]] - matrix[query[some]]).sum(axis=1)
            held.append((query, rows[column], distance))
            if sum(len(q) for q, *_ in held) > 4 * k * len(ids) + 65_536:
                held = [settled()]
    if held:
        query, row, distance = settled()
        yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(row), pa.array(distance)], ["query_id", "vec_id", "distance"])


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix, without a Python object for each number."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 30) -> DataFrame:
    """``query_id, vec_id, distance, rank``: exact nearest rows by squared Euclidean distance.

    Queries (``query_id, embedding``) are taken in blocks of QUERY_BLOCK, which
    bounds what a task holds; every task keeps the best ``k`` of its rows for
    each query, and only those are shuffled.
    """
    found = None
    count = queries.count()
    blocks = max(1, -(-count // QUERY_BLOCK))
    dealt = queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_block"))
    for block in range(blocks):
        own = dealt.where(F.col("_block") == block).select("query_id", "embedding").toArrow()
        if not own.num_rows:
            continue
        ids, matrix = own["query_id"].to_numpy(), _matrix(own["embedding"].combine_chunks())
        shared = rows.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from _nearest_rows(batches, *shared.value, k)

        part = rows.select("vec_id", "embedding").where("embedding is not null").mapInArrow(run, "query_id long, vec_id long, distance double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, distance double")
    return best(found.withColumn("distance", F.round("distance", 6)), ["query_id"], ["distance", "vec_id"], k)


def fuse(lists: list[DataFrame], k: int = RRF_K, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists ``query_id, doc_id, rank``; of equal scores the earlier list goes first."""
    both = None
    for i, ranked in enumerate(lists):
        part = ranked.select("query_id", "doc_id", "rank", F.lit(i).alias("list"))
        both = part if both is None else both.unionByName(part)
    scores = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("_first"))
    order = [F.desc("score"), "_first", "doc_id"]
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).drop("_first")
    return ranked.where(F.col("rank") <= top) if top else ranked


def layers(sources: DataFrame, exact: dict[str, str], prefixes: list[tuple[str, str]], default: str) -> DataFrame:
    """``layer`` of each source: by its whole name, else by the first matching prefix, else the default."""
    label = F.lit(None).cast("string")
    for name, layer in exact.items():
        label = F.coalesce(label, F.when(F.col("source") == name, layer))
    for prefix, layer in prefixes:
        label = F.coalesce(label, F.when(F.startswith("source", F.lit(prefix)), layer))
    return sources.withColumn("layer", F.coalesce(label, F.lit(default)))


def layer_floor(ranked: DataFrame, candidates: DataFrame, layer: str, top: int = 8, least: int = 2) -> DataFrame:
    """If none of a query's first ``top`` is of the layer, the tail gives way to its ``least`` nearest ones.

    ``ranked`` and ``candidates`` have ``query_id, doc_id, rank, layer``.
    """
    head = ranked.where(F.col("rank") <= top)
    has = head.groupBy("query_id").agg(F.count_if(F.col("layer") == layer).alias("_has"))
    missing = has.where("_has = 0").select("query_id")
    fresh = candidates.where(F.col("layer") == layer).join(missing, "query_id", "left_semi").join(head.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    chosen = best(fresh.withColumnRenamed("rank", "_near"), ["query_id"], ["_near", "doc_id"], least)
    room = chosen.groupBy("query_id").agg(F.count("*").alias("_room"))
    kept = head.join(room, "query_id", "left").where(F.col("rank") <= top - F.coalesce("_room", F.lit(0)))
    added = chosen.join(room, "query_id").withColumn("rank", (top - F.col("_room") + F.col("rank")).cast("int"))
    return kept.select("query_id", "doc_id", "layer", "rank").unionByName(added.select("query_id", "doc_id", "layer", "rank"))


def substring_matches(texts: DataFrame, names: DataFrame, reach: int = 3) -> DataFrame:
    """``id, name``: the names (of at least ``reach`` characters) that occur in each text (``id, text``), by one automaton over all of them."""
    told = names.where(F.length("name") >= reach).select("name", F.lit("").alias("value"))
    return name_search.mentions(texts, told, "id", "text", fold=False).select("id", "name").distinct()


def weighted_search(docs: DataFrame, terms: DataFrame, fields: dict[str, int], k: int = 10) -> DataFrame:
    """Documents by the summed weights of the fields that contain a term, the best ``k`` of each term.

    ``terms`` has ``term``, a short stated list.
    """
    score = sum((F.when(F.contains(F.lower(F.coalesce(name, F.lit(""))), F.col("term")), weight).otherwise(0) for name, weight in fields.items()), F.lit(0))
    scored = docs.join(F.broadcast(terms)).withColumn("score", score).where("score > 0")
    return best(scored, ["term"], [F.desc("score"), "doc_id"], k)


def cited(sources: DataFrame, answer: str, order: Sequence[str], key: Sequence[str], book: str = "book") -> DataFrame:
    """Sources of each answer without those that repeat a key (nulls are alike), numbered from 1 in the order of first mention; sources without a book are none."""
    named = sources.where(F.col(book).isNotNull() & (F.trim(F.col(book)) != ""))
    parts = parts_of(named)
    first = keep_first(named.repartition(parts, answer, *key), [answer, *key], order)
    return numbered(first.repartition(parts, answer), [answer], order, "n")


def context_of(rank: str) -> Column:
    """An aggregate: the passages (``book, page, tag, text``) of a group in the order of rank, each under its number, tag, book and page."""
    own = F.array_sort(F.collect_list(F.struct(rank, "book", "page", "tag", "text")))
    page = lambda x: F.when(x["page"].isNotNull(), F.concat(F.lit("第"), x["page"].cast("string"), F.lit("页"))).otherwise("")
    tag = lambda x: F.coalesce(F.concat(F.lit("·"), x["tag"]), F.lit(""))
    text = lambda x, i: F.concat(F.lit("【档案 "), (i + 1).cast("string"), tag(x), F.lit("】《"), x["book"], F.lit("》"), page(x), F.lit("\n"), F.coalesce(x["text"], F.lit("")))
    return F.array_join(F.transform(own, text), "\n\n" + "─" * 40 + "\n\n")


def context(passages: DataFrame, answer: str, rank: str) -> DataFrame:
    """``answer, context``: the passages (``book, page, tag, text``) of each answer in the order of rank, each under its number, tag, book and page."""
    return passages.groupBy(answer).agg(context_of(rank).alias("context"))
