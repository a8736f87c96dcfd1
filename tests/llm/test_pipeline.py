"""Each stage against brute force on its own input."""

import tracemalloc
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quernstone.llm import language_id, near_dedup

from .test_dedup import brute_exact, brute_near
from .test_models import item_words


def test_stages(spark, docs, rows, tmp_path):
    sf = str(tmp_path)
    line = " ".join(rows[0][1].split()[:14])
    spark.createDataFrame([(1, line), (2, "never seen in any document")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in kept.collect()]
        out = stage(spark, kept, sf)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            out.write.parquet(f"{sf}/{k}")
            kept = spark.read.parquet(f"{sf}/{k}")
            found = Counter(r["text"] for r in kept.collect())
        if name == "language ID":
            assert found == Counter(r[1] for r in before if r[1] and any(c.isalpha() for c in r[1]))
        elif name == "exact dedup":
            assert found == Counter({t: 1 for t in {r[1] for r in before}})
            best = {r[1]: max((x[0] is not None, x[0] or 0) for x in before if x[1] == r[1]) for r in before}
            assert {(r["text"], r["doc_id"]) for r in kept.collect()} == {(t, i if known else None) for t, (known, i) in best.items()}
        elif name == "MinHash near-dedup":
            assert sum(found.values()) == sum(n for key, n in brute_near(before, 5, 80).items() if key[3])
        elif name == "benchmark decontamination":
            items = [tuple(item_words(line)[i : i + 10]) for i in range(5)]
            clean = [r[1] for r in before if not any(tuple(item_words(r[1])[i : i + 10]) in items for i in range(len(item_words(r[1]))))]
            assert found == Counter(clean) and len(clean) < len(before)
        else:
            expected = kept.select("doc_id", F.sha2("text", 256).alias("decoded_sha256"))
            assert Counter(map(tuple, out.select("doc_id", "decoded_sha256").collect())) == Counter(map(tuple, expected.collect()))
    assert brute_exact(rows)


def test_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert 100 < found.count() <= 200


class Taken:
    """Stands for a frame: keeps what would run in the Python workers."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run


def peak_mb(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def wide_batch(n=6000, width=300):
    values = np.random.default_rng(3).integers(0, 1 << 30, (n, width))
    ids = pa.array(range(n))
    return pa.RecordBatch.from_arrays([ids, ids, pa.array([" ".join(map(str, row)) for row in values.tolist()])], ["_row", "doc_id", "text"])


def test_signatures_hold_a_slice_of_a_batch():
    frame, batch = Taken(), wide_batch()
    near_dedup.signatures(frame, 5)

    def work():
        rows = 0
        for part in frame.run(iter([batch])):
            assert part.column(0).to_pylist() == list(range(rows, rows + part.num_rows))
            rows += part.num_rows
        assert rows == batch.num_rows

    list(frame.run(iter([batch.slice(0, 10)])))  # powers that are kept are not the batch's
    assert peak_mb(work) < 36
    whole = pa.Table.from_batches(frame.run(iter([batch.slice(0, 40)])))
    assert whole.equals(pa.Table.from_batches(p for i in range(40) for p in frame.run(iter([batch.slice(i, 1)]))).combine_chunks())


def test_letters_are_sought_in_one_text_at_a_time():
    texts = wide_batch().column(2)
    assert peak_mb(lambda: language_id._told(None, texts)) < 4


def test_workers_get_small_batches(spark, docs, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(corpus_pipeline, "BATCH_ROWS", 7)
    try:
        rows = corpus_pipeline.language(spark, docs.where("text is not null"), "").select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
        assert max(r.n for r in rows.collect()) <= 7
    finally:
        spark.conf.set(key, before)
