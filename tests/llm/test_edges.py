"""Very long texts, columns whose names clash with what operators make, and many languages, for all of them."""

import hashlib
import random
import zlib

import corpus_pipeline
import public_tokenizers
import pytest

from quernstone.llm import bpe, decontaminate, exact_dedup, language_id, near_dedup, pii, sharding, substring_dedup, suffix_dedup, toxicity
from quernstone.llm.frames import keyed, repeatable, use_checkpoints

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
CLASHING = "_row score held_out lang_pred n_tokens predicted shard slot spans kept n_removed component_id keep_id h key found words true part w start".split()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    r = random.Random(12)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    long_ = prose(200_000)
    return {1: long_, 2: "a" * 300_000, 3: prose(100) + " jo.doe@mail.example.com " + long_[:600_000], 4: "7" * 200_000, 5: prose(50), 6: prose(50), 7: None, 8: ""}


@pytest.fixture(scope="module")
def docs(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges") / "documents.parquet")
    rows = [(i, t, "en" if i % 2 else "fr", "s", *(["x"] * len(CLASHING))) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHING)).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_dedup_of_long_texts(docs, texts):
    assert {i: r["text_sha256"] for i, r in by_id(exact_dedup.exact_dedup(docs)).items()} == {i: sha(t or "") for i, t in texts.items()}
    words = by_id(substring_dedup.substring_dedup(docs))
    assert words[1]["n_words"] == 200_000 and words[1]["n_removed"] == 0 and words[3]["n_removed"] > 80_000
    spans = by_id(suffix_dedup.suffix_dedup(docs))
    assert spans[1]["n_removed"] == 600_000 and spans[2]["n_removed"] == 300_000 and spans[4]["n_removed"] == 200_000 and spans[5]["n_removed"] == 0
    near = by_id(near_dedup.near_dedup(docs))
    assert near[1]["n_shingles"] == 199_996 and near[2]["n_shingles"] == 1 and near[7]["n_shingles"] == 0 and all(r["kept"] for r in near.values())


def test_reading_of_long_texts(spark, docs, texts):
    items = spark.createDataFrame([(1, " ".join(texts[1].split()[1000:1012]), "clash")], "item_id long, text string, words string")
    hit = by_id(decontaminate.decontaminate(docs, items))
    assert hit[1]["n_hit"] == 12 and hit[1]["n_words"] == 200_000 and not hit[5]["contaminated"]
    found = by_id(bpe.round_trip(docs, PATH, PATTERN))
    assert all(found[i]["decoded_sha256"] == sha(t or "") for i, t in texts.items()) and found[8]["n_tokens"] == 0
    report = by_id(pii.pii_report(docs))
    assert report[3]["n_email"] == 1 and report[1]["n_email"] == report[4]["n_card"] == 0
    placed = by_id(sharding.shard(docs, 2))
    assert all(r["size"] == len((texts[i] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((texts[i] or "").encode()) for i, r in placed.items())


def test_models_on_long_texts(spark, docs, texts):
    told = by_id(language_id.identify(docs))
    assert told[7]["lang_pred"] == told[8]["lang_pred"] == told[4]["lang_pred"] == "und" and told[1]["lang_pred"] in ("en", "fr")
    labels = spark.createDataFrame([(i, 1, i % 2, "x") for i in texts], "doc_id long, quality int, toxic int, score string")
    scored = by_id(toxicity.toxicity(docs, labels))
    assert set(scored) == set(texts) and all(0 <= r["score"] <= 1 for r in scored.values())


def test_many_languages(spark):
    r = random.Random(3)
    words = {f"l{k}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyzäöüñçß") for _ in range(4)) for _ in range(12)] for k in range(80)}
    rows = [(i, " ".join(r.choice(words[f"l{i % 80}"]) for _ in range(40)), f"l{i % 80}") for i in range(1600)]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    assert sum(x["lang_pred"] == f"l{x['doc_id'] % 80}" for x in found) > 0.97 * len(found) > 400


def test_stages_keep_clashing_columns(spark, docs, tmp_path):
    spark.createDataFrame([(1, "never seen in any document")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {r["_row"] for r in out.select("_row").collect()} <= {"x"}


def test_what_counts_as_repeatable(spark, docs):
    assert repeatable(docs.where("doc_id > 0")) and not repeatable(docs.repartition(3))
    made = spark.createDataFrame(docs.repartition(3).rdd, docs.schema)
    assert not repeatable(made) and repeatable(keyed(made))
    use_checkpoints(spark)
    assert spark.sparkContext.getCheckpointDir()
