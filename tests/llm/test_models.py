"""Tokens, language ID, PII, toxicity, decontamination and sharding against brute force and held-out accuracy."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quernstone.llm import bpe, decontaminate, language_id, pii, sharding, toxicity

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def reference_encoder():
    import base64

    import tiktoken

    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(docs, rows, reference_encoder):
    found = Counter(tuple(r) for r in bpe.round_trip(docs, PATH, PATTERN).collect())
    expected = Counter()
    for r in rows:
        ids = reference_encoder.encode_ordinary(r[1] or "")
        expected[r[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(r[1] or "")] += 1
    assert found == expected


def test_bpe_encode_and_decode(docs, rows):
    tokens = bpe.encode(docs, PATH, PATTERN)
    assert Counter(r["text"] for r in bpe.decode(tokens, PATH, PATTERN).collect()) == Counter(r[1] or "" for r in rows)
    own = bpe.codec(PATH, PATTERN)
    for r in tokens.collect():
        assert len(r["ids"]) == len(r["starts"]) and sorted(r["starts"]) == r["starts"]
    text = "naïve 日本🙂 x"
    ids = np.frombuffer(own.encode(text), "<u4")
    for i, start in zip(ids, own.offsets(text, ids)):
        assert text[start:].encode().startswith(own.token_bytes[i]) or own.token_bytes[i][0] & 0xC0 == 0x80


def test_bpe_decodes_broken_ids(spark):
    own = bpe.codec(PATH, PATTERN)
    ids = np.frombuffer(own.encode("🙂"), "<u4").tolist()
    broken = spark.createDataFrame([(1, ids[:-1]), (2, None), (3, ids)], "doc_id long, ids array<int>")
    found = dict(bpe.decode(broken, PATH, PATTERN).collect())
    assert found[2] == "" and found[3] == "🙂" and (len(ids) == 1 or "�" in found[1])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "aa", "ens", "en", "sen", " ", "  ", "\n", "\t", ".", "..", "...", "0", "00", "'s", "'re", "é", "日本", "🙂", "~", "--", "!", "??", " ", "̀", "stones", "tones"]), max_size=25).map("".join))
def test_bpe_is_exact(reference_encoder, text):
    ids = bpe.codec(PATH, PATTERN).encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == reference_encoder.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_bpe_any_text(reference_encoder, text):
    own = bpe.codec(PATH, PATTERN)
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == reference_encoder.encode_ordinary(text) and own.decode(ids).decode() == text


def test_bpe_of_long_pieces(reference_encoder):
    own = bpe.codec(PATH, PATTERN)
    for text in ("a" * 200_000, "0" * 200_000, "ab" * 100_000, "ens" * 50_000, "日本" * 30_000):
        began = time.time()
        assert np.frombuffer(own.encode(text), "<u4").tolist() == reference_encoder.encode_ordinary(text)
        assert time.time() - began < 60 and not any(len(p) > bpe.LONGEST_KEPT for p in own.kept)


def brute_code_lengths(train, text, order=3):
    """Bits of the text in each language, straight from the definition; contexts are not pruned."""
    used = sorted({b for t in train.values() for x in t for b in x} | {0})
    out = {}
    for lang, texts in train.items():
        counts = {}
        for t in texts:
            padded = b"\0" * order + t
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    counts.setdefault(padded[i - k : i], Counter())[padded[i]] += 1
        met = {padded[i - k : i] for texts2 in train.values() for t in texts2 for padded in [b"\0" * order + t] for i in range(order, len(padded)) for k in range(order + 1)}

        def p(context, byte, without):
            if context is None:
                return 1 / (256 - len(without))
            if context not in met or context not in counts:
                return p(context[1:] if context else None, byte, without)
            own = {b: n for b, n in counts[context].items()}
            total, kinds = sum(own.values()), len(own)
            visible = {b: n for b, n in own.items() if b not in without}
            # Exclusion renormalises the whole mixed distribution outside ``without``.
            if not without:
                if byte in own:
                    return own[byte] / (total + kinds)
                return kinds / (total + kinds) * p(context[1:] if context else None, byte, frozenset(own))
            def mixed(b):
                return own[b] / (total + kinds) if b in own else kinds / (total + kinds) * p(context[1:] if context else None, b, frozenset(own))
            return mixed(byte) / (1 - sum(mixed(b) for b in without))

        padded = b"\0" * order + text
        out[lang] = -sum(np.log2(p(padded[i - order : i], padded[i], frozenset())) for i in range(order, len(padded)))
    assert used
    return out


def test_ppm_code_lengths(spark):
    train = {"aa": [b"abcab", b"abd"], "bb": [b"xyzzy", b"bad cab"]}
    rows = [(i, t.decode(), lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in train.items() for t in ts)]
    trees = language_id.grow_trees(language_id.count_contexts(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    for text in (b"abcab", b"cab", b"zebra!", b"a"):
        found = trees.lengths(np.frombuffer(text, np.uint8), np.array([0, len(text)])) / language_id.UNIT
        expected = brute_code_lengths(train, text)
        assert found[0] == pytest.approx([expected[x] for x in trees.langs], abs=0.05)


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = np.mean([r["lang_pred"] == r["lang"] for r in found])
    assert len(found) > 250 and right > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_id_cases(docs, rows, empty):
    found = language_id.identify(docs).collect()
    assert len(found) == len(rows)
    from zlib import crc32

    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 3 == 1)
    letters = Counter((r[0], bool(r[1]) and any(c.isalpha() for c in r[1])) for r in rows)
    assert Counter((r["doc_id"], r["lang_pred"] != "und") for r in found) == letters
    assert language_id.identify(empty).count() == 0


def test_language_id_keeps_the_contexts_of_a_small_language(spark):
    """Two languages, each learned from 0.1 % of the rows, that only contexts of two bytes tell apart, beside one of very many contexts."""
    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    large = [(3 * i, " ".join("".join(r.choice(letters) for _ in range(6)) for _ in range(400)), "zz") for i in range(2000)]
    word = {"ca": ("AXW", "BXV"), "es": ("AXV", "BXW")}
    small = [(100_000 + i, " ".join(r.choice(word[lang]) for _ in range(30)), lang) for i in range(24) for lang in [("ca", "es")[i % 2]]]
    docs = spark.createDataFrame(large + small, "doc_id long, text string, lang string")
    trees = language_id.learn(docs, docs["doc_id"] < 100_004)
    told = language_id.predict(docs.where("doc_id >= 100004"), trees, "doc_id", "lang").collect()
    assert len(told) == 20 and all(x["lang_pred"] == x["lang"] for x in told)
    seen = sum(len(np.unique(tree.seen[3])) for tree in trees.trees)
    assert seen == language_id.count_contexts(docs.where("doc_id < 100004")).count() > 100_000


def brute_base(text):
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(re.sub("[^0-9]", "", v)) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(re.sub("[^0-9]", "", v)[::-1])) % 10 == 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(re.sub("[^0-9]", "", v)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (_, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text) if ok(m.group()))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", "x@y", ".com", "x@y.z", " ", "é", "+1 ", "1", "255", ".", "256", "10.0.0.1", "4111111111111111", "4111 1111-1111 1111", "+1 (988) 555-2485", "-", "(", "%", "@@", "٠"]), max_size=14).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_base(text)


def test_pii_report(spark):
    r = random.Random(3)
    noise = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(300)]
    prose = lambda n: " ".join(r.choice(noise) for _ in range(n))
    rows = [(i, f"{prose(20)} secretname jo.doe@mail.example.com {prose(20)} the") for i in range(6)]
    rows += [(10 + i, f"{prose(30)} the {prose(5)}") for i in range(60)]
    rows += [(90, f"the 4111 1111 1111 1111 the +1 (988) 555-2485"), (91, None), (92, ""), (92, "10.0.0.1"), (None, "10.0.0.300")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.pii_report(docs).collect()
    assert len(found) == len(rows)
    for row, text in [(x, t) for x in found for i, t in rows if i == x["doc_id"] and i != 92]:
        spans = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_base(text or ""))
        assert row["base_sha256"] == sha(spans) and row["n_email"] == spans.count("email:")
        terms = [text[int(a) : int(b)] for kind, a, b in (x.split(":") for x in row["spans"].split(",") if x) if kind == "term"]
        assert terms == (["secretname"] if row["doc_id"] in range(6) else [])
    clean = dict(pii.sanitise(docs).where("doc_id < 6 or doc_id = 91").collect())
    assert clean[91] is None and "jo.doe" not in clean[0] and "[EMAIL]" in clean[0] and "[TERM]" in clean[0]
    assert "secretname" not in dict(pii.sanitise(docs, remove=True).where("doc_id < 6").collect())[3]


def test_pii_terms_of_two_documents(spark):
    rows = [(i, f"written by ownername jo.doe@mail.example.com on day {i}") for i in range(2)] + [(2, "solitary +1 (988) 555-2485")]
    rows += [(10 + i, f"written by somebody on day {i}") for i in range(60)]
    found = dict(pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found[0] == "written by [TERM] [EMAIL] on day 0" and found[1] == "written by [TERM] [EMAIL] on day 1"
    assert found[2] == "solitary [PHONE]"


def test_pii_reach_is_whole_words():
    filler = "7" * 300
    text = " ".join(["outside", "reached", *[filler] * 7, "jo.doe@mail.example.com", *[filler] * 7, "wholeword" + "z" * 3000, "beyond"])
    assert dict(pii._near(text, pii.base_spans(text), 8)) == {"email:jo.doe@mail.example.com": {"reached", "wholeword" + "z" * 3000}}


def test_base_spans_of_long_texts():
    assert pii.base_spans("x 1.2.3." + "0" * 5000 + "1 y") == [(2, 1, 5009)]
    assert pii.base_spans("x 1.2.3." + "9" * 5000 + " y") == []
    began = time.time()
    for text in ("1" * 1_000_000, "1." * 200_000, "+1(" * 200_000, "a@" * 200_000, "1 " * 200_000):
        assert not [k for _, k, _ in pii.base_spans(text) if k != 1]
    assert time.time() - began < 20


def test_terms_beside_many_spans(spark):
    """A term that touches a base span is left out, however many spans there are."""
    text = " ".join(f"secretname x{i}@secretname.com" for i in range(300))
    rows = [(i, text) for i in range(2)] + [(10 + i, "nothing here") for i in range(60)]
    spans = pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 0").first()["spans"].split(",")
    terms = [x for x in spans if x.startswith("term")]
    assert len(terms) == 300 and all(text[int(a) : int(b)] == "secretname" and text[int(b)] == " " for a, b in (x.split(":")[1:] for x in terms))


def test_pii_disclosure_is_that_of_its_definition(spark):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    people = [f"p{i}@mail.example.com" for i in range(6)]
    texts = [" ".join([*(r.choice(vocab) for _ in range(12)), *([r.choice(people), vocab[0]] if r.random() < 0.4 else []), *(r.choice(vocab) for _ in range(6))]) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    n, near, ne, nt = len(texts), Counter(), Counter(), Counter()
    for t in texts:
        words = t.split()
        nt.update({w for w in re.findall(r"[^\W\d_]{3,}", t.lower())})
        for p in set(people) & set(words):
            at = words.index(p)
            ne[p] += 1
            near.update({(p, w) for w in words[max(0, at - 8) : at] + words[at + 1 : at + 9]})
    expected = {("email:" + p, w) for (p, w), k in near.items() if k >= 2 and np.log2(n * k / (ne[p] * nt[w])) / np.log2(n / ne[p]) >= 0.3}
    holders = docs.where("text like '%@%'")
    found = {(x["entity"], x["term"]) for x in pii.revealing_terms(docs, holders, disclosure=0.3).collect()}
    assert found == expected and expected


def test_pii_empty(empty):
    assert pii.pii_report(empty).count() == 0


def toxic_rows(n=900, seed=1):
    """Half of the labelled toxic texts name one group, which clean texts seldom do: a biased sample."""
    r = random.Random(seed)
    noise = ["n" + "".join(r.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(noise) for _ in range(r.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["vilefoo", "vilebar", "grimword"]))
        if r.random() < (0.7 if toxic else 0.02):
            words.append("muslims")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([*rows, (None, None), (9999, ""), (9998, "neutral words on muslims"), (9997, "vilefoo")], "doc_id long, text string")
    labelled = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    truth = {i: t for i, _, t in labels}
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, labelled).collect()}
    assert len(found) == len(rows) + 4
    out = [(found[i]["predicted"], truth[i]) for i in truth if found[i]["held_out"]]
    assert np.mean([a == b for a, b in out]) > 0.97
    assert found[9999]["predicted"] == 0 and found[9997]["predicted"] == 1
    biased = {r["doc_id"]: r for r in toxicity.toxicity(docs, labelled, fairness=0.0).collect()}
    gap = lambda f: abs(f[9998]["score"] - f[9999]["score"])
    assert gap(found) < 0.5 * gap(biased) and found[9998]["predicted"] == 0


def test_toxicity_on_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hit = sum(r[0] and r[1] for r in found)
    assert hit / max(1, sum(r[1] for r in found)) > 0.9 and hit / max(1, sum(r[0] for r in found)) > 0.9


def test_exchanges_act_on_the_given_tables(spark):
    """Content words only are exchanged; with the penalty their weights lie closer, and held-out hits are no fewer."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2
    rows = toxicity._training_rows(docs, labels, ~out, toxicity.MAX_ROWS).cache()
    n = rows.count()
    _, content, others = toxicity.choose(rows)
    learned = toxicity.exchangeable(rows, content, others)
    texts = [set(toxicity._WORD.findall((r["text"] or "").lower())) for r in rows.collect()]
    assert learned and all(len(x) > 1 and sum(w in t for t in texts) <= toxicity.COMMON * n for x in learned for w in x)
    fair, plain = toxicity.fit(rows), toxicity.fit(rows, fairness=0.0)
    spread = lambda model: np.mean([np.std([model.weight[w] for w in own]) for own in learned])
    assert spread(fair) < 0.8 * spread(plain)
    toxic = labels.where(out & (F.col("toxic") == 1)).select("doc_id").distinct()
    hits = lambda model: toxicity.score(docs.join(toxic, "doc_id", "left_semi"), model, "doc_id").where(F.col("score") >= toxicity.THRESHOLD).count()
    assert hits(fair) >= hits(plain) > 100


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=8), min_size=1, max_size=12), st.text("ab", min_size=1, max_size=8))
def test_exchanges_change_the_features(words, into):
    words = set(words)
    out = min(words)
    if out != into:
        stems = Counter(w[:n] for w in words for n in toxicity.PREFIXES if len(w) > n)
        before, after = toxicity.features(" ".join(words)), toxicity.features(" ".join(words - {out} | {into}))
        assert toxicity.exchange(words, stems, out, into) == (before - after, after - before)


def test_exchangeable_words_are_those_of_like_contexts(spark):
    r = random.Random(2)
    rows = [(f"the {r.choice(['cats', 'dogs'])} like {r.choice(['milk', 'meat'])}", 0) for _ in range(200)]
    found = toxicity.exchangeable(spark.createDataFrame(rows, "text string, toxic int"), ["the", "cats", "dogs", "like", "milk", "meat"])
    assert {frozenset(x) for x in found} == {frozenset(["cats", "dogs"]), frozenset(["milk", "meat"])}


def test_descent_reaches_the_optimum():
    """Against gradient steps on dense matrices that are many times as many."""
    r = np.random.default_rng(4)
    x = (r.random((200, 6)) < 0.4).astype(float)
    label = (x[:, 0] + 0.3 * x[:, 1] + r.random(200) > 1.1).astype(float)
    swaps = [([1], [2], 30), ([3], [4], 10), ([0], [], 1)]
    pairs, times = np.array([[0, 1, -1, 0, 0, 0], [0, 0, 0, 1, -1, 0], [1, 0, 0, 0, 0, 0]], float), np.array([30, 10, 1]) / 41

    def loss(w, b):
        z = x @ w + b
        return np.mean(np.logaddexp(0, z) - label * z) + toxicity.RIDGE / 2 * w @ w + np.sum(times * (pairs @ w) ** 2)

    w, b = np.zeros(6), 0.0
    for _ in range(30_000):
        error = (1 / (1 + np.exp(-(x @ w + b))) - label) / 200
        w, b = w - 0.3 * (x.T @ error + toxicity.RIDGE * w + 2 * pairs.T @ (times * (pairs @ w))), b - 0.3 * error.sum()
    own = toxicity.descend([np.flatnonzero(row).tolist() for row in x], label, swaps, 6, 1.0)
    assert loss(*own) < loss(w, b) + 2e-3
    assert abs(own[0][1] - own[0][2]) < 0.1 * abs(toxicity.descend([np.flatnonzero(row).tolist() for row in x], label, swaps, 6, 0.0)[0][1])


def test_toxicity_of_repeated_rows(spark):
    """A labelled id with many texts gives one row to learn from, and clashing columns do no harm."""
    rows, labels = toxic_rows(200)
    docs = spark.createDataFrame([(*x, 0.5, True) for x in rows + [(5, f"again {i}") for i in range(300)]], "doc_id long, text string, score double, held_out boolean")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity._training_rows(docs, labelled, F.lit(True), 150).count() == 150
    found = toxicity.toxicity(docs, labelled)
    assert found.count() == 500 and found.columns == ["doc_id", "held_out", "score", "predicted"]


def test_toxicity_without_labels(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(empty, none).count() == 0


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def test_decontamination(spark, docs, rows):
    long_text = rows[0][1]
    items = [(1, " ".join(long_text.split()[:14]).upper()), (2, "two words"), (10, rows[3][1]), (11, rows[3][1]), (4, None), (5, "..."), (None, "one"), (6, "never seen here at all in any of the given documents today")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = Counter()
    for r in rows:
        w, hit, ids = item_words(r[1]), set(), set()
        for item, text in items:
            q = item_words(text)
            k = min(10, len(q))
            for s in {tuple(q[i : i + k]) for i in range(len(q) - k + 1)} if q else ():
                for i in range(len(w) - k + 1):
                    if tuple(w[i : i + k]) == s:
                        hit.update(range(i, i + k))
                        ids |= {str(item)} if item is not None else set()
        expected[r[0], len(w), len(hit), len(ids), ",".join(sorted(ids)), bool(hit)] += 1
    found = decontaminate.decontaminate(docs, benchmark)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["item_ids"]), r["contaminated"]) for r in found.collect()) == expected
    joined = decontaminate.contamination(decontaminate.keyed(docs), benchmark, broadcast_bytes=0)
    assert joined.where("size(hit) > 0").count() == sum(n for k, n in expected.items() if k[5])
    left = decontaminate.remove_hit_documents(docs, benchmark)
    assert left.columns == docs.columns and left.count() == sum(n for k, n in expected.items() if not k[5])
    spans = Counter((r[0], len(item_words(r[1]))) for r in decontaminate.remove_hit_spans(docs, benchmark).collect())
    assert spans == sum((Counter({(k[0], k[1] - k[2]): n}) for k, n in expected.items()), Counter())
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).where("contaminated").count() == 0


def check_shards(found, rows, shards, slack):
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    sizes = Counter()
    for s in range(shards):
        own = [r for r in found if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        sizes[s] = sum(r["size"] for r in own)
    total = sum(sizes.values())
    largest = max(r["size"] for r in found)
    assert all(abs(v - total / shards) <= largest + slack * total / shards for v in sizes.values())


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding(docs, rows, shards):
    import zlib

    found = sharding.shard(docs, shards).collect()
    check_shards(found, rows, shards, sharding.SLACK)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)


def test_sharding_divides_a_hot_group(spark):
    rows = [(i, "same text") for i in range(3000)] + [(3000 + i, f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.shard(docs, 8, least_ranges=16).collect()
    check_shards(found, rows, 8, sharding.SLACK)
    assert len({r["shard"] for r in found if r["size"] == 10}) > 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-3, 3)] * 3), max_size=40), st.lists(st.tuples(*[st.integers(-3, 3)] * 3), max_size=12))
def test_sharding_ranks(rows, splitters):
    splitters = sorted(set(splitters))
    if rows and splitters:
        found = sharding.ranks([np.array(c) for c in zip(*rows)], [np.array(c) for c in zip(*splitters)])
        assert found.tolist() == [sum(s <= r for s in splitters) for r in rows]


def test_sharding_divides_overfull_ranges(docs, rows):
    found = sharding.shard(docs, 8, range_bytes=2000, least_ranges=2).collect()
    check_shards(found, rows, 8, sharding.SLACK)


def test_sharding_empty(empty):
    assert sharding.shard(empty).count() == 0


def test_op9_sql(spark):
    import duckdb

    from quernstone.llm import queries

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    cursor = con.execute(queries.ORACLE_SQL["op9_sharding"])
    names = [d[0] for d in cursor.description]
    expected = Counter(tuple(r[names.index(c)] for c in ("doc_id", "size", "text_crc32", "shard", "slot")) for r in cursor.fetchall())
    found = queries.QUERIES["op9_sharding"](spark, "/root/testdata/sf0.001")
    assert Counter(tuple(r) for r in found.select("doc_id", "size", "text_crc32", "shard", "slot").collect()) == expected
