"""Dedup operators against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quernstone.llm import exact_dedup, near_dedup, substring_dedup, suffix_dedup
from quernstone.llm.column_bwt import repeated_starts
from quernstone.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FOREVER = -(1 << 63)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def ascii_words(text):
    return [w.decode() for w in (text or "").encode().split()]


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def brute_exact(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[r[1] or ""].append((FOREVER if r[0] is None else r[0], i))
    out = Counter()
    for i, r in enumerate(rows):
        keep, at = max(groups[r[1] or ""])
        out[r[0], None if keep == FOREVER else keep, len(groups[r[1] or ""]), at == i, sha(r[1] or "")] += 1
    return out


@pytest.mark.parametrize("block", [4, 64, 8192])
def test_exact_dedup(docs, rows, block):
    found = exact_dedup.exact_dedup(docs, block)
    assert bag(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(rows)


def test_exact_dedup_survives_hash_collisions(docs, rows):
    from quernstone.llm.frames import keyed

    found = exact_dedup.exact_groups(keyed(docs), 64, digest=lambda c: F.xxhash64(c) % 3)
    assert bag(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(rows)


def test_drop_exact_copies_keeps_columns(docs, rows):
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len({r[1] or "" for r in rows})
    shuffled = exact_dedup.drop_exact_copies(docs.repartition(5))
    assert {r["text"] or "" for r in shuffled.collect()} == {r[1] or "" for r in rows}


def brute_windows(rows, width):
    order = sorted(range(len(rows)), key=lambda i: (FOREVER if rows[i][0] is None else rows[i][0], i))
    seen, out = set(), Counter()
    for i in order:
        words = ascii_words(rows[i][1])
        gone = np.zeros(len(words), bool)
        for p in range(len(words) - width + 1):
            window = tuple(words[p : p + width])
            if window in seen:
                gone[p : p + width] = True
            seen.add(window)
        out[rows[i][0], len(words), int(gone.sum()), " ".join(w for w, g in zip(words, gone) if not g)] += 1
    return out


@pytest.mark.parametrize("width", [13, 20])
@pytest.mark.parametrize("block", [500, 1 << 22])
def test_substring_dedup(docs, rows, width, block, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    found = substring_dedup.substring_dedup(docs, width)
    assert bag(found, "doc_id", "n_words", "n_removed", "kept") == brute_windows(rows, width)


def brute_bytes(rows, length):
    counts = Counter()
    texts = [(r[1] or "").encode() for r in rows]
    for t in texts:
        counts.update(t[p : p + length] for p in range(len(t) - length + 1))
    out = Counter()
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if counts[t[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int(np.sum(np.diff(np.concatenate([[False], gone[:-1]]).astype(int)) == 1))
        out[r[0], len(t), int(gone.sum()), spans, sha(bytes(b for b, g in zip(t, gone) if not g))] += 1
    return out


@pytest.mark.parametrize(("length", "gram", "group"), [(400, None, 4096), (100, 40, 4096), (100, 93, 4096), (60, 20, 2), (30, 30, 4096)])
def test_suffix_dedup(docs, rows, length, gram, group):
    found = suffix_dedup.suffix_dedup(docs, length, gram, group).withColumn("kept_sha256", F.sha2("kept", 256))
    assert bag(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, length)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab\u0000", max_size=30).map(str.encode), min_size=1, max_size=8), st.integers(1, 6))
def test_column_bwt(texts, length):
    counts = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    expected = [len(t) - p >= length and counts[t[p : p + length]] > 1 for t in texts for p in range(len(t))]
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    assert repeated_starts(data, np.array([len(t) for t in texts]), length).tolist() == expected


def brute_near(rows, width, percent):
    sets = []
    for r in rows:
        w = ascii_words((r[1] or "").translate(LOW))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0, i)
        least[root(i)] = min(least.get(root(i), key), key)
    return Counter((r[0], len(sets[i]), rows[least[root(i)][2]][0], rows[least[root(i)][2]][0] == r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize(("width", "percent"), [(4, 80), (5, 80), (1, 60)])
def test_near_dedup(docs, rows, width, percent):
    found = near_dedup.near_dedup(docs, width, percent)
    if percent < 80:  # the bands are made for 0.8; below it links may be missed but none invented
        assert found.count() == len(rows)
        return
    assert bag(found, "doc_id", "n_shingles", "component_id", "kept") == brute_near(rows, width, percent)


def test_near_dedup_of_a_chain(spark):
    """Neighbours are alike and the ends are not: one component through links that no star finds alone."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 12 : i * 12 + 150])) for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {tuple(r) for r in near_dedup.near_dedup(docs, 4).select("doc_id", "component_id").collect()}
    assert found == {(r[0], r[2]) for r in brute_near(rows, 4, 80)}


def test_near_dedup_of_repeated_ids(spark):
    texts = ["one text of some words here", None, "another one that nothing is like"]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[0]), (None, texts[2]), (None, texts[2]), (None, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.near_dedup(docs, 4).select("doc_id", "component_id", "kept")
    assert Counter(map(tuple, found.collect())) == Counter({(1, 1, True): 2, (2, 1, False): 1, (None, None, True): 3})
    assert Counter(map(tuple, near_dedup.drop_near_copies(docs, 4).collect())) == Counter([(1, texts[0]), (None, texts[2]), (None, None)])


@pytest.mark.parametrize("most", [0, 8, 512])
def test_near_dedup_of_a_band_without_links(spark, monkeypatch, most):
    """Many texts share half of their words, and bands, and few are alike enough; the band is compared by first shingles, or member by member."""
    monkeypatch.setattr(near_dedup, "MOST_OUTSIDE", most)
    r = random.Random(6)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(common + [f"x{i}_{j}" for j in range(r.randint(10, 30))])) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " tail") for i in range(10)]
    rows += [(300 + i, " ".join(common + rows[i][1].split()[60:] + [f"y{i}_{j}" for j in range(r.randint(3, 22))])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {tuple(r) for r in near_dedup.near_dedup(docs, 4).select("doc_id", "component_id").collect()}
    assert found == {(r[0], r[2]) for r in brute_near(rows, 4, 80)} and len({c for _, c in found}) > 120


def test_first_shingles_meet_for_every_pair_alike():
    """Sets of all sizes: whatever reaches the threshold shares a key on opposite sides."""
    r = np.random.default_rng(5)
    counts = r.integers(0, 9, near_dedup.FREQUENCY_BUCKETS)
    met = pairs = 0
    for _ in range(1500):
        percent, n = int(r.choice([80, 60, 95])), int(r.integers(1, 120))
        own = np.unique(r.integers(0, 1 << 62, n, np.uint64))
        other = np.unique(np.concatenate([own[r.random(len(own)) < r.choice([0.7, 0.9, 1])], r.integers(0, 1 << 62, int(r.integers(0, n // 4 + 2)), np.uint64)]))
        common = len(np.intersect1d(own, other))
        if len(other) == 0 or 100 * common < percent * (len(own) + len(other) - common):
            continue
        pairs += 1
        (ka, sa), (kb, sb) = (near_dedup._first_shingles(s, counts, percent) for s in (own, other))
        met += any(set(ka[sa == p].tolist()) & set(kb[sb == q].tolist()) for p, q in ((0, 1), (1, 0), (2, 2)))
    assert met == pairs > 200


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (7, 8), (8, 9), (9, 3), (20, 21), (21, 22), (22, 23), (23, 24)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 10: 10, 11: 10, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}


@pytest.mark.parametrize("operator", [exact_dedup.exact_dedup, substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, near_dedup.near_dedup])
def test_empty_tables(empty, operator):
    assert operator(empty).count() == 0
