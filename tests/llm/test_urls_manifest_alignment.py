"""URL filters, the Merkle manifest and cross-tokenizer alignment against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quernstone.llm import alignment, merkle, queries, url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def plain(rows):
    return Counter(tuple(r) for r in rows)


# URL filters

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("WWW.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/a", "allow"),
    ("b.net", "/e", "block"), ("b.net", "", "allow"), ("same.org", "/x", "allow"), ("same.org", "/x", "block"), ("same.org", "/x/y", "other"),
    (None, "/robots", "block"), ("deep.a.b.c.org", None, "block"), ("org", "/" + "s/" * 50, "block"),
]


def brute_url(url, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].translate(LOWER), rest[cut:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = []
    for h, p, v in RULES:
        h, p = (h or "").translate(LOWER), p or ""
        if v in ("allow", "block") and (not h or host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), v, h + p))
    _, _, verdict, rule = max(fits, default=(0, 0, default, None))
    return host, path, rule, verdict


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    r = random.Random(4)
    hosts = ["com", "example.com", "www.Example.com", "a.www.example.com", "notexample.com", "net", "b.net", "c.b.net", "xb.net", "same.org", "deep.a.b.c.org", "a..com", "", "user@example.com", "example.com:80", ".com", "EXAMPLE.COM."]
    paths = ["", "/", "/en", "/en/", "/en/x", "/EN/", "/es/", "/es/a", "/es/ab/c", "/e", "/x", "/x/y/z", "//en/", "/robots.txt", "/" + "s/" * 60, "/" + "q" * 5000]
    urls = [f"{s}://{h}{p}{e}" for s in ("http", "") for h in hosts for p in paths for e in ("", "?a=/en/", "#/es/", "?x://com/")]
    urls += [None, "", "no scheme.com/en/", "mailto:x@example.com", "a://b://com/en/", "http://com\n/en/\nx"] + [r.choice(urls) for _ in range(50)]
    path = str(tmp_path_factory.mktemp("pages"))
    rows = [(None if i % 97 == 0 else i // 2, u, "x", "y", "z") for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, rule string, found string, _row string").coalesce(2).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("trie_bytes", [url_filter.TRIE_BYTES, 0])
def test_longest_rule_decides(spark, pages, trie_bytes):
    rules = spark.createDataFrame(RULES, url_filter.RULES)
    for default in ("allow", "block"):
        want = Counter((r["page_id"], *brute_url(r["url"], default)) for r in pages.collect())
        assert plain(url_filter.url_filter(pages, rules, default, trie_bytes=trie_bytes).collect()) == want
    kept = url_filter.keep_allowed(pages, rules, trie_bytes=trie_bytes)
    assert kept.columns == pages.columns and plain(kept.collect()) == plain(r for r in pages.collect() if brute_url(r["url"], "allow")[3] == "allow")


@pytest.mark.parametrize("trie_bytes", [url_filter.TRIE_BYTES, -1])
def test_no_rules_and_no_pages(spark, pages, trie_bytes):
    none = spark.createDataFrame([], url_filter.RULES)
    assert {(r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, none, trie_bytes=trie_bytes).collect()} == {(None, "allow")}
    assert url_filter.url_filter(pages.limit(0), spark.createDataFrame(RULES, url_filter.RULES), trie_bytes=trie_bytes).collect() == []


def test_a_hot_host_with_many_rules(spark):
    rules = spark.createDataFrame([("hot.com", f"/u{i}", "block") for i in range(3000)] + [("com", "/", "allow")], url_filter.RULES)
    pages = spark.createDataFrame([(i, f"http://www.hot.com/u{i}/x") for i in range(2500, 3500)], "page_id long, url string")
    for trie_bytes in (1 << 20, 0):
        got = {r["page_id"]: r["rule"] for r in url_filter.url_filter(pages, rules, trie_bytes=trie_bytes).collect()}
        assert got == {i: f"hot.com/u{i}" if i < 3000 else f"hot.com/u{i // 10}" for i in range(2500, 3500)}


# Merkle manifest


def H(*values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def image(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows):
    """Rows as (doc_id, source, lang, n_chars, text)."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def siblings(levels, at):
        for nodes in levels[:-1]:
            run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
            yield run[: at % 8], run[at % 8 + 1 :]
            at //= 8

    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0] is not None, r[0] or 0, H(*map(image, r)), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: (sorted(langs[k], key=lambda x: x[:3])) for k in order}
    built = {k: levels([x[2] for x in v]) for k, v in trees.items()}
    top = levels([built[k][-1][0] for k in order]) if order else []
    out = []
    for g, k in enumerate(order):
        for at, (_, _, leaf, r) in enumerate(trees[k]):
            proof = [*siblings(built[k], at), *siblings(top, g)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = H(*map(image, (*r[:4], r[4] and r[4].translate(LOWER)))) if tampered else leaf
            for left, right in proof:
                node = H(*left, node, *right)
            out.append((r[0], leaf, built[k][-1][0], top[-1][0], H(*(x for s in proof for x in [*s[0], *s[1]])), node, node == top[-1][0]))
    return out


def manifest_of(spark, rows, tmp_path, parts=3):
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit("x") for c in ("kids", "place", "n", "group", "digest")}).repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    return queries.op12_merkle_manifest(spark, str(tmp_path)).collect()


def test_manifest_equals_the_plain_tree(spark, tmp_path):
    r = random.Random(9)
    text = lambda: r.choice([None, "", "Plain Text", "ünïcode Ä", "LONG " * r.randint(1, 9), "no capitals"])
    rows = [(i, f"s{i % 3}", "en" if i % 3 else r.choice(["de", "fr", "es"]), r.choice([None, i]), text()) for i in range(700)]
    rows += [(i, None, lang, 0, text()) for i, lang in enumerate([None, "", "zz", "ä", "Z", "-", "2:en", None, "é", "x", "y"])]  # some stand alone
    rows += [rows[5]] * 30 + [(7, "s", "en", 1, "other text of one id")] + [(None, "s", "en", 1, text()) for _ in range(20)]
    assert plain(manifest_of(spark, rows, tmp_path)) == Counter(brute_manifest(rows))


@pytest.mark.parametrize("n", [0, 1, 8, 9, 64, 65])
def test_manifest_of_one_group(spark, tmp_path, n):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
    assert plain(manifest_of(spark, rows, tmp_path)) == Counter(brute_manifest(rows))


def test_manifest_finds_what_was_tampered_with(spark, tmp_path):
    rows = [(i, "s", "en" if i % 2 else None, 3, "Upper" if i % 5 else "lower") for i in range(400)]
    got = {r["doc_id"]: r["verified"] for r in manifest_of(spark, rows, tmp_path)}
    assert got == {i: not (zlib.crc32(str(i).encode()) % 3 == 0 and i % 5 != 0) for i in range(400)}


def test_manifest_of_any_group_and_fields(spark):
    docs = spark.createDataFrame([(i, i % 3, f"t{i}") for i in range(40)], "key long, part int, body string")
    got = merkle.manifest(docs, ("key", "body"), "part", "key").collect()
    assert len(got) == 40 and len({r["root"] for r in got}) == 1 and len({r["subroot"] for r in got}) == 3
    assert {r["key"]: r["leaf"] for r in got} == {i: H(image(i), image(f"t{i}")) for i in range(40)}


# Cross-tokenizer alignment


@pytest.fixture(scope="module")
def plain_tokens():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(k): k for k in printable} | {chr(256 + i): k for i, k in enumerate(k for k in range(256) if k not in printable)}

    def of(text):
        if not text:
            return [], []
        x = [(i, bytes(code[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        whole = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else ([], [])

    return of


def brute_alignment(texts, tokens):
    told, counts = [], Counter()
    for doc_id, text in texts:
        sides = []
        for side in tokens(text):
            at, spans = 0, []
            for i, raw in side:
                spans.append((i, at, at + len(raw)))
                at += len(raw)
            sides.append(spans)
        a, b = sides
        links = [(i, j) for i, s, e in a for j, t, u in b if s < u and t < e] if len(a) < 3000 else None
        if links is None:  # the same by merging, for long texts
            links, q = [], 0
            for i, s, e in a:
                while b[q][2] <= s:
                    q += 1
                links += [(i, b[k][0]) for k in range(q, min(len(b), q + e - s)) if b[k][1] < e]
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for end in ends:
            groups.append(",".join(str(i) for i, s, e in a if start <= s < end) + "|" + ",".join(str(i) for i, s, e in b if start <= s < end) if len(a) < 3000 else "")
            start = end
        counts.update(links)
        told.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(d, na, nb, ng, len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), sha if na < 3000 else None) for d, na, nb, ng, x, sha in told]


@pytest.fixture(scope="module")
def aligned_texts():
    r = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzéßñ'’.,0123456789-ABC日本語🙂\t\n  "
    texts = ["", None, " ", "  ", "   a", "x ", "x  ", "a\n\n b\t c", "<|endoftext|> <s> </s><unk> <0x41>", "under▁score", "▁", "\u0000 \u00a0 \u3000x \u2028 y", "日本語" * 50, "🙂 " * 40, "don't you'll", "\ufffd", " lead", "tail\n", "a" * 900]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(1, 200))) for _ in range(150)]
    words = ["the", "naïve", "Überfluß", "tokens", "12345", "anchor-word", "…", "pneumonoultramicroscopic"]
    texts += [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(80)] + ["the the the"] * 5
    return [(None if i % 41 == 0 else i // 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("pairs", [alignment.BROADCAST_PAIRS, 40, 0])
def test_alignment_equals_all_overlaps(spark, aligned_texts, plain_tokens, pairs):
    docs = spark.createDataFrame([(*x, "c", 1) for x in aligned_texts], "doc_id long, text string, links string, n int").repartition(5)
    got = alignment.cross_alignment(docs, *PATHS, broadcast_pairs=pairs)
    picked = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert plain(picked.collect()) == Counter(brute_alignment(aligned_texts, plain_tokens))


def test_alignment_of_long_and_no_texts(spark, plain_tokens):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(1, 12))) for _ in range(3000)]
    texts = [(1, " ".join(r.choice(words) for _ in range(150_000))), (2, "a" * 300_000), (3, "é漢" * 50_000), (4, "7 " * 100_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r) for r in alignment.cross_alignment(docs, *PATHS).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum").collect()}
    assert got == {x[0]: x[:-1] for x in brute_alignment(texts, plain_tokens)}
    assert alignment.cross_alignment(docs.limit(0), *PATHS).collect() == []


def test_products_expand_groups(spark, plain_tokens):
    text = "Überfluß naïve 日本語 tokens"
    a, b = plain_tokens(text)
    ends = lambda side: [sum(len(t) for _, t in side[: k + 1]) for k in range(len(side))]
    shared, want, start = sorted(set(ends(a)) & set(ends(b))), [], 0
    for g, end in enumerate(shared):
        own = [[i for (i, _), e in zip(side, ends(side)) if start < e <= end] for side in (a, b)]
        want += [(1, i, j, g) for i in own[0] for j in own[1]]
        start = end
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert plain(alignment.products(docs, *PATHS).collect()) == Counter(want)
    assert alignment.cross_alignment(docs, *PATHS).where("doc_id = 1").first()["n_products"] == len(want)
