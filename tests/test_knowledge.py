"""Names, objects, leaves, published versions, fingerprints, chunks, link repair, structures, records and tables, against plain versions."""

import difflib
import json
import random
import re
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quernstone.functions import nested
from quernstone.operators import chunk, names, quality, resolve
from quernstone.sources import snapshots, tables
from quernstone.streaming import fingerprints

# Names


def brute_rewrite(text, pairs, fold, whole, once=False):
    """The names one after the other, the longest first, each place used once."""
    if text is None:
        return None, 0
    low, taken, put = (names.folded(text) if fold else text), [False] * len(text), []
    for name, value in sorted(pairs, key=lambda p: (-len(p[0]), p[0])):
        key, at = names.folded(name) if fold else name, 0
        while (at := low.find(key, at)) >= 0:
            end = at + len(key)
            edge = lambda i: 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()
            if not any(taken[at:end]) and not (whole and (edge(at - 1) or edge(end))):
                taken[at:end] = [True] * (end - at)
                put.append((at, end, value))
                if once:
                    break
            at += 1
    for a, b, value in sorted(put, reverse=True):
        text = text[:a] + value + text[b:]
    return text, len(put)


@pytest.fixture(scope="module")
def some_texts():
    r = random.Random(3)
    words = ["ab", "Abc", "bcd", "cd", "d", "İx", "ABC", "twin", "gun", "twin gun", "-", "日本", "本語", "straße"]
    texts = [None, "", "abcd", "a" * 50] + ["".join(r.choice(words) + r.choice(["", " ", "x", "."]) for _ in range(r.randint(1, 40))) for _ in range(60)]
    return texts, [("ab", "1"), ("bcd", "2"), ("twin gun", "TG"), ("gun", "G"), ("d", "<d>"), ("日本", "J"), ("本語", "L"), ("STRASSE", "s"), ("aa", "2a"), ("aaa", "3a"), ("İx", "i")]


@pytest.mark.parametrize("most", [names.NAMES_BYTES, 40])
@pytest.mark.parametrize(("fold", "whole"), [(True, False), (True, True), (False, True)])
def test_longest_names_first(spark, some_texts, most, fold, whole):
    texts, pairs = some_texts
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    known = spark.createDataFrame([*pairs, (None, "x"), ("", "y"), ("ab", "0 is less")], "name string, value string")
    pairs = [("ab", "0 is less"), *pairs[1:]]
    got = {x["i"]: (x["t"], x["n_replaced"]) for x in names.rewrite(df, known, "t", fold, whole, most=most).collect()}
    assert got == {i: brute_rewrite(t, pairs, fold, whole) for i, t in enumerate(texts)}


def test_mentions_and_no_names(spark):
    df = spark.createDataFrame([(5, "twin gun"), (6, None)], "i long, t string")
    known = spark.createDataFrame([("gun", "g"), ("twin gun", "t"), ("n g", "x")], "name string, value string")
    assert sorted(map(tuple, names.mentions(df, known, "i", "t").collect())) == [(5, 0, 8, "twin gun", "t"), (5, 3, 6, "n g", "x"), (5, 5, 8, "gun", "g")]
    assert {x["t"] for x in names.rewrite(df, known.limit(0), "t").collect()} == {"twin gun", None}


def test_time_does_not_depend_on_how_many_names(spark):
    own = names.automaton([(f"name number {i}", "") for i in range(200_000)], True)
    assert [m[2] for m in names.occurrences(own, "x Name Number 77 y" * 1000, True, False)].count("name number 77") == 1000


def test_links_of_names(spark):
    pages = spark.createDataFrame([(1, "Guard, Guard and [[x|Star Guard]], Star Guard"), (2, None)], "page long, text string")
    known = spark.createDataFrame([("Guard", "g"), ("Star Guard", "s")], "name string, target string")
    assert {x["page"]: (x["text"], x["linked"]) for x in quality.link_names(pages, known).collect()} == {1: ("[[g|Guard]], Guard and [[x|Star Guard]], [[s|Star Guard]]", 2), 2: (None, 0)}


# Objects and leaves


def brute_object(text):
    start = (text or "").find("{")
    if start < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        else:
            depth += (c == "{") - (c == "}")
            if depth == 0:
                return text[start : i + 1]
    return None


def test_first_object_of_generated_texts(spark):
    r = random.Random(1)
    texts = [None, "", "{", "}{}", '{"', '{"a\\'] + ["".join(r.choice('{{}}""\\\\ a:1\n,é') for _ in range(r.randint(1, 40))) for _ in range(600)]
    texts += ["noise } " + json.dumps({"type": "x", "s": t or "", "in": {"deep": [{"{": "}"}]}}) + ' and "more" {' for t in texts]
    texts += ['{"type": "' + '\\"{' * 100_000 + '"} {', "{" * 50_000 + "}" * 50_000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4).select("i", nested.first_object(F.col("t")).alias("o"))
    assert {x["i"]: x["o"] for x in got.collect()} == {i: brute_object(t) for i, t in enumerate(texts)}


def test_objects_need_their_field(spark):
    df = spark.createDataFrame([(1, '```json\n{"type": "a", "n": 1}\n```'), (2, '{"n": 1}'), (3, '{"type": bad}'), (4, "none")], "i int, t string")
    assert {x["i"]: x["o"] for x in df.select("i", nested.object_of(F.col("t")).cast("string").alias("o")).collect()} == {1: '{"n":1,"type":"a"}', 2: None, 3: None, 4: None}


def leaves_of(node):
    if isinstance(node, str):
        return [node]
    if isinstance(node, list):
        return [x for n in node for x in leaves_of(n)]
    if isinstance(node, dict):
        return ([node["text"]] if isinstance(node.get("text"), str) else []) + leaves_of(node.get("content"))
    return []


def test_leaves_in_the_order_of_the_document(spark):
    r = random.Random(2)

    def grow(depth):
        kind = r.randrange(6 if depth < 7 else 3)
        if kind < 3:
            return r.choice(["s", "", None, 3, True, "tè\"x"])
        if kind == 3:
            return [grow(depth + 1) for _ in range(r.randrange(13))]
        return {k: grow(depth + 1) for k in r.sample(["content", "text", "other", "a.b"], r.randrange(1, 5))}

    trees = [grow(0) for _ in range(40)] + [[["deep", [[[["er"]]]]]], {"text": {"text": "not read"}, "content": "c"}]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)] + [(99, None)], "i int, j string").select("i", F.parse_json("j").alias("v"))
    got = {i: [] for i in range(len(trees))}
    for x in sorted(nested.text_leaves(df, "i", "v").collect(), key=lambda x: (x["i"], x["place"])):
        got[x["i"]].append(x["leaf"])
    assert got == {i: leaves_of(t) for i, t in enumerate(trees)}


# Published versions and fingerprints


def test_a_writer_that_fails_midway(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = lambda n: spark.range(n)
    with pytest.raises(ValueError):
        snapshots.read(spark, root, "a")
    first = snapshots.publish(spark, root, lambda store: (store(rows(3), "a"), store(rows(4), "b")))
    open_reader = snapshots.read(spark, root, "a")

    def fails(store):
        store(rows(10), "a")
        store(rows(10).select(F.raise_error(F.lit("midway"))), "b")

    with pytest.raises(PySparkException, match="midway"):
        snapshots.publish(spark, root, fails)
    assert snapshots.versions(spark, root) == [first] and snapshots.read(spark, root, "a").count() == 3 and snapshots.read(spark, root, "b").count() == 4
    assert len(list((tmp_path / "store" / "versions").iterdir())) == 1
    second = snapshots.publish(spark, root, lambda store: store(rows(10), "a"))
    assert snapshots.versions(spark, root) == [second, first] and snapshots.read(spark, root, "a").count() == 10 and snapshots.read(spark, root, "b").count() == 4
    assert open_reader.count() == 3
    assert snapshots.rollback(spark, root) == first and snapshots.read(spark, root, "a").count() == 3
    with pytest.raises(ValueError):
        snapshots.rollback(spark, root)
    for n in range(5, 10):
        snapshots.publish(spark, root, lambda store, n=n: store(rows(n), "a"))
    assert len(snapshots.versions(spark, root)) == snapshots.KEPT_VERSIONS and snapshots.read(spark, root, "a").count() == 9 and snapshots.read(spark, root, "b").count() == 4


def test_columns_are_only_added(spark, tmp_path):
    root = str(tmp_path / "store")
    snapshots.publish(spark, root, lambda store: store(spark.createDataFrame([(1, "x")], "id int, name string"), "t"))
    assert snapshots.add_columns(spark, root, "t", {"state": ("string", "on"), "n": ("int", None), "name": ("string", "never")}) == ["n", "state"]
    assert snapshots.add_columns(spark, root, "t", {"state": ("string", "other"), "n": ("int", 4)}) == []
    assert [tuple(x) for x in snapshots.read(spark, root, "t").collect()] == [(1, "x", "on", None)]
    snapshots.publish(spark, root, lambda store: store(spark.createDataFrame([(2, None, "y")], "id int, state string, name string"), "t"))
    got = snapshots.history(spark, root, "t").orderBy("version").select("version", "id", "name", "state", "n").collect()
    assert [tuple(x) for x in got] == [(0, 1, "x", "on", None), (1, 2, "y", None, None)]


def test_only_what_changed_is_read(spark, tmp_path):
    landing, root, seen = tmp_path / "in", str(tmp_path / "out"), []

    def put(**files):
        for path, content in files.items():
            source, name = path.split("__")
            (landing / source).mkdir(parents=True, exist_ok=True)
            (landing / source / f"{name}.md").write_text(content)

    def rows_of(files):
        seen.append(sorted({x["source"] for x in files.select("source").collect()}))
        return files.select("source", "name", F.decode("content", "UTF-8").alias("text"))

    def run(rules="1"):
        seen.clear()
        report = {x["source"]: x["status"] for x in fingerprints.take_in(spark, str(landing), root, rows_of, rules, "*.md").collect()}
        return report, sorted((x["source"], x["name"], x["text"]) for x in snapshots.read(spark, root, "rows").collect())

    put(a__1="one", a__2="two", b__1="three", c__1="four")
    report, rows = run()
    assert report == {"a": "new", "b": "new", "c": "new"} and len(rows) == 4 and seen == [["a", "b", "c"]]
    version = snapshots.versions(spark, root)
    report, again = run()
    assert set(report.values()) == {"unchanged"} and again == rows and seen == [] and snapshots.versions(spark, root) == version
    put(a__2="2!", d__1="five", b__1="three")  # b is written anew with what it had
    (landing / "c" / "1.md").unlink()
    report, rows = run()
    assert report == {"a": "changed", "b": "unchanged", "c": "gone", "d": "new"} and seen == [["a", "d"]]
    assert rows == [("a", "1.md", "one"), ("a", "2.md", "2!"), ("b", "1.md", "three"), ("d", "1.md", "five")]
    report, _ = run(rules="2")
    assert set(report.values()) == {"changed"}


# Chunks


def plain_chunks(pages, budget):
    """Entry by entry: pages as (number, text)."""
    found = [[None, pages[0][0] if pages else None, []]]
    for number, text in pages:
        for line in re.split(r"\r\n|\n|\r", re.sub(r"(\r\n|\n|\r)$", "", text)) if text else []:
            if line.strip() == chunk.CONTINUED_MARK:
                continue
            if line.startswith("## "):
                found.append([line[3:].strip(), number, []])
            else:
                found[-1][2].append(line)
    out = []
    for entry, (heading, page, lines) in enumerate(found):
        body = "\n".join(lines)
        if entry == 0:
            if not body.strip():
                continue
            heading = next((x[2:].strip() for x in lines if x.startswith("# ")), chunk.PREFACE)
        blocks = re.split(r"\n(?=### )", body)
        if len(body) <= budget:
            parts = [body]
        elif not ("\n" + body).count("\n### "):
            parts = chunk._pieces(body, budget)
        else:
            fixed = [b for i, b in enumerate(blocks) if i == 0 or b.startswith(chunk.WEAPON_SEGMENTS)]
            armed = len(fixed) > 1
            parts, size = (["\n".join(fixed)] if armed else []), None
            for b in [b for b in blocks[1:] if not b.startswith(chunk.WEAPON_SEGMENTS)] if armed else blocks:
                if size is None or (size and size + len(b) > budget):
                    parts.append(b)
                    size = len(b)
                else:
                    parts[-1] = parts[-1] + "\n" + b if size else b
                    size = len(parts[-1])
        for k, p in enumerate(parts):
            out.append((entry, k, page, heading, (f"## {heading}{chunk.CONTINUED if k else ''}" + ("\n" + p if p else "")).strip()))
    return out


def test_chunks_through_all_levels(spark):
    r = random.Random(6)
    line = lambda: r.choice(["", "text " * r.randint(1, 12), "## Entry %d" % r.randint(1, 9), "### 技能", "### 远程武器", "### 近战武器 x", "### 其他", "<!--CONT-->", " <!--CONT--> ", "# Title", "#### not", "x" * 150, "##no"])
    books = {b: [(p, r.choice(["\n", "\n", "\r\n"]).join(line() for _ in range(r.randint(0, 30))) + r.choice(["", "\n"])) for p in range(1, r.randint(2, 6))] for b in range(60)}
    books[60], books[61] = [(1, "preface only\n# Named\nmore")], [(1, "")]
    df = spark.createDataFrame([(b, p, t) for b, pages in books.items() for p, t in pages] + [(62, 1, None)], "b int, p int, t string").repartition(5)
    for budget in (120, 400):
        got = Counter(tuple(x) for x in chunk.section_chunks(df, "b", "p", "t", budget).select("book", "entry", "part", "page", "heading", "chunk").collect())
        want = Counter((b, *x) for b, pages in books.items() for x in plain_chunks([(p, t) for p, t in pages if t], budget))
        assert got == want


# Closest match


@pytest.mark.parametrize("cutoff", [0.6, 0.75, 0.9])
def test_closest_without_blocks(spark, cutoff):
    r = random.Random(7)
    pool = [None, "", "a", "aa"] + ["".join(r.choice("abcdefgh/-1") for _ in range(r.randint(1, 24))) for _ in range(250)]
    asked = [None, "", "b"] + ["".join(r.choice("abcdefgh/-1") for _ in range(r.randint(1, 24))) for _ in range(40)]
    for p in r.sample(pool[4:], 60):
        s = list(p)
        for _ in range(r.randint(0, 3)):
            s.insert(r.randint(0, len(s)), r.choice("abch1")) if r.random() < 0.5 else s and s.pop(r.randrange(len(s)))
        asked.append("".join(s))
    want = {}
    for a in asked:
        near = max(((difflib.SequenceMatcher(None, p, a).ratio(), p) for p in pool if p and a), default=(0, ""))
        if near[0] >= cutoff:
            want[a] = near[1]
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "name string")
    assert {x["name"]: x["match"] for x in resolve.closest(frame(asked), frame(pool), cutoff).collect()} == want


def test_links_are_led_to_the_nearest_page(spark):
    known = spark.createDataFrame([("units/alpha.md",), ("units/beta.md",), ("rules/cover.md",)], "path string")
    pages = spark.createDataFrame([(1, "[[units/alfa.md]] [[units/alfa.md|Alpha]] [[units/beta]] [[zzz]]"), (2, None), (3, "none")], "page int, text string")
    got = {x["page"]: (x["text"], x["n_repaired"]) for x in quality.repaired_links(pages, known).collect()}
    assert got == {1: ("[[units/alpha.md]] [[units/alpha.md|Alpha]] [[units/beta]] [[zzz]]", 2), 2: (None, 0), 3: ("none", 0)}


# Structures, records, tables


def test_structures(spark):
    kind = "key string, lists array<array<string>>"
    rows = spark.createDataFrame([("a", [["y", "x"], [], ["b"]]), ("b", [[], []]), ("c", None), ("d", [["q"], None])], kind)
    same = spark.createDataFrame([("a", [["b"], ["y", "x"], []]), ("d", [[], ["q"]])], kind)
    shape = lambda df: {x["key"]: x["shape"] for x in quality.structure(df, "key", "lists").collect()}
    assert shape(rows) == shape(same) and set(shape(rows)) == {"a", "d"}
    with pytest.raises(PySparkException, match="a key comes twice: a"):
        quality.structure(rows.union(same), "key", "lists").collect()


def plain_verdict(gold, required, answer):
    told = {f: answer.get(f) or (False, []) for f in required}
    seen = {f: [t for t in told[f][1] if t is not None] for f in required}
    hits = [f for f in required if gold.get(f) in seen[f]]
    if any(seen[f] and f not in hits for f in required) or not hits:
        return "wrong"
    if any(not seen[f] for f in required):
        return "partial"
    n = max((len(told[f][1]) for f in required if told[f][0]), default=1)
    fits = lambda f, i: (told[f][1][i] if i < len(told[f][1]) else None) == gold.get(f) if told[f][0] else told[f][1][0] == gold.get(f)
    return "correct" if any(all(fits(f, i) for f in required) for i in range(n)) else "partial"


def test_one_record_must_have_all_values(spark):
    r, cases = random.Random(8), []
    cases.append(({"S": "5", "A": "-1"}, ["S", "A"], {"S": (True, ["5", "10"]), "A": (True, ["-2", "-1"])}))
    for _ in range(400):
        fields = r.sample("SAWD", r.randint(1, 4))
        answer = {}
        for f in fields:
            many = r.random() < 0.6
            if r.random() < 0.9:
                answer[f] = (many, [r.choice(["1", "2", None]) for _ in range(r.randint(0, 4) if many else 1)])
        cases.append(({f: r.choice("12") for f in fields}, fields, answer))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, gold map<string,string>, required array<string>, answer map<string,struct<many: boolean, tokens: array<string>>>")
    got = {x["i"]: x["v"] for x in df.select("i", quality.aligned_verdict(F.col("gold"), F.col("required"), F.col("answer")).alias("v")).collect()}
    assert got == {i: plain_verdict(*c) for i, c in enumerate(cases)} and got[0] == "partial" and len(set(got.values())) == 3


def test_tables_under_headings(spark):
    text = "# Index\n| 类型 | 名称 | 摘要 | Updated |\n|---|---|---|---|\n| t0 | [A](a.md) | s | - |\n### F1\n\n| x | y |\n|:-:|--|\n| 1 \\| 2 |  |\n| [l](p) | q | r | 2026-01-01 |\n```\n| [n](o) | [n](o) | e | e |\n```\n### F2\n| t | [B \\| C](b.md) | long | 2026-02-03 |\n|"
    pages = spark.createDataFrame([(1, text), (2, None), (3, "no table")], "page int, text string")
    assert [(x["heading"], x["cells"]) for x in tables.table_rows(pages, "page", "text").orderBy("line").collect()] == [
        ("", ["t0", "[A](a.md)", "s", "-"]), ("F1", ["1 | 2", ""]), ("F1", ["[l](p)", "q", "r", "2026-01-01"]), ("F2", ["t", "[B | C](b.md)", "long", "2026-02-03"]),
    ]
    assert [tuple(x)[2:] for x in tables.wiki_index(pages, "page", "text").orderBy("line").collect()] == [("a.md", "A", "", "t0", "s", ""), ("b.md", "B | C", "F2", "t", "long", "2026-02-03")]
