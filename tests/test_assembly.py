"""The cascade, loadouts, citations, fragments, ability rows and isolated rules, on small rows with duplicates, nulls and ties."""

import difflib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quernstone.operators import overlay, quality, resolve, retrieve, roster
from quernstone.plans import assembly


def plain_cascade(name, canonical, local, nicknames, cutoff):
    """how, entity, candidates for one name, step by step."""
    keys, inside = defaultdict(set), {}
    for e, n, f in canonical:
        keys[n.upper().strip()].add((e, n, f))
        inside[n.upper().strip(), f.upper()] = min(e, inside.get((n.upper().strip(), f.upper()), e))
    shown = lambda k: sorted({f"{n} ({f})" for _, n, f in keys[k]})
    ids = lambda k: {e for e, _, _ in keys[k]}

    def exactly(t):
        if t in local:
            return "exact", local[t], None
        if t.endswith(")") and "(" in t:
            base, of = t.upper()[:-1].split("(", 1)
            if (base.strip(), of) in inside:
                return "exact", inside[base.strip(), of], None
        if t.upper() in keys:
            own = ids(t.upper())
            return ("exact", min(own), None) if len(own) == 1 else ("ambiguous", None, shown(t.upper()))
        return None

    t = name.strip()
    if found := exactly(t):
        return found
    if t in nicknames and (found := exactly(nicknames[t])) and found[0] == "exact":
        return found
    of_local = difflib.get_close_matches(t, list(local), n=3, cutoff=cutoff)
    of_keys = difflib.get_close_matches(t.upper(), list(keys), n=3, cutoff=cutoff)
    hits = of_local + of_keys
    if len(hits) == 1 and of_local:
        return "fuzzy", local[hits[0]], None
    if len(hits) == 1:
        return ("fuzzy", min(ids(hits[0])), None) if len(ids(hits[0])) == 1 else ("ambiguous", None, shown(hits[0]))
    return ("ambiguous", None, hits) if hits else ("none", None, None)


@pytest.mark.parametrize("cutoff", [0.6, 0.85])
def test_cascade_step_by_step(spark, cutoff):
    r = random.Random(11)
    words = ["helbrute", "Rhino", "dread", "nought", "Knight", "squad", "Alpha", "ix"]
    canonical = list({(i % 31, " ".join(r.sample(words, 2)), r.choice(["CSM", "DG", "UM"])) for i in range(45)})
    local = {"地狱兽": 3, "犀牛战车": 4, "犀牛战车二型": 5}
    nicknames = {"the box": canonical[0][1], "gone": "nobody", "car": "犀牛战车"}
    asked = [n for _, n, _ in canonical] + [f"{n} ({f})".upper() for _, n, f in canonical[:12]] + ["地狱兽", "地狱曾", "犀牛战车三型", "the box", "gone", "car", " car ", "", "zzz", "x (y)", "Rhino", "rhino squat"]
    asked += [n[:2] + n[3:] for _, n, _ in canonical[:15]]
    want = [(i, *plain_cascade(n, canonical, local, nicknames, cutoff)) for i, n in enumerate(asked)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = resolve.cascade(
        frame(list(enumerate(asked)) + [(999, None)], "name_id int, name string"), frame(canonical * 2, "entity_id int, name string, faction string"),
        frame([(n, e) for n, e in local.items()] + [("犀牛战车", 9)], "name string, entity_id int"), frame(list(nicknames.items()), "alias string, name string"), cutoff,
    )
    assert sorted(map(tuple, got.collect())) == sorted([*want, (999, "none", None, None)])
    assert {w[1] for w in want} == {"exact", "ambiguous", "fuzzy", "none"}


def test_loadouts_are_whole_or_nothing(spark):
    def plain(lines, most_lines=4, most=10):
        if not lines or len(lines) > most_lines:
            return None
        out = {}
        for name, n in lines:
            if name is None or not name.strip() or n is None or not 1 <= n <= most:
                return None
            out[name.strip()] = out.get(name.strip(), 0) + n
        return list(out.items()) if max(out.values()) <= most else None

    r = random.Random(5)
    cases = [None, []] + [[(r.choice(["a", " a ", "b", "c", "", None] if r.random() < 0.3 else ["a", " a ", "b"]), r.choice([1, 2, 5, 0, 11, None] if r.random() < 0.3 else [1, 2, 5])) for _ in range(r.randint(1, 5))] for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, lines array<struct<name: string, count: int>>").select("i", roster.merged_loadout(F.col("lines"), 4, 10).alias("m"))
    got = {x["i"]: None if x["m"] is None else [tuple(y) for y in x["m"]] for x in df.collect()}
    assert got == {i: plain(c) for i, c in enumerate(cases)} and len({str(v) for v in got.values()}) > 10


def test_weapons_of_a_phase(spark):
    pool = spark.createDataFrame([(1, "w1", "Gun", False), (1, "w2", "gun ", True), (1, "w3", "Axe", True), (1, "w4", "axe", True), (1, "w5", "Bow", False), (2, "w6", "Gun", None)], "unit_id int, weapon_id string, name string, melee boolean")
    asked = [(1, 1, "GUN", "melee"), (2, 1, "gun", "shooting"), (3, 1, "gun", None), (4, 1, "Axe", "shooting"), (5, 1, "Axe", "melee"), (6, 1, " bow", "melee"), (7, 2, "gun", "melee"), (8, 3, "gun", "melee"), (9, 1, None, "melee")]
    got = roster.matched_weapons(spark.createDataFrame(asked, "i int, unit_id int, name string, phase string"), pool, ["i"])
    assert sorted(map(tuple, got.collect())) == [(1, "one", "w2"), (2, "one", "w1"), (3, "several", None), (4, "several", None), (5, "several", None), (6, "one", "w5"), (7, "one", "w6"), (8, "none", None), (9, "none", None)]


def test_citations_and_contexts(spark):
    rows = [(1, 5, "A", 2), (1, 2, "B", None), (1, 3, "A", 2), (1, 4, "B", None), (1, 1, "", 9), (1, 0, None, 9), (2, 1, "A", 2)]
    cites = retrieve.cited(spark.createDataFrame(rows, "a int, o int, book string, page int"), "a", ["o"], ["book", "page"])
    assert sorted(map(tuple, cites.select("a", "n", "book", "page").collect()), key=str) == [(1, 1, "B", None), (1, 2, "A", 2), (2, 1, "A", 2)]
    passages = spark.createDataFrame([(1, 9, "A", 2, "e/core", "x"), (1, 4, "B", None, None, None)], "a int, rank int, book string, page int, tag string, text string")
    assert retrieve.context(passages, "a", "rank").first()["context"] == "【档案 1】《B》\n\n\n" + "─" * 40 + "\n\n【档案 2·e/core】《A》第2页\nx"


def test_fragments_and_affected_pages(spark):
    entities = spark.createDataFrame([(1, "b", [3, 1, 9, 1]), (2, "c", [1]), (3, "b", None)], "entity_id int, book string, pages array<int>")
    pages = spark.createDataFrame([("b", 1, "one"), ("b", 3, "three"), ("b", 9, None), ("d", 1, "x")], "book string, page int, text string")
    assert [tuple(x) for x in quality.fragments(entities, pages).collect()] == [(1, 3, "one\none\nthree")]
    raw = spark.createDataFrame([(1, ["data/b/page_1.md#a", "x"]), (2, ["data/b/page_11.md"]), (3, []), (4, None), (5, ["b/page_2.md"])], "page int, raw array<string>")
    changed = spark.createDataFrame([("b/page_1",), ("c/page",), (None,)], "path string")
    assert sorted(x["page"] for x in quality.affected(raw, changed).collect()) == [1, 2]


def test_ability_rows(spark):
    masters = [("x", "X", "1", 1), ("x", "X2", "2", 2), (None, "no id", "3", 3), (" ", "no id", "3", 3), ("u_a1", "clash", "4", 4)]
    links = [("u", "Fly", "a", 1), ("u", " ", "b", 2), ("u", " Fly ", "c", 3), (None, "Fly", "d", 4), ("v", "Fly", "e", 5)]
    got = overlay.ability_rows(spark.createDataFrame(masters, "id string, name string, text string, o int"), spark.createDataFrame(links, "owner string, name string, text string, o int"), ["o"])
    assert Counter(map(tuple, got.collect())) == Counter([("x", None, "X2", "2"), ("u_a1", "u", "Fly", "a"), ("u_a2", "u", "Fly", "c"), ("v_a1", "v", "Fly", "e")])


def test_a_rule_that_fails_does_not_stop_the_others(spark):
    good = spark.createDataFrame([(1,), (2,)], "subject int")
    found = quality.lint({"a": good, "b": lambda: good.select(F.col("none").alias("subject")), "c": good.select(F.raise_error(F.lit("x")).alias("subject")), "d": lambda: good.where("subject = 2")})
    assert Counter(map(tuple, found.collect())) == Counter([("a", "1"), ("a", "2"), ("d", "2"), ("lint_error", "b"), ("lint_error", "c")])


def test_units_of_datasheets(spark):
    sheets = spark.createDataFrame([("1", "A", "F"), ("1", "A again", "G"), ("", "no id", "F"), (None, "no id", "F"), ("2", "B", None)], "id string, name string, faction_id string")
    models = spark.createDataFrame([("1", "10", "later"), ("1", "2", "first"), ("1", "x", "no line"), ("", "1", "lost"), ("9", "1", "lost")], "datasheet_id string, line string, M string")
    costs = spark.createDataFrame([("1", "2", "10 models", "150"), ("1", "1", "5 models", " 80 "), ("1", "3", "other", "free"), (None, "1", "lost", "1")], "datasheet_id string, line string, description string, cost string")
    terms = spark.createDataFrame([("1", "旧", 1), ("1", "新", 2), ("1", None, 3), ("3", "无", 1)], "canonical_id string, zh string, ord int")
    factions = spark.createDataFrame([("F", "Faction")], "id string, name string")
    got = [tuple(x) for x in overlay.unit_projection(sheets, models, costs, terms, factions).orderBy("unit_id", "name").collect()]
    items = [("5 models", 80), ("10 models", 150), ("other", None)]
    assert [(*g[:6], [tuple(i) for i in g[6]], *g[7:]) for g in got] == [
        ("1", "A", "新", "F", "Faction", 80, items, 3, "no line"), ("1", "A again", "新", "G", None, 80, items, 3, "no line"), ("2", "B", None, None, None, None, [], 0, None),
    ]


def test_citations_read_their_sources_once(spark, sf_dir):
    found = assembly.q68_citations(spark, sf_dir)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert found.groupBy("l_orderkey").count().where("count > 1").isEmpty()
