"""Overlay operators on rows with duplicates, nulls and ties, against the same work done one row after the other."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as tx
from quernstone.operators import overlay
from quernstone.sources import tables


def guard(v):
    return None if v is None else v.replace('"', "").replace(" ", "").lower()


@pytest.mark.parametrize("seed", range(3))
def test_patches_one_after_the_other(spark, seed):
    r = random.Random(seed)
    values = ["3", '4"', "5 +", "6", None]
    base = [(k, r.choice(values)) for k in range(40)] + [(k, "3") for k in range(5)] + [(None, "3")]
    patches = [(i, r.choice([*range(45), None]), r.choice(values), r.choice(values)) for i in range(400)]
    want, now = [], dict(reversed(base))
    counts = Counter(k for k, _ in base)
    for i, k, f, t in patches:
        if f is None or t is None:
            status = "invalid"
        elif k is None or counts[k] != 1:
            status = "not_unique"
        else:
            cur = now[k]
            status = "mismatch" if cur is None else "already" if guard(cur) == guard(t) else "applied" if guard(cur) == guard(f) else "mismatch"
            if status == "applied":
                now[k] = t
        want.append((i, status))
    rows, wanted = spark.createDataFrame(base, "k int, v string"), spark.createDataFrame(patches, "patch_id int, k int, from string, to string").repartition(4)
    changed, report = overlay.compare_and_set(rows, wanted, ["k"], "v", tx.guard_key)
    assert sorted((x["patch_id"], x["status"]) for x in report.collect()) == want
    assert Counter(map(tuple, changed.collect())) == Counter((k, now[k] if counts[k] == 1 and k is not None else v) for k, v in base)


def test_a_second_patch_from_one_value_and_a_chain(spark):
    base = spark.createDataFrame([(1, 3), (2, 3)], "k int, v int")
    patches = spark.createDataFrame([(1, 1, 3, 4), (2, 1, 3, 5), (3, 2, 3, 4), (4, 2, 4, 6)], "patch_id int, k int, from int, to int")
    changed, report = overlay.compare_and_set(base, patches, ["k"], "v")
    assert sorted(map(tuple, changed.collect())) == [(1, 4), (2, 6)]
    assert [(x["status"], x["found"]) for x in report.orderBy("patch_id").collect()] == [("applied", "3"), ("mismatch", "4"), ("applied", "3"), ("applied", "4")]


@pytest.mark.parametrize("seed", range(4))
def test_inserts_one_after_the_other(spark, seed):
    r = random.Random(seed)
    base = [(k, r.choice(["a", "b", None]), r.choice(["x", None])) for k in range(6)]
    rows = [(i, r.choice([*range(14), None]), r.choice(["a", "b", "c", "d", "e", "f", None]), r.choice(["x", "y", None])) for i in range(120)]
    there, want = list(base), []
    for i, k, n, g in rows:
        same = [x for x in there if x[0] == k]
        status = "inserted"
        if k is None or n is None:
            status = "invalid"
        elif same:
            status = "exists" if any(x[1] == n for x in same) else "id_clash"
        elif any(x[1] == n and x[2] == g for x in there):
            status = "name_clash"
        else:
            there.append((k, n, g))
        want.append((i, k, n, status))
    stored = spark.createDataFrame(base, "id int, name string, grp string")
    merged, report = overlay.guarded_insert(stored, spark.createDataFrame(rows, "nth int, id int, name string, grp string").repartition(3), "id", "name", "grp", ["nth"])
    assert sorted(map(tuple, report.collect()), key=lambda x: x[0]) == want
    assert Counter(map(tuple, merged.collect())) == Counter(there)
    twice, again = overlay.guarded_insert(merged, spark.createDataFrame(rows, "nth int, id int, name string, grp string"), "id", "name", "grp", ["nth"])
    assert again.where("status = 'inserted'").count() == 0 and twice.count() == merged.count()


def test_children_of_what_was_inserted(spark):
    base = spark.createDataFrame([(1, "a", "x")], "id int, name string, grp string")
    rows = spark.createDataFrame([(1, "b", "x"), (2, "c", "x"), (3, "c", "x")], "id int, name string, grp string")
    _, report = overlay.guarded_insert(base, rows, "id", "name", "grp")
    children = spark.createDataFrame([(1, "m1"), (2, "m2"), (2, "m2"), (3, "m3"), (None, "m4")], "unit int, model string")
    assert sorted(map(tuple, overlay.insert_children(children.limit(0), children, report, "id", "unit").collect())) == [(2, "m2"), (2, "m2")]


def test_tiers_with_repeats_and_nulls(spark):
    kind = "array<struct<models: int, cost: int>>"
    cases = [
        ([(5, 80), (10, 150)], [(5, 85), (20, 300)], [(5, 85), (10, 150), (20, 300)]),
        ([(5, 80)], [(5, 85), (5, 85)], [(5, 85)]),
        ([(5, 80)], [(5, 85), (5, 95), (7, 1), (7, 2)], [(5, 80)]),
        ([(5, 80), (5, 81)], [(5, 90)], [(5, 90), (5, 90)]),
        (None, [(1, 10)], [(1, 10)]),
        ([(None, 3)], [(None, 9), (2, None), (3, 4)], [(None, 3), (3, 4)]),
        ([(1, 2)], None, [(1, 2)]),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, own {kind}, listed {kind}")
    got = {x["i"]: [tuple(y) for y in x["m"]] for x in df.select("i", overlay.merged_tiers(F.col("own"), F.col("listed")).alias("m")).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_price_lists_are_settled_before_they_meet_units(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.choice([1, 1, 2, 3, None]), r.choice([10, 10, 10, 20, None])) for _ in range(60)] + [("long", 1 + i % 3, 7 if i % 3 else i) for i in range(3000)]
    listed = spark.createDataFrame(rows, "unit string, models int, cost int")
    told = {x["unit"]: [tuple(y) for y in x["listed"]] for x in overlay.told_tiers(listed, ["unit"], "models", "cost").collect()}
    costs = {}
    for unit, models, cost in rows:
        if models is not None and cost is not None:
            costs.setdefault(unit, {}).setdefault(models, set()).add(cost)
    wanted = {u: sorted((m, *c) for m, c in of.items() if len(c) == 1) for u, of in costs.items()}
    assert told == {u: c for u, c in wanted.items() if c} and told["long"] == [(2, 7), (3, 7)]


def test_an_alias_of_two_names(spark):
    units = spark.createDataFrame([(1, "f", "Alpha"), (2, "f", "Beta"), (3, "g", "Beta"), (4, "f", "Vypers"), (5, "f", "beta ")], "unit_id int, faction string, name string")
    aliases = spark.createDataFrame([("old", "alpha"), ("OLD ", "beta"), ("older", "Alpha"), ("gone", "nobody"), (None, "alpha")], "alias string, name string")
    asked = [(1, "f", "old"), (2, "g", "Old"), (3, "f", "older"), (4, "f", "VYPER"), (5, "f", "beta"), (6, "f", "gone"), (7, None, None)]
    found = overlay.price_lookup(spark.createDataFrame(asked, "list_id int, faction string, name string"), units, aliases)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [(1, "ambiguous", None), (2, "alias", 3), (3, "alias", 1), (4, "singular", 4), (5, "exact", 2), (5, "exact", 5), (6, "none", None), (7, "none", None)], key=str
    )


def test_marks_on_rows_without_a_name(spark):
    base = spark.createDataFrame([(1, None), (2, "b")], "id int, name string")
    marks = spark.createDataFrame([(1, "a", "m"), (1, None, "m"), (2, "B", "m"), (3, "c", "m")], "id int, name string, mark string")
    _, report = overlay.deactivate(base, marks, "id", "name")
    assert Counter(map(tuple, report.collect())) == Counter([(1, "mismatch"), (1, "applied"), (2, "applied"), (3, "not_found")])


def test_price_pages(spark):
    tier = '<div class="bg-slate-200 p font-bold x">{}</div><ul class="y">{}</ul>'
    li = "<li><span>{}</span><span{}>{} pts</span></li>"
    unit = '<div class="a bg-slate-500 b font-bold text-xl c">{}</div>'
    page = (
        "<h3 class='z'>UNITS</h3>" + unit.format("SQUAD ") + tier.format("YOUR UNIT COSTS", li.format("5 models", "", '<template id="P:8"></template>').replace(" pts", "") + li.format("10 models", "", 150))
        + unit.format("WALKER") + li.format("1 model", "", 999) + tier.format("YOUR 1ST TO 2ND UNITS COST", li.format("1 model", "", 165)) + tier.format("YOUR 3RD + UNIT COSTS", li.format("1 model", ' class="up"', "▲ (+10) 175"))
        + '<div class="bg-amber-1"><span class="text-xl keep-all">LORD</span></div>' + tier.format("YOUR UNIT COSTS", li.format("1 model", ' class="d"', "▼ (-20) 330") * 2)
        + "<h3>EVERY MODEL HAS THE <b>IMPERIUM</b> KEYWORD</h3>" + unit.format("SQUAD") + tier.format("YOUR UNIT COSTS", li.format("5 models", "", 888))
        + '<div hidden id="S:8">70 pts</div><script>$RS("S:8","P:8")</script><div hidden id="S:8">80 pts</div><script>x;$RS("S:8","P:8")</script>'
        + '<div hidden id="S:ff">' + tier.format("YOUR 1ST UNIT COSTS", li.format("1 model", "", 777)) + '</div><script>$RS("S:ff","P:ff")</script>'
    )
    pages = spark.createDataFrame([(1, page), (2, "<html></html>"), (3, None)], "page int, html string").select("page", tables.kept_sections(tables.filled_placeholders(F.col("html"))).alias("own"))
    assert sorted(map(tuple, tables.price_rows(pages, "own", "page").collect())) == sorted(
        [
            (1, "SQUAD", "YOUR UNIT COSTS", "5 models", 80), (1, "SQUAD", "YOUR UNIT COSTS", "10 models", 150), (1, "WALKER", "YOUR 1ST TO 2ND UNITS COST", "1 model", 165),
            (1, "WALKER", "YOUR 3RD + UNIT COSTS", "1 model", 175), (1, "LORD", "YOUR UNIT COSTS", "1 model", 330),
        ]
    )
