"""Operators on small stated inputs."""

import difflib
import itertools
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as tx
from quernstone.operators import chunk, ordered, overlay, quality, resolve, retrieve, roster
from quernstone.plans import retrieval
from quernstone.sources import tables
from quernstone.streaming import incremental


def test_compare_and_set_statuses(spark):
    base = spark.createDataFrame([(1, "20+"), (2, "x"), (3, "y"), (3, "y")], "k int, v string")
    wanted = spark.createDataFrame([(1, 1, '20+"', "5"), (2, 1, "20", "6"), (3, 2, "x", "x"), (4, 3, "y", "z"), (5, 9, "a", "b"), (6, 2, None, "b")], "patch_id int, k int, from string, to string")
    once, report = overlay.compare_and_set(base, wanted, ["k"], "v", tx.guard_key)
    assert [r["status"] for r in report.orderBy("patch_id").collect()] == ["applied", "mismatch", "already", "not_unique", "not_unique", "invalid"]
    assert sorted(map(tuple, once.collect())) == [(1, "5"), (2, "x"), (3, "y"), (3, "y")]
    twice, again = overlay.compare_and_set(once, wanted, ["k"], "v", tx.guard_key)
    assert again.where("patch_id = 1").first()["status"] == "already" and sorted(twice.collect()) == sorted(once.collect())


def test_prices(spark):
    items = spark.createDataFrame([("u", 5, 80, False), ("u", 5, 90, True), ("u", 10, 150, True), ("v", 3, 1, True), ("v", 3, 2, True)], "unit string, models int, cost int, qualified boolean")
    got = {(r["unit"], r["models"]): r["cost"] for r in overlay.price_tiers(items, ["unit"], "models", "cost", "qualified").collect()}
    assert got == {("u", 5): 80, ("u", 10): 150}


def test_copy_limits(spark):
    of = lambda *k: spark.range(1).select(roster.copy_limit(F.array(*map(F.lit, k)).cast("array<string>"))).first()[0]
    assert (of(), of("BATTLELINE"), of("DEDICATED TRANSPORT"), of("EPIC HERO")) == (3, None, None, 1)


@pytest.mark.parametrize("common", [1, 50_000])
def test_roster_rules_in_one_pass(spark, monkeypatch, common):
    monkeypatch.setattr(roster, "COMMON", common, raising=False)
    i = F.col("id")
    unit = F.when(i % 10 == 9, F.lit(None)).when(i % 10 == 8, 99).otherwise(F.when(i % 4 == 0, 1).when(i % 4 == 1, 2).otherwise(i % 10 % 3 + 1)).cast("long")
    units = spark.range(0, 23).select((i % 2).alias("roster_id"), unit.alias("unit_id"), (i < 3).alias("warlord"), F.when(i % 3 == 0, F.concat(F.lit("e"), (i % 2).cast("string"))).alias("enhancement"))
    catalogue = spark.createDataFrame([(1, 100, ["EPIC HERO", "CHARACTER"]), (2, None, ["BATTLELINE"]), (3, 700, [])], "unit_id long, price long, keywords array<string>")
    rosters = spark.createDataFrame([(0, "incursion", "d0"), (1, None, "d1"), (2, "onslaught", "d0")], "roster_id long, size string, detachment string")
    costs = {("d0", "e0"): 10, ("d0", "e2"): None}
    found = roster.violations(rosters, units, catalogue, spark.createDataFrame([(*k, v) for k, v in costs.items()], "detachment string, enhancement string, cost int"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 23") <= 2

    entries, about, want = {r[0]: (r[1], r[2]) for r in catalogue.collect()}, {r[0]: (r[1], r[2]) for r in rosters.collect()}, Counter()
    for r, own in itertools.groupby(sorted(units.collect(), key=lambda u: u[0]), key=lambda u: u[0]):
        own, (size, d), points = list(own), about[r], 0
        for _, u, warlord, e in own:
            price, words = entries.get(u, (None, None))
            known, character = words is not None, "CHARACTER" in (words or ())
            points += (price or 0) + (costs.get((d, e)) or 0)
            want += Counter({(r, "unit_not_found"): not known, (r, "unit_unpriced"): known and price is None, (r, "warlord_not_character"): warlord and known and not character})
            if e:
                want += Counter({(r, "enh_unpriced"): costs.get((d, e)) is None, (r, "enh_not_character"): known and not character, (r, "enh_epic_hero"): known and character and "EPIC HERO" in words})
                if (d, e) not in costs:
                    want[r, "enh_wrong_detachment" if d == "d0" else "enh_unverified"] += 1
        for u, n in Counter(x[1] for x in own if x[1] in entries).items():
            most = 1 if "EPIC HERO" in entries[u][1] else None if "BATTLELINE" in entries[u][1] else 3
            want += Counter({(r, "rot_exceeded"): most is not None and n > most, (r, "rot_exempt_uncapped"): most is None and n > 3})
        enh = Counter(x[3] for x in own if x[3])
        want += Counter({(r, "enh_duplicate"): sum(n > 1 for n in enh.values()), (r, "enh_too_many"): enh.total() > 3, (r, "unknown_size"): size is None, (r, "points_over"): points > {"incursion": 1000}.get(size, 2000), (r, "warlord_count"): sum(x[2] for x in own) != 1})
    assert {(x["roster_id"], x["code"]): x["n"] for x in found.collect()} == dict(want)


def test_fuzzy_within_block(spark):
    known = spark.createDataFrame([("a", "Intercessor Squad"), ("b", "Intercessor Squads")], "block string, name string")
    names = spark.createDataFrame([(1, "a", "Intercesor Squad"), (2, "b", "nothing like it")], "name_id int, block string, name string")
    assert [(r["name_id"], r["match"]) for r in resolve.fuzzy(names, known, "block").collect()] == [(1, "intercessor squad")]


def test_fusion_prefers_what_both_lists_have(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, doc_id int, rank int")
    assert [r["doc_id"] for r in retrieve.fuse([a, b]).orderBy("rank").collect()] == [11, 10, 12]


def test_link_injection(spark):
    pages = spark.createDataFrame([(1, "Star Guard and Guard, Guardian; [[x|Guard]]"), (2, None)], "page long, text string")
    got = {r["page"]: (r["text"], r["linked"]) for r in quality.link_names(pages, spark.createDataFrame([("Guard", "g.md"), ("Star Guard", "s.md")], "name string, target string")).collect()}
    assert got == {1: ("[[s.md|Star Guard]] and [[g.md|Guard]], Guardian; [[x|Guard]]", 2), 2: (None, 0)}


def test_packing(spark):
    r = random.Random(4)
    for sizes in ([], [5], [2500, 1, 1999, 1], [r.randint(0, 900) for _ in range(60)]):
        bins, used, number = [], 0, 0
        for s in sizes:
            if used and used + s > 2000:
                used, number = 0, number + 1
            used += s
            bins.append(number)
        starts = [i for i, b in enumerate(bins) if i == 0 or b != bins[i - 1]]
        assert spark.createDataFrame([(sizes,)], "s array<int>").select(ordered.bin_starts(F.col("s"), 2000)).first()[0] == starts


def test_size_pieces(spark):
    text = "aaa\n\nbbb\nccc\n\n\nddddddddddddddd\n"
    rows = spark.createDataFrame([(text,), ("",), (None,), ("x" * 25,)], "t string").select(chunk.size_pieces(F.col("t"), 10)).collect()
    assert [r[0] for r in rows] == [["aaa", "bbb\nccc", "dddddddddd", "ddddd\n"], [], None, ["x" * 10, "x" * 10, "x" * 5]]


def test_placeholders_and_sections(spark):
    html = '<h3>UNITS</h3>A<template id="P:1"></template><h3>OTHER</h3>B<template id="P:9"></template>'
    html += '<div hidden id="S:1">C<template id="P:2"></template></div><script>$RS("S:1","P:1")</script><div hidden id="S:2">D</div><script>$RS("S:2","P:2")</script>'
    page = spark.createDataFrame([(html,), ("no heading",)], "h string")
    assert [r[0] for r in page.select(tables.kept_sections(tables.filled_placeholders(F.col("h")))).collect()] == ["ACD", "no heading"]


def test_merged_tiers(spark):
    rows = spark.createDataFrame([([(5, 80), (10, 150)], [(5, 85), (3, 40)])], "items array<struct<models:int,cost:int>>, listed array<struct<models:int,cost:int>>")
    assert [tuple(x) for x in rows.select(overlay.merged_tiers(F.col("items"), F.col("listed"))).first()[0]] == [(5, 85), (10, 150), (3, 40)]


def test_nearest_against_all_distances(spark):
    r = random.Random(9)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(4)]) for i in range(500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(x["query_id"], x["rank"]): x["vec_id"] for x in retrieve.nearest(frame, frame.where("vec_id < 5").withColumnRenamed("vec_id", "query_id"), 7).collect()}
    for q in range(5):
        order = sorted(rows, key=lambda x: (sum((a - b) ** 2 for a, b in zip(x[1], rows[q][1])), x[0]))
        assert [got[q, k + 1] for k in range(7)] == [i for i, _ in order[:7]]


def test_piped_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id|name|link|\n1| Ultra |x|\n\n2|Short|\n", encoding="utf-8")
    got = tables.piped_text(spark, str(tmp_path / "a.csv")).orderBy("src_ord").collect()
    assert [(r["id"], r["name"], r["link"]) for r in got] == [("1", "Ultra", "x"), ("2", "Short", "")]


def test_piped_text_with_a_header_in_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffid|name|\n1|A|\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("name|id|link\n\nB|2|x\nC\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("", encoding="utf-8")
    got = tables.piped_text(spark, str(tmp_path / "*.csv")).select("id", "name", "link").collect()
    assert sorted(map(tuple, got)) == [("", "C", ""), ("1", "A", ""), ("2", "B", "x")]


def test_patches_and_frontmatter(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"stat_patches": [{"unit_id": "1", "field": "m", "from": "6", "to": "7"}], "resolved": []}')
    assert tables.patches(spark, str(tmp_path / "p.json"), "stat_patches", "unit_id string, field string, `from` string, `to` string").first()["to"] == "7"
    head, body = tables.frontmatter(F.lit("---\nid: 1\n---\nText"))
    assert tuple(spark.range(1).select(head, body).first()) == ("id: 1", "Text")


def test_profiles_xml(spark, tmp_path):
    unit = lambda m: f'<profile name="A" typeName="Unit"><characteristics><characteristic name="M">{m}</characteristic></characteristics></profile>'
    (tmp_path / "c.xml").write_text(f"<catalogue><profiles>{unit(5)}{unit(6)}</profiles></catalogue>")
    assert [tuple(r) for r in tables.profiles_xml(spark, str(tmp_path / "c.xml")).collect()] == [("A", "M", "6")]


def test_incremental_ingest(spark, tmp_path):
    schema = "source string, v int"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: sorted(map(tuple, incremental.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/t", f"{tmp_path}/s", schema, "source").collect()))
    put([("a", 1), ("a", 2), ("b", 3)])
    assert run() == [("a", 1), ("a", 2), ("b", 3)]
    put([("a", 9)])
    assert run() == [("a", 9), ("b", 3)]
    assert run() == [("a", 9), ("b", 3)]


def test_stream_windows_equal_the_batch(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    stream = incremental.windowed_counts(incremental.file_stream(spark, path), late="60 days").select("w.start", "event_type", "n")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = incremental.windowed_counts(spark.read.parquet(path)).select("w.start", "event_type", "n")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 3)
    r = random.Random(1)
    rows = [(i, [r.random() for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = retrieve.nearest(df, df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)
    assert {(x["query_id"], x["vec_id"]) for x in got.where("rank = 1").collect()} == {(i, i) for i in range(0, 200, 20)}
    assert got.count() == 50


def test_layer_floor_reaches_beyond_the_nearest_200(spark, tmp_path):
    docs = [(i, "alpha" if i < 10 else "beta", "src19" if i in (300, 310, 320) else "src5") for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i), 0.0]) for i in range(400)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, "alpha"), (1, "beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = retrieval.q26_layer_floor(spark, str(tmp_path)).where("query_id = 0").orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 9))
    assert [(r["doc_id"], r["layer"]) for r in found[6:]] == [(300, "rules"), (310, "rules")]


def test_cascade(spark):
    canonical = spark.createDataFrame([(1, "Scouts", "SM"), (2, "Scouts", "AM"), (3, "Lion", "DA")], "entity_id long, name string, faction string")
    names = spark.createDataFrame(list(enumerate(["lion", "Scouts", "scouts (am)", "the big cat", "zzz"])), "name_id long, name string")
    aliases = spark.createDataFrame([("The Big Cat", 3)], "alias string, entity_id long")
    got = [(r["how"], r["entity_id"]) for r in resolve.resolve(names, canonical, aliases).orderBy("name_id").collect()]
    assert got == [("exact", 3), ("ambiguous", None), ("qualified", 2), ("alias", 3), ("none", None)]


def test_lint_and_conflicts(spark):
    links = spark.createDataFrame([("p", "a"), ("p", "b.md"), ("p", "c")], "source string, target string")
    pages = spark.createDataFrame([("a.md",), ("b.md",)], "path string")
    assert [r["target"] for r in quality.broken_links(links, pages).collect()] == ["c"]
    names = spark.createDataFrame([("p", "X"), ("q", "x"), ("p", "Y")], "page string, name string")
    found = quality.lint({"links": quality.broken_links(links, pages).withColumn("subject", F.col("target")), "names": quality.name_conflicts(names).withColumn("subject", F.col("name"))})
    assert sorted(map(tuple, found.collect())) == [("links", "c"), ("names", "x")]

def brute_pairs(entities, canonical, cutoff=0.85):
    key = lambda name: name.lower()
    by_key, votes, found = defaultdict(list), defaultdict(Counter), {}
    for c in canonical:
        by_key[key(c[2])].append(c)
    for e, book, name in sorted(entities):
        if name is not None and len(by_key[key(name)]) == 1:
            votes[book][by_key[key(name)][0][1]] += 1
    for e, book, name in entities:
        same = by_key[key(name)] if name is not None else []
        faction = votes[book].most_common(1)[0][0] if votes[book] else None
        inside = [c for c in same if c[1] == faction]
        if len(same) == 1 or len(inside) == 1:
            found[e] = ("exact", same[0][0]) if len(same) == 1 else ("faction", inside[0][0])
        elif same or name is None:
            found[e] = ("ambiguous" if same else "none", None)
        else:
            pool = {k: c for k, cs in by_key.items() for c in cs if len([x for x in cs if faction in (None, x[1])]) == 1 and faction in (None, c[1])}
            near = difflib.get_close_matches(key(name), list(pool), n=1, cutoff=cutoff)
            found[e] = ("fuzzy", pool[near[0]][0]) if near else ("none", None)
    return found


def test_pairing_against_brute_force(spark):
    r = random.Random(3)
    stems = ["".join(r.choice("abcde ") for _ in range(r.randint(1, 14))) or "a" for _ in range(60)]
    canonical = [(i, r.choice(["x", "y", "z"]), r.choice(stems)) for i in range(90)]
    entities = []
    for i in range(250):
        name = r.choice(stems)
        if i % 2:
            at = r.randrange(len(name))
            name = name[:at] + r.choice(["", "b", "ee"]) + name[at + 1 :]
        entities.append((i, r.choice("pqrst") if i % 9 else "no votes", None if i % 50 == 7 else name if i % 9 else name + "q"))
    trim = lambda rows: [(a, b, c and c.strip()) for a, b, c in rows]
    canonical, entities = trim(canonical), trim(entities)
    got = resolve.pair(spark.createDataFrame(entities, "entity_id int, book string, name string"), spark.createDataFrame(canonical, "canonical_id int, faction string, name string"))
    rows = got.collect()
    assert len(rows) == len(entities)
    assert {x["entity_id"]: (x["how"], x["canonical_id"]) for x in rows} == brute_pairs(entities, canonical)
    assert {x["how"] for x in rows} == {"exact", "faction", "ambiguous", "fuzzy", "none"}


def test_a_name_of_many_rows_is_sought_once(spark, monkeypatch):
    known = spark.createDataFrame([(None, "Alpha squad"), ("b", "alpha squid"), ("b", "Alpha squat")], "block string, name string")
    names = spark.range(6000).selectExpr("id as name_id", "if(id % 2 = 0, 'b', null) as block", "'Alph squad' as name")
    asked = []
    inner = resolve.nearest_names
    monkeypatch.setattr(resolve, "nearest_names", lambda *a: asked.append(inner(*a)) or asked[-1])
    got = Counter((r["name_id"] % 2, r["match"]) for r in resolve.fuzzy(names, known, "block").collect())
    assert got == {(0, "alpha squid"): 3000, (1, "alpha squad"): 3000} and asked[0].count() == 2


def test_a_block_of_queries_takes_little_memory():
    r, n = np.random.default_rng(1), 4096
    vectors = pa.array(list(r.normal(size=(n, 64)).astype("float32")))
    tracemalloc.start()
    found = list(retrieve._nearest_rows(iter([pa.RecordBatch.from_arrays([pa.array(range(n)), vectors], ["vec_id", "embedding"])]), np.arange(2048), r.normal(size=(2048, 64)), 200))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0].num_rows >= 2048 * 200 and peak < 250e6


def test_names_are_never_sent_whole_to_all(spark):
    names = spark.createDataFrame([(1, "Alph squad"), (2, "zzz")], "name_id int, name string")
    known = spark.createDataFrame([(7, "Alpha squad", "f"), (8, "Beta", "f")], "entity_id int, name string, faction string")
    told = resolve.cascade(names, known, known.select("name", "entity_id"), spark.createDataFrame([("b", "Beta")], "alias string, name string"), 0.8)
    assert "Broadcast" not in told._jdf.queryExecution().executedPlan().toString()


def test_nearest_names_within_blocks(spark):
    r = random.Random(9)
    names = ["".join(r.choice("abc1") for _ in range(r.randint(1, 9))) for _ in range(60)]
    pool, asked = [(r.choice(["x", "y", None]), r.choice(names)) for _ in range(120)], [(r.choice(["x", "y", "z", None]), n[: len(n) // 2] + n[len(n) // 2 + i % 3 :]) for i, n in enumerate(names)]
    want = {}
    for of, a in set(asked):
        near = sorted(((difflib.SequenceMatcher(None, b, a).ratio(), b) for o, b in set(pool) if o == of and a), reverse=True)
        want |= {(of, a, i + 1): (b, ratio) for i, (ratio, b) in enumerate(near[:2]) if ratio >= 0.7}
    got = resolve.nearest_names(spark.createDataFrame(asked, "of string, name string"), spark.createDataFrame(pool, "of string, name string"), 0.7, 2, "of")
    assert {(x["_of"]["of"], x["a"], x["nth"]): (x["b"], x["ratio"]) for x in got.collect()} == want


def test_pairing_of_the_tables(spark, sf_dir):
    parts = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_name").collect()]
    named = [(k, b, f"{n} of {k}" if k % 3 == 0 else n) for k, b, n in parts]
    entities = [(k, b, n[:2] + n[3:] if k % 5 == 0 else n) for k, b, n in named]
    got = {x["entity_id"]: (x["how"], x["canonical_id"]) for x in retrieval.q55_pairing(spark, sf_dir).collect()}
    assert got == brute_pairs(entities, named)
