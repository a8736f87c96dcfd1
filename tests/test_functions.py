"""Normalisers and parsers on stated values."""

import pytest
from pyspark.sql import functions as F

from quernstone.functions import stats, text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


CASES = [
    (lambda: tx.match_key(F.lit(" O’Neil ")), "o'neil"),
    (lambda: tx.compare_key(F.lit('12" ')), "12"),
    (lambda: tx.guard_key(F.lit('20+"')), "20+"),
    (lambda: tx.guard_key(F.lit('20"')), "20"),
    (lambda: tx.stat_key(F.lit('3+"')), "3"),
    (lambda: tx.text_key(F.lit("<b>Its</b>  ‘own’ – dash\n")), "its 'own' - dash"),
    (lambda: tx.unit_key(F.lit("Grey  Knights")), "grey knight"),
    (lambda: tx.heading_key(F.lit("Ol’ Mek (x)")), "OL' MEK X"),
    (lambda: tx.slug(F.lit("The Lion's Blade!")), "the-lions-blade"),
    (lambda: tx.clean_html(F.lit("<p>a &amp; b<br>c</p>")), "a & b c"),
    (lambda: tx.strip_code_fence(F.lit("```md\nx\n```")), "x"),
    (lambda: tx.strip_links(F.lit("[[a/b.md|B]] and [[c]]")), "B and c"),
    (lambda: tx.link_targets(F.lit("[[a/b.md|B]] and [[c]]")), ["a/b.md", "c"]),
    (lambda: tx.escape_pipes(F.lit("[[a|b]] | c")), "[[a\\|b]] | c"),
    (lambda: tx.cjk_bigrams(F.lit("Ab 星际战士")), ["ab", "星际", "际战", "战士"]),
    (lambda: tx.summary(F.lit("# H\n\n> q\nFirst [[x|line]].\nSecond")), "First line."),
    (lambda: tx.file_of_url(F.lit("https://x/y/z.pdf?a=1#b")), "z.pdf"),
    (lambda: tx.folder_of(F.lit("units/a.md")), "units"),
    (lambda: tx.folder_of(F.lit("a.md")), None),
    (lambda: tx.verdict(F.lit("❌ correct")), "wrong"),
    (lambda: tx.stat_token(F.lit('6"')), "6"),
    (lambda: tx.stat_token(F.lit("3+")), "3"),
    (lambda: tx.as_bool(F.lit("Yes")), True),
    (lambda: tx.as_bool(F.lit(None)), False),
    (lambda: tx.positive_int(F.lit("0"), 5), None),
    (lambda: tx.positive_int(F.lit("4"), 5), 4),
    (lambda: F.to_json(tx.loadout(F.lit("bolter:3, knife"))), '[{"name":"bolter","count":3},{"name":"knife","count":1}]'),
    (lambda: tx.loadout(F.lit("bolter:x")), None),
    (lambda: tx.version_rank(F.lit("pack 20251112"))[0], 4),
    (lambda: tx.version_rank(F.lit("pack V1.20"))[0], 3),
    (lambda: tx.version_rank(F.lit("pack 1.2"))[0], 2),
    (lambda: tx.version_rank(F.lit("pack 1120"))[0], 1),
    (lambda: tx.heading_scripts(F.lit("星际战士 Space Marines"))[1], "Space Marines"),
    (lambda: tx.heading_scripts(F.lit("星际战士 Space Marines"))[0], "星际战士"),
    (lambda: tx.heading_scripts(F.lit("Only Latin"))[0], None),
    (lambda: tx.edition_layer(F.lit("11"), F.lit("rules")), "[11/rules]"),
    (lambda: stats.stat_int(F.lit("3+")), 3),
    (lambda: stats.stat_int(F.lit("N/A")), None),
    (lambda: stats.armour_piercing(F.lit("−2")), -2),
    (lambda: stats.armour_piercing(F.lit("x")), 0),
    (lambda: stats.keyword(F.lit("RAPID FIRE 2"))["name"], "rapid_fire"),
    (lambda: stats.keyword(F.lit("Anti-Infantry 4+"))["value"], 4),
    (lambda: stats.keyword(F.lit("Twin-linked"))["name"], "twin_linked"),
    (lambda: stats.cost(F.lit(" 20 ")), 20),
    (lambda: stats.cost(F.lit("abc")), None),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_function(spark, case):
    column, expected = CASES[case]
    assert one(spark, column()) == expected
