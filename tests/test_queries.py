"""Every catalogue query against its SQL in another engine."""

from collections import Counter

import duckdb
import pytest

from quernstone.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, con, name):
    found = catalogue.QUERIES[name](spark, sf_dir)
    rows = found.collect()
    assert rows
    if name in catalogue.ORACLE_SQL:
        cursor = con.execute(catalogue.ORACLE_SQL[name])
        kinds = {d[0]: str(d[1]) for d in cursor.description}
        names = list(kinds)
        assert sorted(names) == sorted(found.columns)
        assert {c: TYPES[t] for c, t in found.dtypes} == kinds
        assert Counter(tuple(r[c] for c in names) for r in rows) == Counter(cursor.fetchall())


def test_every_query_but_six_has_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"q20_fuzzy_resolve", "q49_link_injection", "q55_pairing", "q56_name_replacement", "q63_link_repair", "q67_cascade"}


def test_names_are_numbered_without_gaps():
    assert sorted(int(n[1:3]) for n in catalogue.QUERIES) == list(range(1, len(catalogue.QUERIES) + 1))


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).columns) == 4
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
