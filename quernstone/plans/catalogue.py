"""The query catalogue: every query by name, and its SQL for another engine."""

from __future__ import annotations

from . import assembly, building, knowledge, quality, relational, retrieval

_FAMILIES = (relational, retrieval, building, quality, knowledge, assembly)
QUERIES = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
ORACLE_SQL = {name: sql for family in _FAMILIES for name, sql in family.ORACLE_SQL.items()}
FLAGSHIP = "q02_nested_rollup"
