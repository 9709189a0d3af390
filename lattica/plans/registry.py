"""All queries of the library and their SQL for DuckDB."""

from __future__ import annotations

from lattica.plans import catalogs, forms, functions, relational
from lattica.session import Query

FLAGSHIP = "catalog_migration_plan"

_FAMILIES = (relational.QUERIES, catalogs.QUERIES, functions.QUERIES, forms.QUERIES)


def queries() -> dict[str, Query]:
    return {name: q for family in _FAMILIES for name, (q, _) in family.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for family in _FAMILIES for name, (_, text) in family.items() if text}
