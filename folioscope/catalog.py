"""All queries of the library by name, with the SQL that checks them."""

from __future__ import annotations

from folioscope.queries import audit, commands, finals, projects, records, registry, resolve, reviews, rules, sources, style, texts, works
from folioscope.queries.common import Query

THEMES = (style, registry, records, audit, rules, projects, finals, works, commands, resolve, reviews, sources, texts)


def queries() -> dict[str, Query]:
    return {name: query for theme in THEMES for name, query in theme.catalog.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for theme in THEMES for name, sql in theme.catalog.sql.items()}
