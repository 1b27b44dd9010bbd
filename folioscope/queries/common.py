"""A small registry of queries, and SQL fragments that several oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries of one theme, with their SQL."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[name] = query
            if sql:
                self.sql[name] = sql
            return query

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: DuckDB: words, paragraphs of over 30 characters and their sentences for each document.
SQL_PARAS = r"""
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, text, [x FOR x IN [trim(regexp_replace(y, '\s+', ' ', 'g')) FOR y IN string_split(text, chr(10))] IF length(x) > 30] AS paras FROM d),
s AS (SELECT doc_id, text, paras, flatten([[z FOR z IN string_split(regexp_replace(q, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) IF length(z) > 5 AND length(trim(z)) > 0] FOR q IN paras]) AS sents FROM p)
"""


def sql_cv(values: str) -> str:
    """Sample standard deviation by mean of a DuckDB list of doubles; 0 where there is no spread."""
    return f"(CASE WHEN len({values}) > 0 AND list_avg({values}) > 0 THEN coalesce(list_stddev_samp({values}), 0) / list_avg({values}) ELSE 0 END)"


def sql_bounded(text: str, phrase: str) -> str:
    """How often a phrase of words stands in a text with no word character beside it: bounds are doubled, so that two matches never share one."""
    doubled = rf"regexp_replace(' ' || {text} || ' ', '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"
    return rf"len(regexp_extract_all({doubled}, '[^\p{{L}}\p{{N}}_]{phrase}[^\p{{L}}\p{{N}}_]'))"
