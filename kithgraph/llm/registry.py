"""Named queries of the subpackage: (spark, folder) -> DataFrame, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = (run, sql)
        return run

    return add


def load_all() -> dict[str, tuple[Query, str | None]]:
    from kithgraph.llm import queries  # noqa: F401

    return QUERIES
