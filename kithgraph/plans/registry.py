"""Named queries: a Spark plan over the graph and, where SQL can say it, the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kithgraph.sources.graph import GRAPH_SQL, Graph

Plan = Callable[[Graph], DataFrame]
PLANS: dict[str, tuple[Plan, str | None]] = {}


def query(name: str, sql: str | None = None, graph: bool = True) -> Callable[[Plan], Plan]:
    """Register a plan.  ``graph=True`` puts the graph's common table expressions before the SQL.

    SQL that needs further ones starts with ``, name AS (...)``.
    """
    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        text = None if sql is None else (GRAPH_SQL + sql if graph else sql)
        PLANS[name] = (plan, text)
        return plan

    return add


def bind(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: plan(Graph(spark, folder))


def load_all() -> dict[str, tuple[Plan, str | None]]:
    from kithgraph.plans import (  # noqa: F401
        alerts, beliefs, concepts, feedback, functions, graph_views, merge, resolution, search, streams, text, vectors)

    return PLANS
