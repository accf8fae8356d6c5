"""The list of plans: each is a Spark function and, where SQL can express it, SQL over the same derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitchloom.sources import derive

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def plan(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan; sql goes on after the CTEs of the derived tables."""

    def add(f: Plan) -> Plan:
        PLANS[name] = f
        if sql is not None:
            SQL[name] = f"WITH {derive.SQL.strip()}{',' if sql.lstrip().startswith('.') else ' '}{sql.lstrip().removeprefix('.')}"
        return f

    return add
