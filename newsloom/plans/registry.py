"""All registered queries of the core library, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "item_list"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name; ``sql`` states the same rows for another engine."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


from . import arrivals, circuits, constraints, content, cubes, cursors, desk, evaluation, extraction, gates, health, intake, lineage, memory, observations, operations, policy, registries, signals, snapshots, text_gates, texts, topics, wording  # noqa: E402, F401  they register themselves
