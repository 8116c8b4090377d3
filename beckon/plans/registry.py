"""Registry of named queries: a Spark callable plus, where SQL can say it, oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from beckon.plans import fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, uses: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)``; ``uses`` names the fixture tables the oracle text reads."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = fixtures.duckdb_text(oracle, uses)
        return fn

    return register
