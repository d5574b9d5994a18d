"""Queries over the given tables and DuckDB SQL with the same rows, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataq.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a function of the tables under ``name``; ``oracle`` is SQL over views of the same tables."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put
