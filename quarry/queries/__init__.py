"""Registered queries of the engine's own operators, with the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.queries.registry import QUERIES, SQL


def _load() -> None:
    from quarry.queries import claim, compile, graph, ledger, rank, scan, select, text  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
