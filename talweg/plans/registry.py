"""Registered queries and their SQL.

Each query is a function of ``Tables`` and stands under its own name; the SQL
that DuckDB runs on the same tables is given beside it, where SQL can say it.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talweg.catalog import Tables

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "actor_credit_ranking"
MODULES = ("aggregation", "claims", "credit", "evaluations", "identity", "joins", "reports", "scalars", "statistics", "texts", "windows", "writes")

_found: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of ``Tables`` as a query, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _found[f.__name__] = (f, sql)
        return f

    return add


def _load() -> dict[str, tuple[Callable[[Tables], DataFrame], str | None]]:
    for m in MODULES:
        importlib.import_module(f"talweg.plans.{m}")
    return _found


def queries() -> dict[str, Query]:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _load().items() if sql}
