"""Registered queries: a name, a function of the tables, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lectern.plans.standin import Tables, ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, with_: str = "") -> Callable:
    """Register a function of ``Tables`` under its name; ``with_`` holds further CTEs."""

    def add(f: Callable[[Tables], DataFrame]):
        name = f.__name__.rstrip("_")

        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            SQL[name] = ctes() + (",\n" + with_ if with_ else "") + "\n" + sql
        return f

    return add
