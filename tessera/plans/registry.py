"""Where queries are kept by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with SQL for the same rows if any."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            # the nudge of functions.numbers.rounded
            SQL[f.__name__] = sql.replace(", 8)", " + 1e-11, 8)").replace(", 6)", " + 1e-9, 6)")
        return f

    return keep
