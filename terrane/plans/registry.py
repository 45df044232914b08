"""Where queries register: each is a function of (spark, folder of tables), beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its function's name, without the q_ in front."""

    def keep(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r(c, digits: int = 6):
    return F.round(c, digits)
