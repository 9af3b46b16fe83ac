"""Every query over the star-schema tables, with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Register a function of ``Base`` under its name; ``sql`` None where SQL can't say the same."""
    from gristmill.plans.base import Base
    from gristmill.plans.sql import sql as whole

    def add(f: Callable[[Base], DataFrame]) -> Callable[[Base], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Base(spark, folder))
        if sql is not None:
            ORACLES[f.__name__] = whole(sql)
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from gristmill.plans import corpus, recall, rerank, stages  # noqa: F401


load()
