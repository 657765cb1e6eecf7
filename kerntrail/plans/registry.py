"""Queries by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    """To six decimals, and no negative zero, so that sums in another order agree."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def blocks(df: DataFrame) -> int:
    from ..operators.pairs import block_count

    return block_count(df.count(), parallel=df.sparkSession.sparkContext.defaultParallelism)
