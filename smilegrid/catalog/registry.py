"""Registered queries: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .inputs import Market, market_for
from .sql import compose

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame, others: str, doubles: str, digits: int) -> DataFrame:
    """Select the compared columns; doubles are rounded so that summation order
    does not matter."""
    return df.select(
        *others.split(), *[(F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) for c in doubles.split()]
    )


def register(
    name: str,
    build: Callable[[Market], DataFrame],
    others: str = "",
    doubles: str = "",
    sql: str | None = None,
    digits: int = 6,
) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = lambda spark, folder: tidy(build(market_for(spark, folder)), others, doubles, digits)
    if sql is not None:
        source = sql if " " in sql.strip() else f"SELECT * FROM {sql.strip()}"
        columns = [*[f'"{c}"' for c in others.split()], *[f'R{digits}("{c}") AS "{c}"' for c in doubles.split()]]
        ORACLES[name] = compose(f"SELECT {', '.join(columns)} FROM ({source})")
