"""Registry of the queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits, ties nudged upward so that both engines agree."""
    return df.select(*[F.round(F.col(f.name) + F.lit(1e-10), 6).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in df.schema.fields])


def query(sql: str | None = None, *, with_: str = "", doubles: str = "", name: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its doubles (named in ``doubles`` for the SQL) are rounded on both sides."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = lambda spark, folder: _rounded(fn(spark, folder))
        if sql is not None:
            replace = ", ".join(f"round({c}::DOUBLE+1e-10,6) AS {c}" for c in doubles.split())
            inner = f"SELECT * REPLACE ({replace}) FROM ({sql})" if replace else sql
            ORACLE_SQL[key] = f"WITH {with_} {inner}" if with_ else inner
        return fn

    return register
