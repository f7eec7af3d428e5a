"""Registered queries: name -> (Spark callable, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; doubles are rounded, as the SQL rounds them."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    def one(c: str, kind: str) -> Column:
        return F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c)

    return frame.select(*[one(c, kind) for c, kind in frame.dtypes])
