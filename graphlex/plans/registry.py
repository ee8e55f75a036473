"""Registers queries by name, with the SQL that a second engine checks them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and fractions rounded to 6 digits, as the SQL has them."""
    kinds = {"int": lambda c: c.cast("bigint"), "smallint": lambda c: c.cast("bigint"), "tinyint": lambda c: c.cast("bigint"), "double": lambda c: F.round(c, 6) + F.lit(0.0), "float": lambda c: F.round(c.cast("double"), 6)}
    return df.select(*[kinds[t](F.col(c)).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
