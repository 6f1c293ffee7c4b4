"""Named queries over the test tables and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, so both engines report one integer type."""
    narrow = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(*[F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, narrow)
                       else F.col(f.name) for f in df.schema])


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it on whole tables, its check."""
    def keep(fn):
        QUERIES[name] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def rounded(x, digits: int = 6) -> Column:
    """Rounding to a grid in plain arithmetic, equal in both engines and free of negative zero.

    The offset is not one half, so decimal data does not sit on the rounding edge.
    """
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * (10.0 ** digits) + 0.4371) / (10.0 ** digits)


def rounded_cols(df: DataFrame, digits: int = 6, **per) -> DataFrame:
    """Round every DOUBLE column."""
    return df.select(*[rounded(f.name, per.get(f.name, digits)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema])


def rs(expr: str, digits: int = 6) -> str:
    """The same rounding as SQL text."""
    return f"(floor(({expr})*1e{digits}+0.4371e0)/1e{digits})"
