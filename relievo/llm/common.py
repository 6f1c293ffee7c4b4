"""Small helpers of the operators: documents as (identifier, text), and the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relievo.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A word, as the contracts define it: a run of anything but space, tab, newline, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it on whole tables, its check."""
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Two columns `d` (identifier) and `t` (text, NULL as empty); nothing else is read."""
    return docs.select(F.col(key).alias("d"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """`texts` plus `tv`, a digest of the text: (d, tv) names one document even where identifiers repeat.

    Columns named in `others` follow as "other <name>", so they clash with nothing.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("d"), t.alias("t"), F.xxhash64(t).alias("tv"), *[F.col(c).alias(f"other {c}") for c in others])


#: Stands for a NULL identifier inside joins; below every identifier in use, so it sorts first too.
NO_ID = -(1 << 63)


def inner_id(col: str = "d"):
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def outer_id(col: str = "d"):
    return F.when(F.col(col) != F.lit(NO_ID), F.col(col))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written to the shared folder and read back: computed once, safe from lost executors."""
    return materialise(df, purpose)
