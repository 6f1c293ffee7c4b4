"""Small helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(x) -> Column:
    """A column from a name, a Python number or a column."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def clamp(x, lo, hi) -> Column:
    """Limit to [lo, hi]; NULL stays NULL (plain `least`/`greatest` would skip it)."""
    x = as_col(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, as_col(hi)), as_col(lo)))


def mean_or_zero(value, mask) -> Column:
    """Aggregate: mean of `value` where `mask`, 0 where nothing is selected."""
    value, mask = as_col(value), F.coalesce(as_col(mask), F.lit(False))
    picked = mask & value.isNotNull()
    total = F.coalesce(F.sum(F.when(picked, value)), F.lit(0.0))
    return total / F.greatest(F.count_if(picked), F.lit(1))


def mean_where(value, mask) -> Column:
    """Aggregate: mean of `value` where `mask`, NULL where nothing is selected."""
    return F.avg(F.when(as_col(mask), as_col(value)))


def draws(count: int, *seed) -> list[Column]:
    """`count` reproducible uniform draws in (0, 1), up to six, from the seed columns.

    They are digits of one digest of the seed text: a retried task sees the same draws, the
    digest is computed once per row, and another SQL engine can reproduce them.
    """
    if not 1 <= count <= 6:
        raise ValueError("one digest gives one to six draws")
    digest = F.md5(F.concat_ws(":", *[as_col(s).cast("string") for s in seed]))
    return [(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("double") + 0.5) / 1048576.0
            for i in range(count)]


def uniform(*seed) -> Column:
    """One reproducible uniform draw in (0, 1)."""
    return draws(1, *seed)[0]


def attach(df: DataFrame, summary: DataFrame, keys=(), how: str = "inner") -> DataFrame:
    """Add the columns of a grouped summary: a join on the keys, or, without keys, a scalar
    subquery over the summary's single row (more than one row is an error)."""
    keys = list(keys)
    if keys:
        return df.join(summary, keys, how)
    names = summary.columns
    row = summary.select(F.struct(*names).alias("_row")).scalar()
    return df.withColumn("_row", row).select("*", *[F.col("_row")[n].alias(n) for n in names]).drop("_row")
