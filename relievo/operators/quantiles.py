"""Exact grouped quantiles that do not gather a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.base import as_col, attach
from ..session import materialise

SUB_BUCKETS = 1024


def exact_quantiles(df: DataFrame, keys, value, quantiles: dict[str, float], mode: str = "linear",
                    accuracy: int = 10_000, extra=()) -> DataFrame:
    """Exact quantiles per group, as (keys, n, <extra>..., <name>...).

    mode "linear" interpolates between the two neighbouring ranks (the median of an even count
    is the mean of the middle pair); "disc" takes the smallest value whose cumulative share
    reaches q. One path for groups of every size: see `spread_quantiles`. `extra` are aggregates to
    add from the same pass. Rows with a NULL key are not a group.
    """
    return spread_quantiles(df, keys, value, quantiles, mode, accuracy, extra)


def _rank(n, q: float, mode: str):
    if mode == "disc":
        return F.greatest(F.ceil(n * q - 1e-9) - 1, F.lit(0)).cast("double")
    return (n - 1) * F.lit(q)


def spread_quantiles(df: DataFrame, keys, value, quantiles: dict[str, float], mode: str = "linear",
                     accuracy: int = 10_000, extra=()) -> DataFrame:
    """Groups of any size, over all tasks.

    Built-in `percentile` keeps every distinct value of a group in one buffer. Here a mergeable
    sketch of bounded size first brackets each wanted rank; a second pass counts what lies
    outside the brackets and ranks the distinct values inside them, in sub-buckets that are
    separate window groups. Both passes aggregate before they shuffle, so a group that holds a
    third of the data stays spread over all tasks. The brackets are written first: with their size known, those of
    a few groups reach the rows without a shuffle that would bring each group to one task.
    """
    keys, names = list(keys), list(quantiles)
    src = df.where(as_col(value).isNotNull()).withColumn("_v", as_col(value).cast("double"))
    slack = 2.0 / accuracy
    wanted = []
    for q in quantiles.values():
        wanted += [max(q - slack, 0.0), min(q + slack, 1.0)]
    stats = src.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", wanted, accuracy).alias("_b"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"), *extra)
    marks = {}
    for i, q in enumerate(quantiles.values()):
        marks[f"_k{i}"] = _rank(F.col("n"), q, mode)
        marks[f"_lo{i}"] = F.col("_min") if q - slack <= 0 else F.col("_b")[2 * i]
        marks[f"_hi{i}"] = F.col("_max") if q + slack >= 1 else F.col("_b")[2 * i + 1]
    stats = materialise(stats.withColumns(marks).drop("_b", "_min", "_max"), "brackets")

    v = F.col("_v")
    tagged = attach(src.select(*keys, "_v"), stats.select(*keys, *marks), keys)
    zone, sub = F.lit(0), None
    for i in range(len(names)):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        zone = zone + (v >= lo).cast("int") + (v > hi).cast("int")
        here = F.when(hi > lo, F.floor((v - lo) / (hi - lo) * (SUB_BUCKETS - 1)).cast("int")
                      ).otherwise(F.lit(0))
        hit = (v >= lo) & (v <= hi)
        sub = F.when(hit, here) if sub is None else sub.when(hit, here)
    # Values outside every bracket collapse to one counted row per zone (sub-bucket -1).
    counted = (tagged.select(*keys, "_v", zone.alias("_zone"), sub.otherwise(F.lit(-1)).alias("_sub"))
               .groupBy(*keys, "_zone", "_sub", F.when(F.col("_sub") >= 0, v).alias("_x"))
               .agg(F.count(F.lit(1)).alias("_c")))
    cell = [*keys, "_zone", "_sub"]
    before = Window.partitionBy(*keys).orderBy("_zone", "_sub").rowsBetween(
        Window.unboundedPreceding, -1)
    base = counted.groupBy(*cell).agg(F.sum("_c").alias("_total")).withColumn(
        "_base", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*cell).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = attach(counted.withColumn("_run", F.sum("_c").over(inside)).join(base, cell), stats, keys)
    top = F.col("_base") + F.col("_run")
    low = top - F.col("_c")

    picks = []
    for i in range(len(names)):
        for tag, r in (("a", F.floor(F.col(f"_k{i}"))), ("b", F.ceil(F.col(f"_k{i}")))):
            picks.append(F.max(F.when((low <= r) & (r < top), F.col("_x"))).alias(f"_{tag}{i}"))
    carried = [c for c in stats.columns if c not in keys]
    out = ranked.groupBy(*keys).agg(*picks, *[F.first(c).alias(c) for c in carried])
    for i, name in enumerate(names):
        k = F.col(f"_k{i}")
        met = F.col(f"_a{i}").isNotNull() & F.col(f"_b{i}").isNotNull()
        # A bracket that misses its rank is an error, never a silent NULL.
        out = out.withColumn(name, F.when(met, F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (k - F.floor(k)))
                             .otherwise(F.raise_error(F.lit(f"no value at the rank of {name}")).cast("double")))
    kept = [c for c in carried if not c.startswith(("_k", "_lo", "_hi"))]
    return out.select(*keys, *kept, *names)
