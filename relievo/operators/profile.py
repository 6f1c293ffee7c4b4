"""Statistics of elevation transects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def profile_stats(points: DataFrame, keys=("profile",), distance: str = "distance_m",
                  height: str = "height_m", segment_m: float = 100_000.0) -> DataFrame:
    """Relief, length and slopes of each transect; transects with fewer than two heights are left out.

    Missing heights are skipped, not zero. A transect is worked in segments of `segment_m`: slopes
    inside a segment come from a window, the joints between segments from one row per segment, so
    a transect of any length spreads over tasks.
    """
    keys = list(keys)
    d, h = F.col(distance), F.col(height)
    valid = points.where(h.isNotNull()).withColumn("_seg", F.floor(d / segment_m))
    w = Window.partitionBy(*keys, "_seg").orderBy(distance, height)
    run = d - F.lag(d).over(w)
    slope = F.when(run > 0, F.abs(F.atan((h - F.lag(h).over(w)) / run)))
    place = F.struct(d.alias("d"), h.alias("h"))
    seg = (valid.withColumn("_slope", slope).groupBy(*keys, "_seg").agg(
        F.count(F.lit(1)).alias("_n"), F.min(h).alias("_min"), F.max(h).alias("_max"),
        F.min(place).alias("_first"), F.max(place).alias("_last"),
        F.sum("_slope").alias("_sum"), F.count("_slope").alias("_k"), F.max("_slope").alias("_steep")))
    along = Window.partitionBy(*keys).orderBy("_seg")
    gap = F.col("_first.d") - F.lag("_last.d").over(along)
    joint = F.when(gap > 0, F.abs(F.atan((F.col("_first.h") - F.lag("_last.h").over(along)) / gap)))
    seg = seg.withColumn("_joint", joint)
    total = F.coalesce(F.sum("_sum"), F.lit(0.0)) + F.coalesce(F.sum("_joint"), F.lit(0.0))
    steps = F.sum("_k") + F.count("_joint")
    out = seg.groupBy(*keys).agg(
        F.sum("_n").alias("_n"), F.min("_min").alias("min_m"), F.max("_max").alias("max_m"),
        (F.max("_max") - F.min("_min")).alias("relief_m"),
        ((F.max("_last.d") - F.min("_first.d")) / 1000.0).alias("length_km"),
        F.degrees(total / F.greatest(steps, F.lit(1))).alias("mean_slope_deg"),
        F.degrees(F.greatest(F.max("_steep"), F.max("_joint"), F.lit(0.0))).alias("max_slope_deg"))
    return out.where(F.col("_n") >= 2).drop("_n")


def consecutive_slopes(points: DataFrame, keys=("profile",), distance: str = "distance_m",
                       height: str = "height_m", segment_m: float = 100_000.0) -> DataFrame:
    """(keys, distance, slope) between each valid point and the one before it.

    The last point of a segment is handed to the next segment that has points, so the window
    stays within a segment.
    """
    keys = list(keys)
    valid = points.where(F.col(height).isNotNull()).withColumn("_seg", F.floor(F.col(distance) / segment_m))
    last = valid.groupBy(*keys, "_seg").agg(F.max(F.struct(distance, height)).alias("_l"))
    along = Window.partitionBy(*keys).orderBy("_seg")
    carried = last.select(*keys, F.lead("_seg").over(along).alias("_seg"),
                          F.col(f"_l.{distance}").alias(distance), F.col(f"_l.{height}").alias(height),
                          F.lit(True).alias("_carried")).where(F.col("_seg").isNotNull())
    both = valid.select(*keys, "_seg", distance, height, F.lit(False).alias("_carried")).unionByName(carried)
    w = Window.partitionBy(*keys, "_seg").orderBy(distance, height)
    dx = F.col(distance) - F.lag(distance).over(w)
    dz = F.col(height) - F.lag(height).over(w)
    return (both.withColumn("slope", F.when(dx > 0, F.abs(F.atan(dz / dx))))
            .where(~F.col("_carried") & F.col("slope").isNotNull())
            .select(*keys, distance, "slope"))
