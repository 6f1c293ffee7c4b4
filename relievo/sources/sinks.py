"""Sinks for results, payload files and region summaries."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(table: DataFrame, path: str, mode: str = "errorifexists"):
    """A metric or calibration table as JSON lines."""
    table.write.mode(mode).json(path)


def write_payload_files(tiles: DataFrame, root: str, suffix: str = "terrain", payload: str = "payload"):
    """One `{root}/{z}/{x}/{y}.{suffix}` file per row on shared storage.

    Each file is written under a temporary name and moved, so a repeated task leaves a whole file.
    """
    def write(rows):
        for r in rows:
            folder = os.path.join(root, str(r["z"]), str(r["x"]))
            os.makedirs(folder, exist_ok=True)
            target = os.path.join(folder, f"{r['y']}.{suffix}")
            part = f"{target}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(bytes(r[payload]))
            os.replace(part, target)

    tiles.select("z", "x", "y", payload).repartition("z", "x").foreachPartition(write)


def product_summary(product: DataFrame, keys=(), pixels=None) -> DataFrame:
    """Height, sigma, relief over altimetry and coverage of a blended product."""
    n = F.count(F.lit(1)) if pixels is None else F.lit(float(pixels))
    return product.groupBy(*keys).agg(
        F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"),
        F.avg("sigma").alias("sigma_mean"), F.max("sigma").alias("sigma_max"),
        F.stddev_pop(F.col("z") - F.col("gtdr")).alias("relief_over_gtdr_m"),
        (F.count("z") / n).alias("coverage"))
