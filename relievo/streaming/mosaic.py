"""Incremental mosaics: tiles are blended as they arrive, in any order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def contributions(tiles: DataFrame, bands) -> DataFrame:
    """Weighted terms of (grow, gcol, w, bands): they merge by addition, in any order."""
    return tiles.select(
        "grow", "gcol", *[(F.col("w") * F.col(b)).alias(f"num_{b}") for b in bands],
        *[F.when(F.col(b).isNotNull(), F.col("w")).alias(f"den_{b}") for b in bands])


def summed(log: DataFrame, bands) -> DataFrame:
    return log.groupBy("grow", "gcol").agg(*[
        F.sum(f"{k}_{b}").alias(f"{k}_{b}") for b in bands for k in ("num", "den")])


def first_deliveries(tiles: DataFrame, shape: tuple[int, int], tile_id=("tile",), forget_s: float = 3600.0) -> DataFrame:
    """The pixels of a stream of (tile_id, row, col, ...) that were not delivered before.

    The state is one row per live tile: a bitmap of its pixels. A tile that gets nothing for `forget_s`
    (processing time) loses its state, so the state follows the tiles in flight, not the mosaic; a repeat
    that comes later still counts as new. A pixel outside `shape` is an error.
    """
    height, width = shape

    def keep(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        bits = np.frombuffer(held.get[0], "u1") if held.exists else np.zeros(-(-height * width // 8), "u1")
        seen = np.unpackbits(bits)[:height * width].astype(bool)
        for pdf in batches:
            row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
            if ((row < 0) | (row >= height) | (col < 0) | (col >= width)).any():
                raise ValueError(f"tile {key} has a pixel outside {height} x {width}")
            at = row * width + col
            new = ~seen[at] & ~pd.Series(at).duplicated().to_numpy()
            seen[at] = True
            yield pdf[new]
        held.update((np.packbits(seen).tobytes(),))
        held.setTimeoutDuration(int(forget_s * 1000))

    return tiles.groupBy(*tile_id).applyInPandasWithState(
        keep, tiles.schema, "seen binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def blend_stream(tiles: DataFrame, bands, log_path: str, checkpoint: str, shape: tuple[int, int], tile_id=("tile",),
                 forget_s: float = 3600.0, trigger: dict | None = None):
    """Start the streaming blend: the weighted terms of every new tile go to a log of parquet files.

    No mosaic-sized state is held. The file sink commits each micro-batch once, so the mosaic is a
    sum over the log (`read_mosaic`), shortened by `compact`. `first_deliveries` removes repeats.
    """
    unique = first_deliveries(tiles, shape, tile_id, forget_s)
    return _logged(contributions(unique, list(bands)), log_path, checkpoint, trigger)


def read_mosaic(spark: SparkSession, log_path: str, bands) -> DataFrame:
    """The mosaic so far."""
    bands = list(bands)
    s = summed(spark.read.parquet(log_path), bands)
    return s.select("grow", "gcol", *[
        F.when(F.col(f"den_{b}") > 0, F.col(f"num_{b}") / F.col(f"den_{b}")).alias(b) for b in bands])


def compact(spark: SparkSession, log_path: str, target: str, bands):
    """Write the summed log to a new folder that `read_mosaic` reads as well."""
    summed(spark.read.parquet(log_path), list(bands)).write.parquet(target)


def log_band(blocks: DataFrame, log_path: str, checkpoint: str, trigger: dict | None = None):
    """Start logging the blocks of a stream to a folder of parquet files, each micro-batch once.

    No state is held and nothing goes to the driver; `arrived_band` over the log is the band so far.
    """
    return _logged(blocks, log_path, checkpoint, trigger)


def _logged(rows: DataFrame, log_path: str, checkpoint: str, trigger: dict | None):
    """Start a parquet log. A run over what is available ends with the data: processing-time timers would
    otherwise ask for one more empty batch for ever, so there they fire in the next batch that has rows."""
    spark, flag = rows.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    trigger = trigger or {"availableNow": True}
    before = spark.conf.get(flag, None)
    if "availableNow" in trigger:
        spark.conf.set(flag, "false")  # a stream keeps the settings it started with
    try:
        return (rows.writeStream.outputMode("append").format("parquet").option("path", log_path)
                .option("checkpointLocation", checkpoint).trigger(**trigger).start())
    finally:
        if before is None:
            spark.conf.unset(flag)
        else:
            spark.conf.set(flag, before)


def arrived_band(blocks: DataFrame, row: str = "row", keys=("dem",)) -> DataFrame:
    """Rows of a raw array that have arrived so far, over a log of blocks or as a running aggregate over a stream."""
    return blocks.groupBy(*keys).agg((F.max(row) + 1).alias("available_rows"))
