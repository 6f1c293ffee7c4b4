"""Tile store: parquet partitioned by quadrangle, with one metadata row."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.augment import crop_origin
from ..operators.joins import split
from ..operators.masks import inside_latitudes


def sliced(tiled: DataFrame, tiles: DataFrame, tiles_per_file: int) -> tuple[DataFrame, int]:
    """Rows with (quad, tile) and the slice `_s` of the quadrangle that they are written with, and the slices of all.

    The counts are one row a quadrangle, of which a sphere has 450.
    """
    files = tiles.groupBy("quad").agg(F.ceil(F.count(F.lit(1)) / tiles_per_file).alias("_files"))
    of = F.pmod(F.xxhash64("tile"), F.coalesce("_files", F.lit(1)))
    count = files.agg(F.coalesce(F.sum("_files"), F.lit(1)).alias("n")).first()["n"]
    return tiled.join(F.broadcast(files), "quad", "left").withColumn("_s", of).drop("_files"), int(count)


def write_sorted(pixels: DataFrame, path: str, mode: str = "errorifexists"):
    """Write pixels that `sliced` has dealt to tasks, each sorted by quadrangle, without a shuffle."""
    pixels.write.mode(mode).partitionBy("quad").parquet(f"{path}/pixel")


def write_tiles(tiles: DataFrame, path: str, meta: dict, mode: str = "errorifexists"):
    """Write the tile rows partitioned by quadrangle, and the settings."""
    tiles.repartition("quad").write.mode(mode).partitionBy("quad").parquet(f"{path}/tile")
    tiles.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").write.mode(mode).json(f"{path}/meta")


def write_store(pixels: DataFrame, tiles: DataFrame, path: str, meta: dict, mode: str = "errorifexists",
                tiles_per_file: int = 16):
    """Write pixels (with `quad`) and tile rows partitioned by quadrangle, and the settings.

    A quadrangle gets a file for every `tiles_per_file` tiles, so a crowded one is written by many tasks and
    a sparse one leaves no small files.
    """
    dealt, _ = sliced(pixels, tiles, tiles_per_file)
    write_sorted(dealt.repartition("quad", "_s").drop("_s").sortWithinPartitions("quad", "tile", "row", "col"), path, mode)
    write_tiles(tiles, path, meta, mode)


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.json(f"{path}/meta").first()["meta"])


def select_tiles(tiles: DataFrame, held_out: DataFrame, part: str, on: str = "quad",
                 max_lat: float = 80.0, require_stereo: bool = False, lat: str = "lat_deg") -> DataFrame:
    """Tiles of a split, within the latitude gate and, if asked, with a stereo DEM."""
    t = tiles.where(inside_latitudes(lat, max_lat))
    if require_stereo:
        t = t.where(F.col("has_stereo_dem").cast("double") > 0.5)  # a flag or a share
    return split(t, held_out, part, on)


def core_crop(pixels: DataFrame, margin: int, core: int) -> DataFrame:
    """The scored core of each tile, re-based to (0, 0); a plain range, so it reaches the scan."""
    last = margin + core - 1
    inside = F.col("row").between(margin, last) & F.col("col").between(margin, last)
    return pixels.where(inside).withColumns({"row": F.col("row") - margin, "col": F.col("col") - margin})


def random_crop(pixels: DataFrame, seed: int, size: int, crop: int, key: str = "tile") -> DataFrame:
    """A reproducible square crop per tile, re-based to (0, 0)."""
    r0, c0 = crop_origin(seed, key, size, crop)
    d = pixels.withColumns({"_r": F.col("row") - r0, "_c": F.col("col") - c0})
    d = d.where((F.col("_r") >= 0) & (F.col("_r") < crop) & (F.col("_c") >= 0) & (F.col("_c") < crop))
    return d.withColumns({"row": F.col("_r"), "col": F.col("_c")}).drop("_r", "_c")


def read_tiles(spark: SparkSession, path: str, part: str, held_out: DataFrame, on: str = "quad",
               keep_margin: bool = True, **gates) -> tuple[DataFrame, DataFrame]:
    """(tiles, pixels) of a split; an empty split is an error."""
    meta = read_meta(spark, path)
    tiles = select_tiles(spark.read.parquet(f"{path}/tile"), held_out, part, on, **gates)
    if tiles.isEmpty():
        raise ValueError(f"split {part!r} is empty: the held-out names may not be in this store")
    pixels = spark.read.parquet(f"{path}/pixel").drop("_tile", "_cover").join(tiles.select("quad", "tile"), ["quad", "tile"], "left_semi")
    return tiles, pixels if keep_margin else core_crop(pixels, meta["margin_px"], meta["core_px"])


def quad_summary(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("quad").agg(F.count(F.lit(1)).alias("tiles"))


def region_summary(tiles: DataFrame) -> DataFrame:
    """Tiles and look coverage per region, with a total row (NULL region)."""
    return tiles.rollup("region").agg(
        F.count(F.lit(1)).alias("tiles"),
        *[F.avg(F.col(c).cast("double")).alias(c) for c in ("has_right", "has_stereo", "has_stereo_dem")
          if c in tiles.columns])


def coverage_report(tiles: DataFrame, left_valid: DataFrame, lat: str = "lat_deg") -> DataFrame:
    """What supervision a store holds; `left_valid` is (tile, left) coverage per tile."""
    t = tiles.join(left_valid, "tile")
    return t.groupBy().agg(
        F.count(F.lit(1)).alias("tiles"), F.avg("left").alias("mean_left_look_valid"),
        *[F.avg(F.col(c).cast("double")).alias(n) for c, n in (
            ("has_right", "frac_with_right_look"), ("has_stereo", "frac_with_stereo_look"),
            ("has_stereo_dem", "frac_with_stereo_dem"))],
        F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"))
