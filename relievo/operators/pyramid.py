"""Terrain and imagery pyramids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy as G
from ..functions import radiometry as R
from ..functions.base import attach
from .blocks import spread
from .grids import pyramid_tiles
from .mesh import encode_tiles
from .quantiles import exact_quantiles
from .resample import area_average, bilinear_gather, upsample_bilinear
from .stencil import hillshade


def tile_vertices(tiles: DataFrame, dem: DataFrame, z: str, height: int, width: int, n: int = 65,
                  keys=("tile",)) -> DataFrame:
    """Bilinear n x n vertex heights of each tile: adds vr, vc, lon, lat, h.

    `tiles` has (keys, z, x, y) and the DEM box west..north; samples run edge to edge of the
    DEM, clamped. Tiles outside the DEM box are dropped.
    """
    keys = list(keys)
    e = G.tile_extent("z", "x", "y")
    t = tiles.withColumn("_e", e)
    box = {k: F.col(k) for k in ("west", "south", "east", "north")}
    t = spread(t.where(G.boxes_overlap({k: F.col(f"_e.{k}") for k in box}, box)), *keys, "z", "x", "y")
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    t = t.withColumn("vr", F.explode(steps)).withColumn("vc", F.explode(steps))
    t = t.withColumns({
        "lon": F.col("_e.west") + F.col("vc") * (F.col("_e.east") - F.col("_e.west")) / (n - 1),
        "lat": F.col("_e.north") - F.col("vr") * (F.col("_e.north") - F.col("_e.south")) / (n - 1)})
    t = t.withColumns({
        "src_row": (F.col("north") - F.col("lat")) / (F.col("north") - F.col("south")) * (height - 1),
        "src_col": (F.col("lon") - F.col("west")) / (F.col("east") - F.col("west")) * (width - 1)})
    return bilinear_gather(t, dem, z, height, width, keys, out="h", edge="clamp").select(
        *keys, "z", "x", "y", "vr", "vc", "lon", "lat", "h")


def terrain_pyramid(boxes: DataFrame, dem: DataFrame, z: str, height: int, width: int, min_level: int,
                    max_level: int, n: int = 65, keys=("tile",), region: DataFrame | None = None) -> DataFrame:
    """(keys, z, x, y, payload) of every tile of the DEM boxes, or of `region` boxes inside them."""
    keys = list(keys)
    if region is None:
        tiles = pyramid_tiles(boxes, min_level, max_level)
    else:  # levels come from the region of interest, samples from the DEM box
        tiles = pyramid_tiles(region, min_level, max_level).drop("west", "south", "east", "north").distinct()
        tiles = tiles.join(boxes, keys)
    vertices = tile_vertices(tiles, dem, z, height, width, n, keys)
    return encode_tiles(vertices, n, [*keys, "z", "x", "y"])


def _level_size(level: int, tile_px: int) -> tuple[int, int]:
    return tile_px * 2 ** level, tile_px * 2 ** (level + 1)


def _as_level(raster: DataFrame, bands, level: int, tile_px: int, keys) -> DataFrame:
    return raster.select(
        *keys, F.lit(level).alias("z"), F.floor(F.col("col") / tile_px).cast("int").alias("x"),
        (F.lit(2 ** level - 1) - F.floor(F.col("row") / tile_px)).cast("int").alias("y"),
        F.pmod(F.col("col"), F.lit(tile_px)).alias("px"), F.pmod(F.col("row"), F.lit(tile_px)).alias("py"),
        *bands)


def imagery_level(image: DataFrame, bands, height: int, width: int, level: int, tile_px: int = 256,
                  keys=("tile",)) -> DataFrame:
    """One level of a global 2x1 pyramid as (keys, z, x, y, px, py, bands); y counts north.

    Reduction is an area mean, enlargement bilinear, each axis by its own need.
    """
    bands = [bands] if isinstance(bands, str) else list(bands)
    out_h, out_w = _level_size(level, tile_px)
    res = image.select(*keys, "row", "col", *bands)
    low_h, low_w = min(height, out_h), min(width, out_w)
    if (low_h, low_w) != (height, width):
        res = area_average(res, bands, F.floor(F.col("row") * low_h / height), F.floor(F.col("col") * low_w / width), keys)
    if (low_h, low_w) != (out_h, out_w):
        res = upsample_bilinear(res, bands, low_h, low_w, out_h, out_w, keys)
    return _as_level(res, bands, level, tile_px, keys)


def imagery_pyramid(image: DataFrame, bands, height: int, width: int, max_level: int, tile_px: int = 256,
                    keys=("tile",)) -> DataFrame:
    """Levels 0 to `max_level`.

    The finest reduced level is summed from the image once; every coarser one adds up four cells of the
    level below it, as cell borders nest. Sums and counts are kept, so each level is the exact mean of
    its pixels. Levels finer than the image are enlarged from it.
    """
    bands, keys = [bands] if isinstance(bands, str) else list(bands), list(keys)
    reduced = [k for k in range(max_level + 1) if _level_size(k, tile_px)[0] <= height and _level_size(k, tile_px)[1] <= width]
    levels, sums = [], None
    for level in reversed(reduced):
        if sums is None:
            h, w = _level_size(level, tile_px)
            cell = {"row": F.floor(F.col("row") * h / height).cast("int"), "col": F.floor(F.col("col") * w / width).cast("int")}
            sums = image.groupBy(*keys, *[c.alias(n) for n, c in cell.items()]).agg(
                *[F.sum(b).alias(b) for b in bands], *[F.count(b).alias(f"_n_{b}") for b in bands])
        else:
            half = [F.floor(F.col(n) / 2).cast("int").alias(n) for n in ("row", "col")]
            sums = sums.groupBy(*keys, *half).agg(
                *[F.sum(b).alias(b) for b in bands], *[F.sum(f"_n_{b}").alias(f"_n_{b}") for b in bands])
        means = sums.select(*keys, "row", "col", *[(F.col(b) / F.col(f"_n_{b}")).alias(b) for b in bands])
        levels.append(_as_level(means, bands, level, tile_px, keys))
    for level in range(len(reduced), max_level + 1):
        levels.append(imagery_level(image, bands, height, width, level, tile_px, keys))
    out = levels[0]
    for one in levels[1:]:
        out = out.unionByName(one)
    return out


def filled_with_median(df: DataFrame, band: str, keys=("tile",)) -> DataFrame:
    med = exact_quantiles(df, keys, F.col(band), {"_med": 0.5}).select(*keys, "_med")
    joined = attach(df, med, keys, "left")
    return joined.withColumn(band, F.coalesce(F.col(band), F.col("_med"))).drop("_med")


def display_layers(df: DataFrame, z: str, rv: str, keys=("tile",)) -> DataFrame:
    """Filled surface with hillshade, hypsometric tint and radar stretch."""
    d = hillshade(filled_with_median(df, z, keys), z, z_factor=3.0, keys=keys)
    tint = R.colour_relief(z)
    return d.select(*keys, "row", "col", z, "shade", tint["red"].alias("red"), tint["green"].alias("green"),
                    tint["blue"].alias("blue"), R.stretch_sar(F.coalesce(F.col(rv), F.lit(0.0))).alias("sar"))


def level_counts(tiles: DataFrame, keys=("z",)) -> DataFrame:
    return tiles.groupBy(*keys).agg(F.count(F.lit(1)).alias("tiles"))


def layer_document(sets: DataFrame, max_level: str, description: str = "terrain") -> DataFrame:
    """The `layer.json` text of each tile set, with the available ranges per level."""
    level = F.sequence(F.lit(0), F.col(max_level))
    ranges = F.transform(level, lambda z: F.array(F.struct(
        F.lit(0).alias("startX"), F.lit(0).alias("startY"),
        (F.pow(F.lit(2.0), z + 1) - 1).cast("int").alias("endX"),
        (F.pow(F.lit(2.0), z) - 1).cast("int").alias("endY"))))
    doc = F.struct(
        F.lit("2.1.0").alias("tilejson"), F.lit("quantized-mesh-1.0").alias("format"),
        F.lit("1.0.0").alias("version"), F.lit("tms").alias("scheme"),
        F.lit("EPSG:4326").alias("projection"), F.lit(description).alias("description"),
        F.array(*[F.lit(v) for v in (-180, -90, 180, 90)]).alias("bounds"),
        F.array(F.lit("{z}/{x}/{y}.terrain?v={version}")).alias("tiles"), ranges.alias("available"))
    return sets.withColumn("layer_json", F.to_json(doc))


def manifest(tiles: DataFrame, layer: str = "layer", keys=()) -> DataFrame:
    """Deepest level per layer as one JSON text (per key)."""
    per = tiles.groupBy(*keys, layer).agg(F.max("z").alias("_z"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(layer).alias("layer"), F.col("_z").alias("z"))))
    return per.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias("max_level"))
