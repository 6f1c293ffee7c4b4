"""Overlap tiling: feathered blending, cap merge and a tiled user function."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geodesy as G
from ..functions.base import as_col
from .blocks import spread
from .resample import bilinear_gather


def tile_origins(extent, tile: int, overlap: int) -> Column:
    """Array of start indices; the last tile is flush with the far edge."""
    extent, step = as_col(extent).cast("int"), max(1, tile - overlap)
    last = extent - tile
    regular = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(
        F.array_union(regular, F.array(last)))


def blend(tiles: DataFrame, bands, keys=()) -> DataFrame:
    """Weighted mean per mosaic pixel of (grow, gcol, w, bands), in any arrival order.

    Sums are DOUBLE and combine before the shuffle. Pixels no tile covers are absent.
    """
    bands = [bands] if isinstance(bands, str) else list(bands)
    sums = [F.sum(F.col("w") * F.col(b)).alias(f"_n_{b}") for b in bands]
    sums += [F.sum(F.when(F.col(b).isNotNull(), F.col("w"))).alias(f"_d_{b}") for b in bands]
    out = tiles.groupBy(*keys, "grow", "gcol").agg(*sums)
    return out.select(*keys, "grow", "gcol", *[
        F.when(F.col(f"_d_{b}") > 0, F.col(f"_n_{b}") / F.col(f"_d_{b}")).alias(b) for b in bands])


def coverage(blended: DataFrame, band: str, pixels: int, keys=()) -> DataFrame:
    """Fraction of the canvas that any tile covered."""
    return blended.groupBy(*keys).agg(
        (F.count(F.col(band)) / F.lit(float(pixels))).alias("coverage"))


def assign_tiles(pixels: DataFrame, height, width, tile: int, overlap: int) -> DataFrame:
    """Copy each mosaic pixel to the overlapping tiles that hold it.

    Adds `orow`, `ocol` (tile origin), `row`, `col` (inside the tile) and the blend weight `w`.
    """
    def owners(position, extent):
        p, extent, step = F.col(position), as_col(extent).cast("int"), max(1, tile - overlap)
        last = F.greatest(extent - tile, F.lit(0))
        lo = F.greatest(F.ceil((p - tile + 1) / step).cast("int"), F.lit(0))
        hi = F.least(F.floor(p / step), F.floor(last / step)).cast("int")
        regular = F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda k: (k * step).cast("int")))
        flush = F.when(p >= last, F.array(last.cast("int")))
        none = F.array().cast("array<int>")
        return F.array_union(F.coalesce(regular, none), F.coalesce(flush, none))

    return (pixels.withColumn("orow", F.explode(owners("grow", height)))
            .withColumn("ocol", F.explode(owners("gcol", width)))
            .withColumns({"row": (F.col("grow") - F.col("orow")).cast("int"),
                          "col": (F.col("gcol") - F.col("ocol")).cast("int")})
            .withColumn("w", G.feather2d("row", "col", tile, overlap)))


def run_tiled(pixels: DataFrame, height, width, tile: int, overlap: int,
              fn: Callable[[pd.DataFrame], pd.DataFrame], bands: dict[str, str], keys=()) -> DataFrame:
    """Apply a user function to each overlapping tile and blend what it returns.

    `fn` gets one tile (row, col, orow, ocol and the input bands) and returns row, col and the
    output bands named in `bands` (name -> type). A tile is bounded by `tile`^2 pixels.
    """
    keys = list(keys)
    tiled = assign_tiles(pixels, height, width, tile, overlap)
    group = keys + ["orow", "ocol"]
    schema = T.StructType([tiled.schema[c] for c in group] + [
        T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType())])
    for name, kind in bands.items():
        schema = schema.add(name, kind)

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        res = fn(pdf)
        for c in group:
            res[c] = pdf[c].iat[0]
        return res[schema.fieldNames()]

    out = spread(tiled.drop("w", "grow", "gcol"), *group).groupBy(*group).applyInPandas(call, schema)
    out = out.withColumns({"grow": F.col("orow") + F.col("row"), "gcol": F.col("ocol") + F.col("col"),
                           "w": G.feather2d("row", "col", tile, overlap)})
    return blend(out, list(bands), keys)


# --- polar caps -----------------------------------------------------------------------------------
def polar_pixels(base: DataFrame, grid: G.Cap) -> DataFrame:
    """The cells of a polar grid for every row of `base` (its key columns are kept).

    Grid rows are spread over tasks before each becomes a line of cells.
    """
    n = F.sequence(F.lit(0), F.lit(grid.cells - 1))
    lines = spread(base.withColumn("row", F.explode(n)), *base.columns, "row")
    lon, lat = G.cap_lonlat("row", "col", grid)
    return lines.withColumn("col", F.explode(n)).withColumns({"lon": lon, "lat": lat})


def cylindrical_to_polar(raster: DataFrame, band: str, cyl: G.CylindricalGrid, grid: G.Cap,
                         keys=("tile",)) -> DataFrame:
    """Resample a global cylindrical raster onto the cap grid; longitude wraps."""
    cells = polar_pixels(raster.select(*keys).distinct(), grid)
    cells = cells.withColumns({"src_row": cyl.row("lat"), "src_col": cyl.col("lon")})
    return bilinear_gather(cells, raster, band, cyl.height, cyl.width, keys, edge="wrap").drop(
        "src_row", "src_col")


def polar_to_cylindrical(cap: DataFrame, band: str, grid: G.Cap, target: DataFrame,
                         cyl: G.CylindricalGrid, keys=("tile",), out: str | None = None) -> DataFrame:
    """Cap values on the pixels of `target` (keys, row, col); NULL outside the cap grid."""
    t = target.withColumns({"_lon": F.lit(cyl.lon_min) + (F.col("col") + 0.5) * (360.0 / cyl.width),
                            "_lat": cyl.lat("row")})
    row, col = G.cap_position("_lon", "_lat", grid)
    t = t.withColumns({"src_row": row, "src_col": col})
    return bilinear_gather(t, cap, band, grid.cells, grid.cells, keys, out=out, edge="inside").drop(
        "src_row", "src_col", "_lon", "_lat")


def cap_cells(base: DataFrame, cyl: G.CylindricalGrid, polar: Column) -> DataFrame:
    """The pixels of a cylindrical grid in the rows where `polar` holds, for every row of `base`.

    Grid rows are spread over tasks before each becomes a line of pixels.
    """
    lines = base.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(cyl.height - 1)))).where(polar)
    return spread(lines, *base.columns, "row").withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cyl.width - 1))))


def merge_cap(cylindrical: DataFrame, cap: DataFrame, band: str, cyl: G.CylindricalGrid,
              grid: G.Cap, inner: float = 80.0, outer: float = 75.0, keys=("tile",)) -> DataFrame:
    """Feather a cap result into the cylindrical one; a missing cap value has weight 0, and where the
    cylindrical value is NULL or its pixel absent the cap stands alone.

    Only the rows poleward of `outer` take part in the gather; the rest pass through. Absent pixels
    come back only with a cap value, and with NULL in the other columns.
    """
    lat = cyl.lat("row")
    polar = (lat > outer) if grid.hemisphere > 0 else (lat < -outer)
    zone, rest = cylindrical.where(polar), cylindrical.where(~polar)
    at = [*keys, "row", "col"]
    cells = cap_cells(cylindrical.select(*keys).union(cap.select(*keys)).distinct().na.drop(), cyl, polar)
    cells = cells.select(*[F.col(c).cast(cylindrical.schema[c].dataType).alias(c) for c in at])
    absent = cells.join(zone.select(*at), at, "left_anti").withColumn("_absent", F.lit(True))
    target = zone.withColumn("_absent", F.lit(False)).unionByName(absent, allowMissingColumns=True)
    got = polar_to_cylindrical(cap, band, grid, target, cyl, keys, out="_cap")
    got = got.where(~F.col("_absent") | F.col("_cap").isNotNull()).drop("_absent")
    w = F.when(F.col("_cap").isNotNull(), G.cap_weight(lat, inner, outer)).otherwise(F.lit(0.0))
    merged = got.withColumn(band, F.coalesce(F.col("_cap"), F.lit(0.0)) * w
                            + F.coalesce(F.col(band), F.col("_cap")) * (F.lit(1.0) - w)).drop("_cap")
    return merged.unionByName(rest)
