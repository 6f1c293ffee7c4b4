"""Products of different grids brought onto one output grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geodesy as G
from ..functions import radiometry as R
from .blocks import BLOCK_PX
from .grids import box_size, window_pixels
from .resample import gather, overlap_average


REACH = (-2, 2)  # patches reach two pixels past a point


@dataclass(frozen=True)
class ProductGrid:
    """Geometry and storage of one raster product on the cylindrical projection."""

    height: int
    width: int
    upper_left_x: float
    upper_left_y: float
    pixel_m: float
    nodata: float | None = None
    scale: float = 1.0
    offset: float = 0.0

    def rows(self, lat):
        return (F.lit(self.upper_left_y) - G.projected_y(lat)) / self.pixel_m - 0.5

    def cols(self, lon):
        return (G.projected_x(lon) - self.upper_left_x) / self.pixel_m - 0.5

    def decoded(self, raster: DataFrame, band: str) -> DataFrame:
        v = F.col(band)
        if self.nodata is not None:
            v = R.scaled(v, self.nodata, self.scale, self.offset)
        elif (self.scale, self.offset) != (1.0, 0.0):
            v = v * self.scale + self.offset
        return raster.withColumn(band, v)


def sample_product(points: DataFrame, raster: DataFrame, band: str, grid: ProductGrid,
                   method: str = "bilinear", out: str | None = None, block: int = BLOCK_PX, keys=()) -> DataFrame:
    """Sample a product at (lon, lat) points; NULL outside its extent and on nodata.

    With `keys`, points and raster name the tile they belong to, and a point meets its own tile only.

    Only source blocks that some point falls in (or beside) are kept before patches are built: a
    semi join on block keys, which prunes a scan partitioned by block.
    """
    out = out or band
    placed = points.withColumns({"src_row": grid.rows("lat"), "src_col": grid.cols("lon")})

    def ends(position):
        return [F.floor((F.col(position) + d) / block).cast("int") for d in REACH]

    # Points of the same blocks are one row before a row becomes up to four blocks.
    sides = dict(zip(("_r0", "_r1", "_c0", "_c1"), (*ends("src_row"), *ends("src_col"))))
    met = (placed.where(F.col("src_row").isNotNull() & F.col("src_col").isNotNull())
           .select(*keys, *[c.alias(n) for n, c in sides.items()]).distinct())
    wanted = (met.withColumn("_kr", F.explode(F.array_distinct(F.array("_r0", "_r1"))))
              .withColumn("_kc", F.explode(F.array_distinct(F.array("_c0", "_c1")))).select(*keys, "_kr", "_kc").distinct())
    return _sampled(placed, _of_blocks(raster, wanted, block, keys), band, grid, method, out, keys)


def sample_source(points: DataFrame, source: DataFrame, band: str, grid: ProductGrid,
                  method: str = "bilinear", out: str | None = None, small: bool = False) -> DataFrame:
    """`sample_product` of a source that `reached` has cut; a `small` one is broadcast and the points stay where they are."""
    placed = points.withColumns({"src_row": grid.rows("lat"), "src_col": grid.cols("lon")})
    return _sampled(placed, source, band, grid, method, out or band, (), small)


def reached(windows: DataFrame, pixel_m, raster: DataFrame, grid: ProductGrid, block: int = BLOCK_PX) -> DataFrame:
    """The raster's blocks that pixels of (west, south, east, north) windows fall in or beside.

    They follow from a window's first and last row and column, so it is not spread into its pixels for this. A window over
    the antimeridian has two runs of columns.
    """
    h, w = box_size("west", "south", "east", "north", pixel_m)
    half_lat, half_lon = (F.col("north") - F.col("south")) / h / 2.0, (F.col("east") - F.col("west")) / w / 2.0

    def near(position, side):
        return F.floor((position + REACH[side]) / block).cast("int")

    top, bottom = grid.rows(F.col("north") - half_lat), grid.rows(F.col("south") + half_lat)
    left, right = grid.cols(F.col("west") + half_lon), grid.cols(F.col("east") - half_lon)
    first, last = (F.lit((x * K.M_PER_DEG - grid.upper_left_x) / grid.pixel_m - 0.5) for x in (-180.0, 180.0))
    around = F.concat(F.sequence(near(left, 0), near(last, 1)), F.sequence(near(first, 0), near(right, 1)))
    cols = (F.when(F.col("east") - F.col("west") >= 360.0, F.sequence(near(first, 0), near(last, 1)))
            .when(left > right, around).otherwise(F.sequence(near(left, 0), near(right, 1))))
    wanted = (windows.select(F.sequence(near(top, 0), near(bottom, 1)).alias("_r"), cols.alias("_c")).distinct()
              .select(F.explode("_r").alias("_kr"), "_c").select("_kr", F.explode("_c").alias("_kc")).distinct())
    return _of_blocks(raster, wanted, block)


def _of_blocks(raster: DataFrame, wanted: DataFrame, block: int, keys=()) -> DataFrame:
    return raster.withColumns({"_kr": F.floor(F.col("row") / block).cast("int"),
                               "_kc": F.floor(F.col("col") / block).cast("int")}).join(
        wanted, [*keys, "_kr", "_kc"], "left_semi").drop("_kr", "_kc")


def _sampled(placed: DataFrame, src: DataFrame, band: str, grid: ProductGrid, method: str, out: str, keys,
             small: bool = False) -> DataFrame:
    got = gather(placed, grid.decoded(src, band), band, grid.height, grid.width, method, keys=keys, out=out, small=small)
    top, bottom = grid.upper_left_y, grid.upper_left_y - grid.height * grid.pixel_m
    y = G.projected_y("lat")
    return got.withColumn(out, F.when((y > bottom) & (y < top), F.col(out))).drop("src_row", "src_col")


def sample_windows(windows: DataFrame, pixel_m: float, raster: DataFrame, band: str, grid: ProductGrid,
                   method: str = "bilinear", out: str | None = None, keys=()) -> DataFrame:
    """A windowed read: each (west, south, east, north) row becomes its pixels with the product's value.

    A window that straddles the antimeridian is an error rather than a mirrored strip. `average` weights
    each source pixel by its part in the output pixel; the others sample at the output pixel's centre.
    """
    straddles = G.lon180("east") <= G.lon180("west")
    checked = windows.withColumn("west", F.when(straddles, F.raise_error(
        F.lit("window straddles the +/-180 seam; split it first")).cast("double")).otherwise(F.col("west")))
    px = window_pixels(checked, pixel_m)
    if method == "average":
        return _averaged(px, pixel_m, raster, band, grid, out or band, keys)
    return sample_product(px, raster, band, grid, method, out, keys=keys)


def _averaged(px: DataFrame, pixel_m: float, raster: DataFrame, band: str, grid: ProductGrid, out: str, keys) -> DataFrame:
    """Window pixels with the area-weighted mean of the product, NULL where their centre is off its rows."""
    n_rows, n_cols = box_size("west", "south", "east", "north", pixel_m)
    half_lat, half_lon = (F.col("north") - F.col("south")) / n_rows / 2.0, (F.col("east") - F.col("west")) / n_cols / 2.0
    # rows() and cols() are relative to pixel centres, areas to pixel edges; half a step keeps clear of the seam
    y, x = grid.rows("lat") + 0.5, grid.cols("lon") + 0.5
    dy, dx = half_lat * K.M_PER_DEG / grid.pixel_m, half_lon * K.M_PER_DEG / grid.pixel_m
    areas = px.withColumns({"src_top": y - dy, "src_bottom": y + dy, "src_left": x - dx, "src_right": x + dx})
    areas = areas.withColumnsRenamed({"row": "_row", "col": "_col"})
    got = overlap_average(areas, grid.decoded(raster, band), band, grid.height, grid.width, keys, out=out)
    mid = (F.col("src_top") + F.col("src_bottom")) / 2.0
    got = got.withColumn(out, F.when((mid > 0) & (mid < grid.height), F.col(out)))
    return got.withColumnsRenamed({"_row": "row", "_col": "col"}).drop("src_top", "src_bottom", "src_left", "src_right")


DEFAULTS = {"emissivity": K.EMISSIVITY_MEAN, "dn_left": 0.0, "dn_right": 0.0, "dn_stereo": 0.0}


def coregister(grid: DataFrame, products: dict[str, DataFrame], keys=("tile", "row", "col"),
               defaults: dict[str, float] | None = None) -> DataFrame:
    """Left-join each resampled product (keys, value) onto the output grid.

    A missing value takes the product's default; the others stay NULL. All joins share the grid
    key, so one exchange of the grid serves them all.
    """
    defaults = DEFAULTS if defaults is None else defaults
    out = grid
    for name, df in products.items():
        out = out.join(df.select(*keys, name), list(keys), "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in defaults.items()
                            if n in products})
