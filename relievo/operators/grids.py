"""Grid generators: each turns rows of boxes, levels or extents into rows of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geodesy as G
from ..functions.base import as_col
from .blend import tile_origins
from .blocks import spread
from .masks import crosses_seam


def _steps(n) -> Column:
    """0 .. n-1, or no row when n < 1."""
    n = as_col(n).cast("int")
    return F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))


def centred_box(lon, lat, span_m) -> Column:
    half = as_col(span_m) / K.M_PER_DEG / 2.0
    lon, lat = as_col(lon), as_col(lat)
    return F.struct((lon - half).alias("west"), (lat - half).alias("south"),
                    (lon + half).alias("east"), (lat + half).alias("north"))


def box_size(west, south, east, north, pixel_m) -> tuple[Column, Column]:
    """(height, width) in pixels of a box, at least one."""
    def n(lo, hi):
        return F.greatest(F.rint((as_col(hi) - as_col(lo)) * K.M_PER_DEG / as_col(pixel_m)), F.lit(1.0)).cast("int")
    return n(south, north), n(west, east)


def window_pixels(windows: DataFrame, pixel_m, spread_rows: bool = True) -> DataFrame:
    """Pixel centres of every (west, south, east, north) row: adds row, col, lon, lat.

    Pixel rows are spread over tasks before each becomes a line of pixels, so one large box is not one task.
    Many small boxes that are dealt out already can stay where they are.
    """
    h, w = box_size("west", "south", "east", "north", pixel_m)
    g = windows.withColumns({"_h": h, "_w": w}).withColumn("row", _steps("_h"))
    g = (spread(g, "west", "south", "east", "north", "row") if spread_rows else g).withColumn("col", _steps("_w"))
    return g.withColumns({
        "lon": F.col("west") + (F.col("col") + 0.5) * (F.col("east") - F.col("west")) / F.col("_w"),
        "lat": F.col("north") - (F.col("row") + 0.5) * (F.col("north") - F.col("south")) / F.col("_h"),
    }).drop("_h", "_w")


def mosaic_windows(boxes: DataFrame, grid: G.CylindricalGrid, core: int, margin: int,
                   max_lat: float = 80.0, stride: int | None = None) -> DataFrame:
    """Full tiles (core plus margin ring) whose cores cover each box once: adds row, col, lon, lat.

    Longitude wraps; tiles that would run off the top or bottom are left out.
    """
    step, full = stride or core, core + 2 * margin

    def whole(c):  # toward zero, like an integer conversion
        return c.cast("int")

    r0 = F.greatest(F.lit(0), whole(grid.row("north")) - margin)
    r1 = F.least(F.lit(grid.height - full), whole(grid.row("south")) - margin)
    span = whole(F.pmod(grid.col("east") - grid.col("west"), F.lit(float(grid.width))))
    span = F.when(span == 0, F.lit(grid.width)).otherwise(span)
    b = boxes.withColumns({"_r0": r0, "_r1": r1, "_span": span, "_c": grid.col("west")})
    b = b.withColumn("_i", _steps(F.floor((F.col("_r1") - F.col("_r0")) / step) + 1))
    b = b.withColumn("_j", _steps(F.floor((F.greatest(F.lit(1), F.col("_span") - core + 1) - 1) / step) + 1))
    b = b.withColumns({
        "row": F.col("_r0") + F.col("_i") * step,
        "col": F.pmod(whole(F.col("_c") - margin + F.col("_j") * step), F.lit(grid.width))})
    b = b.withColumns({"lon": grid.lon(F.col("col") + full / 2), "lat": grid.lat(F.col("row") + full / 2)})
    return b.where(F.abs(F.col("lat")) <= max_lat).drop("_r0", "_r1", "_span", "_c", "_i", "_j")


def tile_centres(regions: DataFrame, core_px: int, pixel_m: float, max_lat: float = 78.0,
                 unwrapped: str | None = None) -> DataFrame:
    """Non-overlapping tile centres over each region, leaving out those that cross a seam.

    `unwrapped` names a column for the longitude counted on from the western edge, which keeps its order
    in regions that cross the meridian.
    """
    step = core_px * pixel_m / K.M_PER_DEG
    east = F.when(F.col("east") < F.col("west"), F.col("east") + 360.0).otherwise(F.col("east"))
    r = regions.withColumn("_e", east)

    def count(lo, hi):  # centres lo + step/2 + k*step below hi
        return F.greatest(F.ceil((hi - lo - step / 2) / step - 1e-12), F.lit(0))

    r = r.withColumn("_i", _steps(count(F.col("south"), F.col("north"))))
    r = r.withColumn("lat", F.col("south") + step / 2 + F.col("_i") * step)
    r = r.where(F.abs(F.col("lat")) <= max_lat)
    r = r.withColumn("_j", _steps(count(F.col("west"), F.col("_e"))))
    r = r.withColumn("_lon", F.col("west") + step / 2 + F.col("_j") * step)
    r = r.where(~crosses_seam(F.col("_lon") - step / 2, F.col("_lon") + step / 2))
    r = r.withColumn("lon", G.lon360("_lon"))
    if unwrapped:
        r = r.withColumn(unwrapped, F.col("_lon"))
    return r.drop("_e", "_i", "_j", "_lon")


def strided_pick(rows: DataFrame, per_group: int, keys=("region",), order=("lat", "lon")) -> DataFrame:
    """At most `per_group` rows per key, evenly strided over the order (index floor(i * n / k)).

    The first order column is a grid row (many tiles share a value). The position in a group is
    the rank inside the grid row plus the sizes of the rows before it, so a large region is not
    ranked in one task.
    """
    keys, order = list(keys), list(order)
    line = [*keys, order[0]]
    sizes = rows.groupBy(*line).agg(F.count(F.lit(1)).alias("_m"))
    prior = Window.partitionBy(*keys).orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_base": F.coalesce(F.sum("_m").over(prior), F.lit(0)),
                               "_n": F.sum("_m").over(Window.partitionBy(*keys))}).drop("_m")
    inner = Window.partitionBy(*line).orderBy(*order[1:])
    r = rows.withColumn("_k", F.row_number().over(inner) - 1).join(sizes, line)

    def below(position):  # how many wanted indices lie before a position
        return F.ceil(position * per_group / F.col("_n"))

    at = F.col("_base") + F.col("_k")
    picked = (F.col("_n") <= per_group) | (below(at + 1) > below(at))
    return r.where(picked).select(*rows.columns)


def region_box(regions: DataFrame, span_m: float) -> DataFrame:
    """Replace each region by a square box of `span_m` about its centre."""
    east = F.when(F.col("east") < F.col("west"), F.col("east") + 360.0).otherwise(F.col("east"))
    box = centred_box((F.col("west") + east) / 2.0, (F.col("south") + F.col("north")) / 2.0, span_m)
    keep = [c for c in regions.columns if c not in ("west", "south", "east", "north")]
    return regions.withColumn("_b", box).select(*keep, "_b.*")


def region_grid(regions: DataFrame, tile_px: int, pixel_m: float, overlap_px: int,
                span_m: float) -> DataFrame:
    """Overlapping tile origins over each region box with the tile centres."""
    deg = pixel_m / K.M_PER_DEG
    b = region_box(regions, span_m).withColumns({
        "width": ((F.col("east") - F.col("west")) / deg).cast("int"),
        "height": ((F.col("north") - F.col("south")) / deg).cast("int")})
    b = b.withColumn("orow", F.explode(tile_origins("height", tile_px, overlap_px)))
    b = b.withColumn("ocol", F.explode(tile_origins("width", tile_px, overlap_px)))
    return b.withColumns({
        "lon": G.lon360(F.col("west") + (F.col("ocol") + tile_px / 2) * deg),
        "lat": F.col("north") - (F.col("orow") + tile_px / 2) * deg})


def pyramid_tiles(boxes: DataFrame, min_level, max_level) -> DataFrame:
    """Tiles (z, x, y) that overlap each box, from index ranges rather than a scan of the level."""
    b = boxes.withColumn("z", F.explode(F.sequence(as_col(min_level), as_col(max_level))))
    span = G.tile_span("z")
    nx = F.pow(F.lit(2.0), F.col("z") + 1)
    ny = F.pow(F.lit(2.0), F.col("z"))

    def run(lo, hi, origin, n):
        first = F.greatest(F.floor((F.col(lo) + origin) / span), F.lit(0)).cast("int")
        last = F.least(F.ceil((F.col(hi) + origin) / span), n - 1).cast("int")
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    b = b.withColumn("x", run("west", "east", 180.0, nx)).withColumn("y", run("south", "north", 90.0, ny))
    e = G.tile_extent("z", "x", "y")
    tile = {k: e[k] for k in ("west", "south", "east", "north")}
    box = {k: F.col(k) for k in ("west", "south", "east", "north")}
    return b.where(G.boxes_overlap(tile, box))


def pyramid_plan(levels: DataFrame, z: str = "z") -> DataFrame:
    """Resolution and tile count per level."""
    return levels.withColumns({
        "m_per_vertex": G.metres_per_vertex(z), "m_per_pixel": G.metres_per_pixel(z),
        "tiles": G.tile_count(z)})


def great_circle(lines: DataFrame, samples: int) -> DataFrame:
    """Points of each (lon1, lat1, lon2, lat2) row: adds i, distance_m, lon, lat."""
    lon1, lat1, lon2, lat2 = (F.radians(F.col(c)) for c in ("lon1", "lat1", "lon2", "lat2"))
    s1, s2 = F.sin((lat2 - lat1) / 2.0), F.sin((lon2 - lon1) / 2.0)
    angle = F.asin(F.least(F.sqrt(s1 * s1 + F.cos(lat1) * F.cos(lat2) * s2 * s2), F.lit(1.0))) * 2.0
    p = spread(lines, "lon1", "lat1", "lon2", "lat2").withColumn("_d", angle).withColumn("i", _steps(samples))
    f, d = F.col("i") / float(max(samples - 1, 1)), F.col("_d")
    still = d < 1e-12
    a = F.when(still, F.lit(1.0) - f).otherwise(F.sin((F.lit(1.0) - f) * d) / F.sin(d))
    b = F.when(still, f).otherwise(F.sin(f * d) / F.sin(d))
    x = a * F.cos(lat1) * F.cos(lon1) + b * F.cos(lat2) * F.cos(lon2)
    y = a * F.cos(lat1) * F.sin(lon1) + b * F.cos(lat2) * F.sin(lon2)
    z = a * F.sin(lat1) + b * F.sin(lat2)
    return p.withColumns({
        "distance_m": f * d * K.RADIUS_M, "lon": F.degrees(F.atan2(y, x)),
        "lat": F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))}).drop("_d")
