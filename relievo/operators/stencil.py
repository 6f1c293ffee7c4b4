"""Slopes, rendering, shading and other neighbourhood operators on `pixel` frames.

A `pixel` frame has key columns (default `tile`), integer `row` (south) and `col` (east) and
DOUBLE bands. Absent pixels and NULL bands count as "no neighbour".
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import radiometry as R
from ..functions.base import as_col
from .blocks import BLOCK_PX, edge_neighbour, neighbour, with_halo


def sobel(df: DataFrame, bands, pixel_m, keys=("tile",), block: int = BLOCK_PX) -> DataFrame:
    """Add `<band>_de` and `<band>_dn`: 3x3 /8 gradient, replicate edge, north positive.

    The kernel is separable, so it is a difference and a [1 2 1] sum per axis: two window
    passes after one exchange instead of nine shifted copies of the raster.
    """
    bands = [bands] if isinstance(bands, str) else list(bands)
    px = as_col(pixel_m)
    b = with_halo(df, 1, keys, block)
    first = {}
    for v in bands:
        west, east = (edge_neighbour(v, "col", b.by_row, s) for s in (-1, 1))
        first[f"_{v}_d"] = east - west
        first[f"_{v}_s"] = west + F.col(v) * 2.0 + east
    b = b.with_columns(first)
    second = {}
    for v in bands:
        d, s = f"_{v}_d", f"_{v}_s"
        d_n, d_s = (edge_neighbour(d, "row", b.by_col, k) for k in (-1, 1))
        s_n, s_s = (edge_neighbour(s, "row", b.by_col, k) for k in (-1, 1))
        second[f"{v}_de"] = (d_n + F.col(d) * 2.0 + d_s) / 8.0 / px
        second[f"{v}_dn"] = -((s_s - s_n) / 8.0 / px)
    b = b.with_columns(second)
    return b.core().drop(*first)


def central_gradient(df: DataFrame, band: str, pixel_m, keys=("tile",),
                     block: int = BLOCK_PX) -> DataFrame:
    """Add `<band>_de` and `<band>_dn`: central differences, one-sided at the border."""
    px = as_col(pixel_m)
    b = with_halo(df, 1, keys, block)

    def axis(position, window):
        before, after = (neighbour(band, position, window, s) for s in (-1, 1))
        both = before.isNotNull() & after.isNotNull()
        return (F.when(both, (after - before) / 2.0)
                .when(after.isNotNull(), after - F.col(band))
                .when(before.isNotNull(), F.col(band) - before)
                .when(F.col(band).isNotNull(), F.lit(0.0))) / px

    b = b.with_columns({f"{band}_de": axis("col", b.by_row), f"{band}_dn": -axis("row", b.by_col)})
    return b.core()


def along_look(de, dn, east, north) -> Column:
    """Facet tilt toward the radar, radians."""
    return F.atan(as_col(de) * as_col(east) + as_col(dn) * as_col(north))


def slope_magnitude(de, dn) -> Column:
    de, dn = as_col(de), as_col(dn)
    return F.atan(F.sqrt(de * de + dn * dn))


def slope_toward_radar(df: DataFrame, z: str, look, pixel_m, keys=("tile",),
                       block: int = BLOCK_PX, out: str = "alpha", method: str = "sobel") -> DataFrame:
    """Add `alpha`. `look` is a (east, north) pair of columns or numbers."""
    step = sobel if method == "sobel" else central_gradient
    g = step(df, z, pixel_m, keys, block)
    return g.withColumn(out, along_look(f"{z}_de", f"{z}_dn", *look)).drop(f"{z}_de", f"{z}_dn")


def render(df: DataFrame, z: str, theta, look, pixel_m, brightness=None, margin_deg: float = 5.0,
           keys=("tile",), block: int = BLOCK_PX, prefix: str = "") -> DataFrame:
    """Add `rv`, `alpha`, `theta_local`, `ok`: the radar image a height model implies."""
    a, t = f"{prefix}alpha", as_col(theta)
    out = slope_toward_radar(df, z, look, pixel_m, keys, block, out=a)
    rv = R.flattened_db(R.local_incidence(F.col(a), t), t)
    if brightness is not None:
        rv = rv + as_col(brightness)
    return out.withColumns({
        f"{prefix}rv": rv,
        f"{prefix}theta_local": R.local_incidence(F.col(a), t),
        f"{prefix}ok": F.coalesce(R.renderable(a, t, margin_deg), F.lit(False)),
    })


def rms_slope(df: DataFrame, z: str, pixel_m, cell_px: int, height, width, keys=("tile",),
              block: int = BLOCK_PX) -> DataFrame:
    """Rms slope (radians) per `cell_px` block as (keys, crow, ccol); partial cells are dropped.

    A cell without a height is NULL, not flat.
    """
    g = sobel(df, z, pixel_m, keys, block)
    whole = (F.col("row") < F.floor(as_col(height) / cell_px) * cell_px) & (
        F.col("col") < F.floor(as_col(width) / cell_px) * cell_px)
    s2 = F.col(f"{z}_de") * F.col(f"{z}_de") + F.col(f"{z}_dn") * F.col(f"{z}_dn")
    return (g.where(whole)
            .groupBy(*keys, F.floor(F.col("row") / cell_px).alias("crow"),
                     F.floor(F.col("col") / cell_px).alias("ccol"))
            .agg(F.when(F.count(z) > 0, F.atan(F.sqrt(F.greatest(F.avg(s2), F.lit(1e-8))))).alias("rms_slope")))


def hillshade(df: DataFrame, z: str, azimuth_deg: float = 315.0, altitude_deg: float = 45.0,
              z_factor: float = 6.0, keys=("tile",), block: int = BLOCK_PX) -> DataFrame:
    """Add `shade`, 0..255 truncated."""
    g = central_gradient(df, z, 1.0, keys, block)
    dx, dy = F.col(f"{z}_de") * z_factor, F.col(f"{z}_dn") * (-z_factor)
    facing = F.lit(math.pi / 2) - F.atan(F.hypot(dx, dy))
    aspect = F.atan2(-dx, dy)
    az, alt = math.radians(450.0 - azimuth_deg), math.radians(altitude_deg)
    level = (F.sin(facing) * math.sin(alt)
             + F.cos(facing) * F.cos(F.lit(az) - aspect) * math.cos(alt)) * 255.0
    return (g.withColumn("shade", F.when(level.isNotNull(), F.greatest(
        F.least(level, F.lit(255.0)), F.lit(0.0))).cast("int"))
        .drop(f"{z}_de", f"{z}_dn"))


def neighbour_steps(df: DataFrame, band: str, keys=("tile",), block: int = BLOCK_PX) -> DataFrame:
    """Add `step_e`, `step_s` (difference to the east and south pixel) and `laplacian`.

    `laplacian` exists on interior pixels only; steps are NULL past the border.
    """
    b = with_halo(df, 1, keys, block)
    v = F.col(band)
    b = b.with_columns({"_w": neighbour(band, "col", b.by_row, -1),
                        "_e": neighbour(band, "col", b.by_row, 1)})
    b = b.with_columns({"_n": neighbour(band, "row", b.by_col, -1),
                        "_s": neighbour(band, "row", b.by_col, 1)})
    b = b.with_columns({
        "step_e": F.col("_e") - v,
        "step_s": F.col("_s") - v,
        "laplacian": F.col("_s") + F.col("_n") + F.col("_e") + F.col("_w") - v * 4.0,
    })
    return b.core().drop("_w", "_e", "_n", "_s")
