"""Validity masks: dilation, radar-dark areas, mosaic seams, supervision flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import as_col
from .blocks import BLOCK_PX, Blocked, neighbour, with_halo


def _dilate(b: Blocked, flag: str, radius: int) -> Blocked:
    """Square dilation as two range-window maxima; a RANGE frame counts pixels, so gaps are safe."""
    if radius <= 0:
        return b
    rows = b.by_row.rangeBetween(-radius, radius)
    cols = b.by_col.rangeBetween(-radius, radius)
    b = b.with_columns({flag: F.max(flag).over(cols)})
    return b.with_columns({flag: F.max(flag).over(rows)})


def dilate(df: DataFrame, mask: str, radius: int, out: str | None = None, keys=("tile",),
           block: int = BLOCK_PX) -> DataFrame:
    """Square dilation of a boolean band."""
    b = with_halo(df, max(radius, 0), keys, block)
    name = out or mask
    b = b.with_columns({name: F.coalesce(F.col(mask), F.lit(False))})
    return _dilate(b, name, radius).core()


def dilate_sparse(hits: DataFrame, radius: int, keys=("tile",)) -> DataFrame:
    """Positions within `radius` of a true pixel, for masks with few true pixels."""
    reach = F.sequence(F.lit(-radius), F.lit(radius))
    return (hits.select(*keys, "row", "col")
            .withColumn("row", F.explode(F.transform(reach, lambda d: F.col("row") + d)))
            .withColumn("col", F.explode(F.transform(reach, lambda d: F.col("col") + d)))
            .distinct())


def _seam_flag(b: Blocked, dem: str, jump_m: float) -> Blocked:
    b = b.with_columns({"_we": F.greatest(*[
        F.abs(F.col(dem) - neighbour(dem, "col", b.by_row, s)) for s in (-1, 1)])})
    return b.with_columns({"_seam": F.coalesce(F.greatest(F.col("_we"), *[
        F.abs(F.col(dem) - neighbour(dem, "row", b.by_col, s)) for s in (-1, 1)]) > jump_m,
        F.lit(False))})


def seam_mask(df: DataFrame, dem: str, jump_m: float = 150.0, dilation: int = 4,
              out: str = "seam_ok", keys=("tile",), block: int = BLOCK_PX) -> DataFrame:
    """Add `seam_ok`: False around implausible jumps between neighbouring pixels."""
    b = _seam_flag(with_halo(df, dilation + 1, keys, block), dem, jump_m)
    b = _dilate(b, "_seam", dilation).with_columns({out: ~F.col("_seam")})
    return b.core().drop("_we", "_seam")


def radar_dark_mask(df: DataFrame, rv: str, valid, threshold_db: float = -12.0, dilation: int = 3,
                    out: str = "dark_ok", keys=("tile",), block: int = BLOCK_PX) -> DataFrame:
    """Add `dark_ok`: False around valid pixels below the backscatter threshold."""
    dark = F.coalesce((F.col(rv) < threshold_db) & as_col(valid), F.lit(False))
    b = with_halo(df, dilation, keys, block).with_columns({"_dark": dark})
    b = _dilate(b, "_dark", dilation).with_columns({out: ~F.col("_dark")})
    return b.core().drop("_dark")


def stereo_trust_mask(df: DataFrame, dem: str, dem_valid, rv: str, rv_valid, keys=("tile",),
                      jump_m: float = 150.0, seam_dilation: int = 4, threshold_db: float = -12.0,
                      dark_dilation: int = 3, out: str = "trust", block: int = BLOCK_PX) -> DataFrame:
    """Add `trust`: shipped validity minus seams minus radar-dark areas, in one exchange."""
    halo = max(seam_dilation + 1, dark_dilation)
    b = with_halo(df, halo, keys, block).with_columns({
        "_dark": F.coalesce((F.col(rv) < threshold_db) & as_col(rv_valid), F.lit(False))})
    b = _dilate(_seam_flag(b, dem, jump_m), "_seam", seam_dilation)
    b = _dilate(b, "_dark", dark_dilation).with_columns({
        out: F.coalesce(as_col(dem_valid), F.lit(False)) & ~F.col("_seam") & ~F.col("_dark")})
    return b.core().drop("_we", "_seam", "_dark")


def unsupervised(trust, valid_right, valid_stereo) -> Column:
    """True where neither a trusted DEM nor a second look constrains the surface."""
    return ~(F.coalesce(as_col(trust), F.lit(False)) | F.coalesce(as_col(valid_right), F.lit(False))
             | F.coalesce(as_col(valid_stereo), F.lit(False)))


def tile_coverage(df: DataFrame, flags: dict, keys=("tile",), pixels=None) -> DataFrame:
    """Per tile, the fraction of pixels where each flag holds.

    `pixels` is the pixel count of a full tile when absent rows stand for nodata.
    """
    n = as_col(pixels) if pixels is not None else F.count(F.lit(1))
    return df.groupBy(*keys).agg(*[
        (F.count_if(F.coalesce(as_col(c), F.lit(False))) / n).alias(name)
        for name, c in flags.items()])


def coverage_gate(df: DataFrame, valid, minimum: float = 0.55, keys=("tile",), pixels=None) -> DataFrame:
    """Keep the pixels of tiles with enough valid radar."""
    keep = tile_coverage(df, {"_cover": valid}, keys, pixels).where(F.col("_cover") >= minimum)
    return df.join(keep.select(*keys), list(keys), "left_semi")


def presence_flags(coverage: DataFrame, rule: str = "ingest") -> DataFrame:
    """`has_*` flags from coverage fractions, by the ingest or the tile-builder thresholds."""
    minimum = {"ingest": 0.55, "tile": 0.5}[rule]
    flags = {f"has_{c}": F.col(c) > minimum for c in ("right", "stereo") if c in coverage.columns}
    if "stereo_dem" in coverage.columns:
        flags["has_stereo_dem"] = F.col("stereo_dem") > (0.2 if rule == "ingest" else 0.0)
    return coverage.withColumns(flags)


def inside_latitudes(lat: str, limit: float = 80.0) -> Column:
    """Latitude gate written as a range, so it reaches the parquet scan."""
    return (F.col(lat) >= -limit) & (F.col(lat) <= limit)


def crosses_seam(west, east) -> Column:
    """Windows that straddle the antimeridian or the prime meridian."""
    west, east = as_col(west), as_col(east)
    return ((west < 180.0) & (east > 180.0)) | (
        F.pmod(west, F.lit(360.0)) > F.pmod(east, F.lit(360.0)))


def lattice_interior(prow, pcol, nrow, ncol, margin_px: int, stride: int) -> Column:
    """Posts at least `margin_px` inside the lattice; none if the lattice is too small."""
    if margin_px <= 0:
        return F.lit(True)
    m = max(1, margin_px // stride)
    prow, pcol, nrow, ncol = (as_col(c) for c in (prow, pcol, nrow, ncol))
    return ((nrow > 2 * m) & (ncol > 2 * m) & (prow >= m) & (prow < nrow - m)
            & (pcol >= m) & (pcol < ncol - m))
