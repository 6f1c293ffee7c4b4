"""Resampling: anti-aliased reduction, post upsampling, bilinear gathers, footprint blur."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import as_col, clamp
from .blocks import BLOCK_PX, neighbour, spread, with_halo


POST_BLOCK = 16  # coarse cells per block side: each cell may own thousands of fine pixels


# --- anti-aliased reduction ------------------------------------------------------------------
def gaussian_taps(factor: int, sigma_scale: float = 0.5) -> list[float]:
    """Normalised taps for offsets -half..half."""
    sigma = sigma_scale * factor
    half = math.ceil(2.5 * sigma)
    g = [math.exp(-0.5 * (t / sigma) ** 2) for t in range(-half, half + 1)]
    total = sum(g)
    return [v / total for v in g]


def _scatter(df: DataFrame, position: str, size, factor: int, taps: list[float],
             bands: list[str], group: list[str]) -> DataFrame:
    """One axis of the reduction: each pixel adds its weighted value to the cells it reaches.

    A border pixel also carries the taps that fall outside (replicate padding), which is a
    difference of cumulative taps. Partial aggregation runs before the shuffle.
    """
    half, off = len(taps) // 2, factor // 2
    sums = [0.0]
    for t in taps:
        sums.append(sums[-1] + t)
    cumulative = F.array(*[F.lit(v) for v in sums])
    pos, size = F.col(position).cast("int"), as_col(size)
    cells = F.floor((size - off + factor - 1) / factor).cast("int")
    first = F.greatest(F.ceil((pos - half - off) / factor).cast("int"), F.lit(0))
    last = F.least(F.floor((pos + half - off) / factor).cast("int"), cells - 1)
    centre = F.col("__cell") * factor + off

    def up_to(tap):  # sum of taps for offsets <= tap
        k = F.greatest(F.least(tap + half + 1, F.lit(2 * half + 1)), F.lit(0))
        return F.element_at(cumulative, k + 1)

    upper = F.when(pos == size - 1, F.lit(half)).otherwise(pos - centre)
    lower = F.when(pos == 0, F.lit(-half)).otherwise(pos - centre)
    weight = up_to(upper) - up_to(lower - 1)
    return (df.where(first <= last)
            .withColumn("__cell", F.explode(F.sequence(first, last)))
            .withColumn("__tap", weight)
            .groupBy(*group, F.col("__cell").alias(f"_{position}"))
            .agg(*[F.sum(F.col("__tap") * F.col(b)).alias(b) for b in bands])
            .withColumnRenamed(f"_{position}", position))


def gaussian_downsample(df: DataFrame, bands, factor: int, height, width, sigma_scale: float = 0.5,
                        keys=("tile",)) -> DataFrame:
    """Gaussian prefilter and decimation at cell centres, as (keys, row, col, bands).

    Only the kept cells are computed, one axis at a time; the first pass already shrinks the
    rows by `factor`. Absent or NULL pixels add nothing, so smooth the mask as another band
    where coverage matters.
    """
    bands = [bands] if isinstance(bands, str) else list(bands)
    keys = list(keys)
    df = df.select(*keys, "row", "col", *bands)
    if factor <= 1:
        return df
    taps = gaussian_taps(factor, sigma_scale)
    across = _scatter(df, "col", width, factor, taps, bands, keys + ["row"])
    return _scatter(across, "row", height, factor, taps, bands, keys + ["col"]).select(
        *keys, "row", "col", *bands)


def cells_of(size: int, factor: int) -> int:
    """Cells the reduction keeps along an axis."""
    return size if factor <= 1 else (size - factor // 2 + factor - 1) // factor


def scale_factor(pixel_m: float, scale_m: float) -> int:
    """Whole reduction factor that brings a grid to the scale a product is trusted at."""
    return max(1, round(scale_m / pixel_m))


def at_scale(df: DataFrame, bands, pixel_m: float, scale_m: float, height, width,
             keys=("tile",)) -> DataFrame:
    return gaussian_downsample(df, bands, scale_factor(pixel_m, scale_m), height, width, keys=keys)


def box_mean(df: DataFrame, bands, factor: int, keys=("tile",)) -> DataFrame:
    """Block means on a grid `factor` times coarser."""
    bands = [bands] if isinstance(bands, str) else list(bands)
    return df.groupBy(*keys, F.floor(F.col("row") / factor).cast("int").alias("row"),
                      F.floor(F.col("col") / factor).cast("int").alias("col")).agg(
        *[F.avg(b).alias(b) for b in bands])


def adaptive_pool(df: DataFrame, aggs: dict, height: int, width: int, out_h: int, out_w: int,
                  keys=("tile",)) -> DataFrame:
    """Pool to a fixed coarse grid; cells cover floor(kH/n)..ceil((k+1)H/n)-1 and may overlap.

    `aggs` maps an output name to ("avg" | "max", band).
    """
    def cells(position, size, n):
        lo = F.floor(F.col(position) * n / size).cast("int")
        hi = F.ceil((F.col(position) + 1) * n / size).cast("int") - 1
        return F.explode(F.sequence(lo, hi))

    fns = {"avg": F.avg, "max": F.max}
    return (df.withColumn("crow", cells("row", height, out_h))
            .withColumn("ccol", cells("col", width, out_w))
            .groupBy(*keys, "crow", "ccol")
            .agg(*[fns[how](band).alias(name) for name, (how, band) in aggs.items()]))


# --- upsampling: each coarse cell produces the fine pixels it owns -------------------------------
def _cubic_weights(t: Column, a: float = -0.75) -> list[Column]:
    def near(d):
        return ((d * (a + 2.0)) - (a + 3.0)) * d * d + 1.0

    def far(d):
        return ((d * a - 5.0 * a) * d + 8.0 * a) * d - 4.0 * a

    return [far(t + 1.0), near(t), near(F.lit(1.0) - t), far(F.lit(2.0) - t)]


def _axis_patch(b, bands, position, window, reach):
    """Neighbours -1..+2 (or 0..+1) along an axis with border clamping."""
    out = {}
    for v in bands:
        nxt = F.coalesce(neighbour(v, position, window, 1), F.col(v))
        out[f"{v}_0"] = F.col(v)
        out[f"{v}_1"] = nxt
        if reach == 4:
            out[f"{v}_m"] = F.coalesce(neighbour(v, position, window, -1), F.col(v))
            out[f"{v}_2"] = F.coalesce(neighbour(v, position, window, 2), nxt)
    return b.with_columns(out)


def _upsample(df, bands, height, width, out_h, out_w, slope, shift, reach, keys, block):
    """Shared body: `u(i) = (i + shift) * slope`, clamped to the coarse grid."""
    b = with_halo(df.select(*keys, "row", "col", *bands), 2, keys, block, expands=True)
    names = ["m", "0", "1", "2"] if reach == 4 else ["0", "1"]
    b = _axis_patch(b, bands, "col", b.by_row, reach)
    wide = [f"{v}_{n}" for v in bands for n in names]
    b = _axis_patch(b, wide, "row", b.by_col, reach)
    patch = b.core()

    def owned(position, size, out_size, k):
        # fine indices whose clamped coordinate has floor == position
        pos, size, out_size = F.col(position), as_col(size), as_col(out_size)
        lo = F.ceil(pos / slope[k] - shift[k] - 1e-9).cast("int")
        hi = F.ceil((pos + 1) / slope[k] - shift[k] - 1e-9).cast("int") - 1
        lo = F.when(pos == 0, F.lit(0)).otherwise(F.greatest(lo, F.lit(0)))
        hi = F.when(pos == size - 1, out_size - 1).otherwise(F.least(hi, out_size - 1))
        return F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int")))

    def frac(fine, position, size, k):
        u = clamp((F.col(fine) + shift[k]) * slope[k], 0.0, as_col(size) - 1.0)
        return clamp(u - F.col(position), 0.0, 1.0)

    fine = (patch.withColumn("_i", F.explode(owned("row", height, out_h, 0)))
            .withColumn("_j", F.explode(owned("col", width, out_w, 1)))
            .withColumn("_ty", frac("_i", "row", height, 0))
            .withColumn("_tx", frac("_j", "col", width, 1)))
    ty, tx = F.col("_ty"), F.col("_tx")
    wy = _cubic_weights(ty) if reach == 4 else [F.lit(1.0) - ty, ty]
    wx = _cubic_weights(tx) if reach == 4 else [F.lit(1.0) - tx, tx]

    def blend(v):
        rows = []
        for m, w in zip(names, wy):
            line = [F.col(f"{v}_{n}_{m}") * x for n, x in zip(names, wx)]
            total = line[0]
            for term in line[1:]:
                total = total + term
            rows.append(total * w)
        out = rows[0]
        for term in rows[1:]:
            out = out + term
        return out

    return fine.select(*keys, F.col("_i").alias("row"), F.col("_j").alias("col"),
                       *[blend(v).alias(v) for v in bands])


def upsample_posts(df: DataFrame, bands, stride: int, height, width, out_h, out_w,
                   offset: float | None = None, keys=("tile",), block: int = POST_BLOCK) -> DataFrame:
    """Cubic (A = -0.75) upsampling with post j at fine pixel `offset + j * stride`.

    Posts are prepared as 4x4 patches; each patch then generates the fine pixels it owns, so
    the only shuffle is over the coarse posts and none over the fine grid.
    """
    bands = [bands] if isinstance(bands, str) else list(bands)
    off = stride // 2 if offset is None else offset
    return _upsample(df, bands, height, width, out_h, out_w, (1.0 / stride,) * 2, (-off,) * 2, 4,
                     tuple(keys), block)


def upsample_altimetry(posts: DataFrame, value: str, stride: int, height, width, out_h, out_w,
                       keys=("tile",), block: int = POST_BLOCK) -> DataFrame:
    """Upsampled posts with their gaps carried: NULL where the upsampled mask is not above 0.99."""
    p = posts.withColumn("_m", F.col(value).isNotNull().cast("double")).withColumn(
        value, F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    up = upsample_posts(p, [value, "_m"], stride, height, width, out_h, out_w, keys=keys, block=block)
    return up.withColumn(value, F.when(F.col("_m") > 0.99, F.col(value))).drop("_m")


def upsample_bilinear(df: DataFrame, bands, height: int, width: int, out_h: int, out_w: int,
                      keys=("tile",), block: int = POST_BLOCK) -> DataFrame:
    """Bilinear upsampling of cell centres (corners not aligned)."""
    bands = [bands] if isinstance(bands, str) else list(bands)
    slope = (height / out_h, width / out_w)
    shift = tuple(0.5 - 0.5 / s for s in slope)  # (i + .5) * s - .5 == (i + shift) * s
    return _upsample(df, bands, height, width, out_h, out_w, slope, shift, 2, tuple(keys), block)


# --- bilinear gather at arbitrary points ------------------------------------------------------------
def bilinear_gather(points: DataFrame, raster: DataFrame, band: str, height, width, keys=("tile",),
                    at=("src_row", "src_col"), out: str | None = None, edge: str = "inside",
                    block: int = BLOCK_PX, small: bool = False) -> DataFrame:
    """Sample `band` at fractional positions; NULL if a needed corner is missing.

    edge: "inside"  positions within [0, size-1], else NULL
          "strict"  positions within [0, size-1), as for a DEM with an open far edge
          "clamp"   positions are clamped to the raster
          "wrap"    columns wrap and rows are clamped (global cylindrical raster)

    The raster side becomes one row per 2x2 patch, so every point needs a single equi-join
    row instead of four taps and a second aggregation; AQE splits a hot patch's points.
    """
    out = out or band
    keys, (ry, cx) = tuple(keys), at
    h, w = as_col(height), as_col(width)
    src = raster.select(*keys, "row", "col", F.col(band).alias("_v"))
    if edge == "wrap":
        src = src.withColumn("col", F.explode(F.when(F.col("col") == 0, F.array("col", w.cast("int")))
                                              .otherwise(F.array("col"))))
    b = with_halo(src, 1, keys, block)
    last_col = F.lit(False) if edge == "wrap" else F.col("col") == w - 1
    b = b.with_columns({"_v01": F.when(last_col, F.col("_v")).otherwise(
        neighbour("_v", "col", b.by_row, 1))})
    last_row = F.col("row") == h - 1
    b = b.with_columns({
        "_v10": F.when(last_row, F.col("_v")).otherwise(neighbour("_v", "row", b.by_col, 1)),
        "_v11": F.when(last_row, F.col("_v01")).otherwise(neighbour("_v01", "row", b.by_col, 1))})
    patch = b.core().withColumnsRenamed({"row": "_r0", "col": "_c0"})
    if edge == "wrap":
        patch = patch.where(F.col("_c0") < w)

    r, c = F.col(ry), F.col(cx)
    if edge in ("clamp", "wrap"):
        r = clamp(r, 0.0, h - 1.0)
    if edge == "clamp":
        c = clamp(c, 0.0, w - 1.0)
    usable = r.isNotNull() & c.isNotNull()
    if edge == "inside":
        usable = usable & (r >= 0) & (r <= h - 1) & (c >= 0) & (c <= w - 1)
    elif edge == "strict":
        usable = usable & (r >= 0) & (r < h - 1) & (c >= 0) & (c < w - 1)
    c0 = F.floor(c)
    placed = points.withColumns({
        "_fr": r - F.floor(r), "_fc": c - c0,
        "_r0": _cell(points, F.floor(r), usable, *keys, *at, "row", "col"),
        "_c0": _cell(points, F.pmod(c0, w) if edge == "wrap" else c0, usable, *keys, *at, "row", "col")})
    joined = placed.join(_few(patch, small), [*keys, "_r0", "_c0"], "left")
    fr, fc = F.col("_fr"), F.col("_fc")
    top = F.col("_v") * (F.lit(1.0) - fc) + F.col("_v01") * fc
    bottom = F.col("_v10") * (F.lit(1.0) - fc) + F.col("_v11") * fc
    return joined.withColumn(out, top * (F.lit(1.0) - fr) + bottom * fr).drop(
        *({"_v", "_v01", "_v10", "_v11", "_r0", "_c0", "_fr", "_fc"} - {out}))


def _cell(points: DataFrame, index, usable, *names):
    """A point's patch index; an unusable point gets one that no patch has, different from its like.

    Without it all such points would meet on one NULL key.
    """
    apart = -1 - F.pmod(F.xxhash64(*[c for c in points.columns if c in names]), F.lit(1 << 24)).cast("int")
    return F.when(F.coalesce(usable, F.lit(False)), index.cast("int")).otherwise(apart)


def cubic_gather(points: DataFrame, raster: DataFrame, band: str, height, width, keys=("tile",),
                 at=("src_row", "src_col"), out: str | None = None, a: float = -0.5,
                 block: int = BLOCK_PX, small: bool = False) -> DataFrame:
    """Cubic sample at fractional positions with border clamping; NULL outside the raster.

    The raster side becomes 4x4 patches, one equi-join row per point.
    """
    out, keys = out or band, tuple(keys)
    h, w = as_col(height), as_col(width)
    b = with_halo(raster.select(*keys, "row", "col", F.col(band).alias("_v")), 2, keys, block)
    names = ["m", "0", "1", "2"]
    b = _axis_patch(b, ["_v"], "col", b.by_row, 4)
    b = _axis_patch(b, [f"_v_{n}" for n in names], "row", b.by_col, 4)
    taps = [f"_v_{n}_{m}" for m in names for n in names]
    patch = b.core().select(*keys, F.col("row").alias("_r0"), F.col("col").alias("_c0"), *taps)
    r, c = F.col(at[0]), F.col(at[1])
    usable = (r >= -0.5) & (r <= h - 0.5) & (c >= -0.5) & (c <= w - 0.5)
    r, c = clamp(r, 0.0, h - 1.0), clamp(c, 0.0, w - 1.0)
    placed = points.withColumns({
        "_fr": r - F.floor(r), "_fc": c - F.floor(c),
        "_r0": _cell(points, F.floor(r), usable, *keys, *at, "row", "col"),
        "_c0": _cell(points, F.floor(c), usable, *keys, *at, "row", "col")})
    wy, wx = _cubic_weights(F.col("_fr"), a), _cubic_weights(F.col("_fc"), a)
    total = F.lit(0.0)
    for m, y in zip(names, wy):
        for n, x in zip(names, wx):
            total = total + F.col(f"_v_{n}_{m}") * x * y
    return placed.join(_few(patch, small), [*keys, "_r0", "_c0"], "left").withColumn(out, total).drop(
        *taps, "_r0", "_c0", "_fr", "_fc")


def area_average(raster: DataFrame, bands, to_row, to_col, keys=("tile",)) -> DataFrame:
    """Average source pixels into the output pixel their centre falls in."""
    bands = [bands] if isinstance(bands, str) else list(bands)
    return (raster.groupBy(*keys, F.floor(as_col(to_row)).cast("int").alias("row"),
                           F.floor(as_col(to_col)).cast("int").alias("col"))
            .agg(*[F.avg(b).alias(b) for b in bands]))


def overlap_average(areas: DataFrame, raster: DataFrame, band: str, height, width, keys=("tile",),
                    at=("src_top", "src_bottom", "src_left", "src_right"), out: str | None = None) -> DataFrame:
    """Mean of `band` over a rectangle of the raster, each pixel weighted by the part of it inside.

    A rectangle is four positions in pixel edges: pixel i reaches from i to i + 1. NULL pixels and what lies
    outside the raster carry no weight; without any weight, or with a NULL side, the mean is NULL. A rectangle of no area
    takes the pixel it lies in.

    Each rectangle is cut into its rows of pixels, which are spread before they become pixels, so a rectangle
    as large as the raster is not one task; the weighted terms combine before they meet. The terms are at
    most four times the larger of the raster's pixels under them and the rectangles. They meet the raster in a
    merge join: Spark's estimate of either side knows nothing of the rows that a rectangle or a compressed file becomes,
    and a broadcast by it would pass them through the driver.
    """
    out, keys = out or band, tuple(keys)
    top, bottom, left, right = (F.col(c) for c in at)
    h, w = as_col(height), as_col(width)

    def reach(low, high, extent):
        first = F.greatest(F.floor(low), F.lit(0)).cast("int")
        last = F.least(F.greatest(F.ceil(high) - 1, F.floor(low)), extent - 1).cast("int")
        return F.when(first <= last, F.sequence(first, last))

    def part(low, high, i):
        return F.when(high > low, F.least(high, i + 1.0) - F.greatest(low, i.cast("double"))).otherwise(F.lit(1.0))

    shape = areas.select(*keys, *at).distinct()  # equal rectangles are averaged once
    rows = shape.withColumn("row", F.explode(reach(top, bottom, h)))
    taps = spread(rows, *keys, *at, "row").withColumn("col", F.explode(reach(left, right, w)))
    taps = taps.withColumn("_part", part(top, bottom, F.col("row")) * part(left, right, F.col("col")))
    src = raster.select(*keys, "row", "col", F.col(band).alias("_v")).where(F.col("_v").isNotNull())
    mean = (taps.hint("merge").join(src, [*keys, "row", "col"]).groupBy(*keys, *at)
            .agg((F.sum(F.col("_part") * F.col("_v")) / F.sum("_part")).alias(out)))
    return areas.join(mean, [*keys, *at], "left")


def gather(points: DataFrame, raster: DataFrame, band: str, height, width, method: str = "bilinear",
           keys=("tile",), at=("src_row", "src_col"), out: str | None = None, small: bool = False) -> DataFrame:
    """Sample by a resampling name: nearest, bilinear or cubic (`average` needs areas: `overlap_average`).

    A raster known to be `small` is broadcast, so the points stay where they are.
    """
    if method == "nearest":
        src = raster.withColumnRenamed(band, out or band)
        return nearest_gather(points, src, out or band, keys, at, small)
    if method == "bilinear":
        return bilinear_gather(points, raster, band, height, width, keys, at, out, "inside", small=small)
    if method == "cubic":
        return cubic_gather(points, raster, band, height, width, keys, at, out, small=small)
    raise ValueError(f"unknown resampling {method!r}")


def _few(patch: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(patch) if small else patch


def nearest_gather(points: DataFrame, raster: DataFrame, bands, keys=("tile",),
                   at=("src_row", "src_col"), small: bool = False) -> DataFrame:
    """Value of the pixel whose area holds the position."""
    bands = [bands] if isinstance(bands, str) else list(bands)
    placed = points.withColumns({"_r0": F.floor(F.col(at[0]) + 0.5).cast("int"),
                                 "_c0": F.floor(F.col(at[1]) + 0.5).cast("int")})
    src = raster.select(*keys, F.col("row").alias("_r0"), F.col("col").alias("_c0"), *bands)
    return placed.join(_few(src, small), [*keys, "_r0", "_c0"], "left").drop("_r0", "_c0")


def coarse_baseline(df: DataFrame, band: str, factor: int, height: int, width: int,
                    keys=("tile",)) -> DataFrame:
    """The surface through a coarse instrument: block means, then a smooth cubic surface."""
    return upsample_posts(box_mean(df, band, factor, keys), band, factor, height // factor,
                          width // factor, height, width, offset=(factor - 1) / 2.0, keys=keys)


# --- altimeter footprint --------------------------------------------------------------------------------
@dataclass(frozen=True)
class Footprint:
    """Anisotropic Gaussian footprint; azimuth is clockwise from north."""

    sigma_along_m: float = 4000.0
    sigma_cross_m: float = 8000.0
    azimuth_rad: float = 0.0


    def covariance(self, less_m: float = 0.0, least_m: float = 0.0) -> np.ndarray:
        """Covariance in (east, north), m^2: an isotropic width already applied is taken off each axis."""
        along = np.array([math.sin(self.azimuth_rad), math.cos(self.azimuth_rad)])
        cross = np.array([along[1], -along[0]])
        var = [max(s * s - less_m * less_m, least_m * least_m) for s in (self.sigma_along_m, self.sigma_cross_m)]
        return var[0] * np.outer(along, along) + var[1] * np.outer(cross, cross)


def gaussian_kernel(covariance: np.ndarray, pixel_m: float, truncate: float) -> np.ndarray:
    """Weights of a Gaussian with a given covariance on an odd square grid whose rows go south."""
    reach = truncate * math.sqrt(np.linalg.eigvalsh(covariance)[-1])
    steps = np.arange(-(n := max(1, math.ceil(reach / pixel_m - 1e-9))), n + 1) * pixel_m
    at = np.stack(np.broadcast_arrays(steps[None, :], -steps[:, None]), axis=-1)
    weights = np.exp(-0.5 * np.einsum("...i,ij,...j->...", at, np.linalg.inv(covariance), at))
    return weights / weights.sum()


def apply_kernel(df: DataFrame, band: str, kernel: np.ndarray, height: int, width: int,
                 keys=("tile",), block: int = BLOCK_PX) -> DataFrame:
    """Correlate with a small dense kernel, replicate padding, as (keys, row, col, band).

    A rotated kernel is not separable, so each block with its halo is one grouped-map call on
    a bounded array; absent pixels count as 0.
    """
    half = kernel.shape[0] // 2
    block = max(block, half)
    b = with_halo(df.select(*keys, "row", "col", band), half, keys, block, expands=True)
    schema = T.StructType([b.df.schema[k] for k in keys] + [
        T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()),
        T.StructField(band, T.DoubleType())])
    keys = list(keys)

    def convolve(pdf: pd.DataFrame) -> pd.DataFrame:
        br, bc = int(pdf["_br"].iat[0]), int(pdf["_bc"].iat[0])
        r0, c0 = br * block, bc * block
        r1, c1 = min(r0 + block, height), min(c0 + block, width)
        if r0 >= r1 or c0 >= c1:
            return pd.DataFrame({f.name: [] for f in schema})
        lo_r, lo_c = max(r0 - half, 0), max(c0 - half, 0)
        hi_r, hi_c = min(r1 + half, height), min(c1 + half, width)
        a = np.zeros((hi_r - lo_r, hi_c - lo_c))
        a[pdf["row"].to_numpy() - lo_r, pdf["col"].to_numpy() - lo_c] = np.nan_to_num(
            pdf[band].to_numpy(dtype=float))
        a = np.pad(a, ((lo_r - (r0 - half), r1 + half - hi_r),
                       (lo_c - (c0 - half), c1 + half - hi_c)), mode="edge")
        views = np.lib.stride_tricks.sliding_window_view(a, kernel.shape)
        res = np.einsum("ijkl,kl->ij", views, kernel)
        rr, cc = np.mgrid[r0:r1, c0:c1]
        out = {k: pdf[k].iat[0] for k in keys}
        return pd.DataFrame({**{k: np.repeat(v, res.size) for k, v in out.items()},
                             "row": rr.ravel().astype("int32"), "col": cc.ravel().astype("int32"),
                             band: res.ravel()})

    return b.df.groupBy(*keys, "_br", "_bc").applyInPandas(convolve, schema)


@dataclass(frozen=True)
class BlurPlan:
    """How a footprint blur is factored: reduce by `factor`, convolve, come back up."""

    factor: int
    kernel: np.ndarray
    coarse_h: int
    coarse_w: int


def plan_blur(fp: Footprint, pixel_m: float, height: int, width: int, truncate: float = 3.5,
              max_kernel_px: int = 96) -> BlurPlan:
    """Reduce so far that a coarse pixel is a quarter of the narrow axis.

    If that leaves a kernel wider than `max_kernel_px`, reduce further; this depends on the instrument and
    the pixel alone, never on the amount of data. The reduction's own blur, one coarse pixel wide, is
    taken off the kernel.
    """
    axes = fp.sigma_along_m, fp.sigma_cross_m
    factor = int(min(axes) / (4.0 * pixel_m))
    if factor > 1:
        factor = max(factor, math.ceil(truncate * max(axes) / (pixel_m * max_kernel_px) - 1e-12))
    factor = max(1, factor)
    coarse = factor * pixel_m
    kernel = gaussian_kernel(fp.covariance(coarse if factor > 1 else 0.0, coarse / 2.0), coarse, truncate)
    return BlurPlan(factor, kernel, cells_of(height, factor), cells_of(width, factor))


def footprint_blur(df: DataFrame, band: str, fp: Footprint, pixel_m: float, height: int, width: int,
                   keys=("tile",), block: int = BLOCK_PX, at: DataFrame | None = None) -> DataFrame:
    """The surface as the altimeter sees it.

    With `at` (keys, row, col) only those fine pixels are interpolated back, which is all an
    altimetry residual needs.
    """
    plan = plan_blur(fp, pixel_m, height, width)
    coarse = gaussian_downsample(df, band, plan.factor, height, width, 1.0, keys)
    blurred = apply_kernel(coarse, band, plan.kernel, plan.coarse_h, plan.coarse_w, keys, block)
    if plan.factor == 1:
        return blurred if at is None else at.join(blurred, [*keys, "row", "col"], "left")
    if at is None:
        return upsample_bilinear(blurred, band, plan.coarse_h, plan.coarse_w, height, width, keys)
    sy, sx = plan.coarse_h / height, plan.coarse_w / width
    points = at.withColumns({"src_row": (F.col("row") + 0.5) * sy - 0.5,
                             "src_col": (F.col("col") + 0.5) * sx - 0.5})
    return bilinear_gather(points, blurred, band, plan.coarse_h, plan.coarse_w, keys, edge="clamp",
                           block=block).drop("src_row", "src_col")
