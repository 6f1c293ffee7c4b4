"""Fits from aggregates: temperature, incidence profile, viewing angle per patch, datum tie."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geodesy as G
from ..functions.base import as_col, attach, clamp
from ..session import materialise
from .angles import fit_angles
from .metrics import calibration
from .quantiles import exact_quantiles

THETA_GRID = (8.0, 55.5, 0.5)  # first, last, step in degrees


def fit_temperature(df: DataFrame, error, sigma, target: float = 0.6827, keys=()) -> DataFrame:
    """Smallest t with P(|err| <= t * sigma) >= target: the `target` quantile of |err| / sigma."""
    s = as_col(sigma)
    ratio = F.when(s > 0, F.abs(as_col(error)) / s)
    fit = exact_quantiles(df, keys, ratio, {"temperature": target}, mode="disc")
    return fit.withColumn("temperature", clamp("temperature", 1e-3, 1e3))


def calibration_report(df: DataFrame, error: str, sigma: str, fit_half, keys=()) -> DataFrame:
    """Fit the temperature on one half, report coverage before and after on the other."""
    t = fit_temperature(df.where(fit_half), error, sigma, keys=keys).select(*keys, "temperature")
    rest = df.where(~as_col(fit_half))
    both = attach(rest, t, keys)
    before = calibration(both, error, sigma, keys=[*keys, "temperature"]).withColumn(
        "stage", F.lit("before"))
    after = calibration(both, error, F.col(sigma) * F.col("temperature"),
                        keys=[*keys, "temperature"]).withColumn("stage", F.lit("after"))
    return before.unionByName(after)


def fit_incidence(df: DataFrame, lat, theta, keys=("cycle",), weight=None) -> DataFrame:
    """Least-squares quadratic of incidence against latitude, from one pass of power sums.

    A fit without a peak (curvature the wrong way, or too few distinct latitudes) falls back to
    the flat mean. The mean latitude is removed first to keep the normal equations well scaled.
    """
    lat, theta = as_col(lat), as_col(theta)
    w = F.lit(1.0) if weight is None else as_col(weight)
    x = lat / 90.0
    use = lat.isNotNull() & theta.isNotNull()
    sums = {f"_s{p}": F.sum(F.when(use, w * F.pow(x, F.lit(float(p))))) for p in range(5)}
    sums |= {f"_t{p}": F.sum(F.when(use, w * F.pow(x, F.lit(float(p))) * theta)) for p in range(3)}
    s = df.groupBy(*keys).agg(
        *[e.alias(n) for n, e in sums.items()], F.avg(F.when(use, theta)).alias("_mean"),
        F.min(F.when(use, theta)).alias("_low"), F.count_if(use).alias("n"))
    c = {n: F.col(n) for n in sums}

    def det(m):
        (a, b, d), (e, f, g), (h, i, j) = m
        return a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)

    base = [[c["_s0"], c["_s1"], c["_s2"]], [c["_s1"], c["_s2"], c["_s3"]], [c["_s2"], c["_s3"], c["_s4"]]]
    rhs = [c["_t0"], c["_t1"], c["_t2"]]

    def solved(k):
        return det([[rhs[r] if j == k else base[r][j] for j in range(3)] for r in range(3)])

    s = s.withColumn("_det", det(base))
    for k in range(3):
        s = s.withColumn(f"_c{k}", F.when(F.abs(F.col("_det")) > 1e-12, solved(k) / F.col("_det")))
    c0, c1, c2 = F.col("_c0"), F.col("_c1") / 90.0, F.col("_c2") / 8100.0
    peaked = F.coalesce(c2 < 0, F.lit(False))
    peak = -c1 / (c2 * 2.0)
    return s.select(
        *keys, "n",
        F.when(peaked, peak).otherwise(F.lit(0.0)).alias("lat_peak_deg"),
        F.when(peaked, c0 + c1 * peak + c2 * peak * peak).otherwise(F.col("_mean")).alias("theta_peak_deg"),
        F.when(peaked, -c2).otherwise(F.lit(0.0)).alias("curvature_deg_per_deg2"),
        F.when(peaked, F.greatest(F.col("_low"), F.lit(5.0))).otherwise(F.col("_low")).alias("theta_min_deg"))


def patch_gate(df: DataFrame, alpha: str, valid, keys=("tile",), min_valid: float = 0.5,
               min_slope_std_deg: float = 0.8, pixels=None) -> DataFrame:
    """Keys of patches with enough valid pixels and enough relief to constrain an angle."""
    ok = F.coalesce(as_col(valid), F.lit(False))
    n = as_col(pixels) if pixels is not None else F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        (F.count_if(ok) / n).alias("_valid"), F.count_if(ok).alias("n_pixels"),
        F.degrees(F.stddev_pop(F.when(ok, F.col(alpha)))).alias("slope_std_deg")).where(
        (F.col("_valid") >= min_valid) & (F.col("slope_std_deg") >= min_slope_std_deg)).drop("_valid")


def fit_patches(df: DataFrame, rv: str, alpha: str, valid, keys=("tile",), min_pixels: int = 200,
                grid=THETA_GRID) -> DataFrame:
    """Per patch the incidence angle that best explains the image.

    For each candidate angle the brightness offset is the median residual and the misfit the rms
    about it; the smaller angle wins a tie. Only patches of at most one block are gathered
    (see `angles.fit_angles`). Patches with fewer than `min_pixels` are left out.
    """
    keys = list(keys)
    first, last, step = grid
    theta = first + step * np.arange(int(round((last - first) / step)) + 1)
    usable = df.where(F.coalesce(as_col(valid), F.lit(False))).select(
        *keys, F.col(rv).alias("rv"), F.col(alpha).alias("alpha"))
    tried = fit_angles(usable, keys, theta, min_pixels).withColumn("theta_deg", F.col("k") * F.lit(float(step)) + F.lit(float(first)))
    best = F.min_by(F.struct("theta_deg", "b", "rms", "n"), F.struct(F.round("rms", 9), "theta_deg"))
    return tried.groupBy(*keys).agg(best.alias("_p")).select(
        *keys, F.col("_p.theta_deg").alias("theta_deg"), F.col("_p.b").alias("brightness_db"),
        F.col("_p.rms").alias("residual_db"), F.col("_p.n").alias("n_pixels"))


def band_table(fits: DataFrame, lat: str = "lat", keys=(), width: float = 20.0, south: float = -70.0,
               minimum: int = 3) -> DataFrame:
    """Weighted mean angle per latitude band, beside the standing profile, with the band's median misfit and angle."""
    band = F.floor((F.col(lat) - south) / width) * F.lit(width) + F.lit(south)
    misfit = F.greatest(F.col("residual_db"), F.lit(0.2))
    w = F.lit(1.0) / (misfit * misfit)
    by = [*keys, "band_south"]
    held = materialise(fits.where((F.col(lat) >= south) & (F.col(lat) < south + 8 * width)).withColumn("band_south", band), "bands")
    table = exact_quantiles(held, by, "residual_db", {"median_residual_db": 0.5}, extra=[
        (F.sum(w * F.col("theta_deg")) / F.sum(w)).alias("theta_deg"), F.avg(lat).alias("_lat")]).where(F.col("n") >= minimum)
    angle = exact_quantiles(held, by, "theta_deg", {"median_theta_deg": 0.5}).select(*by, "median_theta_deg")
    return table.join(angle, by).withColumn("standing_deg", G.incidence_deg("_lat", "left")).drop("_lat")


def guarded_profile(fits: DataFrame, lat: str = "lat", keys=("cycle",), minimum: int = 12,
                    grid_top: float = 55.5) -> DataFrame:
    """The fitted profile with a status; a degenerate fit keeps its row but no profile.

    Degenerate: over 30 % of the patches railed at the top of the grid, or a peak that is not a
    latitude. Too few patches is a status of its own.
    """
    profile = fit_incidence(fits, lat, "theta_deg", keys)
    railed = fits.groupBy(*keys).agg(
        F.avg((F.col("theta_deg") >= grid_top - 0.51).cast("double")).alias("railed"))
    p = attach(profile, railed, keys)
    status = (F.when(F.col("n") < minimum, "too few patches")
              .when((F.col("railed") > 0.30) | (F.abs(F.col("lat_peak_deg")) > 90.0), "degenerate")
              .otherwise("ok"))
    p = p.withColumn("status", status)
    shape = ("lat_peak_deg", "theta_peak_deg", "curvature_deg_per_deg2", "theta_min_deg")
    return p.withColumns({c: F.when(F.col("status") == "ok", F.col(c)) for c in shape})


def datum_offsets(df: DataFrame, stereo: str, gtdr: str, keys=("tile",), minimum: int = 64) -> DataFrame:
    """(keys, _tie): the median of stereo DEM minus altimetry where more than `minimum` posts tie it."""
    keys = list(keys)
    both = F.when(F.col(stereo).isNotNull() & F.col(gtdr).isNotNull(), F.col(stereo) - F.col(gtdr))
    return exact_quantiles(df, keys, both, {"_tie": 0.5}).where(F.col("n") > minimum).select(*keys, "_tie")


def tile_datum_offset(stereo: str, gtdr: str, tile, minimum: int = 64):
    """`datum_offsets` over a window of one tile of bounded size, whose pixels lie together: an exact median, no second pass."""
    both = F.when(F.col(stereo).isNotNull() & F.col(gtdr).isNotNull(), F.col(stereo) - F.col(gtdr))
    return F.when(F.count(both).over(tile) > minimum, F.percentile(both, F.lit(0.5)).over(tile))


def datum_tie(df: DataFrame, stereo: str, gtdr: str, keys=("tile",), minimum: int = 64,
              offsets: DataFrame | None = None) -> DataFrame:
    """Shift the stereo DEM by its median offset to altimetry; NULL where too few posts tie it.

    `offsets` are those of `datum_offsets`, where they are already written.
    """
    tie = datum_offsets(df, stereo, gtdr, keys, minimum) if offsets is None else offsets
    return df.join(tie, list(keys), "left").withColumn(stereo, F.col(stereo) - F.col("_tie")).drop("_tie")
