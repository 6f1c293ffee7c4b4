"""Scores of a predicted surface against independent observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import as_col, attach, mean_where
from ..session import materialise
from .joins import lattice_pixels
from .masks import lattice_interior
from .resample import Footprint, at_scale, footprint_blur, scale_factor
from .stencil import render, slope_magnitude, sobel


def mae(error, mask=True) -> Column:
    return mean_where(F.abs(as_col(error)), as_col(mask))


def rmse(error, mask=True) -> Column:
    return F.sqrt(mean_where(as_col(error) * as_col(error), as_col(mask)))


def sigma_coverage(error, sigma, k: float = 1.0, mask=True) -> Column:
    """Share of errors within k sigma."""
    return mean_where((F.abs(as_col(error)) <= as_col(sigma) * k).cast("double"), as_col(mask))


def calibration(df: DataFrame, error, sigma, mask=True, keys=()) -> DataFrame:
    return df.groupBy(*keys).agg(
        sigma_coverage(error, sigma, 1.0, mask).alias("coverage_1sigma"),
        sigma_coverage(error, sigma, 2.0, mask).alias("coverage_2sigma"),
        mean_where(as_col(sigma), as_col(mask)).alias("mean_sigma_m"),
        rmse(error, mask).alias("rms_error_m"))


def stereo_scores(df: DataFrame, pred: str, dem: str, trust: str, pixel_m: float, height, width,
                  scale_m: float = 1000.0, keys=("tile",)) -> DataFrame:
    """MAE, RMSE and slope MAE per key at the scale the stereo DEM is trusted at.

    Cells count where more than 0.9 of their smoothed mask is trusted; the DEM itself is
    smoothed without the mask.
    """
    band = df.withColumn("_m", F.coalesce(F.col(trust), F.lit(False)).cast("double"))
    small = at_scale(band, [pred, dem, "_m"], pixel_m, scale_m, height, width, keys)
    g = sobel(small, [pred, dem], pixel_m * scale_factor(pixel_m, scale_m), keys)
    err = F.col(pred) - F.col(dem)
    slope = F.degrees(F.abs(slope_magnitude(f"{pred}_de", f"{pred}_dn")
                            - slope_magnitude(f"{dem}_de", f"{dem}_dn")))
    keep = F.col("_m") > 0.9
    return g.groupBy(*keys).agg(
        mae(err, keep).alias("stereo_mae_m"), rmse(err, keep).alias("stereo_rmse_m"),
        mean_where(slope, keep).alias("stereo_slope_mae_deg"))


def altimetry_differences(df: DataFrame, pred: str, gtdr: str, valid: str, fp: Footprint,
                          pixel_m: float, height: int, width: int, stride: int,
                          edge_margin_px: int = 0, keys=("tile",)) -> DataFrame:
    """(keys, prow, pcol, diff, keep): the surface through the footprint minus the posts."""
    posts = lattice_pixels(df.select(*keys, "row", "col", gtdr, valid), stride)
    seen = footprint_blur(df, pred, fp, pixel_m, height, width, keys, at=posts)
    nrow, ncol = ((n - stride // 2 + stride - 1) // stride for n in (height, width))
    keep = F.coalesce(F.col(valid), F.lit(False)) & lattice_interior(
        "prow", "pcol", nrow, ncol, edge_margin_px, stride)
    return seen.select(*keys, "prow", "pcol", (F.col(pred) - F.col(gtdr)).alias("diff"),
                       keep.alias("keep"))


def altimetry_residual(df: DataFrame, pred: str, gtdr: str, valid: str, fp: Footprint, pixel_m: float,
                       height: int, width: int, stride: int, edge_margin_px: int = 0,
                       keys=("tile",), by=()) -> DataFrame:
    """Mean distance of the seen surface from the altimetry posts: the drift check."""
    d = altimetry_differences(df, pred, gtdr, valid, fp, pixel_m, height, width, stride,
                              edge_margin_px, keys)
    return d.groupBy(*(by or keys)).agg(mae("diff", F.col("keep")).alias("alt_resid_m"))


def physics_residual(df: DataFrame, residual, mask, keys=("tile",), fit_offset: bool = True) -> DataFrame:
    """Mean |residual - offset| per key with the offset fitted as the masked mean, beside the
    pixel count and the usable share.

    The offset is one small aggregate joined back, so a hot key needs no window over its rows;
    both sides of the join read the same columns and so share the exchanges below.
    """
    keys = list(keys)
    d = df.select(*keys, F.when(as_col(mask), as_col(residual)).alias("_r"))
    first = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_r").alias("_o"),
                                 (F.count("_r") / F.count(F.lit(1))).alias("valid_fraction"))
    both = attach(d, first, keys)
    gap = F.col("_r") - F.col("_o") if fit_offset else F.col("_r")
    return both.groupBy(*keys, "n", "valid_fraction").agg(F.avg(F.abs(gap)).alias("phys_resid_db"))


def look_psnr(residual, mask, peak_db: float = 50.0, fit_offset: bool = True) -> Column:
    """PSNR of a rendered look in one pass: removing the offset makes the error a variance."""
    r = F.when(as_col(mask), as_col(residual))
    mse = F.var_pop(r) if fit_offset else F.avg(r * r)
    # `greatest` passes over NULL, so a tile without a usable pixel is told apart first.
    floored = F.when(mse.isNotNull(), F.greatest(mse, F.lit(1e-9)))
    return F.log10(F.lit(peak_db * peak_db) / floored) * 10.0


def rendered_residual(df: DataFrame, z: str, observed: str, valid, theta, look, pixel_m,
                      brightness=None, keys=("tile",)) -> DataFrame:
    """Add `residual` (render minus observation) and `usable`."""
    r = render(df, z, theta, look, pixel_m, brightness, keys=keys)
    return r.withColumns({"residual": F.col("rv") - F.col(observed),
                          "usable": F.col("ok") & F.coalesce(as_col(valid), F.lit(False))})


def truth_scores(df: DataFrame, pred: str, truth: str, pixel_m, sigma: str | None = None,
                 keys=("tile",)) -> DataFrame:
    """Per-key MAE, RMSE, slope MAE (and 1-sigma coverage) against a known surface."""
    g = sobel(df, [pred, truth], pixel_m, keys)
    err = F.col(pred) - F.col(truth)
    slope = F.degrees(F.abs(slope_magnitude(f"{pred}_de", f"{pred}_dn")
                            - slope_magnitude(f"{truth}_de", f"{truth}_dn")))
    aggs = [mae(err).alias("mae_vs_truth"), rmse(err).alias("rmse_vs_truth"),
            F.avg(slope).alias("slope_mae_deg")]
    if sigma:
        aggs.append(sigma_coverage(err, sigma).alias("cov_1sigma"))
    return g.groupBy(*keys).agg(*aggs)


def metric_table(long: DataFrame, metrics: list[str]) -> DataFrame:
    """(run, metric, value) rows to one row per run with unweighted means."""
    return long.groupBy("run").pivot("metric", metrics).agg(F.avg("value"))


def skill_table(table: DataFrame, baseline: str, metric: str = "mae_vs_truth") -> DataFrame:
    """Add the skill of each run against the baseline run; NULL where the baseline has no value."""
    base = table.where(F.col("run") == baseline).select(F.col(metric).alias("_base"))
    return attach(table, base).withColumn(
        "skill", F.lit(1.0) - F.col(metric) / F.when(F.col("_base").isNotNull(), F.greatest(F.col("_base"), F.lit(1e-9)))).drop("_base")


def weighted_table(batches: DataFrame, metrics: list[str], weight: str = "n", keys=()) -> DataFrame:
    """Means over batches weighted by their tile counts."""
    return batches.groupBy(*keys).agg(*[
        (F.sum(F.col(m) * F.col(weight)) / F.sum(F.when(F.col(m).isNotNull(), F.col(weight)))).alias(m)
        for m in metrics])


def diagnostics(df: DataFrame, x, y, keys=()) -> DataFrame:
    """Correlation and regression of y on x, as the supervision checks report them."""
    x, y = as_col(x), as_col(y)
    return df.groupBy(*keys).agg(
        F.corr(x, y).alias("correlation"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def direction_correlation(df: DataFrame, de, dn, brightness, azimuths_deg, keys=("tile",)) -> DataFrame:
    """(keys, azimuth_deg, correlation, n): brightness against the slope along each assumed direction.

    Azimuths count clockwise from north. A slope along any direction is a mix of the two axes, so one
    aggregate of moments serves all directions, however many; no row per pixel and direction is made.
    Pixels without a slope or a brightness take no part; NULL where either does not vary.
    """
    de, dn, b = as_col(de), as_col(dn), as_col(brightness)
    use = de.isNotNull() & dn.isNotNull() & b.isNotNull()
    e, n, v = (F.when(use, c) for c in (de, dn, b))
    m = df.groupBy(*keys).agg(
        F.var_pop(e).alias("_ee"), F.var_pop(n).alias("_nn"), F.covar_pop(e, n).alias("_en"), F.var_pop(v).alias("_vv"),
        F.covar_pop(e, v).alias("_ev"), F.covar_pop(n, v).alias("_nv"), F.count_if(use).alias("n"))
    m = m.withColumn("azimuth_deg", F.explode(F.array(*[F.lit(float(a)) for a in azimuths_deg])))
    x, y = F.sin(F.radians("azimuth_deg")), F.cos(F.radians("azimuth_deg"))
    along = x * x * F.col("_ee") + y * y * F.col("_nn") + x * y * F.col("_en") * 2.0
    both = x * F.col("_ev") + y * F.col("_nv")
    r = F.when((along > 0) & (F.col("_vv") > 0), both / F.sqrt(along * F.col("_vv")))
    return m.select(*keys, "azimuth_deg", r.alias("correlation"), "n")


def half_split(df: DataFrame, rank_by: str, value: str, keys=()) -> DataFrame:
    """Mean of `value` in the lower and upper half by `rank_by`.

    The cut is the exact distributed median, not a global `ntile` window; ties stay together. It is written, so the cuts
    of a few groups reach the rows without a shuffle by group.
    """
    from .quantiles import exact_quantiles

    cut = exact_quantiles(df, keys, rank_by, {"_cut": 0.5}, mode="disc")
    d = attach(df, materialise(cut.select(*keys, "_cut"), "cuts"), keys)
    half = F.when(F.col(rank_by) <= F.col("_cut"), 1).otherwise(2)
    return d.withColumn("half", half).groupBy(*keys, "half").agg(
        F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"))
