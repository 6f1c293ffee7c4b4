"""Values of the training objective's terms. Each is 0 where its supervision is absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import radiometry as R
from ..functions.base import as_col, attach, mean_or_zero
from .metrics import altimetry_differences, rendered_residual
from .resample import Footprint, adaptive_pool, gaussian_downsample, scale_factor
from .stencil import neighbour_steps, rms_slope, sobel

SCALE = K.OBJECTIVE_SCALE


def _gradient_gap(df, a, b):
    return F.abs(F.col(f"{a}_de") - F.col(f"{b}_de")) + F.abs(F.col(f"{a}_dn") - F.col(f"{b}_dn"))


def gradient_l1(df: DataFrame, a: str, b: str, pixel_m, mask=True, keys=("tile",)) -> DataFrame:
    g = sobel(df, [a, b], pixel_m, keys)
    return g.groupBy(*keys).agg(mean_or_zero(_gradient_gap(g, a, b), mask).alias("gradient_l1"))


def earth_term(df: DataFrame, z: str, truth: str, pixel_m, mask=True, keys=("tile",)) -> DataFrame:
    g = sobel(df, [z, truth], pixel_m, keys)
    height = mean_or_zero(F.abs(F.col(z) - F.col(truth)), mask) / SCALE["earth_m"]
    slope = mean_or_zero(_gradient_gap(g, z, truth), mask) / SCALE["slope_rad"]
    return g.groupBy(*keys).agg((height + slope).alias("earth"))


def _masked_coarse(df, z, target, valid, pixel_m, height, width, scale_m, keys, also=()):
    """Bring z, the masked target and the mask to the trusted scale; normalise by the mask."""
    f = scale_factor(pixel_m, scale_m)
    m = F.coalesce(as_col(valid), F.lit(False)).cast("double")
    src = df.withColumns({"_w": m, "_t": F.coalesce(F.col(target), F.lit(0.0)) * m})
    small = gaussian_downsample(src, [z, "_t", "_w", *also], f, height, width, keys=keys)
    return small.withColumns({"_t": F.col("_t") / F.greatest(F.col("_w"), F.lit(1e-8)),
                              "_keep": F.col("_w") > 0.5}), f


def stereo_term(df: DataFrame, z: str, dem: str, valid, pixel_m: float, height, width,
                scale_m: float = 1000.0, grad_weight: float = 1.0, keys=("tile",)) -> DataFrame:
    """Robust height and gradient gap to the mask-normalised stereo DEM at its trusted scale."""
    small, f = _masked_coarse(df, z, dem, valid, pixel_m, height, width, scale_m, keys)
    g = sobel(small, [z, "_t"], pixel_m * f, keys)
    high = mean_or_zero(R.charbonnier(F.col(z) - F.col("_t")), F.col("_keep")) / SCALE["stereo_m"]
    slope = mean_or_zero(_gradient_gap(g, z, "_t"), F.col("_keep")) / SCALE["slope_rad"]
    return g.groupBy(*keys).agg((high + slope * grad_weight).alias("stereo"))


def altimetry_term(df: DataFrame, z: str, gtdr: str, valid: str, fp: Footprint, pixel_m: float,
                   height: int, width: int, stride: int, edge_margin_px: int = 0,
                   keys=("tile",)) -> DataFrame:
    d = altimetry_differences(df, z, gtdr, valid, fp, pixel_m, height, width, stride, edge_margin_px, keys)
    return d.groupBy(*keys).agg(
        (mean_or_zero(F.abs(F.col("diff")), F.col("keep")) / SCALE["alt_m"]).alias("alt"))


def physics_term(df: DataFrame, z: str, observed: str, valid, theta, look, pixel_m: float, height, width,
                 brightness=None, levels: int = 2, keys=("tile",), name: str = "phys") -> DataFrame:
    """Huber residual at full resolution and on a pyramid of the residual image.

    Adds the diagnostics `phys_resid_db` and `phys_valid_frac`.
    """
    keys = list(keys)
    r = rendered_residual(df, z, observed, valid, theta, look, pixel_m, brightness, keys)
    r = r.select(*keys, "row", "col", F.when(F.col("usable"), F.col("residual")).otherwise(
        F.lit(0.0)).alias("_r"), F.col("usable").cast("double").alias("_w"))
    full = r.groupBy(*keys).agg(
        mean_or_zero(R.huber("_r"), F.col("_w") > 0).alias("_h0"),
        mean_or_zero(F.abs(F.col("_r")), F.col("_w") > 0).alias("phys_resid_db"),
        F.avg("_w").alias("phys_valid_frac"))
    total = F.col("_h0")
    for level in range(1, max(1, levels)):
        small = gaussian_downsample(r, ["_r", "_w"], 4 ** level, height, width, keys=keys)
        coarse = small.groupBy(*keys).agg(mean_or_zero(
            R.huber(F.col("_r") / F.greatest(F.col("_w"), F.lit(1e-8))),
            F.col("_w") > 0.9).alias(f"_h{level}"))
        full = attach(full, coarse, keys, "left")
        total = total + F.coalesce(F.col(f"_h{level}"), F.lit(0.0))
    return full.select(*keys, (total / (max(1, levels) * SCALE["phys_db"])).alias(name),
                       "phys_resid_db", "phys_valid_frac")


def cross_look_term(df: DataFrame, z_one_look: str, observed: str, valid, theta, look, pixel_m: float,
                    height, width, brightness=None, keys=("tile",)) -> DataFrame:
    """The physics term on a look the prediction did not use."""
    return physics_term(df, z_one_look, observed, valid, theta, look, pixel_m, height, width,
                        brightness, keys=keys, name="cross").select(*keys, "cross")


def rms_term(df: DataFrame, z: str, roughness: str, valid: str, pixel_m: float, height: int, width: int,
             cell_m: float = 4641.0, keys=("tile",)) -> DataFrame:
    cell = max(1, round(cell_m / pixel_m))
    out_h, out_w = height // cell, width // cell
    pred = rms_slope(df, z, pixel_m, cell, height, width, keys)
    seen = df.withColumn("_ok", F.coalesce(F.col(valid), F.lit(False)).cast("int"))
    target = adaptive_pool(seen, {"_t": ("avg", roughness), "_ok": ("max", "_ok")}, height, width,
                           out_h, out_w, keys)
    return pred.join(target, [*keys, "crow", "ccol"]).groupBy(*keys).agg(
        (mean_or_zero(F.abs(F.col("rms_slope") - F.col("_t")), F.col("_ok") > 0)
         / SCALE["rms_rad"]).alias("rms"))


def nll_term(df: DataFrame, z: str, logvar: str, target: str, valid, unsupervised=None,
             unsupervised_weight: float = 0.5, scale_m: float = 1000.0, pixel_m: float = 75.0,
             height=None, width=None, keys=("tile",)) -> DataFrame:
    """Gaussian NLL at the trusted scale plus a hinge where nothing supervises the surface.

    The variance, not its log, is averaged to the coarse cell.
    """
    keys = list(keys)
    src = df.withColumn("_var", F.exp(F.col(logvar)))
    small, _ = _masked_coarse(src, z, target, valid, pixel_m, height, width, scale_m, keys, ("_var",))
    lv = F.log(F.greatest(F.col("_var"), F.lit(1e-8)))
    gap = F.col(z) - F.col("_t")
    nll = (lv + gap * gap / F.greatest(F.exp(lv), F.lit(1e-8))) * 0.5
    out = small.groupBy(*keys).agg(mean_or_zero(nll, F.col("_keep")).alias("nll"))
    if unsupervised is None:
        return out
    flags = df.select(*keys, F.col(logvar).alias("_lv"),
                      F.coalesce(as_col(valid), F.lit(False)).alias("_ok"),
                      F.coalesce(as_col(unsupervised), F.lit(False)).alias("_un"))
    floor = flags.groupBy(*keys).agg(mean_or_zero("_lv", F.col("_ok")).alias("_floor"))
    both = attach(flags, floor, keys)
    hinge = both.groupBy(*keys).agg(mean_or_zero(
        F.greatest(F.col("_floor") - F.col("_lv"), F.lit(0.0)), F.col("_un")).alias("_hinge"))
    joined = attach(out, hinge, keys)
    return joined.select(*keys, (F.col("nll") + F.col("_hinge") * unsupervised_weight).alias("nll"))


def smoothness_term(surface: DataFrame, z: str, brightness: DataFrame, b: str, keys=("tile",)) -> DataFrame:
    """Brightness total variation plus a thousandth of the mean |Laplacian| of the surface."""
    tv = neighbour_steps(brightness, b, keys).groupBy(*keys).agg(
        (F.avg(F.abs(F.col("step_e"))) + F.avg(F.abs(F.col("step_s")))).alias("_tv"))
    lap = neighbour_steps(surface, z, keys).groupBy(*keys).agg(
        F.avg(F.abs(F.col("laplacian"))).alias("_lap"))
    return tv.join(lap, list(keys)).select(*keys, (F.col("_tv") + F.col("_lap") * 1e-3).alias("reg"))


def total(terms: DataFrame, weights: dict[str, float] | None = None, ramp: float = 1.0,
          keys=("tile",)) -> DataFrame:
    """Weighted sum of long (keys, term, value) rows; unknown terms are ignored."""
    weights = weights or K.OBJECTIVE_WEIGHT
    w = F.create_map(*[x for t, v in weights.items() for x in (
        F.lit(t), F.lit(v * ramp if t in K.RAMPED_TERMS else v))])
    part = F.try_element_at(w, F.col("term")) * F.col("value")
    return terms.groupBy(*keys).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("total"))


def smoothed_history(steps: DataFrame, value: str = "loss", order: str = "step", beta: float = 0.98,
                     keys=("run", "term"), block: int = 4096) -> DataFrame:
    """Exponentially smoothed value after the last record, seeded with the first value.

    Each record turns s into beta * s + (1 - beta) * x. The records of one block of steps are one such map,
    s -> decay * s + gain, and maps of blocks combine in order, so no run has to be folded in one task. Gaps in the
    steps and steps in any order do no harm; records of one step go by value, those without a step or value are skipped.
    """
    keys = list(keys)
    use = steps.where(F.col(order).isNotNull() & F.col(value).isNotNull()).select(
        *keys, F.col(order).alias("_at"), F.col(value).cast("double").alias("_x"), F.floor(F.col(order) / block).alias("_blk"))
    back = Window.partitionBy(*keys, "_blk").orderBy(F.desc("_at"), F.desc("_x"))
    maps = use.withColumn("_later", F.row_number().over(back) - 1).groupBy(*keys, "_blk").agg(
        F.sum(F.col("_x") * F.pow(F.lit(beta), F.col("_later")) * (1.0 - beta)).alias("_gain"), F.count("*").alias("_n"),
        F.max("_at").alias("_last"), F.min(F.struct("_at", "_x")).alias("_first"))
    after = Window.partitionBy(*keys).orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    lifted = maps.withColumn("_lift", F.pow(F.lit(beta), F.coalesce(F.sum("_n").over(after), F.lit(0))))
    return lifted.groupBy(*keys).agg(
        F.max("_last").alias("steps"),
        (F.sum(F.col("_gain") * F.col("_lift")) + F.min("_first")["_x"] * F.pow(F.lit(beta), F.sum("_n"))).alias("smoothed"))
