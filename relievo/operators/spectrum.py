"""Radially averaged power spectrum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import spread


def tile_power(df: DataFrame, band: str, size: int, pixel_m: float, keys=("tile",)) -> DataFrame:
    """(keys, frequency, power) for every non-zero frequency of every square tile.

    A Fourier transform needs the whole tile, so this is a grouped map; a tile is bounded by
    its fixed size. Incomplete tiles are filled with the tile mean.
    """
    keys = list(keys)
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("frequency", T.DoubleType()), T.StructField("power", T.DoubleType())])

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        z = pdf[band].to_numpy(dtype=float)
        a = np.full((size, size), np.nanmean(z))
        a[pdf["row"], pdf["col"]] = np.where(np.isnan(z), np.nanmean(z), z)
        taper = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(size) / (size - 1))
        p = np.abs(np.fft.fft2((a - a.mean()) * np.outer(taper, taper))) ** 2
        axis = np.fft.fftfreq(size, d=pixel_m)
        f = np.hypot(axis[:, None], axis[None, :]).ravel()
        keep = f > 0
        out = pd.DataFrame({"frequency": f[keep], "power": p.ravel()[keep]})
        for k in keys:
            out[k] = pdf[k].iat[0]
        return out[schema.fieldNames()]

    return spread(df.select(*keys, "row", "col", band), *keys).groupBy(*keys).applyInPandas(transform, schema)


def radial_spectrum(power: DataFrame, n_bins: int = 64, group=()) -> DataFrame:
    """Mean power per logarithmic frequency bin as (group, bin, wavelength_m, power).

    The highest frequency closes the last bin and, as with half-open bins, falls outside it.
    Empty bins are kept with NULL power.
    """
    group = list(group)
    # One row per distinct frequency first: tiles share their frequencies, so from here on the
    # rows are bounded by the tile size and the transform runs once.
    per_f = power.groupBy(*group, "frequency").agg(F.sum("power").alias("_s"), F.count("power").alias("_n"))
    w = Window.partitionBy(*group)
    per_f = per_f.withColumns({"_lo": F.min("frequency").over(w), "_hi": F.max("frequency").over(w)})
    span = F.log(F.col("_hi") / F.col("_lo"))
    binned = per_f.withColumn("bin", F.floor(
        F.log(F.col("frequency") / F.col("_lo")) / span * n_bins + 1e-9).cast("int"))
    means = binned.groupBy(*group, "_lo", "_hi", "bin").agg((F.sum("_s") / F.sum("_n")).alias("power"))
    curve = means.groupBy(*group, "_lo", "_hi").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "power"))).alias("_m"))
    out = curve.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    return out.select(
        *group, "bin", (F.lit(1.0) / (F.col("_lo") * F.exp(span * (F.col("bin") + 0.5) / n_bins))).alias("wavelength_m"),
        F.try_element_at("_m", F.col("bin")).alias("power"))
