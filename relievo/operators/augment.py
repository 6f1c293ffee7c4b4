"""Reproducible augmentation and feature assembly for tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import radiometry as R
from ..functions.base import as_col, draws, uniform

LOOKS = ("left", "right", "stereo")


def dihedral(df: DataFrame, k, flip_h, flip_v, height, width, vectors=()) -> DataFrame:
    """Quarter turns (counter-clockwise) then flips, for pixels and look vectors together.

    `k`, `flip_h`, `flip_v` may be columns, so every tile can have its own transform. Vectors
    are STRUCT<east, north> columns.
    """
    k = F.pmod(as_col(k).cast("int"), F.lit(4))
    fh, fv, h, w = as_col(flip_h), as_col(flip_v), as_col(height), as_col(width)
    r, c = F.col("row"), F.col("col")
    row = F.when(k == 1, w - 1 - c).when(k == 2, h - 1 - r).when(k == 3, c).otherwise(r)
    col = F.when(k == 1, r).when(k == 2, w - 1 - c).when(k == 3, h - 1 - r).otherwise(c)
    swapped = (k % 2) == 1
    hh, ww = F.when(swapped, w).otherwise(h), F.when(swapped, h).otherwise(w)
    cols = {"row": F.when(fv, hh - 1 - row).otherwise(row).cast("int"),
            "col": F.when(fh, ww - 1 - col).otherwise(col).cast("int")}
    for v in vectors:
        e, n = F.col(v)["east"], F.col(v)["north"]
        east = F.when(k == 1, -n).when(k == 2, -e).when(k == 3, n).otherwise(e)
        north = F.when(k == 1, e).when(k == 2, -n).when(k == 3, -e).otherwise(n)
        cols[v] = F.struct(F.when(fh, -east).otherwise(east).alias("east"),
                           F.when(fv, -north).otherwise(north).alias("north"))
    return df.withColumns(cols)


def look_dropout(df: DataFrame, seed: int, key: str = "tile", p: float = 0.4,
                 looks=("right", "stereo")) -> DataFrame:
    """Per tile, drop a look with probability `p`; image and mask go together."""
    cols = {}
    for name in looks:
        gone = uniform(F.lit(seed), F.col(key), F.lit(name)) < p
        cols[f"rv_{name}"] = F.when(~gone, F.col(f"rv_{name}"))
        cols[f"valid_{name}"] = F.col(f"valid_{name}") & ~gone
    return df.withColumns(cols)


def drop_second_looks(channels: DataFrame) -> DataFrame:
    """Channels as if only the left look existed."""
    return channels.withColumns({c: F.lit(0.0) for c in (
        "sar_right_db", "mask_right", "sar_stereo_db", "mask_stereo")})


def crop_origin(seed: int, tile, n: int, crop: int):
    """Reproducible (row, col) of a crop of `crop` pixels in a tile of `n`."""
    if crop >= n:
        return F.lit(0), F.lit(0)
    return tuple(F.floor(u * (n - crop + 1)).cast("int")
                 for u in draws(2, F.lit(seed), as_col(tile), F.lit("crop")))


def decode_looks(df: DataFrame, looks=LOOKS, gain_db: float = 0.0, seed: int = 0,
                 key: str = "tile") -> DataFrame:
    """Add `rv_*` and `valid_*` from `dn_*`, gated by `has_*`; an optional gain per tile and look."""
    cols = {}
    for name in looks:
        has = F.col(f"has_{name}") if f"has_{name}" in df.columns else F.lit(True)
        valid = F.coalesce((F.col(f"dn_{name}") != K.DN_NODATA) & has, F.lit(False))
        rv = R.rv_from_dn(f"dn_{name}")
        if gain_db:
            rv = R.gain(rv, gain_db, F.lit(seed), F.col(key), F.lit(f"gain {name}"))
        cols[f"rv_{name}"] = F.when(valid, rv)
        cols[f"valid_{name}"] = valid
    return df.withColumns(cols)


def assemble_channels(df: DataFrame, keys=("tile",)) -> DataFrame:
    """The 18 input channels per pixel.

    Needs rv_*/valid_* of three looks, gtdr_up, emissivity, theta_* (radians), look_left and
    lat_deg. Altimetry is centred on the tile mean, an aggregate joined back; a gap in it has the mean.
    """
    keys = list(keys)
    ref = df.groupBy(*keys).agg(F.avg("gtdr_up").alias("_ref"))
    d = df.join(ref, keys)
    ch = {}
    for n in LOOKS:
        ch[f"sar_{n}_db"] = F.coalesce(F.when(F.col(f"valid_{n}"), F.col(f"rv_{n}")), F.lit(0.0)) / K.RV_SCALE_DB
        ch[f"mask_{n}"] = F.col(f"valid_{n}").cast("double")
    ch["gtdr_up"] = F.coalesce(F.col("gtdr_up") - F.col("_ref"), F.lit(0.0)) / K.GTDR_SCALE_M
    ch["emissivity"] = (F.coalesce(F.col("emissivity"), F.lit(K.EMISSIVITY_MEAN))
                        - K.EMISSIVITY_MEAN) / K.EMISSIVITY_SCALE
    for n in LOOKS:
        ch[f"theta_{n}_sin"] = F.sin(F.col(f"theta_{n}"))
        ch[f"theta_{n}_cos"] = F.cos(F.col(f"theta_{n}"))
    ch["look_east"] = F.col("look_left")["east"]
    ch["look_north"] = F.col("look_left")["north"]
    ch["lat_sin"] = F.sin(F.radians(F.col("lat_deg")))
    ch["lat_cos"] = F.cos(F.radians(F.col("lat_deg")))
    return d.select(*keys, "row", "col", *[c.alias(n) for n, c in ch.items()])


def assemble_conditioning(df: DataFrame, keys=("tile",)) -> DataFrame:
    """The 10 conditioning values per tile, with any-valid flags of the second looks."""
    aggs = []
    for n in LOOKS:
        t = F.max(f"theta_{n}")
        aggs += [F.sin(t).alias(f"theta_{n}_sin"), F.cos(t).alias(f"theta_{n}_cos")]
    aggs += [F.max(F.col("look_left")["east"]).alias("look_east"),
             F.max(F.col("look_left")["north"]).alias("look_north"),
             F.bool_or("valid_right").cast("double").alias("has_right"),
             F.bool_or("valid_stereo").cast("double").alias("has_stereo")]
    return df.groupBy(*keys).agg(*aggs)
