"""Radar backscatter: DN coding, the scattering law and display stretches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .base import as_col, clamp, draws, uniform


def rv_from_dn(dn) -> Column:
    """Flattened backscatter in dB from an 8-bit DN; DN 0 is nodata and becomes NULL."""
    dn = as_col(dn)
    return F.when(dn != K.DN_NODATA, (dn.cast("double") - 1.0) / K.DN_SCALE - K.DN_OFFSET)


def dn_from_rv(rv) -> Column:
    """8-bit DN from dB, half-even rounding, never the nodata code."""
    code = F.rint((clamp(rv, K.RV_MIN_DB, K.RV_MAX_DB) + K.DN_OFFSET) * K.DN_SCALE + 1.0)
    return clamp(code, 1.0, 255.0)


def altimetry_from_raw(raw) -> Column:
    """Altimetry metres; the nodata code becomes NULL and never 0 m."""
    return F.nullif(as_col(raw), F.lit(K.ALTIMETRY_NODATA)).cast("double")


def scaled(raw, nodata, scale=1.0, offset=0.0) -> Column:
    """Stored value to physical value; the nodata test is on the stored value."""
    raw = as_col(raw)
    usable = raw.isNotNull() & ~F.isnan(raw.cast("double")) & (raw != as_col(nodata))
    return F.when(usable, raw * as_col(scale) + as_col(offset))


def scatter_law(theta) -> Column:
    """Backscatter cross-section at an incidence angle in radians."""
    t = clamp(theta, 1e-3, math.pi / 2 - 1e-3)
    base = F.sin(t) + F.cos(t) * K.LAW_C
    return F.cos(t) * K.LAW_A / F.greatest(base * base * base, F.lit(1e-8))


def scatter_law_db(theta) -> Column:
    """The law in dB, with the floors of the angle fit."""
    t = clamp(theta, 1e-3, math.pi / 2 - 1e-3)
    base = F.greatest(F.sin(t) + F.cos(t) * K.LAW_C, F.lit(1e-9))
    return F.log10(F.greatest(F.cos(t) * K.LAW_A / (base * base * base), F.lit(1e-12))) * 10.0


def flattened_db(local, nominal) -> Column:
    """Backscatter of a facet relative to the law at the nominal angle, in dB."""
    ratio = scatter_law(local) / F.greatest(scatter_law(nominal), F.lit(1e-8))
    return F.log10(F.greatest(ratio, F.lit(1e-8))) * 10.0


def flatten_sigma0(sigma0_db, incidence) -> Column:
    """Calibrated backscatter (dB) to flattened units, with the per-pixel incidence."""
    return as_col(sigma0_db) - F.log10(scatter_law(incidence)) * 10.0


def local_incidence(alpha, theta) -> Column:
    return as_col(theta) - as_col(alpha)


def renderable(alpha, theta, margin_deg: float = 5.0) -> Column:
    """False in or near layover and shadow, where the small-slope model fails."""
    alpha, margin = as_col(alpha), math.radians(margin_deg)
    return (alpha < as_col(theta) - margin) & (alpha > -(math.pi / 2 - margin))


def usable_facet(alpha, theta) -> Column:
    """Facets that carry information in the angle fit: 3 to 87 degrees of local incidence."""
    local = as_col(theta) - as_col(alpha)
    return (local > math.radians(3.0)) & (local < math.radians(87.0))


def speckle(rv, looks: int, *seed) -> Column:
    """Gamma(looks) speckle in linear power; the draw is a function of the seed columns."""
    drawn = None
    for first in range(0, looks, 6):
        for u in draws(min(6, looks - first), *seed, F.lit(first)):
            drawn = -F.log(u) if drawn is None else drawn - F.log(u)
    power = F.pow(F.lit(10.0), as_col(rv) / 10.0) * (drawn / looks)
    return F.log10(F.greatest(power, F.when(as_col(rv).isNotNull(), F.lit(1e-6)))) * 10.0


def gain(rv, max_db: float, *seed) -> Column:
    """A uniform dB shift, the same for every row that shares the seed columns."""
    return as_col(rv) + (uniform(*seed) * 2.0 - 1.0) * max_db


def stripe(rv, col, amplitude_db: float, wavelength, phase) -> Column:
    """Low-frequency gain stripe along the column direction."""
    turn = as_col(col).cast("double") * (2.0 * math.pi) / as_col(wavelength) + as_col(phase)
    return as_col(rv) + F.sin(turn) * amplitude_db


def worn(speckled, col, tile_seed, stripe_db: float = 0.8, wavelength=(40.0, 200.0), gain_db: float = 1.5) -> Column:
    """Stripe and gain of the tile on speckled radar."""
    u_length, u_phase, u_gain = draws(3, *tile_seed, F.lit("degrade"))
    wl = u_length * (wavelength[1] - wavelength[0]) + wavelength[0]
    phase = u_phase * (2.0 * math.pi)
    return stripe(speckled, col, stripe_db, wl, phase) + (u_gain * 2.0 - 1.0) * gain_db


def degrade(df: DataFrame, rv: str, col: str, tile_seed, pixel_seed, looks: int = 6, stripe_db: float = 0.8,
            wavelength=(40.0, 200.0), gain_db: float = 1.5, quantise: bool = True) -> DataFrame:
    """Speckle, stripe, gain and DN round trip: make clean radar look like the archive.

    Adds `speckled` and `degraded`. Each step is a column of its own: a value that a later step tests and uses
    is drawn once, not once for every mention.
    """
    d = df.withColumn("speckled", speckle(rv, looks, *pixel_seed))
    d = d.withColumn("degraded", worn("speckled", col, tile_seed, stripe_db, wavelength, gain_db))
    if not quantise:
        return d
    return d.withColumn("degraded", dn_from_rv("degraded")).withColumn("degraded", rv_from_dn("degraded"))


def charbonnier(x, eps: float = 1e-3) -> Column:
    return F.sqrt(as_col(x) * as_col(x) + eps * eps)


def huber(x, delta: float = 1.0) -> Column:
    a = F.abs(as_col(x))
    return F.when(a <= delta, a * a * 0.5).otherwise((a - 0.5 * delta) * delta)


def stretch_sar(rv) -> Column:
    """dB to an 8-bit display level, truncated."""
    return clamp((as_col(rv) + 12.0) / 24.0 * 255.0, 0.0, 255.0).cast("int")


def _ramp_channel(z: Column, channel: int) -> Column:
    stops = [(m, float(rgb[channel])) for m, rgb in K.COLOUR_RAMP]
    out = F.when(z <= stops[0][0], F.lit(stops[0][1]))
    for (m0, v0), (m1, v1) in zip(stops, stops[1:]):
        out = out.when(z < m1, (z - m0) * ((v1 - v0) / (m1 - m0)) + v0)
    return F.when(z.isNotNull(), out.otherwise(F.lit(stops[-1][1])).cast("int"))


def colour_relief(z) -> Column:
    """Hypsometric tint as STRUCT<red, green, blue>, truncated to integers."""
    z = as_col(z)
    return F.struct(*[_ramp_channel(z, i).alias(n) for i, n in enumerate(("red", "green", "blue"))])


def confidence_fog(sigma) -> Column:
    """Opacity of the grey uncertainty overlay."""
    return (clamp((as_col(sigma) - 40.0) / 300.0, 0.0, 1.0) * 200.0).cast("int")


def coverage_tint(covered) -> Column:
    return F.struct(F.lit(0).alias("red"), F.lit(220).alias("green"), F.lit(140).alias("blue"),
                    F.when(as_col(covered), 110).otherwise(0).alias("alpha"))


def emissivity_tint(e) -> Column:
    n = clamp((as_col(e) - 0.5) / 0.4, 0.0, 1.0)
    return F.struct(((F.lit(1.0) - n) * 255.0).cast("int").alias("red"),
                    (n * 80.0 + 120.0).cast("int").alias("green"),
                    (n * 200.0).cast("int").alias("blue"))
