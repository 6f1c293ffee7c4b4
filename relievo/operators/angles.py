"""The angle fit: a patch of one block at once; larger ones as blocks of pixels, with histograms of residuals that add
up, then one look into the median's bin."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .blocks import spread

#: Pixels of a patch that one task works on together.
BLOCK_PIXELS = 16_384
#: Bins of a residual histogram: about the square root of the pixels of the patch, within these limits.
BINS = (16, 4096)
#: Candidate angles whose histograms travel in one row.
TOGETHER = 16
#: Usable local incidence.
NEAR, STEEP = math.radians(3.0), math.radians(87.0)


def scatter_law_db(sin: np.ndarray, cos: np.ndarray) -> np.ndarray:
    """The law in dB, as `radiometry.scatter_law_db`, from sine and cosine of the angle of a usable facet."""
    base = sin + cos * K.LAW_C
    return 10.0 * np.log10(cos * K.LAW_A / (base * base * base))


def residuals(theta: np.ndarray, rv: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, usable) by (angle, pixel); the law is computed once for each distinct slope, and 0 stands for what is not usable."""
    alpha, at = np.unique(alpha, return_inverse=True)
    local = theta[:, None] - alpha[None, :]
    usable = (local > NEAR) & (local < STEEP)
    s, c, sa, ca = np.sin(theta)[:, None], np.cos(theta)[:, None], np.sin(alpha)[None, :], np.cos(alpha)[None, :]
    with np.errstate(invalid="ignore", divide="ignore"):
        law = scatter_law_db(s * ca - c * sa, c * ca + s * sa) - scatter_law_db(np.sin(theta), np.cos(theta))[:, None]
    usable = usable[:, at]
    return np.where(usable, rv[None, :] - law[:, at], 0.0), usable


def fit_whole(theta: np.ndarray, rv: np.ndarray, alpha: np.ndarray, min_pixels: int) -> tuple[np.ndarray, ...]:
    """(k, b, rms, n) of a patch of one block, for the angles with enough usable pixels."""
    found = []
    step = max(TOGETHER, (1 << 16) // max(len(rv), 1))
    for lo in range(0, len(theta), step):
        value, usable = residuals(theta[lo:lo + step], rv, alpha)
        n = usable.sum(axis=1)
        kept = np.flatnonzero((n >= min_pixels) & (n > 0))
        value, usable, n = value[kept], usable[kept], n[kept]
        ranked = np.sort(np.where(usable, value, np.inf), axis=1)
        middle = np.stack([(n - 1) // 2, n // 2], axis=1)
        b = np.take_along_axis(ranked, middle, axis=1).sum(axis=1) / 2.0
        off = np.where(usable, value - b[:, None], 0.0)
        found.append((lo + kept, b, np.sqrt(np.square(off).sum(axis=1) / n), n))
    return tuple(np.concatenate(x) for x in zip(*found))


class Residuals:
    """Residuals (angle, pixel) of one block of pixels for some candidate angles, and the bin each falls into.

    Bins are equal parts of the range that the residuals of the whole patch can have at an angle; it
    follows from the extremes of the patch, since the law falls with the angle. All blocks of a patch thus
    share their bins, and the second look finds a value in the same bin as the first. Facets that are not
    `usable` have residual 0.
    """

    def __init__(self, theta: np.ndarray, pdf: pd.DataFrame):
        one, alpha = pdf.iloc[0], pdf["alpha"].to_numpy()
        self.bins = int(min(max(2 ** math.ceil(math.log2(math.sqrt(one["_n"]))), BINS[0]), BINS[1]))
        base = scatter_law_db(np.sin(theta), np.cos(theta))
        self.value, self.usable = residuals(theta, pdf["rv"].to_numpy(), alpha)

        def end(alpha):
            t = np.clip(theta - alpha, NEAR, STEEP)
            return scatter_law_db(np.sin(t), np.cos(t)) - base

        low = one["_rv_low"] - end(one["_alpha_high"])
        high = one["_rv_high"] - end(one["_alpha_low"])
        #: Sums are taken about the middle of the range, so a narrow spread is not lost in them.
        self.centre = (low + high) / 2.0
        scale = self.bins / np.maximum(high - low, 1e-12)
        self.bin = np.clip((self.value - low[:, None]) * scale[:, None], 0, self.bins - 1).astype("int32")


def _fold(df: DataFrame, by: list[str], merge, finish, schema: str) -> DataFrame:
    """The rows of each group, sorted and read as a stream, taken together one by one; `finish` gives the result rows."""
    def work(batches):
        now, held = None, None
        for pdf in batches:
            out = []
            for key, row in zip(zip(*(pdf[c].tolist() for c in by)), pdf.to_dict("records")):
                if key != now:
                    if held is not None:
                        out += [(*now, *x) for x in finish(held)]
                    now, held = key, None
                held = merge(held, row)
            if out:
                yield pd.DataFrame(out)
        if held is not None:
            yield pd.DataFrame([(*now, *x) for x in finish(held)])

    return spread(df, *by).sortWithinPartitions(*by).mapInPandas(work, schema)


def _summed(held, row):
    """Counts, sums and histograms of a patch at the angles of one group, over its blocks."""
    new = [np.frombuffer(row[c], k) for c, k in (("n", "int64"), ("s1", "float64"), ("s2", "float64"), ("hist", "int64"))]
    return new if held is None else [x + y for x, y in zip(held, new)]


def _middle(held):
    """The bins that hold the two middle ranks of each angle, and the values below them."""
    n, s1, s2, hist = held
    up_to = np.cumsum(hist.reshape(len(n), -1), axis=1)
    first = (up_to <= ((n - 1) // 2)[:, None]).sum(axis=1)
    last = (up_to <= (n // 2)[:, None]).sum(axis=1)
    below = np.where(first > 0, np.take_along_axis(up_to, np.maximum(first - 1, 0)[:, None], 1)[:, 0], 0)
    some = np.maximum(n, 1)
    yield tuple(x.tobytes() for x in (n, s1 / some, s2 / some, first, last, below))


def _distinct(angle, value, count):
    """Distinct (angle, value) in ascending order, with the sum of their counts."""
    order = np.lexsort((value, angle))
    angle, value, count = angle[order], value[order], count[order]
    new = np.flatnonzero(np.concatenate(([True], (angle[1:] != angle[:-1]) | (value[1:] != value[:-1]))))[:len(angle)]
    return angle[new], value[new], np.add.reduceat(count, new) if len(new) else count


def _gathered(held, row):
    """The distinct values in the middle bins of a patch, over its blocks."""
    new = [np.frombuffer(row[c], k) for c, k in (("angle", "int64"), ("value", "float64"), ("count", "int64"))]
    return row, new if held is None else _distinct(*(np.concatenate(x) for x in zip(held[1], new)))


def _fitted(held):
    """For each angle of a group the median, the misfit about it and the number of pixels."""
    row, (angle, value, count) = held
    n, m1, m2, below, centre = (np.frombuffer(row[c], k) for c, k in (
        ("n", "int64"), ("m1", "float64"), ("m2", "float64"), ("below", "int64"), ("centre", "float64")))
    start, up_to = np.searchsorted(angle, np.arange(len(n) + 1)), np.concatenate(([0], np.cumsum(count)))
    for i in np.flatnonzero(np.diff(start)):
        here = up_to[start[i] + 1:start[i + 1] + 1] - up_to[start[i]] + below[i]
        at = np.searchsorted(here, [(n[i] - 1) // 2, n[i] // 2], "right") + start[i]
        b = value[at].sum() / 2.0
        off = b - centre[i]
        yield row["g"] * TOGETHER + int(i), b, math.sqrt(max(m2[i] - 2.0 * off * m1[i] + off * off, 0.0)), int(n[i])


def fit_angles(pixels: DataFrame, keys: list[str], theta_deg: np.ndarray, min_pixels: int) -> DataFrame:
    """(keys, k, b, rms, n): for each patch and candidate angle k the median residual and the misfit about it.

    A patch of at most BLOCK_PIXELS is one group and is fitted in one look. The pixels (keys, rv, alpha) of a larger one are
    dealt to blocks of about that size by a digest, so a patch that holds a third of them is spread. A block computes the residuals of all angles and hands on one row with
    histograms for every TOGETHER angles, not a row per pixel and angle. The histograms of a patch add
    up to the bin of the median, and a second look at the blocks brings the distinct values of that bin alone.
    Both sums are streams over the blocks' rows. The median is exact; pixels with a NULL key, or without a
    value, take no part, and angles with fewer than `min_pixels` usable ones are left out.
    """
    theta = np.radians(theta_deg)
    groups = [theta[lo:lo + TOGETHER] for lo in range(0, len(theta), TOGETHER)]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.schema if f.name in keys)
    ok = F.col("rv").isNotNull() & F.col("alpha").isNotNull() & ~F.isnan("rv") & ~F.isnan("alpha")
    for c in keys:
        ok = ok & F.col(c).isNotNull()
    pixels = pixels.where(ok).select(*keys, F.col("rv").cast("double").alias("rv"), F.col("alpha").cast("double").alias("alpha"))
    extent = pixels.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("rv").alias("_rv_low"), F.max("rv").alias("_rv_high"),
        F.min("alpha").alias("_alpha_low"), F.max("alpha").alias("_alpha_high"))
    parts = F.ceil(F.col("_n") / BLOCK_PIXELS)
    block = [*keys, "_block"]
    # Spread: each block of pixels is worked on for every angle.
    dealt = spread(pixels.join(extent.where(F.col("_n") > BLOCK_PIXELS), keys).withColumn(
        "_block", F.pmod(F.xxhash64("rv", "alpha"), parts).cast("int")), *block)
    small = spread(pixels.join(extent.where(F.col("_n") <= BLOCK_PIXELS).select(*keys), keys), *keys)

    def whole(key, table):
        k, b, rms, n = fit_whole(theta, table["rv"].to_numpy(), table["alpha"].to_numpy(), min_pixels)
        return pa.table([*[pa.repeat(x, len(k)) for x in key], k.astype("int32"), b, rms, n.astype("int64")], [*keys, "k", "b", "rms", "n"])

    fitted = small.groupBy(*keys).applyInArrow(whole, f"{ddl}, k int, b double, rms double, n long")

    def frame(key, rows, names):
        return pd.DataFrame([(*key[:len(keys)], *r) for r in rows], columns=[*keys, *names])

    def counted(key, pdf):
        out = []
        for g, some in enumerate(groups):
            r, m = Residuals(some, pdf), len(some)
            off = np.where(r.usable, r.value - r.centre[:, None], 0.0)
            n, s1, s2 = r.usable.sum(axis=1), off.sum(axis=1), np.square(off).sum(axis=1)
            code = (np.arange(m)[:, None] * r.bins + r.bin)[r.usable]
            hist = np.bincount(code, minlength=m * r.bins)
            out.append((g, n.astype("int64").tobytes(), s1.tobytes(), s2.tobytes(), hist.astype("int64").tobytes()))
        return frame(key, out, ["g", "n", "s1", "s2", "hist"])

    counts = dealt.groupBy(*block).applyInPandas(counted, f"{ddl}, g int, n binary, s1 binary, s2 binary, hist binary")
    packed = ["n", "m1", "m2", "first", "last", "below"]
    state = _fold(counts, [*keys, "g"], _summed, _middle, f"{ddl}, g int, " + ", ".join(f"{c} binary" for c in packed))
    asked = state.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("g", *packed))).alias("_s")).join(
        extent.where(F.col("_n") > BLOCK_PIXELS).select(*keys, parts.cast("int").alias("_parts")), keys).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(*block, "_s")

    def looked(key, pdf, wanted):
        out = []
        for s in wanted["_s"].iloc[0] if len(pdf) and len(wanted) else ():
            n, first, last = (np.frombuffer(s[c], "int64") for c in ("n", "first", "last"))
            r = Residuals(groups[s["g"]], pdf)
            angle, pixel = np.nonzero((r.bin >= first[:, None]) & (r.bin <= last[:, None]) & r.usable & (n >= min_pixels)[:, None])
            found = _distinct(angle, r.value[angle, pixel], np.ones(len(angle), "int64"))
            out.append((s["g"], *(s[c] for c in ("n", "m1", "m2", "below")), r.centre.tobytes(), *(x.tobytes() for x in found)))
        return frame(key, out, ["g", "n", "m1", "m2", "below", "centre", "angle", "value", "count"])

    values = dealt.groupBy(*block).cogroup(asked.groupBy(*block)).applyInPandas(
        looked, f"{ddl}, g int, n binary, m1 binary, m2 binary, below binary, centre binary, angle binary, value binary, `count` binary")
    large = _fold(values, [*keys, "g"], _gathered, _fitted, f"{ddl}, _g int, k int, b double, rms double, n long").drop("_g")
    return fitted.unionByName(large)
