"""The array layout against the pixel layout, with gaps, NULLs, several tiles and blocks of any size."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from relievo.operators import chunks, masks, stencil
from relievo.operators import resample as S


@pytest.fixture(scope="module")
def gappy(spark):
    """Two tiles of 45 x 70 with absent pixels and NULL heights."""
    rng = np.random.default_rng(5)
    parts = []
    for tile in (0, 7):
        r, c = np.mgrid[:45, :70]
        z = np.cumsum(rng.normal(0, 40, (45, 70)), axis=1)
        z[rng.random(z.shape) < 0.08] = np.nan
        keep = rng.random(z.size) > 0.1
        parts.append(pd.DataFrame({"tile": np.int64(tile), "row": r.ravel()[keep], "col": c.ravel()[keep], "z": z.ravel()[keep]}))
    df = spark.createDataFrame(pd.concat(parts)).withColumn("z", F.when(~F.isnan("z"), F.col("z")))
    return df.withColumns({n: F.col(n).cast("int") for n in ("row", "col")})


def same(a, b, key=("tile", "row", "col")):
    a, b = (d.toPandas().sort_values(list(key)).reset_index(drop=True) for d in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=0, atol=1e-9, equal_nan=True), c


@pytest.mark.parametrize("block", [8, 32, 256])
def test_stencils_agree_with_the_pixel_layout(gappy, block):
    c = chunks.to_chunks(gappy, "z", block=block)
    names = ["tile", "row", "col", "z_de", "z_dn"]
    same(chunks.to_pixels(chunks.sobel(c, "z", 10.0, block=block), ["z_de", "z_dn"], block=block),
         stencil.sobel(gappy, "z", 10.0).select(names))
    same(chunks.to_pixels(chunks.central_gradient(c, "z", 10.0, block=block), ["z_de", "z_dn"], block=block),
         stencil.central_gradient(gappy, "z", 10.0).select(names))
    steps = ["step_e", "step_s", "laplacian"]
    same(chunks.to_pixels(chunks.neighbour_steps(c, "z", block=block), steps, block=block),
         stencil.neighbour_steps(gappy, "z").select("tile", "row", "col", *steps))


@pytest.mark.parametrize("block,factor", [(16, 4), (32, 5), (256, 4)])
def test_reduction_agrees_with_the_pixel_layout(gappy, block, factor):
    c = chunks.to_chunks(gappy, "z", block=block)
    same(chunks.gaussian_downsample(c, "z", factor, 45, 70, block=block), S.gaussian_downsample(gappy, "z", factor, 45, 70))


def test_reduction_reaches_blocks_without_a_pixel(spark):
    """A cell whose own block is empty still gets what its neighbours' pixels give."""
    df = spark.createDataFrame(pd.DataFrame({"tile": [1] * 8, "row": [3] * 8, "col": list(range(8)), "z": [1.0] * 8}))
    same(chunks.gaussian_downsample(chunks.to_chunks(df, "z", block=8), "z", 4, 8, 16, block=8),
         S.gaussian_downsample(df, "z", 4, 8, 16))


def test_masks_on_a_full_raster(frame):
    rng = np.random.default_rng(2)
    d = frame(z=rng.normal(0, 60, (40, 50)), rv=rng.normal(0, 5, (40, 50)))
    c = chunks.stereo_trust_mask(chunks.to_chunks(d, ["z", "rv"], block=16), "z", "rv", block=16)
    want = masks.radar_dark_mask(masks.seam_mask(d, "z"), "rv", F.lit(True))
    same(chunks.to_pixels(c, ["seam_ok", "dark_ok"], block=16), want.select("tile", "row", "col", "seam_ok", "dark_ok"))


def test_dilation_crosses_absent_pixels(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0), (1, 2, 2, 0.0), (1, 3, 3, 0.0)], "tile int, row int, col int, m double")
    got = chunks.to_pixels(chunks.dilate(chunks.to_chunks(df, "m", block=4), "m", 2, block=4), "m", block=4).collect()
    assert {(r.row, r.col): r.m for r in got} == {(0, 0): 1.0, (2, 2): 1.0, (3, 3): 0.0}


def test_round_trip_empty_and_nan(spark, gappy):
    same(chunks.to_pixels(chunks.to_chunks(gappy, "z", block=16), "z", block=16), gappy)
    none = chunks.to_chunks(gappy.where("tile = 3"), "z", block=16)
    assert chunks.to_pixels(chunks.sobel(none, "z", 1.0, block=16), ["z_de", "z_dn"], block=16).count() == 0
    assert chunks.gaussian_downsample(none, "z", 4, 45, 70, block=16).count() == 0
    nan = spark.createDataFrame([(1, 0, 0, float("nan"))], "tile int, row int, col int, z double")
    assert chunks.to_pixels(chunks.to_chunks(nan, "z"), "z").first()["z"] is None


def test_frame_larger_than_the_block_is_refused(gappy):
    with pytest.raises(ValueError):
        chunks.dilate(chunks.to_chunks(gappy, "z", block=4), "z", 5, block=4)


def test_neighbours_exchange_strips_once(gappy):
    """After the blocks are written, a stencil shuffles once and sends slices, not pixel rows."""
    c = chunks.to_chunks(gappy, "z", block=16)
    text = chunks.sobel(c, "z", 1.0, block=16)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?<!Broadcast)Exchange hash", text)) == 2  # one builds the blocks
