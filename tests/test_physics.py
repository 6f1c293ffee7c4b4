import math

import numpy as np
import pytest
from conftest import grid
from pyspark.sql import functions as F

from relievo.functions import geodesy as G
from relievo.functions import radiometry as R
from relievo.operators import masks, stencil
from relievo.operators import resample as S


def test_dn_round_trip(spark):
    d = spark.range(256).select(F.col("id").alias("dn"), R.rv_from_dn("id").alias("rv"))
    rows = d.withColumn("back", R.dn_from_rv("rv")).toPandas()
    assert rows.loc[0, ["rv", "back"]].isna().all()
    inside = rows[(rows.dn >= 1) & (rows.dn <= 251)]
    assert (inside.dn == inside.back).all()


def test_ramp_faces_a_western_radar(frame):
    z = np.tile(np.arange(20.0) * 10, (12, 1))  # rises eastward
    d = stencil.slope_toward_radar(frame(z=z), "z", (1.0, 0.0), 100.0, block=5)
    a = grid(d, "alpha")
    assert np.allclose(a[:, 1:-1], math.atan(0.1))
    r = stencil.render(frame(z=z), "z", 0.6, (1.0, 0.0), 100.0)
    assert (grid(r, "rv")[:, 1:-1] > 0).all()  # brighter than nominal


def test_look_vectors(spark):
    v = spark.range(1).select(G.look_vector(F.lit("left")).alias("l"), G.look_vector(F.lit("stereo")).alias("s")).first()
    assert tuple(v["l"]) == (1.0, 0.0) and tuple(v["s"]) == (-1.0, 0.0)
    with pytest.raises(Exception, match="unknown look"):
        spark.range(1).select(G.look_vector(F.lit("up"))).collect()


@pytest.mark.parametrize("block", [4, 7, 256])
def test_blocks_do_not_change_stencils(frame, block):
    z = np.random.default_rng(0).normal(size=(23, 31)) * 50
    d = stencil.sobel(frame(z=z), "z", 10.0, block=block)
    p = np.pad(z, 1, mode="edge")
    de = (p[:-2, 2:] - p[:-2, :-2] + 2 * (p[1:-1, 2:] - p[1:-1, :-2]) + p[2:, 2:] - p[2:, :-2]) / 80
    assert np.allclose(grid(d, "z_de"), de)
    c = stencil.central_gradient(frame(z=z), "z", 10.0, block=block)
    north, east = np.gradient(z, 10.0)
    assert np.allclose(grid(c, "z_de"), east) and np.allclose(grid(c, "z_dn"), -north)


def test_rms_slope_of_a_ramp_drops_partial_cells(frame):
    z = np.tile(np.arange(21.0) * 5, (17, 1))
    d = stencil.rms_slope(frame(z=z), "z", 100.0, 5, 17, 21).toPandas()
    assert len(d) == 3 * 4
    inner = d[(d.ccol > 0) & (d.ccol < 3)]
    assert np.allclose(inner.rms_slope, math.atan(0.05))


def test_footprint_attenuates_like_its_transfer_function(frame):
    px, lam = 500.0, 20_000.0
    x = np.arange(200) * px
    z = np.tile(100 * np.sin(2 * np.pi * x / lam), (120, 1))
    fp = S.Footprint(4000.0, 4000.0)
    got = grid(S.footprint_blur(frame(z=z), "z", fp, px, 120, 200), "z")
    expected = math.exp(-2 * (math.pi * 4000.0 / lam) ** 2)
    centre = got[60, 60:140]
    assert abs(np.ptp(centre) / 200 - expected) < 0.02


def test_blur_of_a_constant_is_the_constant(frame):
    d = S.footprint_blur(frame(z=np.full((40, 50), 7.5)), "z", S.Footprint(3000.0, 6000.0, 0.4), 500.0, 40, 50)
    assert np.allclose(grid(d, "z"), 7.5)


def test_posts_land_on_their_pixels(frame):
    posts = np.random.default_rng(1).normal(size=(6, 7)) * 100
    up = grid(S.upsample_posts(frame(z=posts), "z", 5, 6, 7, 31, 36), "z", (31, 36))
    assert np.allclose(up[2::5, 2::5], posts)
    assert not np.isnan(up).any()


def test_altimetry_gap_never_becomes_sea_level(frame):
    posts = np.full((6, 6), 900.0)
    posts[3, 3] = np.nan
    up = grid(S.upsample_altimetry(frame(z=posts).withColumn("z", F.nullif(F.nanvl("z", F.lit(-1e9)), F.lit(-1e9))),
                                   "z", 4, 6, 6, 24, 24), "z", (24, 24))
    assert np.isnan(up[14, 14])
    assert np.nanmin(up) > 850


def test_seam_and_dark_patch(frame):
    z = np.zeros((64, 64))
    z[:, 30:33] = 400.0
    ok = grid(masks.seam_mask(frame(z=z), "z", block=20), "seam_ok")
    assert not ok[:, 25:38].any() and ok[:, :24].all() and ok[:, 39:].all()
    rv = np.zeros((64, 64))
    rv[20:24, 20:24] = -20.0
    dark = grid(masks.radar_dark_mask(frame(rv=rv), "rv", F.lit(True), block=20), "dark_ok")
    assert not dark[17:27, 17:27].any() and dark.sum() == 64 * 64 - 100


def test_dilation_counts_pixels_across_gaps(spark):
    pts = [(0, 0, c, c == 0) for c in (0, 2, 3, 9)]
    d = spark.createDataFrame(pts, "tile long, row int, col int, m boolean")
    hit = {r["col"] for r in masks.dilate(d, "m", 2).where("m").collect()}
    assert hit == {0, 2}


def test_lattice_margin(spark):
    d = spark.range(64).select((F.col("id") / 8).cast("int").alias("prow"), (F.col("id") % 8).cast("int").alias("pcol"))
    keep = lambda n, m: d.where(masks.lattice_interior("prow", "pcol", n, 8, m, 10)).count()
    assert keep(8, 0) == 64 and keep(8, 25) == 16 and keep(4, 25) == 0


def test_polar_round_trip(spark):
    cap = G.cap_reaching(-75.0, 50_000.0, -1)
    assert cap.cells % 2 == 0
    d = spark.range(200).select((F.col("id") * 1.7 % 360).alias("lon"), (F.lit(-76.0) - F.col("id") / 16).alias("lat"))
    row, col = G.cap_position("lon", "lat", cap)
    d = d.select("lon", "lat", row.alias("r"), col.alias("c"))
    lon, lat = G.cap_lonlat("r", "c", cap)
    p = d.select("lon", "lat", lon.alias("lon2"), lat.alias("lat2")).toPandas()
    edge = spark.range(1).select(G.cap_position(F.lit(90.0), F.lit(-75.0), cap)[1]).first()[0]
    assert cap.cells - 3 <= edge <= cap.cells - 0.5
    assert np.allclose(p.lon, p.lon2) and np.allclose(p.lat, p.lat2)


def test_speckle_has_unit_mean(spark):
    d = spark.range(40_000).select(F.pow(F.lit(10.0), R.speckle(F.lit(0.0), 6, F.col("id")) / 10).alias("p"))
    m, v = d.agg(F.avg("p"), F.var_pop("p")).first()
    assert abs(m - 1) < 0.01 and abs(v - 1 / 6) < 0.01
