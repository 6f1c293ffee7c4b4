"""Imagery levels from one scan, and the slope-brightness correlation by direction."""

import numpy as np
import pandas as pd

from relievo.operators import metrics, pyramid
from test_plans import plan


def test_levels_add_up_and_scan_the_image_once(spark, frame, tmp_path):
    rng = np.random.default_rng(3)
    z = rng.normal(0, 10, (37, 70))
    z[4, 5] = np.nan
    path = str(tmp_path / "image")
    frame(z=z).selectExpr("tile", "row", "col", "if(isnan(z), null, z) AS z").write.parquet(path)
    image = spark.read.parquet(path).withColumnRenamed("z", "v")
    out = pyramid.imagery_pyramid(image, "v", 37, 70, 2, 8)
    got = pd.DataFrame(out.collect(), columns=out.columns)
    for level, h, w in ((0, 8, 16), (1, 16, 32), (2, 32, 64)):
        r, c = np.mgrid[:37, :70]
        flat = pd.DataFrame({"i": (r * h // 37).ravel(), "j": (c * w // 70).ravel(), "v": z.ravel()})
        want = flat.groupby(["i", "j"]).v.mean().unstack().to_numpy()
        one = got[got.z == level]
        have = np.full((h, w), np.nan)
        have[(2 ** level - 1 - one.y) * 8 + one.py, one.x * 8 + one.px] = one.v
        assert len(one) == h * w and np.allclose(have, want, equal_nan=True)
    final = plan(out).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_one_axis_reduction_averages(frame):
    """More rows than the level needs, fewer columns: rows are averaged before columns are enlarged."""
    z = np.tile(np.array([[0.0], [10.0]]), (16, 8))  # alternating rows, constant along a row
    got = pyramid.imagery_level(frame(v=z), "v", 32, 8, 0, 8).toPandas()
    assert len(got) == 8 * 16 and np.allclose(got.v, 5.0)


def test_direction_correlation_finds_the_direction(spark):
    rng = np.random.default_rng(1)
    de, dn = rng.normal(0, 1, 500), rng.normal(0, 2, 500)
    a = np.radians(30.0)
    d = pd.DataFrame({"tile": [1] * 500, "de": de, "dn": dn, "b": 4 * (de * np.sin(a) + dn * np.cos(a)) + 1})
    d.loc[:9, "b"] = None
    df = spark.createDataFrame(pd.concat([d, pd.DataFrame({"tile": [2] * 3, "de": [0.0] * 3, "dn": [0.0] * 3, "b": [1.0, 2.0, 3.0]})]))
    df = df.selectExpr("tile", "de", "dn", "if(isnan(b), null, b) AS b")
    got = metrics.direction_correlation(df, "de", "dn", "b", [0, 30, 120, 210]).toPandas()
    one = got[got.tile == 1].set_index("azimuth_deg")
    assert abs(one.correlation[30.0] - 1) < 1e-9 and abs(one.correlation[210.0] + 1) < 1e-9 and (one.n == 490).all()
    for az in (0.0, 120.0):
        s = de * np.sin(np.radians(az)) + dn * np.cos(np.radians(az))
        assert abs(one.correlation[az] - np.corrcoef(s[10:], d.b[10:])[0, 1]) < 1e-9
    assert got[got.tile == 2].correlation.isna().all()
