"""Hot groups: exact results from the distributed paths, one path for every size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from relievo.operators import fits, metrics, profile
from relievo.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    key = np.where(rng.random(30_000) < 0.4, 0, rng.integers(1, 60, 30_000))
    v = np.round(rng.normal(size=30_000) * 10, 2)
    v[:4000] = 1.25  # heavy ties
    return pd.DataFrame({"k": key, "v": v})


def test_quantiles_are_exact_in_hot_groups(spark, skewed):
    got = exact_quantiles(spark.createDataFrame(skewed), ["k"], "v", {"low": 0.0, "p10": 0.1, "med": 0.5, "top": 1.0},
                          accuracy=200).toPandas().set_index("k").sort_index()
    want = skewed.groupby("k")["v"].quantile([0.0, 0.1, 0.5, 1.0]).unstack()
    assert np.allclose(got[["low", "p10", "med", "top"]], want)
    assert (got["n"] == skewed.groupby("k").size()).all()


def test_discrete_quantile_without_keys(spark, skewed):
    got = exact_quantiles(spark.createDataFrame(skewed), [], "v", {"q": 0.6827}, mode="disc", accuracy=100).first()
    s = np.sort(skewed["v"].to_numpy())
    assert got["q"] == s[int(np.ceil(0.6827 * len(s))) - 1]


def test_temperature_reaches_its_coverage(spark):
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"err": np.abs(rng.normal(0, 40, 20_000)), "sigma": 40 / 3})
    d = spark.createDataFrame(p)
    t = fits.fit_temperature(d, "err", "sigma").first()["temperature"]
    assert abs(t - 3.0) < 0.1  # the sampling error of the quantile is about 0.02
    share = d.agg(metrics.sigma_coverage("err", F.col("sigma") * t)).first()[0]
    assert 0.6827 <= share < 0.6828


def test_patch_fit_finds_the_angle(spark):
    rng = np.random.default_rng(7)
    n = 900
    alpha = rng.uniform(-0.15, 0.15, n)
    t = np.radians(32.0)

    def law(x):
        return 10 * np.log10(0.0118 * np.cos(x) / (np.sin(x) + 0.111 * np.cos(x)) ** 3)

    rv = law(t - alpha) - law(np.full(n, t)) + 1.5 + rng.normal(0, 0.05, n)
    d = spark.createDataFrame(pd.DataFrame({"tile": np.repeat([1, 2], [700, 200]), "rv": rv, "alpha": alpha}))
    got = fits.fit_patches(d, "rv", "alpha", F.lit(True)).toPandas().sort_values("tile")
    assert abs(got.theta_deg.iloc[0] - 32.0) <= 1.0 and abs(got.brightness_db.iloc[0] - 1.5) < 0.05
    assert got.n_pixels.tolist() == [700, 200]


def test_guard_refuses_railed_and_small_fits(spark):
    rows = ([("ok", float(x), 45 - 0.004 * (x - 10) ** 2) for x in range(-60, 70, 6)]
            + [("railed", float(x), 55.5) for x in range(-60, 70, 6)] + [("few", 1.0, 30.0)])
    d = spark.createDataFrame(rows, "cycle string, lat double, theta_deg double")
    p = fits.guarded_profile(d).toPandas().set_index("cycle")
    assert p.status.to_dict() == {"ok": "ok", "railed": "degenerate", "few": "too few patches"}
    assert abs(p.lat_peak_deg["ok"] - 10) < 1e-6 and abs(p.curvature_deg_per_deg2["ok"] - 0.004) < 1e-9
    assert np.isnan(p.theta_peak_deg["railed"])


def test_empty_supervision_is_null_in_metrics_and_zero_in_objectives(spark):
    from relievo.functions.base import mean_or_zero
    d = spark.createDataFrame([(1, 2.0, False)], "tile long, x double, m boolean")
    assert d.agg(metrics.mae("x", F.col("m"))).first()[0] is None
    assert d.agg(mean_or_zero("x", F.col("m"))).first()[0] == 0.0


@pytest.mark.parametrize("segment", [5.0, 1e9])
def test_profile_segments_do_not_change_results(spark, segment):
    pts = [("a", float(i), None if i == 7 else float(i % 5)) for i in range(40)] + [("b", 0.0, 1.0), ("b", 1.0, None)]
    d = spark.createDataFrame(pts, "profile string, distance_m double, height_m double")
    r = profile.profile_stats(d, segment_m=segment).toPandas()
    h = [(x, y) for _, x, y in pts[:40] if y is not None]
    s = [abs(np.degrees(np.arctan((b[1] - a[1]) / (b[0] - a[0])))) for a, b in zip(h, h[1:])]
    assert list(r.profile) == ["a"]
    assert np.isclose(r.mean_slope_deg[0], np.mean(s)) and np.isclose(r.max_slope_deg[0], max(s))
    slopes = profile.consecutive_slopes(d, segment_m=segment).toPandas()
    assert len(slopes) == len(s)
