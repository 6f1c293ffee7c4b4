"""The angle fit on blocks against a plain median per patch and angle."""

import numpy as np
import pandas as pd
import pytest

from relievo.operators import angles, fits


def plain(p, theta_deg, minimum):
    out = {}
    for tile, g in p.dropna().groupby("tile"):
        rows = []
        for k, t in enumerate(np.radians(theta_deg)):
            local = t - g.alpha.to_numpy()
            ok = (local > np.radians(3)) & (local < np.radians(87))

            def law(x):
                return 10 * np.log10(0.0118 * np.cos(x) / (np.sin(x) + 0.111 * np.cos(x)) ** 3)

            r = g.rv.to_numpy()[ok] - (law(local[ok]) - law(t))
            if len(r) >= minimum:
                b = np.median(r)
                rows.append((round(float(np.sqrt(np.mean((r - b) ** 2))), 7), k, b, len(r)))
        if rows:
            out[tile] = min(rows)
    return out


@pytest.mark.parametrize("block,bins", [(16_384, (16, 4096)), (300, (2, 8))])
def test_blocks_give_the_plain_median(spark, monkeypatch, block, bins):
    """One patch holds most pixels; repeated values, an even and an odd count, steep facets, NULLs, a constant patch."""
    monkeypatch.setattr(angles, "BLOCK_PIXELS", block)
    monkeypatch.setattr(angles, "BINS", bins)
    rng = np.random.default_rng(3)
    sizes = {1: 4001, 2: 350, 3: 211, 4: 150, 5: 260}
    p = pd.DataFrame({"tile": np.repeat(list(sizes), list(sizes.values()))})
    p["alpha"] = rng.uniform(-0.3, 0.3, len(p)).round(2)
    p["rv"] = (rng.normal(0, 3, len(p)) - 20 * p.alpha).round(1)
    p.loc[p.tile == 3, ["alpha", "rv"]] = 0.1, 2.0
    p.loc[p.tile == 5, "alpha"] = np.where(np.arange(260) < 80, 1.45, p.alpha[p.tile == 5])
    p.loc[7, "rv"] = np.nan
    d = spark.createDataFrame(p).selectExpr("if(tile = 1 and rv = 0.7, null, tile) as tile", "nullif(rv, double('nan')) as rv", "alpha")
    p.loc[(p.tile == 1) & (p.rv == 0.7), "tile"] = np.nan
    got = {r["tile"]: r for r in fits.fit_patches(d, "rv", "alpha", d["rv"].isNotNull()).collect()}
    grid = 8.0 + 0.5 * np.arange(96)
    want = plain(p, grid, 200)
    assert set(got) == set(want) and 4 not in got
    for t, (rms, k, b, n) in want.items():
        r = got[t]
        assert abs(r["residual_db"] - rms) < 1e-6 and abs(r["brightness_db"] - b) < 1e-9 and r["n_pixels"] == n
        assert abs(r["theta_deg"] - grid[k]) < 0.51


def test_no_row_per_pixel_and_angle(spark):
    """The plan multiplies no pixels: the only generator deals a patch's summary to its blocks."""
    d = spark.range(1000).selectExpr("id % 3 as tile", "double(id) as rv", "0.1d as alpha")
    plan = fits.fit_patches(d, "rv", "alpha", d["rv"].isNotNull())._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Generate explode") == 1
    assert fits.fit_patches(d.limit(0), "rv", "alpha", d["rv"].isNotNull()).collect() == []
