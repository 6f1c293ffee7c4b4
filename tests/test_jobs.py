import math

import numpy as np
import pandas as pd
from conftest import grid
from pyspark.sql import functions as F

from relievo import constants as K
from relievo.operators.coregister import ProductGrid
from relievo.plans import jobs
from relievo.sources import tilestore


def raster(spark, values):
    r, c = np.mgrid[:values.shape[0], :values.shape[1]]
    return spark.createDataFrame(pd.DataFrame({"row": r.ravel().astype("int32"), "col": c.ravel().astype("int32"), "v": values.ravel()}))


def test_ingest_gates_fills_and_ties(spark):
    m = K.M_PER_DEG
    deg = 0.1
    n = 100  # 10 x 10 degrees from (20 E, 10 N) south-east
    yy, xx = np.mgrid[:n, :n]
    dn = np.full((n, n), 101.0)
    dn[:, 60:] = 0.0  # no radar in the east
    terrain = 100.0 * np.sin(xx / 9) + yy
    g = ProductGrid(n, n, 20 * m, 10 * m, deg * m)
    products = {
        "dn_left": jobs.Product(raster(spark, dn), "v", ProductGrid(n, n, 20 * m, 10 * m, deg * m, 0.0), "nearest"),
        "gtdr_up": jobs.Product(raster(spark, terrain), "v", g, "cubic"),
        "stereo_dem": jobs.Product(raster(spark, terrain - 795.0), "v", g),
        "emissivity": jobs.Product(raster(spark, np.where(xx < 30, 8500.0, -1.0)), "v",
                                   ProductGrid(n, n, 20 * m, 10 * m, deg * m, -1.0, 1e-4, 0.0)),
    }
    spec = jobs.IngestSpec(pixel_m=deg * m, core_px=20)
    regions = spark.createDataFrame([("a", 20.0, 0.0, 30.0, 10.0)], "region string, west double, south double, east double, north double")
    px, tiles = jobs.ingest(regions, products, spec)
    t = tiles.toPandas()
    assert len(t) == 15 and t["lon"].max() < 26  # 5 x 5 planned, two eastern columns gated away
    assert set(t.region) == {"a"} and (t.has_stereo_dem).all()
    assert np.allclose(t.theta_left, np.radians(np.clip(45 - 0.004 * (t.lat_deg - 10) ** 2, 17, 45)))
    one = t.sort_values(["lat_deg", "lon"]).iloc[0]
    p = px.where(F.col("tile") == int(one.tile)).toPandas()
    assert len(p) == 400 and (p.dn_left == 101).all()
    good = p.dropna(subset=["gtdr_up", "stereo_dem"])
    assert abs((good.stereo_dem - good.gtdr_up).median()) < 1e-6  # datum removed
    assert math.isclose(p.emissivity.max(), 0.85, abs_tol=1e-9)


def test_region_product_covers_and_summarises(spark):
    regions = spark.createDataFrame([("a", 350.0, -5.0, 10.0, 5.0)], "region string, west double, south double, east double, north double")

    def values(px):
        return px.withColumns({"z": F.col("lat") * 100.0, "sigma": F.lit(30.0), "rv": F.lit(0.0), "gtdr": F.col("lat") * 100.0 - 2.0})

    product, summary = jobs.region_product(regions, 100_000.0, 1000.0, 32, 8, values)
    s = summary.first()
    assert s["coverage"] == 1.0 and abs(s["sigma_mean"] - 30) < 1e-9 and s["relief_over_gtdr_m"] < 1e-6
    z = grid(product.select(F.col("grow").alias("row"), F.col("gcol").alias("col"), "z"), "z")
    assert not np.isnan(z).any() and np.allclose(z, z[:, :1])


def test_store_prunes_quadrangles_and_keeps_files_few(spark, tmp_path):
    """A split reads only its quadrangles' folders; a quadrangle has a file for every few tiles."""
    px = spark.range(40 * 16).select((F.col("id") / 16).cast("long").alias("tile"), (F.col("id") / 4 % 4).cast("int").alias("row"),
                                     (F.col("id") % 4).cast("int").alias("col"), F.col("id").cast("double").alias("z"))
    px = px.withColumn("quad", F.when(F.col("tile") < 36, "q01_01").otherwise(F.concat(F.lit("q02_0"), F.col("tile") % 4)))
    tiles = px.select("tile", "quad").distinct().withColumn("lat_deg", F.lit(1.0))
    path = str(tmp_path / "store")
    whole = "spark.sql.adaptive.coalescePartitions.enabled"  # else these few rows end in one task
    spark.conf.set(whole, "false")
    try:
        tilestore.write_store(px, tiles, path, {"margin_px": 1, "core_px": 2}, tiles_per_file=9)
    finally:
        spark.conf.unset(whole)
    files = {q.name: len(list(q.glob("*.parquet"))) for q in (tmp_path / "store" / "pixel").glob("quad=*")}
    assert set(files) == {"quad=q01_01"} | {f"quad=q02_0{k}" for k in range(4)}
    assert 1 < files["quad=q01_01"] <= 4 and all(n == 1 for q, n in files.items() if q != "quad=q01_01")
    held = spark.createDataFrame([("q02_01",)], "quad string")
    for part, n in (("val", 1), ("train", 39)):
        got, cut = tilestore.read_tiles(spark, path, part, held, keep_margin=False)
        assert got.count() == n and cut.count() == 4 * n
    _, cut = tilestore.read_tiles(spark, path, "val", held)
    assert "dynamicpruning" in cut._jdf.queryExecution().executedPlan().toString()
    some = spark.read.parquet(f"{path}/pixel").where("quad = 'q02_01'")
    assert "PartitionFilters: [isnotnull(quad" in some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == 16


def test_ingest_to_store_round_trip(spark, tmp_path):
    m, n = K.M_PER_DEG, 60
    yy, xx = np.mgrid[:n, :n]
    g = ProductGrid(n, n, 20 * m, 10 * m, 0.1 * m)
    products = {"dn_left": jobs.Product(raster(spark, 100.0 + xx), "v", g, "nearest"), "gtdr_up": jobs.Product(raster(spark, 1.0 * yy), "v", g)}
    regions = spark.createDataFrame([("a", 20.0, 4.0, 26.0, 10.0)], "region string, west double, south double, east double, north double")
    path = str(tmp_path / "store")
    jobs.ingest_to_store(regions, products, jobs.IngestSpec(pixel_m=0.1 * m, core_px=8, margin_px=2), path)
    meta = tilestore.read_meta(spark, path)
    assert meta["core_px"] == 8 and meta["margin_px"] == 2 and meta["bands"] == ["dn_left", "gtdr_up"]
    tiles, px = tilestore.read_tiles(spark, path, "train", spark.createDataFrame([], "quad string"), keep_margin=False)
    assert tiles.count() == 49 and px.count() == 49 * 64
    one = px.drop("lon").join(tiles.select("quad", "tile", "lon", "lat_deg"), ["quad", "tile"]).where(
        "row = 0 and col = 0").select("lon", "dn_left").collect()
    assert all(r.dn_left == 100 + round((r.lon - 0.4 - 20) / 0.1) for r in one)
