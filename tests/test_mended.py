"""Empty masks, absent baselines, regions across the meridian, flags of any type, and work that spreads."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from relievo.functions import geodesy as G
from relievo.operators import blend, features, grids, metrics, resample, stencil
from relievo.plans import jobs, load_all
from relievo.sources import catalogue, tilestore


def test_no_usable_pixel_has_no_psnr(spark):
    d = spark.createDataFrame([(1, 0.5, True), (1, 0.7, True), (2, 0.5, False), (2, None, True)], "tile int, r double, ok boolean")
    got = {r["tile"]: r["p"] for r in d.groupBy("tile").agg(metrics.look_psnr("r", "ok").alias("p")).collect()}
    assert got[1] > 0 and got[2] is None


def test_skill_without_baseline_is_null(spark):
    t = spark.createDataFrame([("a", 3.0), ("b", 2.0)], "run string, mae_vs_truth double")
    assert {r["skill"] for r in metrics.skill_table(t, "none").collect()} == {None}
    assert {r["run"]: round(r["skill"], 6) for r in metrics.skill_table(t, "a").collect()} == {"a": 0.0, "b": round(1 / 3, 6)}


def test_cell_without_heights_is_not_flat(frame):
    z = np.zeros((8, 8))
    z[:, 4:] = np.nan
    d = frame(z=z).withColumn("z", F.when(~F.isnan("z"), F.col("z")))
    got = {(r["crow"], r["ccol"]): r["rms_slope"] for r in stencil.rms_slope(d, "z", 100.0, 4, 8, 8).collect()}
    assert got[0, 0] is not None and got[0, 1] is None and got[1, 1] is None


def test_strided_tiles_count_from_the_western_edge(spark):
    region = spark.createDataFrame([("m", 352.0, -4.0, 16.0, 4.0)], "region string, west double, south double, east double, north double")
    spec = jobs.IngestSpec(core_px=512, pixel_m=300.0, margin_px=0, per_region=7)
    every = grids.tile_centres(region, 512, 300.0, 78.0, "eastward").toPandas().sort_values(["lat", "eastward"])
    want = [round(every.iloc[int(i * len(every) / 7)]["lon"], 6) for i in range(7)]
    got = jobs.plan_tiles(region, spec).toPandas()
    assert sorted(round(x, 6) for x in got["tile_lon"]) == sorted(want) and any(x > 350 for x in want)


def test_stereo_flags_of_any_type(spark):
    held = spark.createDataFrame([("q9",)], "quad string")
    for values, kind in (((True, False), "boolean"), ((1.0, 0.0), "double")):
        t = spark.createDataFrame([(1, "q1", 10.0, values[0]), (2, "q1", 10.0, values[1])], f"tile int, quad string, lat_deg double, has_stereo_dem {kind}")
        assert [r["tile"] for r in tilestore.select_tiles(t, held, "train", require_stereo=True).collect()] == [1]


def tasks(df):
    """Tasks that hold rows, when partitions are not merged."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_one_cap_and_one_box_are_many_tasks(spark):
    one = spark.createDataFrame([(1,)], "tile int")
    assert tasks(blend.polar_pixels(one, G.Cap(64, 1000.0))) > 1
    box = spark.createDataFrame([(10.0, 0.0, 11.0, 1.0)], "west double, south double, east double, north double")
    assert tasks(grids.window_pixels(box, 2000.0)) > 1


def test_unusable_points_do_not_share_a_key(spark, frame):
    raster = frame(z=np.arange(16.0).reshape(4, 4))
    p = pd.DataFrame({"tile": 0, "row": np.arange(200), "col": 0, "src_row": np.r_[1.5, np.full(199, -9.0)], "src_col": 1.0})
    got = resample.bilinear_gather(spark.createDataFrame(p), raster, "z", 4, 4).toPandas().sort_values("row")
    assert got["z"].iloc[0] == 7.0 and got["z"].iloc[1:].isna().all() and len(got) == 200


def test_missing_cylindrical_value_is_the_caps(spark):
    cyl, grid = G.CylindricalGrid(36, 18), G.Cap(60, 100_000.0)
    cells = spark.createDataFrame([(0, 17, c, None if c % 2 else 1.0) for c in range(36)], "tile int, row int, col int, z double")
    north = cells.withColumn("row", F.when(cyl.lat("row") > 0, F.col("row")).otherwise(17 - F.col("row")))
    cap = blend.polar_pixels(spark.createDataFrame([(0,)], "tile int"), grid).withColumn("z", F.lit(5.0)).select("tile", "row", "col", "z")
    got = blend.merge_cap(north, cap, "z", cyl, grid).toPandas()
    assert got["z"].notna().all()


def test_cap_fills_absent_pixels(spark, frame):
    cyl, grid = G.CylindricalGrid(20, 90), G.Cap(40, 100_000.0)
    z = np.full((90, 20), 7.0)
    base = frame(z=z).withColumn("seen", F.lit(1))
    made = blend.cylindrical_to_polar(base, "z", cyl, grid).select("tile", "row", "col", "z")
    cap = made.withColumn("z", F.col("z") + 1.0)
    polar = F.col("row") < 7  # poleward of 75 degrees
    want = {(r["row"], r["col"]) for r in base.where(polar).collect()}
    holes = base.where(~polar | ((F.col("row") + F.col("col")) % 3 != 0))
    for held in (holes, base.where(~polar), base.limit(0)):
        had = {(r["row"], r["col"]) for r in held.collect()}
        got = blend.merge_cap(held, cap, "z", cyl, grid).collect()
        assert {(r["row"], r["col"]) for r in got} == want | had and len(got) == len(want | had)
        assert all(r["z"] == 8.0 and r["seen"] is None for r in got if (r["row"], r["col"]) not in had)
    # without a cap value an absent pixel stays absent, and rows without a key pass through
    nothing = cap.withColumn("z", F.lit(None).cast("double"))
    assert blend.merge_cap(holes, nothing, "z", cyl, grid).count() == holes.count()
    nameless = holes.withColumn("tile", F.lit(None).cast("long"))
    assert blend.merge_cap(nameless, cap.limit(0), "z", cyl, grid).count() == holes.count()


def test_checksums_read_in_blocks(spark, tmp_path):
    data = bytes(range(256)) * 5000
    (tmp_path / "a.bin").write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in catalogue.checksums(spark, str(tmp_path), block=1000).collect()}
    assert got == {"a.bin": hashlib.sha256(data).hexdigest()}


def test_features_by_name_and_region(spark):
    d = spark.createDataFrame([("beta", "Y"), ("Álpha", "Z"), ("gamma", "x"), ("alpha b", None)], "name string, region string")
    assert [r["name"] for r in features.ordered(d).collect()] == ["Álpha", "alpha b", "beta", "gamma"]
    assert [r["name"] for r in features.ordered(d, "region").collect()] == ["gamma", "beta", "Álpha", "alpha b"]


def test_band_is_not_held_in_the_driver(spark):
    before = {t.name for t in spark.catalog.listTables()}
    band = load_all()[0]["streamed_band"](spark, "/root/testdata/sf0.01")
    assert {t.name for t in spark.catalog.listTables()} == before  # a memory sink registers its rows here
    assert "band-log" in "".join(band.inputFiles())
    assert {(r["dem"], r["available_rows"]) for r in band.collect()} == {(0, 50), (1, 50), (2, 50)}
