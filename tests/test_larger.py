"""Work and memory that follow the input on larger tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from relievo import constants as K
from relievo.functions import radiometry
from relievo.operators import angles, coregister, grids, joins, metrics, quantiles, resample
from relievo.plans import jobs, load_all
from relievo.sources import raw_array, raw_dem


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rectangles_do_not_pass_through_the_driver(spark, tmp_path):
    """A few short rows become many pixels: their estimate must not make them a broadcast."""
    spark.range(40).selectExpr("id as tile", "0d as src_top", "9d as src_bottom", "0d as src_left", "11d as src_right").write.parquet(f"{tmp_path}/a")
    spark.range(400).selectExpr("id % 40 as tile", "int(id % 9) as row", "int(id % 11) as col", "double(id) as z").write.parquet(f"{tmp_path}/z")
    mean = resample.overlap_average(spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/z"), "z", 9, 11)
    text = plan(mean)
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
    assert mean.count() == 40


def test_large_groups_stay_spread(spark, tmp_path):
    """Rows of few groups meet their brackets and cuts where they are: no shuffle by group alone."""
    path = f"{tmp_path}/v"
    spark.range(20_000).selectExpr("id % 2 as run", "double(id * 7919 % 20011) as v").write.parquet(path)
    d = spark.read.parquet(path)
    flag = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(flag)
    spark.conf.set(flag, "50000")  # less than the rows, more than what is known of the groups
    try:
        q = quantiles.exact_quantiles(d, ["run"], "v", {"low": 0.01, "mid": 0.5})
        halves = metrics.half_split(d, "v", "v", ("run",))
        assert plan(q).count("BroadcastHashJoin") >= 2  # beside the rows and beside their counts
        assert "BroadcastHashJoin" in plan(halves) and "SortMergeJoin" not in plan(halves)
    finally:
        spark.conf.set(flag, before)
    p = d.toPandas()
    want = p.groupby("run").v.quantile([0.01, 0.5]).unstack()
    for r in q.collect():
        assert np.isclose(r["low"], want.loc[r["run"], 0.01]) and np.isclose(r["mid"], want.loc[r["run"], 0.5])
    assert {(r["run"], r["half"]): r["n"] for r in halves.collect()} == {(g, h): 5000 for g in (0, 1) for h in (1, 2)}


def test_labels_are_parsed_once_and_spread(spark, tmp_path):
    label = ("<P xmlns:a='urn:a'><a:value_offset>1.5</a:value_offset><Axis><elements> {h} </elements></Axis><Axis><elements>4</elements></Axis>"
             "<elements>9</elements><pixel_resolution_x>2</pixel_resolution_x><upperleft_corner_x><![CDATA[-7]]></upperleft_corner_x>"
             "<upperleft_corner_y>8</upperleft_corner_y><value_offset>99</value_offset></P>")
    pd.DataFrame({"id": range(64), "value": [label.format(h=i + 1) for i in range(64)]}).to_parquet(f"{tmp_path}/l.parquet")
    read = raw_dem.read_labels(spark.read.parquet(f"{tmp_path}/l.parquet"))
    assert plan(read).count("XPath") == 1
    got = read.withColumn("part", F.spark_partition_id()).collect()
    assert {tuple(r)[2:8] for r in got} == {(i + 1, 4, 2.0, -7.0, 8.0, 1.5) for i in range(64)}
    assert len({r["part"] for r in got}) > 2
    for broken in (label.format(h="").replace("<elements>9</elements>", ""), label.format(h=2).replace("pixel_resolution_x", "x")):
        with pytest.raises(Exception, match="label has no <(elements|pixel_resolution_x)>|CAST_INVALID_INPUT"):
            raw_dem.read_labels(spark.createDataFrame([(broken,)], "value string")).collect()
    assert raw_dem.read_labels(spark.createDataFrame([(None,)], "value string").limit(0)).collect() == []


def test_speckle_is_drawn_once(spark):
    d = spark.range(50).selectExpr("id div 25 as tile", "int(id) as row", "int(id) as col", "if(id = 7, null, double(id) - 25) as rv")
    seed = (F.col("tile"), F.col("row"), F.col("col"))
    out = radiometry.degrade(d, "rv", "col", (F.col("tile"),), seed)
    digests = out._jdf.queryExecution().optimizedPlan().toString().count("md5(")
    assert digests <= 6 + 3  # a mention per draw; equal ones of one step are computed once
    got = out.toPandas()
    clean = d.select("*", radiometry.speckle("rv", 6, *seed).alias("want")).toPandas()
    assert np.allclose(got.speckled, clean.want, equal_nan=True) and got.degraded.isna().sum() == 1
    code = (got.degraded + 20) * 5 + 1
    assert np.allclose(code.dropna(), code.dropna().round()) and code.dropna().between(1, 255).all()
    same = got[got.tile == 0].dropna()
    assert (same.degraded - same.speckled.clip(-20, 30)).abs().max() <= 0.8 + 1.5 + 0.1


def test_small_patches_are_fitted_in_one_look(spark, monkeypatch):
    rng = np.random.default_rng(8)
    p = pd.DataFrame({"tile": np.repeat([1, 2], [400, 230]), "alpha": rng.uniform(-0.3, 0.3, 630).round(2), "rv": rng.normal(0, 3, 630).round(1)})
    d, theta = spark.createDataFrame(p), 8.0 + 0.5 * np.arange(96)

    def fitted(block):
        monkeypatch.setattr(angles, "BLOCK_PIXELS", block)
        return angles.fit_angles(d, ["tile"], theta, 200)

    whole = fitted(400)
    assert "FlatMapGroupsInArrow" in plan(whole)  # a patch of one block needs no histograms
    key = ["tile", "k"]
    whole, cut = (x.toPandas().sort_values(key).set_index(key) for x in (whole, fitted(60)))
    assert len(whole) > 100 and whole.index.equals(cut.index) and (whole.n == cut.n).all()
    assert np.allclose(whole.b, cut.b, atol=1e-12) and np.allclose(whole.rms, cut.rms, atol=1e-9)


def test_many_small_arrays_are_few_tasks(spark, tmp_path):
    a = np.arange(40 * 10 * 6, dtype="<f4").reshape(40, 10, 6)
    z = pd.DataFrame({"dem": np.repeat(np.arange(40), 60), "row": np.tile(np.repeat(np.arange(10), 6), 40), "col": np.tile(np.arange(6), 400), "z": a.ravel()})
    written = raw_array.write_arrays(spark.createDataFrame(z).where("NOT row = 4 OR dem = 1"), "z", str(tmp_path / "w"), 6)
    assert "collect_list" not in plan(written)  # pixels stay flat: no line of structs in Python
    assert {tuple(r) for r in written.collect()} == {(str(i), 10) for i in range(40)}
    arrays = [raw_array.RawArray(str(i), f"{tmp_path}/w/{i}.img", 10, 6) for i in range(40)]
    rows = raw_array.scan(spark, arrays, 4)
    assert rows.rdd.getNumPartitions() == 3  # three ranges an array, each kind of range together
    got = rows.toPandas().astype({"dem": int}).sort_values(["dem", "row", "col"]).raw.to_numpy().reshape(40, 10, 6)
    want = a.copy()
    want[np.arange(40) != 1, 4] = np.nan
    assert np.array_equal(got, want, equal_nan=True)
    assert len(raw_array.together([raw_array.RowRange(raw_array.RawArray(str(i), "", 1, raw_array.TASK_VALUES), 0, 1) for i in range(3)])) == 3


def test_box_sums_are_those_of_the_pairs(spark):
    rng = np.random.default_rng(4)
    n = 300
    span, height = 360 * 2.0 ** -rng.uniform(0, 20, n), 180 * 2.0 ** -rng.uniform(0, 16, n)
    west, south = rng.uniform(0, 360, n), rng.uniform(-90, 90 - height)
    b = pd.DataFrame({"box": np.arange(n), "west": west, "south": south, "east": (west + span) % 360, "north": south + height})
    b.loc[0, ["west", "east", "south", "north"]] = [10.0, 10.0, 0.0, 0.0]  # a single point
    b.loc[1, ["south", "north"]] = [5.0, -5.0]  # upside down
    b.loc[2, ["west", "east", "south", "north"]] = [0.0, 360.0, -90.0, 90.0]  # everything
    b.loc[3, ["west", "east", "south", "north"]] = [20.0, 19.99999, -90.0, 90.0]  # all but a gap within a strip
    b.loc[4, ["west", "east", "south", "north"]] = [90.0, 112.5, 0.0, 45.0]  # edges of strips
    pts = pd.DataFrame({"lon": np.r_[rng.uniform(0, 360, 2 * n), west, b.east, 90.0, 112.5, -5.0, 10.0, 10.0, 19.999995],
                        "lat": np.r_[rng.uniform(-90, 90, 2 * n), south, b.north, 45.0, 0.0, -7.0, 0.0, 0.0, 3.0]})
    pts["v"] = rng.integers(0, 1000, len(pts)).astype(float)
    d = spark.createDataFrame(pts).withColumn("v", F.when(F.col("v") > 50, F.col("v")))
    d = d.unionByName(spark.createDataFrame([(None, 1.0, 1.0), (1.0, None, 1.0), (float("nan"), 1.0, 1.0), (1.0, float("nan"), 1.0)], d.schema))
    boxes = spark.createDataFrame(b).unionByName(spark.createDataFrame([(n, None, 0.0, 9.0, 9.0)], spark.createDataFrame(b).schema))
    sums = joins.box_sums(d, boxes, "v")
    want = joins.points_in_boxes(d, boxes).groupBy("box").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("m"), F.sum("v").alias("s"))
    got = {r["box"]: (r["n"], r["n_value"], r["sum_value"]) for r in sums.collect()}
    want = {r["box"]: (r["n"], r["m"], r["s"] or 0.0) for r in want.collect()}
    assert got == want and {0, 2, 3, 4} <= set(got) and 1 not in got and len(got) > n // 2
    assert joins.box_sums(d, boxes.limit(0), "v").collect() == [] and joins.box_sums(d.limit(0), boxes, "v").collect() == []


def test_points_of_one_block_are_one_row_before_blocks_multiply(spark, frame):
    z = np.add.outer(np.arange(40.0) * 100, np.arange(50.0))
    grid = coregister.ProductGrid(40, 50, 0.0, 40.0 * K.M_PER_DEG, K.M_PER_DEG)
    p = spark.createDataFrame(pd.DataFrame({"lon": [0.5, 7.9, 8.0, 8.25, 49.5, 60.0], "lat": [39.5, 32.1, 32.0, 31.75, 0.5, 5.0]}))
    got = coregister.sample_product(p, frame(z=z).drop("tile"), "z", grid, block=8)
    text = got._jdf.queryExecution().optimizedPlan().toString()
    below = text[text.index("Generate explode"):]
    assert below.index("Aggregate [_r0") > 0  # the aggregate feeds the generators
    at = [((40 - r["lat"] - 0.5) * 100 + r["lon"] - 0.5, r["z"]) for r in got.collect() if r["lon"] < 50]
    assert len(at) == 5 and all(np.isclose(a, b) for a, b in at)


def _ingested(spark, tmp_path, name):
    m, n = K.M_PER_DEG, 40
    r, c = np.mgrid[:n, :n]

    def product(values, method="bilinear", code=None):
        px = spark.createDataFrame(pd.DataFrame({"row": r.ravel().astype("int32"), "col": c.ravel().astype("int32"), "v": values.ravel().astype(float)}))
        return jobs.Product(px, "v", coregister.ProductGrid(n, n, -180.0 * m, 90.0 * m, 9.0 * m, code), method)

    z = np.hypot(r, c * 1.7) * 40
    products = {"dn_left": product(np.where((c > 1) & (c < 6), 0, 9), "nearest", 0.0), "dn_right": product(np.where(c % 3, 5, 0), "nearest", 0.0),
                "gtdr_up": product(z, "cubic"), "stereo_dem": product(np.where((r + c) % 9, z - 795 + r % 3, -1.0), "bilinear", -1.0)}
    regions = spark.createDataFrame([("a", 100.0, -40.0, 250.0, -10.0), ("b", 330.0, 0.0, 20.0, 20.0)], "region string, west double, south double, east double, north double")
    spec = jobs.IngestSpec(pixel_m=0.5 * m, core_px=20, margin_px=3)
    jobs.ingest_to_store(regions, products, spec, f"{tmp_path}/{name}")
    return regions, products, spec


def test_an_ingest_writes_its_pixels_once_where_they_are_made(spark, tmp_path, monkeypatch):
    written, keep = [], jobs.materialise
    monkeypatch.setattr(jobs, "materialise", lambda df, purpose: written.append((purpose, out := keep(df, purpose))) or out)
    regions, products, spec = _ingested(spark, tmp_path, "one")
    px = spark.read.parquet(f"{tmp_path}/one/pixel")
    tiles = spark.read.parquet(f"{tmp_path}/one/tile")
    assert 20 < tiles.count() < jobs.plan_tiles(regions, spec).count()  # gated
    assert px.count() == tiles.count() * 26 ** 2
    assert all(d.count() <= 1600 for _, d in written)  # nothing of a row a pixel but the store
    node, above = jobs._laid_out(jobs.plan_tiles(regions, spec), products, spec)._jdf.queryExecution().executedPlan().inputPlan(), []
    while "Generate" not in node.nodeName():
        above.append(node.nodeName())
        node = node.children().apply(0)  # of a join, the side of the pixels
    assert above.count("BroadcastHashJoin") == 4 and not any("Exchange" in name for name in above) and above.count("Sort") == 1
    monkeypatch.setattr(jobs, "SMALL_SOURCE_PX", 0)  # every source in a shuffle
    _ingested(spark, tmp_path, "two")
    key = ["quad", "tile", "row", "col"]
    a, b = (spark.read.parquet(f"{tmp_path}/{n}/pixel").drop("_tile", "_cover").toPandas().sort_values(key).reset_index(drop=True) for n in ("one", "two"))
    pd.testing.assert_frame_equal(a, b[a.columns])
    left, right = (spark.read.parquet(f"{tmp_path}/{n}/tile").orderBy("tile").select("tile", "quad", "has_right", "has_stereo_dem").collect() for n in ("one", "two"))
    assert left == right and len({r["has_right"] for r in left}) == 2
    at_pixels = jobs.tile_facts(px, ("tile",)).groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("region", "lon", "lat_deg", "has_right")).alias("k"))
    assert {(r["n"], r["k"]) for r in at_pixels.collect()} == {(676, 1)}
    assert "Join" not in plan(load_all()[0]["ingest_tiles"](spark, "/root/testdata/sf0.001"))  # no pixel meets its tile's row
    tied = px.where("stereo_dem IS NOT NULL AND gtdr_up IS NOT NULL").groupBy("tile").agg(F.median(F.col("stereo_dem") - F.col("gtdr_up")).alias("m"))
    assert all(abs(r["m"]) < 1e-9 for r in tied.collect())


def test_windows_reach_the_blocks_of_their_pixels(spark):
    m = K.M_PER_DEG
    grid = coregister.ProductGrid(60, 120, -180.0 * m, 90.0 * m, 3.0 * m)
    w = pd.DataFrame({"west": [10.0, 176.0, 350.0, -3.0, 0.0, 181.0], "east": [14.0, 184.0, 372.0, 4.0, 360.0, 183.0],
                      "south": [-5.0, 20.0, 60.0, -89.0, 0.0, -40.0], "north": [5.0, 29.0, 66.0, -80.0, 2.0, -38.0]})
    r, c = np.mgrid[:60, :120]
    raster = spark.createDataFrame(pd.DataFrame({"row": r.ravel().astype("int32"), "col": c.ravel().astype("int32"), "z": 1.0}))
    for i in range(len(w)):
        window = spark.createDataFrame(w.iloc[[i]])
        p = grids.window_pixels(window, 0.5 * m).select(grid.rows("lat").alias("y"), grid.cols("lon").alias("x")).toPandas()
        want = {(a, b) for dr in (-2, 2) for dc in (-2, 2) for a, b in zip(np.floor((p.y + dr) / 8).astype(int), np.floor((p.x + dc) / 8).astype(int))}
        want = {(a, b) for a, b in want if 0 <= a < 8 and 0 <= b < 15}
        got = coregister.reached(window, 0.5 * m, raster, grid, block=8).toPandas()
        blocks = set(zip(got.row // 8, got.col // 8))
        assert want <= blocks and len(blocks - want) <= 3 and len(got) < 7200, i
