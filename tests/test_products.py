import gzip

import numpy as np
import pandas as pd
import pytest
from conftest import grid
from pyspark.sql import functions as F

from relievo.functions import geodesy as G
from relievo.operators import augment, blend, features, grids, joins, mesh, pyramid, spectrum


def test_feather_is_a_partition_of_unity(spark):
    px = spark.range(300).select(F.lit(0).alias("grow"), F.col("id").cast("int").alias("gcol"))
    t = blend.assign_tiles(px, 1, 300, 64, 16).groupBy("gcol").agg(F.sum(G.feather("col", 64, 16)).alias("w")).toPandas()
    assert len(t) == 300
    assert np.allclose(t.w[(t.gcol >= 16) & (t.gcol < 236)], 1.0)


def test_blending_keeps_constants_and_ramps(spark):
    r, c = np.mgrid[:90, :70]
    px = spark.createDataFrame(pd.DataFrame({"grow": r.ravel().astype("int32"), "gcol": c.ravel().astype("int32"),
                                             "z": (r * 3.0 + c).ravel()}))
    out = blend.blend(blend.assign_tiles(px, 90, 70, 32, 8), "z").toPandas()
    assert len(out) == 90 * 70 and np.allclose(out.z, out.grow * 3.0 + out.gcol)


def test_cap_merge_is_seamless_and_ignores_the_other_pole(spark):
    cyl, cap = G.CylindricalGrid(80, 40), G.Cap(30, 150_000.0)
    r, c = np.mgrid[:40, :80]
    base = spark.createDataFrame(pd.DataFrame({"tile": 0, "row": r.ravel().astype("int32"), "col": c.ravel().astype("int32"), "z": 5.0}))
    made = blend.cylindrical_to_polar(base, "z", cyl, cap)
    assert made.where("z is null").count() == 0  # no hole at the pole
    out = grid(blend.merge_cap(base, made.withColumn("z", F.col("z") + 10).select("tile", "row", "col", "z"), "z", cyl, cap), "z")
    assert np.allclose(out[20:], 5.0) and np.allclose(out[0], 15.0)
    assert ((out >= 5) & (out <= 15)).all()


@pytest.mark.parametrize("k,fh,fv", [(k, h, v) for k in range(4) for h in (False, True) for v in (False, True)])
def test_dihedral_moves_raster_and_vector_together(frame, k, fh, fv):
    z = np.arange(20.0).reshape(4, 5)
    d = frame(z=z).withColumn("look", F.struct(F.lit(0.6).alias("east"), F.lit(0.8).alias("north")))
    out = augment.dihedral(d, k, F.lit(fh), F.lit(fv), 4, 5, ("look",))
    a = np.rot90(z, k)
    a = a[:, ::-1] if fh else a
    a = a[::-1] if fv else a
    assert np.array_equal(grid(out, "z"), a)
    # the slope along the look direction does not change
    def along(img, e, n):
        dr, dc = np.gradient(img)
        return (dc * e - dr * n).ravel()
    look = out.select("look.*").first()
    assert np.allclose(np.sort(along(a, look["east"], look["north"])), np.sort(along(z, 0.6, 0.8)))


def test_mosaic_windows_cover_cores_once(spark):
    g = G.CylindricalGrid(2000, 1000)
    box = spark.createDataFrame([(350.0, -20.0, 10.0, 20.0)], "west double, south double, east double, north double")
    w = grids.mosaic_windows(box, g, core=20, margin=5).toPandas()
    assert len(w) > 0 and w["col"].between(0, 1999).all()
    assert not w.duplicated(["row", "col"]).any()
    assert set(np.diff(np.sort(w["row"].unique()))) == {20}


def test_boxes_across_the_meridian(spark):
    pts = spark.createDataFrame([(1, 359.0, 0.0), (2, 1.0, 0.0), (3, 180.0, 0.0), (4, 1.0, 50.0)], "id int, lon double, lat double")
    box = joins.region_frame(spark, {"m": (350.0, -10.0, 10.0, 10.0), "all": (0.0, -90.0, 360.0, 90.0)})
    got = sorted((r["region"], r["id"]) for r in joins.points_in_boxes(pts, box).collect())
    assert got == [("all", 1), ("all", 2), ("all", 3), ("all", 4), ("m", 1), ("m", 2)]
    plan = joins.points_in_boxes(pts, box)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_boxes_of_all_sizes_and_shapes(spark):
    rng = np.random.default_rng(3)
    n = 400
    span, height = 360 * 2.0 ** -rng.uniform(0, 16, n), 180 * 2.0 ** -rng.uniform(0, 16, n)
    west, south = rng.uniform(0, 360, n), rng.uniform(-90, 90 - height)
    b = pd.DataFrame({"box": np.arange(n), "west": west, "south": south, "east": (west + span) % 360, "north": south + height})
    b.loc[0, ["west", "east", "south", "north"]] = [10.0, 10.0, 0.0, 0.0]  # a single point
    b.loc[1, ["south", "north"]] = [5.0, -5.0]  # upside down: holds nothing
    pts = pd.DataFrame({"id": np.arange(3 * n), "lon": np.r_[rng.uniform(0, 360, n), west, (west + span / 2) % 360],
                        "lat": np.r_[rng.uniform(-90, 90, n), south, south + height / 2]})
    pts.loc[0, ["lon", "lat"]] = [10.0, 0.0]
    w, e = b.west.to_numpy(), b.east.to_numpy()
    turn = (pts.lon.to_numpy()[:, None] - w) % 360 <= (e - w) % 360
    lat = pts.lat.to_numpy()[:, None]
    want = {tuple(map(int, p)) for p in np.argwhere(turn & (lat >= b.south.to_numpy()) & (lat <= b.north.to_numpy()))}
    sb, sp = spark.createDataFrame(b), spark.createDataFrame(pts)
    got = [(r["id"], r["box"]) for r in joins.points_in_boxes(sp, sb).select("id", "box").collect()]
    assert len(got) == len(set(got)) and set(got) == want and (0, 0) in want
    assert joins.box_cells(sb).groupBy("box").count().agg(F.max("count")).first()[0] <= 9  # cells follow no box's size
    none = spark.createDataFrame([(None, 1.0, 1.0, 2.0)], "west double, south double, east double, north double")
    assert joins.points_in_boxes(sp, none).count() == 0 and joins.points_in_boxes(sp, sb.limit(0)).count() == 0


def test_overlap_average_against_a_fine_count(spark, frame):
    from relievo.operators.resample import overlap_average
    rng = np.random.default_rng(5)
    z = rng.normal(size=(9, 11))
    z[4, 5] = np.nan
    areas = [(0.0, 9.0, 0.0, 11.0), (2.25, 4.75, 1.5, 6.25), (3.0, 4.0, 3.0, 4.0), (4.1, 4.9, 5.1, 5.9), (-2.0, 0.5, 10.5, 14.0),
             (20.0, 21.0, 1.0, 2.0), (3.5, 3.5, 2.5, 2.5), (2.25, 4.75, 1.5, 6.25), (None, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame([(0, i, *a) for i, a in enumerate(areas)], "tile long, id int, src_top double, src_bottom double, src_left double, src_right double")
    px = frame(z=z).withColumn("z", F.when(~F.isnan("z"), F.col("z")))
    got = {r["id"]: r["z"] for r in overlap_average(df, px, "z", 9, 11).collect()}
    fine = np.repeat(np.repeat(z, 20, 0), 20, 1)  # every edge above is a multiple of 1/20
    for i, (t, b, l, r) in enumerate(areas[:5]):
        cut = fine[max(0, round(t * 20)):round(b * 20), max(0, round(l * 20)):round(r * 20)]
        if i == 3:
            assert got[i] is None  # only a gap inside
        else:
            assert np.isclose(got[i], np.nanmean(cut))
    assert got[5] is None and np.isclose(got[6], z[3, 2]) and got[7] == got[1] and got[8] is None


def test_site_on_a_tile_edge_belongs_to_both(spark):
    s = spark.createDataFrame([("edge", 0.0, 10.0), ("west", 194.6, 0.5)], "name string, lon double, lat double")
    got = joins.sites_in_tiles(s, 1).toPandas()
    assert sorted(got[(got.name == "edge") & (got.z == 0)].x) == [0, 1]
    w = got[(got.name == "west") & (got.z == 1)].iloc[0]
    assert (w.x, w.y) == (0, 1)


def vertices(spark, n=9, scale=1000.0):
    rng = np.random.default_rng(2)
    r, c = np.mgrid[:n, :n]
    return spark.createDataFrame(pd.DataFrame({
        "z": 4, "x": 3, "y": 9, "vr": r.ravel(), "vc": c.ravel(), "lon": 10 + c.ravel() * 0.5, "lat": 30 - r.ravel() * 0.5,
        "h": rng.normal(size=n * n) * scale}))


def test_mesh_round_trip(spark):
    n = 9
    v = vertices(spark, n)
    blob = mesh.encode_tiles(v, n)
    assert bytes(blob.first()["payload"])[:2] == b"\x1f\x8b"
    d = mesh.decode_tiles(blob).first()
    assert d["vertex_count"] == n * n and sorted(set(d["indices"])) == list(range(n * n)) and len(d["indices"]) == (n - 1) ** 2 * 6
    h = d["min_height"] + np.array(d["hq"]) / 32767 * (d["max_height"] - d["min_height"])
    src = {(r["vc"], n - 1 - r["vr"]): r["h"] for r in v.collect()}
    step = 32767 / (n - 1)
    want = [src[round(u / step), round(w / step)] for u, w in zip(d["u"], d["v"])]
    assert np.max(np.abs(h - want)) <= (d["max_height"] - d["min_height"]) / 32767
    # counter-clockwise from outside
    t = np.array(d["indices"]).reshape(-1, 3)
    x, y = np.array(d["u"])[t].astype(float), np.array(d["v"])[t].astype(float)
    assert (((x[:, 1] - x[:, 0]) * (y[:, 2] - y[:, 0]) - (x[:, 2] - x[:, 0]) * (y[:, 1] - y[:, 0])) > 0).all()
    raw = gzip.decompress(bytes(blob.first()["payload"]))
    assert mesh.encode_tiles(v, n, compress=False).first()["payload"] == raw


def test_sphere_contains_every_vertex(spark):
    v = vertices(spark)
    head = mesh.tile_headers(v).first()
    p = v.select(G.ecef("lon", "lat", "h").alias("p")).select("p.*").toPandas().to_numpy()
    d = np.linalg.norm(p - [head["sphere_x"], head["sphere_y"], head["sphere_z"]], axis=1)
    assert d.max() <= head["sphere_radius"] * (1 + 1e-9)
    assert np.linalg.norm([head[f"occlusion_{k}"] for k in "xyz"]) >= 1.0


def test_out_of_order_indices_are_an_error(spark):
    s = spark.createDataFrame([(0, 0, 0, 0, 0), (0, 0, 0, 1, 2)], "z int, x int, y int, pos int, v int")
    with pytest.raises(Exception, match="first-use"):
        mesh.high_water_code(s, "v").collect()


def test_pyramid_is_sparse(spark, frame):
    box = spark.createDataFrame([(0, 10.0, -10.0, 30.0, 10.0)], "tile long, west double, south double, east double, north double")
    z = np.random.default_rng(0).normal(size=(20, 20)) * 100
    dem = frame(h0=z)
    p = pyramid.terrain_pyramid(box, dem, "h0", 20, 20, F.lit(0), F.lit(4), 5)
    counts = {r["z"]: r["tiles"] for r in pyramid.level_counts(p).collect()}
    assert counts[0] == 1 and counts[4] == 2 * 2 * 1 or counts[4] <= 9
    region = box.select("tile", "west", F.lit(0.0).alias("south"), F.lit(15.0).alias("east"), "north")
    roi = pyramid.terrain_pyramid(box, dem, "h0", 20, 20, F.lit(5), F.lit(5), 5, region=region)
    assert 0 < roi.count() <= 9


def test_incomplete_features_are_dropped(spark):
    doc = ('{"features":[{"properties":{"name":"B","feature_type":"Mons","diameter":0},"geometry":{"coordinates":[1,2]}},'
           '{"properties":{"Name":"A","type":"Corona","diameter_km":"12.5"},"geometry":{"coordinates":[3,4]}},'
           '{"properties":{"type":"x"},"geometry":{"coordinates":[3,4]}},{"properties":{"name":"C"}}]}')
    got = [tuple(r) for r in features.parse_features(spark.createDataFrame([(doc,)], "value string")).orderBy("name").collect()]
    assert got == [("A", "Corona", 3.0, 4.0, 12.5), ("B", "Mons", 1.0, 2.0, 100.0)]


def test_search_folds_accents_and_prefers_prefixes(spark):
    f = spark.createDataFrame([("Şäwtämä",), ("Old Sawtama",), ("Mead",)], "name string")
    assert [r["name"] for r in features.search(f, "sawt").collect()] == ["Şäwtämä", "Old Sawtama"]
    assert features.search(f, "  ").count() == 0
    assert features.search(f, "a", limit=1).count() == 1


def test_spectrum_finds_its_wavelength(spark, frame):
    x = np.arange(32)
    z = np.tile(np.sin(2 * np.pi * x / 8), (32, 1))
    s = spectrum.radial_spectrum(spectrum.tile_power(frame(z=z), "z", 32, 100.0), 20).toPandas()
    top = s.loc[s.power.idxmax()]
    assert abs(top.wavelength_m - 800) < 150
