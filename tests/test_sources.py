import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from relievo import constants as K
from relievo.functions import geodesy as G
from relievo.sources import catalogue, sinks, tilestore
from relievo.sources.raw_dem import RawDem, read_labels
from relievo.streaming import monitor, mosaic

LABEL = """<Product><Axis_Array><elements>{h}</elements></Axis_Array><Axis_Array><elements> {w} </elements></Axis_Array>
<cart:pixel_resolution_x unit="m/pixel">1000.0</cart:pixel_resolution_x><cart:upperleft_corner_x unit="m">0.0</cart:upperleft_corner_x>
<cart:upperleft_corner_y unit="m">2000000.0</cart:upperleft_corner_y><value_offset>6040000.0</value_offset></Product>"""


@pytest.fixture
def raw(tmp_path):
    h, w = 30, 40
    a = np.add.outer(np.arange(h) * 10.0, np.arange(w)).astype("<f4") + 11800
    a[5, 6] = -3e38
    (tmp_path / "dem.xml").write_text(LABEL.format(h=h, w=w))
    (tmp_path / "dem.img").write_bytes(a.tobytes()[: 20 * w * 4 + 7])  # arrived in part
    return tmp_path, a


def test_partial_array_is_a_northern_band(spark, raw):
    path, a = raw
    dem = RawDem.open(spark, str(path / "dem.img"), str(path / "dem.xml"))
    assert (dem.height, dem.width, dem.available_rows) == (30, 40, 20)
    px = dem.pixels(spark, rows_per_task=6)
    got = px.toPandas()
    assert len(got) == 20 * 40 and got.z.isna().sum() == 1
    v = got[(got.row == 9) & (got.col == 8)].z.iloc[0]
    assert np.isclose(v, a[9, 8] + 6_040_000 - K.RADIUS_M)
    # bilinear: exact on the plane, NULL at gaps and past the band
    pts = spark.createDataFrame(pd.DataFrame({"r": [3.5, 4.5, 19.5], "c": [10.25, 5.5, 3.0]})).select(
        (F.col("c") * 1000.0 / K.M_PER_DEG).alias("lon"), ((F.lit(2e6) - F.col("r") * 1000.0) / K.M_PER_DEG).alias("lat"), "r")
    s = dem.sample(pts, px).orderBy("r").toPandas()["stereo"]
    assert np.isclose(s[0], 35 + 10.25 + 11800 + 6_040_000 - K.RADIUS_M) and s[1:].isna().all()


def test_label_without_a_tag_is_an_error(spark):
    d = spark.createDataFrame([(LABEL.format(h=1, w=1).replace("value_offset", "other"),)], "value string")
    with pytest.raises(Exception, match="value_offset"):
        read_labels(d).collect()


def test_inventory_and_uri(spark, raw):
    path, a = raw
    import hashlib
    files = {r["path"].rsplit("/", 1)[1]: r for r in catalogue.checksums(spark, str(path)).collect()}
    assert files["dem.img"]["sha256"] == hashlib.sha256((path / "dem.img").read_bytes()).hexdigest()
    (path / K.PRODUCTS[4][1]).write_bytes(b"x")
    got = catalogue.resolve(catalogue.catalogue(spark), catalogue.list_files(spark, str(path)), "raw", "http://x").collect()
    assert sum(r["uri"].startswith("raw/") for r in got) == 1


def test_tile_store(spark, tmp_path):
    tiles = spark.range(40).select(F.col("id").alias("tile"), (F.col("id") * 2.0 - 40).alias("lat_deg"), (F.col("id") * 9.0).alias("lon"),
                                   F.lit(1.0).alias("has_stereo_dem")).withColumn("quad", G.quad_id("lat_deg", "lon"))
    px = tiles.select("tile", "quad").crossJoin(spark.range(100).select((F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col")))
    path = str(tmp_path / "store")
    tilestore.write_store(px.withColumn("z", F.col("row") * 1.0), tiles, path, {"core_px": 6, "margin_px": 2})
    held = tiles.select("quad").distinct().orderBy("quad").limit(3)
    val, vpx = tilestore.read_tiles(spark, path, "val", held, keep_margin=False)
    train, tpx = tilestore.read_tiles(spark, path, "train", held)
    assert val.count() + train.count() == 40 and vpx.count() == val.count() * 36 and tpx.count() == train.count() * 100
    assert vpx.agg(F.max("row"), F.min("z")).first()[:] == (5, 2.0)
    with pytest.raises(ValueError, match="empty"):
        tilestore.read_tiles(spark, path, "val", spark.createDataFrame([("q99_99",)], "quad string"))
    plan = spark.read.parquet(f"{path}/tile").where("lat_deg >= -5 AND lat_deg <= 5 AND quad = 'q07_01'")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lat_deg), GreaterThanOrEqual(lat_deg" in plan and "PartitionFilters: [isnotnull(quad" in plan


def test_payload_files_and_json(spark, tmp_path):
    t = spark.createDataFrame([(1, 2, 3, bytearray(b"abc"))], "z int, x int, y int, payload binary")
    sinks.write_payload_files(t, str(tmp_path / "p"))
    assert (tmp_path / "p/1/2/3.terrain").read_bytes() == b"abc"
    sinks.write_json(t.select("z"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["z"] == 1


def test_stream_blend_ignores_order_and_repeats(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(t, r, c, t * 4 + r, c, float(rng.random() + 0.1), float(rng.normal())) for t in range(3) for r in range(6) for c in range(5)]
    p = pd.DataFrame(rows, columns=["tile", "row", "col", "grow", "gcol", "w", "z"]).astype({"row": "int32"})
    src = tmp_path / "in"
    for i, order in enumerate((p.sample(frac=0.7, random_state=1), p.sample(frac=1.0, random_state=2))):
        spark.createDataFrame(order).coalesce(1).write.mode("append").parquet(str(src))
    s = spark.readStream.schema(spark.read.parquet(str(src)).schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    log = str(tmp_path / "log")
    mosaic.blend_stream(s, ["z"], log, str(tmp_path / "ck"), (6, 5)).awaitTermination(120)
    want = p.assign(n=p.w * p.z).groupby(["grow", "gcol"]).agg(n=("n", "sum"), w=("w", "sum"))
    want = (want.n / want.w).sort_index().to_numpy()

    def values(df):
        return df.toPandas().sort_values(["grow", "gcol"]).z.to_numpy()

    assert np.allclose(values(mosaic.read_mosaic(spark, log, ["z"])), want)
    mosaic.compact(spark, log, str(tmp_path / "small"), ["z"])
    assert np.allclose(values(mosaic.read_mosaic(spark, str(tmp_path / "small"), ["z"])), want)


def test_status_stream_reports_done_and_stalled(spark, tmp_path):
    src = tmp_path / "in"
    beats = [("a", 10, 100, 2.0, 1.0), ("a", 20, 100, 2.0, 2.0), ("b", 100, 100, 1.0, 2.0)]
    d = spark.createDataFrame(beats, "run string, step long, steps long, seconds_per_step double, updated double")
    d.write.parquet(str(src))
    s = monitor.status_stream(spark.readStream.schema(d.schema).parquet(str(src)), stale_s=1.0)
    q = s.writeStream.outputMode("update").format("memory").queryName("beats").option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
    import time
    for _ in range(80):
        time.sleep(0.5)
        rows = {(r["run"], r["state"]): r for r in spark.table("beats").collect()}
        if ("a", "stalled") in rows:
            break
    q.stop()
    assert rows[("a", "running")]["eta_s"] == 160.0 and ("b", "done") in rows and ("a", "stalled") in rows


def test_done_beats_stalled(spark):
    h = spark.createDataFrame([("a", 100, 100, 1.0, 0.0), ("b", 5, 100, 1.0, 0.0), ("c", 5, 100, 1.0, 950.0)],
                              "run string, step long, steps long, seconds_per_step double, updated double")
    s = {r["run"]: (r["state"], r["eta_s"]) for r in monitor.status(h, 1000.0).collect()}
    assert s == {"a": ("done", None), "b": ("stalled", None), "c": ("running", 95.0)}
    logged = spark.createDataFrame([("a", 1, 9, 1.0, 0.0), ("z", 1, 9, 1.0, 0.0)], h.schema)
    assert monitor.with_logs(h, logged).count() == 4
