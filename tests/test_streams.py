"""Raw arrays by byte ranges, in batch and growing; tile state of the streamed mosaic."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from relievo.sources import raw_array
from relievo.streaming import mosaic


def test_only_arrived_rows_are_read_and_ranges_cut(spark, tmp_path):
    a = np.arange(70, dtype="<f4").reshape(10, 7)
    (tmp_path / "a.img").write_bytes(a.tobytes()[: 8 * 28 + 13])  # eight rows and part of the ninth
    one = raw_array.RawArray("a", f"file://{tmp_path}/a.img", 10, 7)
    none = raw_array.RawArray("b", str(tmp_path / "b.img"), 10, 7)  # not there yet
    df = raw_array.scan(spark, [one, none], rows_per_task=3)
    assert df.rdd.getNumPartitions() == 3
    got = df.toPandas().sort_values(["row", "col"])
    assert (got["raw"].to_numpy().reshape(8, 7) == a[:8]).all() and set(got["dem"]) == {"a"}
    cut = raw_array.scan(spark, [one], 3, 2, 5)
    assert cut.rdd.getNumPartitions() == 1 and {r["row"] for r in cut.select("row").distinct().collect()} == {2, 3, 4}
    assert raw_array.scan(spark, [none]).count() == 0


def test_gaps_are_null(spark, tmp_path):
    np.array([[1, np.nan, np.inf, -3e38]], "<f4").tofile(tmp_path / "g.img")
    z = raw_array.heights(raw_array.scan(spark, [raw_array.RawArray("g", str(tmp_path / "g.img"), 1, 4)]), 0.0)
    assert [r["z"] is None for r in z.orderBy("col").collect()] == [False, True, True, True]


def test_write_and_read_back(spark, frame, tmp_path):
    z = np.arange(12.0).reshape(3, 4)
    px = frame(z=z).where("NOT (row = 1 AND col = 2) AND NOT (row = 0)").withColumn("z", F.when(F.col("col") != 0, F.col("z")))
    assert raw_array.write_arrays(px, "z", str(tmp_path / "w"), 4, "tile").first()[:] == ("0", 3)
    got = np.fromfile(tmp_path / "w" / "0.img", "<f4").reshape(3, 4)
    want = z.copy()
    want[0], want[1, 2], want[:, 0] = np.nan, np.nan, np.nan
    assert np.array_equal(got, want, equal_nan=True)


def test_growing_file_in_two_micro_batches(spark, tmp_path):
    a = np.arange(60, dtype="<f4").reshape(12, 5)
    f, log, ck = tmp_path / "a.img", str(tmp_path / "log"), str(tmp_path / "ck")
    array = raw_array.RawArray("a", str(f), 12, 5)
    seen = []
    for rows in (5, 12):
        f.write_bytes(a.tobytes()[: rows * 20 + 3])
        q = mosaic.log_band(raw_array.scan_stream(spark, [array], 4), log, ck)
        q.awaitTermination(120)
        seen.append(sum(p["numInputRows"] for p in q.recentProgress))
    assert seen == [25, 35]
    got = spark.read.parquet(log).toPandas().sort_values(["row", "col"])
    assert (got["raw"].to_numpy().reshape(12, 5) == a).all()
    assert mosaic.arrived_band(spark.read.parquet(log)).first()["available_rows"] == 12


def test_state_is_one_row_per_tile_and_expires(spark, tmp_path):
    src, log, ck = (str(tmp_path / n) for n in ("in", "log", "ck"))

    def deliver(tiles):
        rows = [(t, r, c, 1.0) for t in tiles for r in range(6) for c in range(5)] * 2
        spark.createDataFrame(pd.DataFrame(rows, columns=["tile", "row", "col", "z"])).coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema("tile long, row long, col long, z double").parquet(src)
        q = mosaic.log_band(mosaic.first_deliveries(s, (6, 5), forget_s=2.0), log, ck)
        q.awaitTermination(120)
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    assert deliver([0, 1, 2]) == 3
    assert spark.read.parquet(log).count() == 90
    import time
    time.sleep(2.5)
    assert deliver([7]) == 1  # the three tiles got nothing for longer than forget_s
    assert spark.read.parquet(log).count() == 120


def test_pixel_outside_the_tile_is_an_error(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(0, 9, 0)], "tile long, row long, col long").write.parquet(src)
    s = spark.readStream.schema("tile long, row long, col long").parquet(src)
    with pytest.raises(Exception, match="outside"):
        mosaic.log_band(mosaic.first_deliveries(s, (6, 5)), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination(120)
