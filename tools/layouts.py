"""Time stencils on both layouts over one made raster: python tools/layouts.py [megapixels]"""

from __future__ import annotations

import sys
import tempfile
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])
from pyspark.sql import functions as F  # noqa: E402

from relievo.operators import chunks, masks, stencil  # noqa: E402
from relievo.operators import resample as S  # noqa: E402
from relievo.session import build_session  # noqa: E402


def main():
    side = int((float(sys.argv[1]) * 1e6 if len(sys.argv) > 1 else 1e7) ** 0.5)
    spark = build_session("local[8]", "layouts", **{"spark.sql.shuffle.partitions": 32, "spark.driver.memory": "10g"})
    spark.sparkContext.setLogLevel("ERROR")
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    i = F.col("id")
    (spark.range(side * side).select(
        F.lit(0).alias("tile"), F.floor(i / side).cast("int").alias("row"), (i % side).cast("int").alias("col"),
        (F.sin(i / 97.0) * 300 + F.pmod(F.xxhash64("id"), F.lit(97))).alias("z"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(997)) / 20.0 - 12.2).alias("rv"))
     .write.parquet(f"{base}/pixel"))
    px = spark.read.parquet(f"{base}/pixel")
    start = time.perf_counter()
    chunks.to_chunks(px, ["z", "rv"]).write.parquet(f"{base}/chunk")
    print(f"pixels to blocks: {time.perf_counter() - start:.1f} s", flush=True)
    ch = spark.read.parquet(f"{base}/chunk")
    pairs = {
        "sobel": (stencil.sobel(px, "z", 75.0).select("tile", "row", "col", "z_de", "z_dn"), chunks.sobel(ch, "z", 75.0)),
        "trust": (masks.stereo_trust_mask(px, "z", F.lit(True), "rv", F.col("rv").isNotNull()),
                  chunks.stereo_trust_mask(ch, "z", "rv")),
        "reduce": (S.gaussian_downsample(px, "z", 8, side, side), chunks.gaussian_downsample(ch, "z", 8, side, side)),
        "steps": (stencil.neighbour_steps(px, "z"), chunks.neighbour_steps(ch, "z")),
    }
    for name, frames in pairs.items():
        took = []
        for df in frames:
            start = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        print(f"{name}: pixel rows {took[0]:.1f} s, blocks {took[1]:.1f} s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
