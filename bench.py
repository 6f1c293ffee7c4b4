"""Headline queries timed on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from relievo.plans import load_all
from relievo.session import build_session

HEADLINE = [
    "decode_dn",            # radiometry over single samples
    "quad_physics_mae",     # decode, render, split and score
    "stereo_trust",         # seams, dilation, radar-dark areas
    "gaussian_reduce",      # anti-aliased reduction
    "altimetry_upsampled",  # cubic post upsampling with gaps
    "footprint_blur",       # altimeter footprint
    "blended_mosaic",       # feathered blend
    "fitted_temperature",   # exact distributed quantile
    "patch_angles",         # 96 candidate angles per patch
    "points_in_boxes",      # spatial join
    "terrain_payloads",     # mesh encode and decode
    "power_spectrum",       # tile spectra
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
        print(f"{name}: {times[name]} (median {statistics.median(runs):.2f})", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total of headline queries, best of runs", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
