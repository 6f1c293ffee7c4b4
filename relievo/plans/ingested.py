"""Queries of the tile store: an ingest written by quadrangle, and its splits read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators.coregister import ProductGrid
from ..session import materialise, workspace
from ..sources import tilestore
from . import bindings as B
from . import jobs
from .bindings import H, W, sql
from .registry import query, rounded_cols, rs
from .terrain import _quad_sql

SPEC = jobs.IngestSpec(pixel_m=0.25 * K.M_PER_DEG, core_px=10, margin_px=3, max_lat=60.0)
FULL = SPEC.core_px + 2 * SPEC.margin_px

# rasters of the whole scene table: one cell per (key % 50, key // 50 % 100)
_RASTER = f"""ras AS (SELECT key % {H} AS r, key // {H} % {W} AS c, floor(avg(dn_left)) AS dn_left, floor(avg(dn_right)) AS dn_right,
     avg(z) AS gtdr, avg(z_hat)+795e0 AS stereo, floor(avg(sigma)+0.4371e0)*100 AS em
   FROM (SELECT *, tile*{H * W}+r*{W}+c AS key FROM scene) GROUP BY 1, 2),
coded AS (SELECT r, c, CASE WHEN c%10<7 AND dn_left<>0 THEN dn_left END AS dn_left, CASE WHEN r%4<>0 AND dn_right<>0 THEN dn_right END AS dn_right,
     gtdr, CASE WHEN (r+c)%5<>0 THEN stereo END AS stereo, CASE WHEN (r+2*c)%6<>0 THEN em*1e-4 END AS em FROM ras)"""

_PLANNED = f"""planned AS (SELECT box, lat, ((lo%360e0)+360e0)%360e0 AS lon FROM (SELECT box, south+1.25e0+i*2.5e0 AS lat, west+1.25e0+j*2.5e0 AS lo
     FROM (SELECT *, CASE WHEN east<west THEN east+360e0 ELSE east END AS e FROM boxes), LATERAL generate_series(0,60) a(i), LATERAL generate_series(0,60) b(j)
     WHERE south+1.25e0+i*2.5e0<north AND west+1.25e0+j*2.5e0<e)
   WHERE abs(lat)<=60 AND NOT ((lo-1.25e0<180 AND lo+1.25e0>180) OR (((lo-1.25e0)%360e0)+360e0)%360e0 > (((lo+1.25e0)%360e0)+360e0)%360e0)),
grid AS (SELECT *, floor(y) AS r0, floor(x) AS c0, y-floor(y) AS fy, x-floor(x) AS fx, floor(y+0.5e0) AS rn, floor(x+0.5e0) AS cn FROM (
   SELECT *, (90e0-plat)/3.6e0-0.5e0 AS y, ((plon+180e0)%360e0+360e0)%360e0/3.6e0-0.5e0 AS x FROM (
     SELECT box, lon, lat, i, j, lon-2e0+(j+0.5e0)*0.25e0 AS plon, lat+2e0-(i+0.5e0)*0.25e0 AS plat
     FROM planned, generate_series(0,{FULL - 1}) a(i), generate_series(0,{FULL - 1}) b(j))))"""


def _tap(v):
    return f"CASE WHEN y BETWEEN 0 AND {H - 1} AND x BETWEEN 0 AND {W - 1} THEN (a.{v}*(1-fx)+b.{v}*fx)*(1-fy)+(d.{v}*(1-fx)+e.{v}*fx)*fy END"


_STORE = f"""sampled AS (SELECT g.*, n.dn_left, n.dn_right, n.em, {_tap('gtdr')} AS gtdr, {_tap('stereo')} AS shipped
   FROM grid g LEFT JOIN coded n ON n.r=rn AND n.c=cn LEFT JOIN coded a ON a.r=r0 AND a.c=c0 LEFT JOIN coded b ON b.r=r0 AND b.c=least(c0+1,{W - 1})
   LEFT JOIN coded d ON d.r=least(r0+1,{H - 1}) AND d.c=c0 LEFT JOIN coded e ON e.r=least(r0+1,{H - 1}) AND e.c=least(c0+1,{W - 1})),
tied AS (SELECT *, shipped-CASE WHEN ties>64 THEN tie END AS stereo FROM sampled JOIN (
   SELECT box, lon, lat, quantile_cont(shipped-gtdr,0.5) AS tie, count(shipped-gtdr) AS ties FROM sampled
   GROUP BY 1,2,3 HAVING count(dn_left)/{FULL * FULL}e0>=0.55) USING (box, lon, lat)),
store AS (SELECT t.*, has_right, has_stereo_dem, {_quad_sql('lat', 'lon')} AS quad FROM tied t JOIN (
   SELECT box, lon, lat, count(dn_right)/{FULL * FULL}e0>0.55 AS has_right, count(stereo)/{FULL * FULL}e0>0.2 AS has_stereo_dem
   FROM tied GROUP BY 1,2,3) USING (box, lon, lat))"""


def products(spark, sf):
    """Five rasters of one grid, each with its own nodata code."""
    key = F.col("tile") * (H * W) + F.col("row") * W + F.col("col")
    mean = B.scene(spark, sf).groupBy((key % H).cast("int").alias("row"), (F.floor(key / H) % W).cast("int").alias("col")).agg(
        F.floor(F.avg("dn_left")).cast("double").alias("left"), F.floor(F.avg("dn_right")).cast("double").alias("right"),
        F.avg("z").alias("gtdr"), (F.avg("z_hat") + 795.0).alias("stereo"), (F.floor(F.avg("sigma") + 0.4371) * 100.0).alias("em"))
    mean = materialise(mean, "rasters")  # a row per cell, read by every product
    r, c = F.col("row"), F.col("col")

    def raster(band, code=None, seen=None, scale=1.0, method="bilinear"):
        m = K.M_PER_DEG
        px = mean.select("row", "col", (F.col(band) if seen is None else F.when(seen, F.col(band)).otherwise(code)).alias(band))
        return jobs.Product(px, band, ProductGrid(H, W, -180.0 * m, 90.0 * m, 3.6 * m, code, scale), method)

    return {"dn_left": raster("left", 0.0, c % 10 < 7, method="nearest"),
            "dn_right": raster("right", 0.0, r % 4 != 0, method="nearest"),
            "gtdr_up": raster("gtdr"), "stereo_dem": raster("stereo", -32768.0, (r + c) % 5 != 0),
            "emissivity": raster("em", -1.0, (r + c * 2) % 6 != 0, 1e-4, "nearest")}


def written(spark, sf) -> str:
    """The folder of a store ingested over every box."""
    path = workspace(spark, "store")
    regions = B.boxes(spark, sf).withColumn("region", F.col("box").cast("string"))
    jobs.ingest_to_store(regions, products(spark, sf), SPEC, path)
    return path


@query("ingest_tiles", sql("scene boxes", f"""SELECT box, {rs('lon')} AS lon, {rs('lat')} AS lat, quad, i AS "row", j AS col, coalesce(dn_left,0e0) AS dn_left,
   coalesce(dn_right,0e0) AS dn_right, {rs('coalesce(em,0.85e0)')} AS emissivity, {rs('gtdr', 3)} AS gtdr_up, {rs('stereo', 3)} AS stereo_dem, has_right, has_stereo_dem,
   {rs('radians(greatest(least(45e0-0.004e0*power(lat-10e0,2),45e0),17e0))')} AS theta_left FROM store""", _RASTER, _PLANNED, _STORE))
def ingest_tiles(spark, sf):
    """Tiles of every box sampled from five rasters, gated, tied, written by quadrangle and read back whole."""
    path = written(spark, sf)
    kept = ("quad", "row", "col", "dn_left", "dn_right", "emissivity", "gtdr_up", "stereo_dem")
    px = jobs.tile_facts(spark.read.parquet(f"{path}/pixel"), kept, (F.col("region").cast("bigint").alias("box"), "lon", F.col("lat_deg").alias("lat"),
                                                                     "has_right", "has_stereo_dem", "theta_left"))
    return rounded_cols(px, gtdr_up=3, stereo_dem=3)


@query("stored_split", sql("scene boxes", f"""SELECT box, {rs('lon')} AS lon, {rs('lat')} AS lat, i-{SPEC.margin_px} AS "row", j-{SPEC.margin_px} AS col, {rs('gtdr', 3)} AS gtdr_up,
   {rs('stereo', 3)} AS stereo_dem, CASE WHEN (CAST(substr(quad,2,2) AS BIGINT)+CAST(substr(quad,5,2) AS BIGINT))%2=0 THEN 'val' ELSE 'train' END AS part
   FROM store WHERE has_stereo_dem AND abs(lat)<=40 AND i BETWEEN {SPEC.margin_px} AND {SPEC.margin_px + SPEC.core_px - 1}
     AND j BETWEEN {SPEC.margin_px} AND {SPEC.margin_px + SPEC.core_px - 1}""", _RASTER, _PLANNED, _STORE))
def stored_split(spark, sf):
    """Both splits of a written store: cores of tiles with a stereo DEM, whole quadrangles held out."""
    path = written(spark, sf)
    quads = spark.read.parquet(f"{path}/tile").select("quad").distinct()
    held = quads.where((F.substring("quad", 2, 2).cast("int") + F.substring("quad", 5, 2).cast("int")) % 2 == 0)
    out = None
    for part in ("train", "val"):
        tiles, px = tilestore.read_tiles(spark, path, part, held, keep_margin=False, max_lat=40.0, require_stereo=True)
        one = px.select("quad", "tile", "row", "col", "gtdr_up", "stereo_dem").join(tiles.select(
            "quad", "tile", F.col("region").cast("bigint").alias("box"), "lon", F.col("lat_deg").alias("lat")), ["quad", "tile"])
        one = one.drop("quad", "tile").withColumn("part", F.lit(part))
        out = one if out is None else out.unionByName(one)
    return rounded_cols(out, gtdr_up=3, stereo_dem=3)
