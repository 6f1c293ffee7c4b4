"""Queries of masks, stencils and resampling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geodesy as G
from ..functions import radiometry as R
from ..operators import blend, chunks, masks, stencil
from ..operators import joins, metrics
from ..operators import resample as S
from ..operators.coregister import ProductGrid, sample_windows
from . import bindings as B
from .bindings import H, PX, W, downsample_sql, flattened_sql, sobel_sql, sql
from ..functions.base import attach
from .registry import ORACLES, query, rounded, rounded_cols, rs

LAT = "(90e0-(r+0.5e0)*3.6e0)"
LON = "((c+0.5e0)*3.6e0)"
THETA = f"radians(greatest(least(45e0-0.004e0*power({LAT}-10e0,2),45e0),17e0))"
GRID = G.CylindricalGrid(W, H)


def _quad_sql(lat, lon):
    return f"printf('q%02d_%02d', CAST(floor(({lat}+90)/12) AS INTEGER), CAST(floor({lon}/12) AS INTEGER))"


def located(df):
    """Longitude, latitude and left-look incidence of every pixel."""
    d = df.withColumns({"lon": GRID.lon("col"), "lat": GRID.lat("row")})
    return d.withColumn("theta", F.radians(G.incidence_deg("lat", "left")))


RENDERED = [
    sobel_sql("sob", "scene", "z_hat", str(H), str(W), f"{PX}e0"),
    f"""rendered AS (SELECT s.*, {LAT.replace('r+', 's.r+')} AS lat, {LON.replace('c+', 's.c+')} AS lon,
      {THETA.replace('r+', 's.r+')} AS theta, atan(sob.de) AS alpha FROM scene s JOIN sob USING (tile, r, c))""",
    f"""resid AS (SELECT *, {flattened_sql('theta-alpha', 'theta')}+brightness-((dn_left-1e0)/5e0-20e0) AS res,
      (alpha<theta-radians(5e0) AND alpha>-(pi()/2-radians(5e0)) AND dn_left<>0) AS usable FROM rendered)"""]


def rendered_scene(spark, sf):
    d = located(B.scene(spark, sf)).withColumn("rv_left", R.rv_from_dn("dn_left"))
    return metrics.rendered_residual(d, "z_hat", "rv_left", F.col("dn_left") != 0, "theta", (1.0, 0.0), PX,
                                     "brightness")


@query("quad_physics_mae", sql("scene", f"""SELECT quad, n, {rs('valid_fraction')} AS valid_fraction, {rs('mae')} AS phys_resid_db FROM (
  SELECT q.quad, count(*) AS n, avg(CASE WHEN usable THEN 1e0 ELSE 0e0 END) AS valid_fraction,
    avg(CASE WHEN usable THEN abs(res-o.off) END) AS mae
  FROM q JOIN (SELECT quad, avg(CASE WHEN usable THEN res END) AS off FROM q GROUP BY 1) o ON o.quad=q.quad
  WHERE NOT q.held GROUP BY 1)""", *RENDERED,
    f"q AS (SELECT *, {_quad_sql('lat', 'lon')} AS quad, CAST(floor((lat+90)/12) AS INTEGER)%4=0 AS held FROM resid)"))
def quad_physics_mae(spark, sf):
    """Flagship: decode, split by quadrangle, render, and score the image per training quadrangle."""
    r = rendered_scene(spark, sf).withColumn("quad", G.quad_id("lat", "lon"))
    lat_band = F.substring("quad", 2, 2).cast("int")
    held_out = located(B.dem(spark, sf)).select(G.quad_id("lat", "lon").alias("quad")).where(lat_band % 4 == 0)
    train = joins.split(r, held_out, "train")
    return rounded_cols(metrics.physics_residual(train, "residual", F.col("usable"), ("quad",)))


@query("sobel_slope", sql("dem", f"""SELECT tile, r AS "row", c AS col, {rs('de', 9)} AS de, {rs('dn', 9)} AS dn,
  {rs('atan(de*0.6e0+dn*0.8e0)', 9)} AS alpha, {rs('atan(sqrt(de*de+dn*dn))', 9)} AS slope FROM sob""",
    sobel_sql("sob", "dem", "z", str(H), str(W), f"{PX}e0")))
def sobel_slope(spark, sf):
    g = stencil.sobel(B.dem(spark, sf), "z", PX, block=32)
    return g.select("tile", "row", "col", rounded("z_de", 9).alias("de"), rounded("z_dn", 9).alias("dn"),
                    rounded(stencil.along_look("z_de", "z_dn", 0.6, 0.8), 9).alias("alpha"),
                    rounded(stencil.slope_magnitude("z_de", "z_dn"), 9).alias("slope"))


@query("rendered_look", sql("scene", f"""SELECT tile, r AS "row", c AS col, CASE WHEN dn_left<>0 THEN {rs('res')} END AS residual, {rs('alpha', 9)} AS alpha, usable FROM resid""", *RENDERED))
def rendered_look(spark, sf):
    d = rendered_scene(spark, sf)
    return d.select("tile", "row", "col", rounded("residual").alias("residual"), rounded("alpha", 9).alias("alpha"), "usable")


_CENTRAL = """grad AS (SELECT tile, r, c, (ez-wz)/(ec-wc) AS dc, (sz-nz)/(sr-nr) AS dr FROM (SELECT *,
   coalesce(lag(z) OVER x, z) AS wz, coalesce(lead(z) OVER x, z) AS ez, coalesce(lag(c) OVER x, c) AS wc, coalesce(lead(c) OVER x, c) AS ec,
   coalesce(lag(z) OVER y, z) AS nz, coalesce(lead(z) OVER y, z) AS sz, coalesce(lag(r) OVER y, r) AS nr, coalesce(lead(r) OVER y, r) AS sr
   FROM dem WINDOW x AS (PARTITION BY tile, r ORDER BY c), y AS (PARTITION BY tile, c ORDER BY r)))"""
_DX, _DY = "(dc*0.02e0)", "(dr*0.02e0)"
_SHADE = (f"(sin(radians(45e0))*sin(pi()/2-atan(sqrt({_DX}*{_DX}+{_DY}*{_DY})))+cos(radians(45e0))*"
          f"cos(pi()/2-atan(sqrt({_DX}*{_DX}+{_DY}*{_DY})))*cos(radians(135e0)-atan2(-{_DX},{_DY})))*255e0")


@query("hillshade", sql("dem", f"""SELECT tile, r AS "row", c AS col, {rs(f'dc/{PX}e0', 9)} AS de, {rs(f'-dr/{PX}e0', 9)} AS dn,
  CAST(floor(greatest(least({_SHADE},255e0),0e0)) AS BIGINT) AS shade FROM grad""", _CENTRAL))
def hillshade(spark, sf):
    g = stencil.central_gradient(B.dem(spark, sf), "z", PX, block=64)
    s = stencil.hillshade(B.dem(spark, sf), "z", z_factor=0.02, block=64)
    return g.join(s.select("tile", "row", "col", "shade"), ["tile", "row", "col"]).select(
        "tile", "row", "col", rounded("z_de", 9).alias("de"), rounded("z_dn", 9).alias("dn"), "shade")


@query("rms_slope_cells", sql("dem", f"""SELECT tile, r//8 AS crow, c//8 AS ccol,
  {rs('atan(sqrt(greatest(avg(de*de+dn*dn),1e-8)))', 9)} AS rms_slope FROM sob WHERE r<48 AND c<96 GROUP BY 1,2,3""",
    sobel_sql("sob", "dem", "z", str(H), str(W), f"{PX}e0")))
def rms_slope_cells(spark, sf):
    return rounded_cols(stencil.rms_slope(B.dem(spark, sf), "z", PX, 8, H, W), 9)


@query("roughness_steps", sql("dem", f"""SELECT a.tile, {rs('avg(abs(e.z-a.z))')} AS step_e, {rs('avg(abs(s.z-a.z))')} AS step_s,
  {rs('avg(abs(s.z+n.z+e.z+w.z-4e0*a.z))')} AS laplacian, count(s.z+n.z+e.z+w.z) AS interior FROM dem a
   LEFT JOIN dem w ON w.tile=a.tile AND w.r=a.r AND w.c=a.c-1 LEFT JOIN dem e ON e.tile=a.tile AND e.r=a.r AND e.c=a.c+1
   LEFT JOIN dem n ON n.tile=a.tile AND n.c=a.c AND n.r=a.r-1 LEFT JOIN dem s ON s.tile=a.tile AND s.c=a.c AND s.r=a.r+1
  GROUP BY 1"""))
def roughness_steps(spark, sf):
    d = stencil.neighbour_steps(B.dem(spark, sf), "z", block=32)
    return rounded_cols(d.groupBy("tile").agg(
        F.avg(F.abs("step_e")).alias("step_e"), F.avg(F.abs("step_s")).alias("step_s"),
        F.avg(F.abs("laplacian")).alias("laplacian"), F.count("laplacian").alias("interior")))


MASKS = [f"""jump AS (SELECT DISTINCT a.tile, a.r, a.c FROM scene a JOIN scene b ON b.tile=a.tile AND
     ((b.r=a.r AND abs(b.c-a.c)=1) OR (b.c=a.c AND abs(b.r-a.r)=1)) WHERE abs(a.z-b.z)>4400e0)""",
         "dark AS (SELECT tile, r, c FROM scene WHERE dn_left<>0 AND (dn_left-1e0)/5e0-20e0 < -17e0)",
         """masked AS (SELECT s.*,
   NOT EXISTS (SELECT 1 FROM jump j WHERE j.tile=s.tile AND j.r BETWEEN s.r-1 AND s.r+1 AND j.c BETWEEN s.c-1 AND s.c+1) AS seam_ok,
   NOT EXISTS (SELECT 1 FROM dark k WHERE k.tile=s.tile AND k.r BETWEEN s.r-2 AND s.r+2 AND k.c BETWEEN s.c-2 AND s.c+2) AS dark_ok
   FROM scene s)""",
         "trusted AS (SELECT *, (seam_ok AND dark_ok AND (r+c)%7<>0) AS trust FROM masked)"]


def trusted_scene(spark, sf):
    """The scene with decoded left look and the stereo trust mask."""
    d = B.scene(spark, sf).withColumn("rv_left", R.rv_from_dn("dn_left"))
    shipped = (F.col("row") + F.col("col")) % 7 != 0
    return masks.stereo_trust_mask(d, "z", shipped, "rv_left", F.col("rv_left").isNotNull(), jump_m=4400.0,
                                   seam_dilation=1, threshold_db=-17.0, dark_dilation=2)


@query("stereo_trust", sql("scene", """SELECT tile, r AS "row", c AS col, seam_ok, dark_ok, trust,
  NOT (trust OR dn_right<>0 OR dn_stereo<>0) AS unsupervised FROM trusted""", *MASKS))
def stereo_trust(spark, sf):
    d = trusted_scene(spark, sf)
    d = masks.seam_mask(d, "z", 4400.0, 1, block=32)
    d = masks.radar_dark_mask(d, "rv_left", F.col("rv_left").isNotNull(), -17.0, 2, block=32)
    return d.select("tile", "row", "col", "seam_ok", "dark_ok", "trust", masks.unsupervised(
        "trust", F.col("dn_right") != 0, F.col("dn_stereo") != 0).alias("unsupervised"))


@query("dilated_highs", sql("dem", """SELECT s.tile, s.r AS "row", s.c AS col FROM dem s WHERE EXISTS (SELECT 1 FROM dem j
  WHERE j.z>4800e0 AND j.tile=s.tile AND j.r BETWEEN s.r-3 AND s.r+3 AND j.c BETWEEN s.c-3 AND s.c+3)"""))
def dilated_highs(spark, sf):
    d = B.dem(spark, sf)
    near = masks.dilate_sparse(d.where(F.col("z") > 4800.0), 3)
    return d.join(near, ["tile", "row", "col"], "left_semi").select("tile", "row", "col")


@query("dilated_dense", sql("dem", """SELECT s.tile, count(*) AS hit FROM dem s WHERE EXISTS (SELECT 1 FROM dem j
  WHERE j.z>4800e0 AND j.tile=s.tile AND j.r BETWEEN s.r-3 AND s.r+3 AND j.c BETWEEN s.c-3 AND s.c+3) GROUP BY 1"""))
def dilated_dense(spark, sf):
    d = B.dem(spark, sf).withColumn("m", F.col("z") > 4800.0)
    return masks.dilate(d, "m", 3, block=16).where("m").groupBy("tile").agg(F.count(F.lit(1)).alias("hit"))


_COVER = """cover AS (SELECT tile, avg(CASE WHEN dn_left<>0 THEN 1e0 ELSE 0e0 END) AS left_, avg(CASE WHEN dn_right<>0 THEN 1e0 ELSE 0e0 END) AS right_,
   avg(CASE WHEN dn_stereo<>0 THEN 1e0 ELSE 0e0 END) AS stereo_, avg(CASE WHEN z>2000 THEN 1e0 ELSE 0e0 END) AS dem_ FROM scene GROUP BY 1)"""


@query("tile_coverage_flags", sql("scene", f"""SELECT tile, {rs('left_')} AS "left", {rs('right_')} AS "right", {rs('stereo_')} AS stereo,
  {rs('dem_')} AS stereo_dem, right_>0.55 AS has_right, stereo_>0.55 AS has_stereo, dem_>0.2 AS has_stereo_dem,
  right_>0.5 AS tile_right, stereo_>0.5 AS tile_stereo FROM cover WHERE left_>=0.55""", _COVER))
def tile_coverage_flags(spark, sf):
    d = B.scene(spark, sf)
    kept = masks.coverage_gate(d, F.col("dn_left") != 0, 0.55)
    cover = masks.tile_coverage(kept, {"left": F.col("dn_left") != 0, "right": F.col("dn_right") != 0,
                                       "stereo": F.col("dn_stereo") != 0, "stereo_dem": F.col("z") > 2000.0})
    t = masks.presence_flags(cover, "ingest")
    loose = masks.presence_flags(cover, "tile").select("tile", F.col("has_right").alias("tile_right"),
                                                       F.col("has_stereo").alias("tile_stereo"))
    return rounded_cols(t.join(loose, "tile"))


# --- resampling ------------------------------------------------------------------------------------------------
@query("gaussian_reduce", sql("dem", f"""SELECT tile, r AS "row", c AS col, {rs('z')} AS z FROM d""",
                              downsample_sql("d", "dem", "z", 4, 0.5, H, W)))
def gaussian_reduce(spark, sf):
    return rounded_cols(S.gaussian_downsample(B.dem(spark, sf), "z", 4, H, W))


@query("at_trusted_scale", sql("dem", f"""SELECT tile, r AS "row", c AS col, {rs('z')} AS z FROM d""",
                               downsample_sql("d", "dem", "z", 3, 0.5, H, W)))
def at_trusted_scale(spark, sf):
    return rounded_cols(S.at_scale(B.dem(spark, sf), "z", PX, 31_000.0, H, W))


# --- the same stencils on array blocks ---------------------------------------------------------------------------
CHUNK = 32


@query("sobel_slope_chunks", ORACLES["sobel_slope"])
def sobel_slope_chunks(spark, sf):
    c = chunks.sobel(chunks.to_chunks(B.dem(spark, sf), "z", block=CHUNK), "z", PX, block=CHUNK)
    g = chunks.to_pixels(c, ["z_de", "z_dn"], block=CHUNK)
    return g.select("tile", "row", "col", rounded("z_de", 9).alias("de"), rounded("z_dn", 9).alias("dn"),
                    rounded(stencil.along_look("z_de", "z_dn", 0.6, 0.8), 9).alias("alpha"),
                    rounded(stencil.slope_magnitude("z_de", "z_dn"), 9).alias("slope"))


@query("stereo_trust_chunks", sql("scene", """SELECT tile, r AS "row", c AS col, seam_ok, dark_ok FROM trusted""", *MASKS))
def stereo_trust_chunks(spark, sf):
    d = B.scene(spark, sf).withColumn("rv_left", R.rv_from_dn("dn_left"))
    c = chunks.stereo_trust_mask(chunks.to_chunks(d, ["z", "rv_left"], block=CHUNK), "z", "rv_left", jump_m=4400.0,
                                 seam_dilation=1, threshold_db=-17.0, dark_dilation=2, block=CHUNK)
    flags = ("seam_ok", "dark_ok")
    return chunks.to_pixels(c, flags, block=CHUNK).withColumns({n: F.col(n) != 0 for n in flags})


@query("dilated_chunks", ORACLES["dilated_highs"])
def dilated_chunks(spark, sf):
    d = B.dem(spark, sf).withColumn("high", (F.col("z") > 4800.0).cast("double"))
    c = chunks.dilate(chunks.to_chunks(d, "high", block=16), "high", 3, block=16)
    return chunks.to_pixels(c, "high", block=16).where("high <> 0").select("tile", "row", "col")


@query("gaussian_reduce_chunks", ORACLES["gaussian_reduce"])
def gaussian_reduce_chunks(spark, sf):
    c = chunks.to_chunks(B.dem(spark, sf), "z", block=CHUNK)
    return rounded_cols(chunks.gaussian_downsample(c, "z", 4, H, W, block=CHUNK))


@query("roughness_steps_chunks", ORACLES["roughness_steps"])
def roughness_steps_chunks(spark, sf):
    c = chunks.neighbour_steps(chunks.to_chunks(B.dem(spark, sf), "z", block=CHUNK), "z", block=CHUNK)
    d = chunks.to_pixels(c, ["step_e", "step_s", "laplacian"], block=CHUNK)
    return rounded_cols(d.groupBy("tile").agg(
        F.avg(F.abs("step_e")).alias("step_e"), F.avg(F.abs("step_s")).alias("step_s"),
        F.avg(F.abs("laplacian")).alias("laplacian"), F.count("laplacian").alias("interior")))


@query("gradient_chunks", sql("dem", f"""SELECT tile, r AS "row", c AS col, {rs(f'dc/{PX}e0', 9)} AS de, {rs(f'-dr/{PX}e0', 9)} AS dn FROM grad""", _CENTRAL))
def gradient_chunks(spark, sf):
    c = chunks.central_gradient(chunks.to_chunks(B.dem(spark, sf), "z", block=CHUNK), "z", PX, block=CHUNK)
    g = chunks.to_pixels(c, ["z_de", "z_dn"], block=CHUNK)
    return g.select("tile", "row", "col", rounded("z_de", 9).alias("de"), rounded("z_dn", 9).alias("dn"))


STRIDE = 5
_POSTS = f"""posts AS (SELECT tile, (r-2)//{STRIDE} AS r, (c-2)//{STRIDE} AS c,
    CASE WHEN (r*31+c*17)%23=0 THEN 0e0 ELSE z END AS v, CASE WHEN (r*31+c*17)%23=0 THEN 0e0 ELSE 1e0 END AS m
    FROM dem WHERE r%{STRIDE}=2 AND c%{STRIDE}=2)"""


def _cubic_sql(t, a="(-0.75e0)"):
    near = lambda d: f"((({a}+2)*({d})-({a}+3))*({d})*({d})+1)"
    far = lambda d: f"((({a}*({d})-5*{a})*({d})+8*{a})*({d})-4*{a})"
    return [far(f"{t}+1"), near(t), near(f"1-({t})"), far(f"2-({t})")]


def upsample_sql(name, posts, bands, ph, pw, out_h, out_w, stride, off):
    """CTE (tile, r, c, bands): 16 clamped taps per fine pixel as a join."""
    u = f"greatest(least((i-({off}))/{stride}e0,{ph}-1e0),0e0)"
    v = f"greatest(least((j-({off}))/{stride}e0,{pw}-1e0),0e0)"
    ws = _cubic_sql("t")

    def axis(n, coord, var, size):
        taps = " UNION ALL ".join(f"SELECT i, greatest(least(k0+({d}),{size}-1),0) AS k, {w} AS w FROM b"
                                  for d, w in zip((-1, 0, 1, 2), ws))
        return f"""{name}_{var} AS (WITH b AS (SELECT i, CAST(floor(x) AS BIGINT) AS k0, x-floor(x) AS t FROM
            (SELECT {var} AS i, {coord} AS x FROM generate_series(0,{n}-1) g({var}))) {taps})"""
    sums = ", ".join(f"sum(y.w*x.w*p.{b}) AS {b}" for b in bands.split())
    return f"""{axis(out_h, u, 'i', ph)},
{axis(out_w, v, 'j', pw)},
{name} AS (SELECT p.tile, y.i AS r, x.i AS c, {sums} FROM {posts} p JOIN {name}_i y ON p.r=y.k JOIN {name}_j x ON p.c=x.k
       GROUP BY 1,2,3)"""


def dem_posts(spark, sf):
    """Altimetry posts cut from the dem lattice, with gaps."""
    gap = F.pmod(F.col("row") * 31 + F.col("col") * 17, F.lit(23)) == 0
    p = joins.lattice_pixels(B.dem(spark, sf), STRIDE)
    return p.select("tile", F.col("prow").alias("row"), F.col("pcol").alias("col"), F.when(~gap, F.col("z")).alias("z"))


@query("altimetry_upsampled", sql("dem", f"""SELECT tile, r AS "row", c AS col, CASE WHEN m>0.99 THEN {rs('v')} END AS z FROM up""",
       _POSTS, upsample_sql("up", "posts", "v m", 10, 20, H, W, STRIDE, 2)))
def altimetry_upsampled(spark, sf):
    return rounded_cols(S.upsample_altimetry(dem_posts(spark, sf), "z", STRIDE, 10, 20, H, W))


@query("coarse_baseline", sql("dem", f"""SELECT tile, r AS "row", c AS col, {rs('v')} AS z FROM up""",
       "box AS (SELECT tile, r//5 AS r, c//5 AS c, avg(z) AS v FROM dem GROUP BY 1,2,3)",
       upsample_sql("up", "box", "v", 10, 20, H, W, 5, "2e0")))
def coarse_baseline(spark, sf):
    return rounded_cols(S.coarse_baseline(B.dem(spark, sf), "z", 5, H, W))


@query("bilinear_enlarged", sql("dem", f"""SELECT a.tile, i AS "row", j AS col,
   {rs('(a.z*(1-fx)+b.z*fx)*(1-fy)+(d.z*(1-fx)+e.z*fx)*fy')} AS z FROM
   (SELECT i, j, floor(y) AS r0, floor(x) AS c0, y-floor(y) AS fy, x-floor(x) AS fx FROM (SELECT i, j,
      greatest(least((i+0.5e0)*50e0/120e0-0.5e0,49e0),0e0) AS y, greatest(least((j+0.5e0)*100e0/250e0-0.5e0,99e0),0e0) AS x
      FROM generate_series(0,119) s(i), generate_series(0,249) t(j)))
   JOIN dem a ON a.r=r0 AND a.c=c0 LEFT JOIN dem b ON b.tile=a.tile AND b.r=r0 AND b.c=least(c0+1,99)
   LEFT JOIN dem d ON d.tile=a.tile AND d.r=least(r0+1,49) AND d.c=c0 LEFT JOIN dem e ON e.tile=a.tile AND e.r=d.r AND e.c=b.c"""))
def bilinear_enlarged(spark, sf):
    return rounded_cols(S.upsample_bilinear(B.dem(spark, sf), "z", H, W, 120, 250))


@query("adaptive_pooling", sql("dem", f"""SELECT tile, k AS crow, l AS ccol, {rs('avg(z)')} AS mean_z, {rs('max(z)')} AS max_z
  FROM dem, generate_series(0,6) a(k), generate_series(0,10) b(l)
  WHERE r>=floor(k*50e0/7e0) AND r<ceil((k+1)*50e0/7e0) AND c>=floor(l*100e0/11e0) AND c<ceil((l+1)*100e0/11e0) GROUP BY 1,2,3"""))
def adaptive_pooling(spark, sf):
    return rounded_cols(S.adaptive_pool(B.dem(spark, sf), {"mean_z": ("avg", "z"), "max_z": ("max", "z")}, H, W, 7, 11))


FP = S.Footprint(80_000.0, 120_000.0, 0.35)


def footprint_kernel_sql(name: str, along: float, cross: float, az: float, px: float, truncate: float) -> str:
    half = max(1, math.ceil(truncate * max(along, cross) / px))
    ca, sa = f"cos({az}e0)", f"sin({az}e0)"
    return f"""{name} AS (SELECT i, j, w/sum(w) OVER () AS w FROM (SELECT i, j,
       exp(-0.5e0*(power((-i*{px}e0*{ca}+j*{px}e0*{sa})/{along!r}e0,2)+power((i*{px}e0*{sa}+j*{px}e0*{ca})/{cross!r}e0,2))) AS w
       FROM generate_series(-{half},{half}) a(i), generate_series(-{half},{half}) b(j)))"""


def blur_sql(src: str, band: str) -> list[str]:
    """CTEs down to `blur` (tile, r, c, band) on the coarse grid of the footprint blur of `src`."""
    plan = S.plan_blur(FP, PX, H, W)
    spent = (PX * plan.factor) ** 2
    a, c = (math.sqrt(s * s - spent) for s in (FP.sigma_along_m, FP.sigma_cross_m))
    return [downsample_sql("low", src, band, plan.factor, 1.0, H, W),
            footprint_kernel_sql("fk", a, c, FP.azimuth_rad, PX * plan.factor, 3.5),
            f"""blur_t AS (SELECT a.r, a.c, greatest(least(a.r+k.i,{plan.coarse_h - 1}),0) AS nr,
              greatest(least(a.c+k.j,{plan.coarse_w - 1}),0) AS nc, sum(k.w) AS w FROM (SELECT DISTINCT r, c FROM low) a CROSS JOIN fk k GROUP BY 1,2,3,4)""",
            f"""blur AS (SELECT b.tile, t.r, t.c, sum(t.w*b.{band}) AS {band} FROM blur_t t JOIN low b ON b.r=t.nr AND b.c=t.nc
              GROUP BY 1,2,3)"""]


def blurred_at_sql(points: str, band: str, key_cols: str) -> str:
    """Select of `points` (tile, r, c, ...) with the blurred band interpolated back as `seen`."""
    plan = S.plan_blur(FP, PX, H, W)
    hi, wi = plan.coarse_h, plan.coarse_w
    return f"""(SELECT {key_cols}, (a.{band}*(1-fx)+b.{band}*fx)*(1-fy)+(d.{band}*(1-fx)+e.{band}*fx)*fy AS seen FROM
     (SELECT *, floor(y) AS r0, floor(x) AS c0, y-floor(y) AS fy, x-floor(x) AS fx FROM (SELECT *,
        greatest(least((r+0.5e0)*{hi}e0/{H}e0-0.5e0,{hi - 1}e0),0e0) AS y, greatest(least((c+0.5e0)*{wi}e0/{W}e0-0.5e0,{wi - 1}e0),0e0) AS x FROM {points})) p
     LEFT JOIN blur a ON a.tile=p.tile AND a.r=r0 AND a.c=c0 LEFT JOIN blur b ON b.tile=p.tile AND b.r=r0 AND b.c=least(c0+1,{wi - 1})
     LEFT JOIN blur d ON d.tile=p.tile AND d.r=least(r0+1,{hi - 1}) AND d.c=c0 LEFT JOIN blur e ON e.tile=p.tile AND e.r=d.r AND e.c=b.c)"""


@query("footprint_blur", sql("dem", f"""SELECT tile, r AS "row", c AS col, {rs('seen', 4)} AS z FROM
  {blurred_at_sql('dem', 'z', 'p.tile, p.r, p.c')}""", *blur_sql("dem", "z")))
def footprint_blur(spark, sf):
    return rounded_cols(S.footprint_blur(B.dem(spark, sf), "z", FP, PX, H, W, block=16), 4)


# --- gathers -----------------------------------------------------------------------------------------------------
_PTS = """pts AS (SELECT event_id, event_id//5000 AS tile, value/500e0*52e0-1e0 AS y, lon/360e0*102e0-1e0 AS x FROM obs)"""


def event_points(spark, sf):
    return B.obs(spark, sf).select(
        "event_id", F.floor(F.col("event_id") / (H * W)).cast("bigint").alias("tile"),
        (F.col("value") / 500.0 * 52.0 - 1.0).alias("src_row"), (F.col("lon") / 360.0 * 102.0 - 1.0).alias("src_col"))


@query("bilinear_points", sql("obs dem", f"""SELECT event_id, {rs('(a.z*(1-fx)+b.z*fx)*(1-fy)+(d.z*(1-fx)+e.z*fx)*fy')} AS z FROM
   (SELECT *, floor(y) AS r0, floor(x) AS c0, y-floor(y) AS fy, x-floor(x) AS fx FROM pts) p
   LEFT JOIN dem a ON a.tile=p.tile AND a.r=r0 AND a.c=c0 AND y<=49 AND x<=99
   LEFT JOIN dem b ON b.tile=p.tile AND b.r=r0 AND b.c=least(c0+1,99)
   LEFT JOIN dem d ON d.tile=p.tile AND d.r=least(r0+1,49) AND d.c=c0 LEFT JOIN dem e ON e.tile=p.tile AND e.r=d.r AND e.c=b.c""", _PTS))
def bilinear_points(spark, sf):
    return rounded_cols(S.bilinear_gather(event_points(spark, sf), B.dem(spark, sf), "z", H, W, block=32
                                          ).select("event_id", "z"))


_W16 = _cubic_sql("fx", "(-0.5e0)"), _cubic_sql("fy", "(-0.5e0)")


@query("cubic_points", sql("obs dem", f"""SELECT q.event_id, {rs('s.z')} AS z, n.z IS NOT NULL AS near, {rs('n.z')} AS nearest FROM pts q
   LEFT JOIN (SELECT p.event_id, sum(d.z*t.wx*u.wy) AS z FROM
     (SELECT *, greatest(least(y,49e0),0e0) AS yy, greatest(least(x,99e0),0e0) AS xx FROM pts WHERE y>=-0.5 AND y<=49.5 AND x>=-0.5 AND x<=99.5) p,
     LATERAL (SELECT xx-floor(xx) AS fx, yy-floor(yy) AS fy) f,
     LATERAL (SELECT -1 AS dx, {_W16[0][0]} AS wx UNION ALL SELECT 0, {_W16[0][1]} UNION ALL SELECT 1, {_W16[0][2]} UNION ALL SELECT 2, {_W16[0][3]}) t,
     LATERAL (SELECT -1 AS dy, {_W16[1][0]} AS wy UNION ALL SELECT 0, {_W16[1][1]} UNION ALL SELECT 1, {_W16[1][2]} UNION ALL SELECT 2, {_W16[1][3]}) u,
     dem d WHERE d.tile=p.tile AND d.r=greatest(least(floor(yy)+dy,49),0) AND d.c=greatest(least(floor(xx)+dx,99),0) GROUP BY 1) s ON s.event_id=q.event_id
   LEFT JOIN dem n ON n.tile=q.tile AND n.r=floor(q.y+0.5) AND n.c=floor(q.x+0.5)""", _PTS))
def cubic_points(spark, sf):
    dem, pts = B.dem(spark, sf), event_points(spark, sf)
    c = S.cubic_gather(pts, dem, "z", H, W, block=32)
    n = S.gather(pts, dem, "z", H, W, "nearest", out="nearest").select("event_id", "nearest")
    return rounded_cols(c.select("event_id", "z").join(n, "event_id").withColumn(
        "near", F.col("nearest").isNotNull()))


SUP = 75_000.0
_GRIDSQL = f"""prod AS (SELECT tile, r, c, CASE WHEN (r+c)%37=0 THEN NULL ELSE floor(z)*0.5e0-100e0 END AS v FROM dem)"""


@query("windowed_sample", sql("dem", f"""SELECT box, p.tile, i AS "row", j AS col, {rs('(a.v*(1-fx)+b.v*fx)*(1-fy)+(d.v*(1-fx)+e.v*fx)*fy')} AS v FROM
   (SELECT *, floor(y) AS r0, floor(x) AS c0, y-floor(y) AS fy, x-floor(x) AS fx FROM (
      SELECT box, tile, i, j, (90e0*m-lat*m)/(3.6e0*m)-0.5e0 AS y, ((lon+180e0)*m)/(3.6e0*m)-0.5e0 AS x FROM (
       SELECT box, tile, i, j, w+(j+0.5e0)*(e-w)/nx AS lon, n-(i+0.5e0)*(n-s)/ny AS lat, radians(1e0)*6051800e0 AS m FROM win,
         LATERAL generate_series(0,CAST(ny AS BIGINT)-1) a(i), LATERAL generate_series(0,CAST(nx AS BIGINT)-1) b(j)))) p
   LEFT JOIN prod a ON a.tile=p.tile AND a.r=r0 AND a.c=c0 AND x>=0 AND x<=99 AND y>=0 AND y<=49 LEFT JOIN prod b ON b.tile=p.tile AND b.r=r0 AND b.c=least(c0+1,99)
   LEFT JOIN prod d ON d.tile=p.tile AND d.r=least(r0+1,49) AND d.c=c0 LEFT JOIN prod e ON e.tile=p.tile AND e.r=d.r AND e.c=b.c""",
   _GRIDSQL,
   """win AS (SELECT *, greatest(round_even((e-w)*radians(1e0)*6051800e0/75000e0,0),1) AS nx, greatest(round_even((n-s)*radians(1e0)*6051800e0/75000e0,0),1) AS ny
      FROM (SELECT s_suppkey AS box, s_suppkey%(SELECT max(tile)+1 FROM dem) AS tile, w, w+3e0 AS e, s, s+2e0 AS n FROM (SELECT s_suppkey, (s_suppkey*17.3e0)%350e0-178e0 AS w, (s_suppkey*7.9e0)%150e0-78e0 AS s FROM supplier)))"""))
def windowed_sample(spark, sf):
    """Windows of a stored product of many tiles: nodata, scale and offset, extent and pruning in one read."""
    dem = B.dem(spark, sf)
    s = attach(B.table(spark, sf, "supplier"), dem.agg((F.max("tile") + 1).alias("tiles")))
    west = F.pmod(F.col("s_suppkey") * 17.3, F.lit(350.0)) - 178.0
    south = F.pmod(F.col("s_suppkey") * 7.9, F.lit(150.0)) - 78.0
    windows = s.select(F.col("s_suppkey").alias("box"), (F.col("s_suppkey") % F.col("tiles")).alias("tile"), west.alias("west"),
                       south.alias("south"), (west + 3.0).alias("east"), (south + 2.0).alias("north"))
    raw = F.when((F.col("row") + F.col("col")) % 37 == 0, F.lit(-32768.0)).otherwise(F.floor("z").cast("double"))
    m = math.radians(1.0) * 6_051_800.0
    grid = ProductGrid(H, W, -180.0 * m, 90.0 * m, 3.6 * m, -32768.0, 0.5, -100.0)
    got = sample_windows(windows, SUP, dem.select("tile", "row", "col", raw.alias("v")), "v", grid, keys=("tile",))
    return rounded_cols(got.select("box", "tile", "row", "col", "v"))


@query("windowed_average", sql("dem", f"""SELECT box, p.tile, i AS "row", j AS col, {rs('sum(part*v)/sum(part)')} AS v FROM (
   SELECT p.*, d.v, (least(y+dy,d.r+1e0)-greatest(y-dy,d.r))*(least(x+dx,d.c+1e0)-greatest(x-dx,d.c)) AS part FROM (
     SELECT box, tile, i, j, (90e0-n+(i+0.5e0)*20e0/4e0)/3.6e0 AS y, (w+(j+0.5e0)*30e0/5e0+180e0)/3.6e0 AS x, 20e0/4e0/7.2e0 AS dy, 30e0/5e0/7.2e0 AS dx
     FROM win, generate_series(0,3) a(i), generate_series(0,4) b(j)) p
   LEFT JOIN prod d ON d.tile=p.tile AND d.v IS NOT NULL AND d.r+1>y-dy AND d.r<y+dy AND d.c+1>x-dx AND d.c<x+dx) p GROUP BY 1,2,3,4""",
   _GRIDSQL, """win AS (SELECT s_suppkey AS box, s_suppkey%(SELECT max(tile)+1 FROM dem) AS tile, (s_suppkey*17.3e0)%320e0-178e0 AS w, (s_suppkey*7.9e0)%150e0-65e0 AS n FROM supplier)"""))
def windowed_average(spark, sf):
    """Coarse windows of many tiles: each output pixel the area-weighted mean of the stored pixels under it."""
    dem = B.dem(spark, sf)
    s = attach(B.table(spark, sf, "supplier"), dem.agg((F.max("tile") + 1).alias("tiles")))
    west = F.pmod(F.col("s_suppkey") * 17.3, F.lit(320.0)) - 178.0
    north = F.pmod(F.col("s_suppkey") * 7.9, F.lit(150.0)) - 65.0
    windows = s.select(F.col("s_suppkey").alias("box"), (F.col("s_suppkey") % F.col("tiles")).alias("tile"), west.alias("west"),
                       (north - 20.0).alias("south"), (west + 30.0).alias("east"), north.alias("north"))
    raw = F.when((F.col("row") + F.col("col")) % 37 == 0, F.lit(-32768.0)).otherwise(F.floor("z").cast("double"))
    m = math.radians(1.0) * 6_051_800.0
    grid = ProductGrid(H, W, -180.0 * m, 90.0 * m, 3.6 * m, -32768.0, 0.5, -100.0)
    got = sample_windows(windows, 600_000.0, dem.select("tile", "row", "col", raw.alias("v")), "v", grid, "average", keys=("tile",))
    return rounded_cols(got.select("box", "tile", "row", "col", "v"))


@query("seam_window", sql("dem", """SELECT tile, r-5 AS "row", ((c-90)%100+100)%100 AS col, floor(z*1e4+0.4371e0)/1e4 AS z FROM dem
  WHERE r BETWEEN 5 AND 34 AND (c>=90 OR c<20)"""))
def seam_window(spark, sf):
    return rounded_cols(joins.read_window(B.dem(spark, sf), 5, 90, 30, W), 4)


# --- polar caps -----------------------------------------------------------------------------------------------------
CAP = G.Cap(24, 150_000.0)
_CAPCELLS = f"""cells AS (SELECT t.tile, i, j, 90e0-2e0*degrees(atan(sqrt(x*x+y*y)/(2e0*6051800e0))) AS lat,
    ((degrees(atan2(x,-y))%360e0)+360e0)%360e0 AS lon FROM (SELECT DISTINCT tile FROM dem) t,
    (SELECT i, j, (i-11.5e0)*150000e0 AS y, (j-11.5e0)*150000e0 AS x FROM generate_series(0,23) a(i), generate_series(0,23) b(j)))"""
_CAPSQL = """cap AS (SELECT p.tile, p.i, p.j, p.lon, p.lat, (a.z*(1-fx)+b.z*fx)*(1-fy)+(d.z*(1-fx)+e.z*fx)*fy AS z FROM
   (SELECT *, floor(y) AS r0, ((floor(x)%100)+100)%100 AS c0, y-floor(y) AS fy, x-floor(x) AS fx FROM (
     SELECT *, greatest(least((90e0-lat)/3.6e0-0.5e0,49e0),0e0) AS y, lon/3.6e0-0.5e0 AS x FROM cells)) p
   LEFT JOIN dem a ON a.tile=p.tile AND a.r=r0 AND a.c=c0 LEFT JOIN dem b ON b.tile=p.tile AND b.r=r0 AND b.c=(c0+1)%100
   LEFT JOIN dem d ON d.tile=p.tile AND d.r=least(r0+1,49) AND d.c=c0 LEFT JOIN dem e ON e.tile=p.tile AND e.r=d.r AND e.c=b.c)"""


def dem_cap(spark, sf):
    return blend.cylindrical_to_polar(B.dem(spark, sf), "z", GRID, CAP)


@query("polar_cap", sql("dem", f"""SELECT tile, i AS "row", j AS col, {rs('lon')} AS lon, {rs('lat')} AS lat, {rs('z')} AS z FROM cap""",
                        _CAPCELLS, _CAPSQL))
def polar_cap(spark, sf):
    return rounded_cols(dem_cap(spark, sf))


@query("merged_cap", sql("dem", f"""SELECT p.tile, p.r AS "row", p.c AS col, {rs('CASE WHEN q IS NULL OR lat<=0 THEN z ELSE q*w+z*(1-w) END')} AS z FROM
   (SELECT p.*, (a.z*(1-fx)+b.z*fx)*(1-fy)+(d.z*(1-fx)+e.z*fx)*fy+500e0 AS q FROM
     (SELECT *, floor(y) AS r0, floor(x) AS c0, y-floor(y) AS fy, x-floor(x) AS fx, 0.5e0*(1-cos(pi()*greatest(least((abs(lat)-75e0)/5e0,1e0),0e0))) AS w FROM (
       SELECT *, -rho*cos(radians(lon))/150000e0+11.5e0 AS y, rho*sin(radians(lon))/150000e0+11.5e0 AS x FROM (
         SELECT *, 2e0*6051800e0*tan(radians(45e0-lat/2e0)) AS rho FROM (SELECT *, {LAT} AS lat, {LON} AS lon FROM dem)))) p
     LEFT JOIN cap a ON a.tile=p.tile AND a.i=r0 AND a.j=c0 AND y>=0 AND y<=23 AND x>=0 AND x<=23
     LEFT JOIN cap b ON b.tile=p.tile AND b.i=r0 AND b.j=least(c0+1,23) LEFT JOIN cap d ON d.tile=p.tile AND d.i=least(r0+1,23) AND d.j=c0
     LEFT JOIN cap e ON e.tile=p.tile AND e.i=least(r0+1,23) AND e.j=least(c0+1,23)) p""", _CAPCELLS, _CAPSQL))
def merged_cap(spark, sf):
    cap = dem_cap(spark, sf).withColumn("z", F.col("z") + 500.0).select("tile", "row", "col", "z")
    return rounded_cols(blend.merge_cap(B.dem(spark, sf), cap, "z", GRID, CAP))
