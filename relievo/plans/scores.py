"""Queries of metrics, objective terms and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import radiometry as R
from ..operators import fits, metrics, objectives, spectrum
from ..operators.quantiles import exact_quantiles
from ..operators.stencil import central_gradient, along_look, sobel
from . import bindings as B
from .bindings import H, PX, W, downsample_sql, sobel_sql, sql
from .registry import query, rounded, rounded_cols, rs
from .terrain import FP, MASKS, RENDERED, STRIDE, blur_sql, blurred_at_sql, rendered_scene, trusted_scene


# --- pointwise scores ------------------------------------------------------------------------------------------
@query("error_scores", sql("errors", f"""SELECT run, {rs('avg(abs(err))')} AS mae, {rs('sqrt(avg(err*err))')} AS rmse,
  {rs('avg(CASE WHEN abs(err)<=sigma THEN 1e0 ELSE 0e0 END)')} AS coverage_1sigma,
  {rs('avg(CASE WHEN abs(err)<=2*sigma THEN 1e0 ELSE 0e0 END)')} AS coverage_2sigma,
  {rs('avg(sigma)')} AS mean_sigma_m, {rs('sqrt(avg(err*err))')} AS rms_error_m FROM errors GROUP BY 1"""))
def error_scores(spark, sf):
    e = B.errors(spark, sf)
    s = e.groupBy("run").agg(metrics.mae("err").alias("mae"), metrics.rmse("err").alias("rmse"))
    return rounded_cols(s.join(metrics.calibration(e, "err", "sigma", keys=("run",)), "run"))


@query("fitted_temperature", sql("errors", f"""SELECT run, count(*) AS n, {rs('quantile_disc(abs(err)/sigma, 0.6827)')} AS temperature
  FROM errors GROUP BY 1"""))
def fitted_temperature(spark, sf):
    return rounded_cols(fits.fit_temperature(B.errors(spark, sf), "err", "sigma", keys=("run",)))


@query("temperature_one_group", sql("errors", f"""SELECT count(*) AS n, {rs('quantile_disc(abs(err)/sigma, 0.6827)')} AS temperature FROM errors"""))
def temperature_one_group(spark, sf):
    return rounded_cols(fits.fit_temperature(B.errors(spark, sf), "err", "sigma"))


_CAL = f"""SELECT run, {rs('t')} AS temperature, stage, {rs('avg(CASE WHEN abs(err)<=f*sigma THEN 1e0 ELSE 0e0 END)')} AS coverage_1sigma,
   {rs('avg(CASE WHEN abs(err)<=2*f*sigma THEN 1e0 ELSE 0e0 END)')} AS coverage_2sigma, {rs('avg(f*sigma)')} AS mean_sigma_m,
   {rs('sqrt(avg(err*err))')} AS rms_error_m
   FROM (SELECT e.run, t, stage, err, sigma, CASE stage WHEN 'after' THEN t ELSE 1e0 END AS f FROM errors e
     JOIN (SELECT run, quantile_disc(abs(err)/sigma, 0.6827) AS t FROM errors WHERE l_orderkey%2=0 GROUP BY 1) q ON q.run=e.run
     CROSS JOIN (VALUES ('before'),('after')) v(stage) WHERE l_orderkey%2=1) GROUP BY run, t, stage"""


@query("calibration_report", sql("errors", _CAL))
def calibration_report(spark, sf):
    return rounded_cols(fits.calibration_report(B.errors(spark, sf), "err", "sigma", F.col("l_orderkey") % 2 == 0, ("run",)))


@query("display_percentiles", sql("errors", f"""SELECT run, count(*) AS n, {rs('quantile_cont(err,0.01)')} AS low, {rs('quantile_cont(err,0.5)')} AS median,
  {rs('quantile_cont(err,0.99)')} AS high FROM errors GROUP BY 1"""))
def display_percentiles(spark, sf):
    return rounded_cols(exact_quantiles(B.errors(spark, sf), ("run",), "err", {"low": 0.01, "median": 0.5, "high": 0.99}))


@query("look_psnr", sql("sar", f"""SELECT tile, {rs('10e0*log10(2500e0/greatest(var_pop(d),1e-9))')} AS psnr,
  {rs('10e0*log10(2500e0/greatest(avg(d*d),1e-9))')} AS psnr_raw FROM
  (SELECT tile, theta*20e0-alpha*50e0-((dn-1e0)/5e0-20e0) AS d FROM sar WHERE dn<>0) GROUP BY 1"""))
def look_psnr(spark, sf):
    d = B.sar(spark, sf).withColumn("rv", R.rv_from_dn("dn"))
    r, ok = F.col("theta") * 20.0 - F.col("alpha") * 50.0 - F.col("rv"), F.col("rv").isNotNull()
    return rounded_cols(d.groupBy("tile").agg(metrics.look_psnr(r, ok).alias("psnr"),
                                              metrics.look_psnr(r, ok, fit_offset=False).alias("psnr_raw")))


# --- surface scores -----------------------------------------------------------------------------------------------
@query("truth_scores", sql("scene", f"""SELECT s.tile, {rs('avg(abs(z_hat-z))')} AS mae_vs_truth, {rs('sqrt(avg(power(z_hat-z,2)))')} AS rmse_vs_truth,
  {rs('avg(degrees(abs(atan(sqrt(p.de*p.de+p.dn*p.dn))-atan(sqrt(t.de*t.de+t.dn*t.dn)))))')} AS slope_mae_deg,
  {rs('avg(CASE WHEN abs(z_hat-z)<=sigma THEN 1e0 ELSE 0e0 END)')} AS cov_1sigma
  FROM scene s JOIN p USING (tile,r,c) JOIN t USING (tile,r,c) GROUP BY 1""",
    sobel_sql("p", "scene", "z_hat", str(H), str(W), f"{PX}e0"), sobel_sql("t", "scene", "z", str(H), str(W), f"{PX}e0")))
def truth_scores(spark, sf):
    return rounded_cols(metrics.truth_scores(B.scene(spark, sf), "z_hat", "z", PX, "sigma"))


_M = "masked_scene AS (SELECT tile, r, c, z_hat, z AS dem, CASE WHEN trust THEN 1e0 ELSE 0e0 END AS m, CASE WHEN trust THEN z ELSE 0e0 END AS zt FROM trusted)"
_LOW = [_M, downsample_sql("low", "masked_scene", "z_hat dem m zt", 4, 0.5, H, W)]
_LOWGRAD = [sobel_sql("gp", "low", "z_hat", "12", "25", "40000e0"), sobel_sql("gs", "low", "dem", "12", "25", "40000e0")]


@query("stereo_scores", sql("scene", f"""SELECT l.tile, {rs('avg(CASE WHEN m>0.6 THEN abs(z_hat-dem) END)')} AS stereo_mae_m,
   {rs('sqrt(avg(CASE WHEN m>0.6 THEN power(z_hat-dem,2) END))')} AS stereo_rmse_m,
   {rs('avg(CASE WHEN m>0.6 THEN degrees(abs(atan(sqrt(p.de*p.de+p.dn*p.dn))-atan(sqrt(s.de*s.de+s.dn*s.dn)))) END)')} AS stereo_slope_mae_deg
   FROM low l JOIN gp p USING (tile,r,c) JOIN gs s USING (tile,r,c) GROUP BY 1""".replace("m>0.6", "m>0.9"), *MASKS, *_LOW, *_LOWGRAD))
def stereo_scores(spark, sf):
    return rounded_cols(metrics.stereo_scores(trusted_scene(spark, sf), "z_hat", "z", "trust", PX, H, W, 40_000.0))


_ALT = """posts AS (SELECT tile, r, c, z, (r-2)//5 AS pr, (c-2)//5 AS pc, (r+c)%9<>0 AS valid FROM scene WHERE r%5=2 AND c%5=2)"""


@query("altimetry_residual", sql("scene", f"""SELECT tile, {rs('avg(CASE WHEN valid AND pr BETWEEN 1 AND 8 AND pc BETWEEN 1 AND 18 THEN abs(seen-z) END)', 4)} AS alt_resid_m,
   {rs('avg(CASE WHEN valid THEN abs(seen-z) END)/30e0', 4)} AS alt FROM {blurred_at_sql('posts', 'z_hat', 'p.tile, p.z, pr, pc, valid')} GROUP BY 1""",
       *blur_sql("scene", "z_hat"), _ALT))
def altimetry_residual(spark, sf):
    s = B.scene(spark, sf).withColumn("valid", (F.col("row") + F.col("col")) % 9 != 0)
    a = metrics.altimetry_residual(s, "z_hat", "z", "valid", FP, PX, H, W, STRIDE, edge_margin_px=7)
    t = objectives.altimetry_term(s, "z_hat", "z", "valid", FP, PX, H, W, STRIDE)
    return rounded_cols(a.join(t, "tile"), 4)


@query("image_scores", sql("scene", f"""SELECT tile, {rs('avg(abs(res-o))')} AS phys_resid_db, {rs('10e0*log10(2500e0/greatest(var_pop(res),1e-9))')} AS cross_look_psnr
  FROM (SELECT *, avg(res) OVER (PARTITION BY tile) AS o FROM resid WHERE usable) GROUP BY 1""", *RENDERED))
def image_scores(spark, sf):
    r = rendered_scene(spark, sf)
    a = metrics.physics_residual(r, "residual", F.col("usable")).select("tile", "phys_resid_db")
    b = r.groupBy("tile").agg(metrics.look_psnr("residual", F.col("usable")).alias("cross_look_psnr"))
    return rounded_cols(a.join(b, "tile"))


@query("power_spectrum", sql("patch", f"""SELECT bin, {rs('wavelength_m')} AS wavelength_m, {rs('power', 3)} AS power FROM (
   SELECT b.bin, 1e0/(b.lo*exp(ln(b.hi/b.lo)*(b.bin+0.5e0)/16e0)) AS wavelength_m, m.power FROM
   (SELECT bin, min(f) AS lo, max(f) AS hi FROM spec, generate_series(0,15) g(bin) GROUP BY 1) b
   LEFT JOIN (SELECT CAST(floor(ln(f/lo)/ln(hi/lo)*16e0+1e-9) AS BIGINT) AS bin, avg(p) AS power
     FROM spec, (SELECT min(f) AS lo, max(f) AS hi FROM spec) GROUP BY 1) m ON m.bin=b.bin)""",
   """win AS (SELECT tile, r, c, (z-avg(z) OVER (PARTITION BY tile))*(0.5e0-0.5e0*cos(2e0*pi()*r/7e0))*(0.5e0-0.5e0*cos(2e0*pi()*c/7e0)) AS v FROM patch)""",
   """spec AS (SELECT sqrt(power((CASE WHEN u<4 THEN u ELSE u-8 END)/(8e0*75e0),2)+power((CASE WHEN w<4 THEN w ELSE w-8 END)/(8e0*75e0),2)) AS f,
      power(re,2)+power(im,2) AS p FROM (SELECT tile, u, w, sum(v*cos(2e0*pi()*(u*r+w*c)/8e0)) AS re, sum(v*sin(2e0*pi()*(u*r+w*c)/8e0)) AS im
      FROM win, generate_series(0,7) a(u), generate_series(0,7) b(w) WHERE u+w>0 GROUP BY 1,2,3))"""))
def power_spectrum(spark, sf):
    p = spectrum.tile_power(B.patch(spark, sf), "z", 8, 75.0)
    d = spectrum.radial_spectrum(p, 16)
    return d.select("bin", rounded("wavelength_m").alias("wavelength_m"), rounded("power", 3).alias("power"))


@query("supervision_diagnostics", sql("scene", f"""SELECT tile, {rs('corr(z_hat,z)')} AS correlation, {rs('regr_slope(z,z_hat)')} AS slope,
  {rs('regr_intercept(z,z_hat)', 4)} AS intercept, CAST(regr_count(z,z_hat) AS BIGINT) AS n FROM scene GROUP BY 1"""))
def supervision_diagnostics(spark, sf):
    return rounded_cols(metrics.diagnostics(B.scene(spark, sf), "z_hat", "z", ("tile",)), intercept=4)


@query("half_split", sql("errors", f"""SELECT run, CAST(CASE WHEN sigma<=cut THEN 1 ELSE 2 END AS BIGINT) AS half, {rs('avg(abs(err))')} AS mean_value, count(*) AS n
  FROM errors JOIN (SELECT run, quantile_disc(sigma,0.5) AS cut FROM errors GROUP BY 1) USING (run) GROUP BY 1,2"""))
def half_split(spark, sf):
    e = B.errors(spark, sf).withColumn("abs_err", F.abs("err"))
    return rounded_cols(metrics.half_split(e, "sigma", "abs_err", ("run",)))


# --- tables ------------------------------------------------------------------------------------------------------------
_PER = """per AS (SELECT run, l_suppkey, count(*) AS n, avg(abs(err)) AS mae, sqrt(avg(err*err)) AS rmse FROM errors GROUP BY 1,2)"""


@query("metric_table", sql("errors", f"""SELECT run, {rs('mae')} AS mae_vs_truth, {rs('rmse')} AS rmse_vs_truth,
  {rs("1e0-mae/greatest((SELECT avg(mae) FROM per WHERE run='N'),1e-9)")} AS skill FROM (SELECT run, avg(mae) AS mae, avg(rmse) AS rmse FROM per GROUP BY 1)""", _PER))
def metric_table(spark, sf):
    per = B.errors(spark, sf).groupBy("run", "l_suppkey").agg(
        metrics.mae("err").alias("mae_vs_truth"), metrics.rmse("err").alias("rmse_vs_truth"))
    names = ["mae_vs_truth", "rmse_vs_truth"]
    long = per.unpivot(["run", "l_suppkey"], names, "metric", "value")
    return rounded_cols(metrics.skill_table(metrics.metric_table(long, names), "N"))


@query("weighted_table", sql("errors", f"""SELECT run, {rs('sum(mae*n)/sum(n)')} AS mae, {rs('sum(rmse*n)/sum(n)')} AS rmse FROM per GROUP BY 1""", _PER))
def weighted_table(spark, sf):
    per = B.errors(spark, sf).groupBy("run", "l_suppkey").agg(
        metrics.mae("err").alias("mae"), metrics.rmse("err").alias("rmse"), F.count(F.lit(1)).alias("n"))
    return rounded_cols(metrics.weighted_table(per, ["mae", "rmse"], keys=("run",)))


# --- objective terms -----------------------------------------------------------------------------------------------------
@query("earth_objective", sql("scene", f"""SELECT s.tile, {rs('avg(abs(z_hat-z))/30e0+avg(abs(p.de-t.de)+abs(p.dn-t.dn))/0.0175e0')} AS earth,
  {rs('avg(abs(p.de-t.de)+abs(p.dn-t.dn))', 9)} AS gradient_l1
  FROM scene s JOIN p USING (tile,r,c) JOIN t USING (tile,r,c) GROUP BY 1""",
    sobel_sql("p", "scene", "z_hat", str(H), str(W), f"{PX}e0"), sobel_sql("t", "scene", "z", str(H), str(W), f"{PX}e0")))
def earth_objective(spark, sf):
    s = B.scene(spark, sf)
    a = objectives.earth_term(s, "z_hat", "z", PX)
    return rounded_cols(a.join(objectives.gradient_l1(s, "z_hat", "z", PX), "tile"), gradient_l1=9)


_NORM = "norm AS (SELECT tile, r, c, z_hat, zt/greatest(m,1e-8) AS t, m FROM low)"


@query("stereo_objective", sql("scene", f"""SELECT n.tile, {rs('''coalesce(sum(CASE WHEN m>0.5 THEN sqrt(power(z_hat-t,2)+1e-6) END),0e0)/greatest(count(CASE WHEN m>0.5 THEN 1 END),1)/75e0
   + coalesce(sum(CASE WHEN m>0.5 THEN abs(p.de-s.de)+abs(p.dn-s.dn) END),0e0)/greatest(count(CASE WHEN m>0.5 THEN 1 END),1)/0.0175e0''')} AS stereo
   FROM norm n JOIN gp p USING (tile,r,c) JOIN gs s USING (tile,r,c) GROUP BY 1""", *MASKS, *_LOW, _NORM,
   sobel_sql("gp", "norm", "z_hat", "12", "25", "40000e0"), sobel_sql("gs", "norm", "t", "12", "25", "40000e0")))
def stereo_objective(spark, sf):
    return rounded_cols(objectives.stereo_term(trusted_scene(spark, sf), "z_hat", "z", F.col("trust"), PX, H, W, 40_000.0))


_HUBER = "CASE WHEN abs(x)<=1 THEN 0.5e0*x*x ELSE abs(x)-0.5e0 END"


def _physics_sql(column, name):
    return f"""SELECT f.tile, {rs('(h0+coalesce(h1,0e0))/(2e0*2e0)')} AS {name}, {rs('mr')} AS phys_resid_db, {rs('vf')} AS phys_valid_frac FROM
   (SELECT tile, coalesce(sum(CASE WHEN w>0 THEN {_HUBER} END),0e0)/greatest(sum(w),1) AS h0, sum(abs(x)*w)/greatest(sum(w),1) AS mr, avg(w) AS vf FROM flat GROUP BY 1) f
   LEFT JOIN (SELECT tile, coalesce(sum(CASE WHEN w>0.9 THEN {_HUBER} END),0e0)/greatest(count(CASE WHEN w>0.9 THEN 1 END),1) AS h1
     FROM (SELECT tile, w, x/greatest(w,1e-8) AS x FROM lowres) GROUP BY 1) g USING (tile)"""


_FLAT = "flat AS (SELECT tile, r, c, CASE WHEN usable THEN res ELSE 0e0 END AS x, CASE WHEN usable THEN 1e0 ELSE 0e0 END AS w FROM resid)"


@query("physics_objective", sql("scene", _physics_sql("dn_left", "phys"), *RENDERED, _FLAT, downsample_sql("lowres", "flat", "x w", 4, 0.5, H, W)))
def physics_objective(spark, sf):
    from .terrain import located
    d = located(B.scene(spark, sf)).withColumn("rv_left", R.rv_from_dn("dn_left"))
    return rounded_cols(objectives.physics_term(d, "z_hat", "rv_left", F.col("dn_left") != 0, "theta", (1.0, 0.0), PX,
                                                H, W, "brightness"))


_CROSS = [x.replace("atan(sob.de)", "atan(-sob.de)").replace("dn_left", "dn_right").replace("z_hat", "z") for x in RENDERED]


@query("cross_look_objective", sql("scene", _physics_sql("dn_right", "cross_").replace("AS cross_,", "AS \"cross\",").split(", (floor((mr)")[0] + " FROM"
       + _physics_sql("dn_right", "x").split(" FROM", 1)[1], *_CROSS, _FLAT, downsample_sql("lowres", "flat", "x w", 4, 0.5, H, W)))
def cross_look_objective(spark, sf):
    from .terrain import located
    d = located(B.scene(spark, sf)).withColumn("rv_right", R.rv_from_dn("dn_right"))
    return rounded_cols(objectives.cross_look_term(d, "z", "rv_right", F.col("dn_right") != 0, "theta", (-1.0, 0.0), PX,
                                                   H, W, "brightness"))


@query("rms_objective", sql("scene", f"""SELECT p.tile, {rs('coalesce(sum(CASE WHEN ok>0 THEN abs(rs-t) END),0e0)/greatest(count(CASE WHEN ok>0 THEN 1 END),1)/0.0175e0')} AS rms
   FROM (SELECT tile, r//8 AS i, c//8 AS j, atan(sqrt(greatest(avg(de*de+dn*dn),1e-8))) AS rs FROM p WHERE r<48 AND c<96 GROUP BY 1,2,3) p
   JOIN (SELECT tile, i, j, avg(sigma/1000e0) AS t, max(CASE WHEN dn_right<>0 THEN 1 ELSE 0 END) AS ok FROM scene, generate_series(0,5) a(i), generate_series(0,11) b(j)
     WHERE r>=floor(i*50e0/6e0) AND r<ceil((i+1)*50e0/6e0) AND c>=floor(j*100e0/12e0) AND c<ceil((j+1)*100e0/12e0) GROUP BY 1,2,3) q USING (tile,i,j) GROUP BY 1""",
   sobel_sql("p", "scene", "z_hat", str(H), str(W), f"{PX}e0")))
def rms_objective(spark, sf):
    s = B.scene(spark, sf).withColumns({"rough": F.col("sigma") / 1000.0, "ok": F.col("dn_right") != 0})
    return rounded_cols(objectives.rms_term(s, "z_hat", "rough", "ok", PX, H, W, cell_m=80_000.0))


_NLLSRC = """nsrc AS (SELECT tile, r, c, z_hat, CASE WHEN trust THEN 1e0 ELSE 0e0 END AS m, CASE WHEN trust THEN z ELSE 0e0 END AS zt, sigma*sigma AS va FROM trusted)"""


@query("nll_objective", sql("scene", f"""SELECT a.tile, {rs('nll+0.5e0*hinge')} AS nll FROM
   (SELECT tile, coalesce(sum(CASE WHEN m>0.5 THEN 0.5e0*(ln(greatest(va,1e-8))+power(z_hat-zt/greatest(m,1e-8),2)/greatest(va,1e-8)) END),0e0)/greatest(count(CASE WHEN m>0.5 THEN 1 END),1) AS nll
     FROM low GROUP BY 1) a JOIN
   (SELECT tile, coalesce(sum(CASE WHEN un THEN greatest(fl-lv,0e0) END),0e0)/greatest(count(CASE WHEN un THEN 1 END),1) AS hinge FROM
     (SELECT tile, 2e0*ln(sigma) AS lv, NOT (trust OR dn_right<>0 OR dn_stereo<>0) AS un,
        sum(CASE WHEN trust THEN 2e0*ln(sigma) ELSE 0e0 END) OVER (PARTITION BY tile)/greatest(count(CASE WHEN trust THEN 1 END) OVER (PARTITION BY tile),1) AS fl FROM trusted) GROUP BY 1) b USING (tile)""",
   *MASKS, _NLLSRC, downsample_sql("low", "nsrc", "z_hat m zt va", 4, 0.5, H, W)))
def nll_objective(spark, sf):
    from ..operators.masks import unsupervised
    d = trusted_scene(spark, sf).withColumn("logvar", F.log("sigma") * 2.0)
    un = unsupervised("trust", F.col("dn_right") != 0, F.col("dn_stereo") != 0)
    return rounded_cols(objectives.nll_term(d, "z_hat", "logvar", "z", F.col("trust"), un, scale_m=40_000.0, pixel_m=PX,
                                            height=H, width=W))


@query("smoothness_objective", sql("scene", f"""SELECT a.tile, {rs('avg(abs(e.brightness-a.brightness))+avg(abs(s.brightness-a.brightness))+1e-3*avg(abs(s.z_hat+n.z_hat+e.z_hat+w.z_hat-4e0*a.z_hat))')} AS reg
   FROM scene a LEFT JOIN scene w ON w.tile=a.tile AND w.r=a.r AND w.c=a.c-1 LEFT JOIN scene e ON e.tile=a.tile AND e.r=a.r AND e.c=a.c+1
   LEFT JOIN scene n ON n.tile=a.tile AND n.c=a.c AND n.r=a.r-1 LEFT JOIN scene s ON s.tile=a.tile AND s.c=a.c AND s.r=a.r+1 GROUP BY 1"""))
def smoothness_objective(spark, sf):
    s = B.scene(spark, sf)
    return rounded_cols(objectives.smoothness_term(s, "z_hat", s, "brightness"))


@query("total_objective", f"""SELECT l_suppkey AS tile, {rs('''sum(CASE l_linenumber WHEN 1 THEN 1e0 WHEN 2 THEN 1e0 WHEN 3 THEN 2e0 WHEN 4 THEN 0.3e0*0.5e0
   WHEN 5 THEN 0.3e0*0.5e0 WHEN 6 THEN 0.05e0 ELSE 0e0 END*l_discount)''')} AS total FROM lineitem GROUP BY 1""")
def total_objective(spark, sf):
    names = F.array(*[F.lit(n) for n in ("earth", "stereo", "alt", "phys", "cross", "rms", "other")])
    t = B.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("tile"), F.element_at(names, F.col("l_linenumber")).alias("term"),
        F.col("l_discount").alias("value"))
    return rounded_cols(objectives.total(t, ramp=0.5))


_HIST = """hist AS (SELECT *, n+CAST(n//5 AS BIGINT)*3 AS step FROM (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS n, value FROM events))"""


@query("smoothed_history", "WITH " + _HIST + f""" SELECT run, max(step) AS steps, {rs('max(x0)*power(0.98e0,max(m)+1)+0.02e0*sum(value*power(0.98e0,m-n))')} AS smoothed
  FROM (SELECT *, max(n) OVER (PARTITION BY run) AS m, CASE WHEN n=0 THEN value END AS x0 FROM hist) GROUP BY 1""")
def smoothed_history(spark, sf):
    """Every fifth record is followed by a gap in the steps."""
    from pyspark.sql import Window
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.row_number().over(w) - 1
    h = B.table(spark, sf, "events").select(F.col("user_id").alias("run"), (n + F.floor(n / 5) * 3).alias("step"), F.col("value").alias("loss"))
    return rounded_cols(objectives.smoothed_history(h, keys=("run",), block=32))


# --- fits -----------------------------------------------------------------------------------------------------------------------
_LABELS = """labels_ AS (SELECT event_type AS cycle, lat, CASE WHEN event_type='signup' THEN 20e0+0.002e0*lat*lat+value/500e0
   ELSE 45e0-0.004e0*power(lat-10e0,2)+value/50e0 END AS theta FROM obs)"""


@query("incidence_profile", sql("obs", f"""SELECT cycle, n, {rs('CASE WHEN c<0 THEN -b/(2*c) ELSE 0e0 END', 4)} AS lat_peak_deg,
   {rs('CASE WHEN c<0 THEN a-b*b/(4*c) ELSE mt END', 4)} AS theta_peak_deg, {rs('CASE WHEN c<0 THEN -c ELSE 0e0 END', 8)} AS curvature_deg_per_deg2,
   {rs('CASE WHEN c<0 THEN greatest(lo,5e0) ELSE lo END', 4)} AS theta_min_deg FROM (
   SELECT *, (t1-b*s2-c*s3/1e0)/1e0 AS unused, mt-b*m1-c*m2 AS a FROM (
   SELECT *, (cxt*v22-c2t*c12)/(v11*v22-c12*c12) AS b, (c2t*v11-cxt*c12)/(v11*v22-c12*c12) AS c FROM (
   SELECT cycle, count(*) AS n, avg(theta) AS mt, avg(lat) AS m1, avg(lat*lat) AS m2, min(theta) AS lo, 0e0 AS t1, 0e0 AS s2, 0e0 AS s3,
     var_pop(lat) AS v11, var_pop(lat*lat) AS v22, covar_pop(lat,lat*lat) AS c12, covar_pop(lat,theta) AS cxt, covar_pop(lat*lat,theta) AS c2t
   FROM labels_ GROUP BY 1)))""".replace("(t1-b*s2-c*s3/1e0)/1e0 AS unused, ", "").replace(", 0e0 AS t1, 0e0 AS s2, 0e0 AS s3", ""), _LABELS))
def incidence_profile(spark, sf):
    lat = F.col("lat")
    theta = F.when(F.col("event_type") == "signup", F.lit(20.0) + lat * lat * 0.002 + F.col("value") / 500.0).otherwise(
        F.lit(45.0) - (lat - 10.0) * (lat - 10.0) * 0.004 + F.col("value") / 50.0)
    o = B.obs(spark, sf).select(F.col("event_type").alias("cycle"), "lat", theta.alias("theta"))
    return rounded_cols(fits.fit_incidence(o, "lat", "theta"), 4, curvature_deg_per_deg2=8)


_LAW = "10e0*log10(greatest(0.0118e0*cos({t})/power(greatest(sin({t})+0.111e0*cos({t}),1e-9),3),1e-12))"


def _law(t):
    return _LAW.format(t=f"greatest(least({t},pi()/2-1e-3),1e-3)")


_PATCHES = [f"""px AS (SELECT l_suppkey AS tile, atan(({'(l_discount-0.05e0)'})*8e0) AS alpha, l_quantity/5e0-8e0-40e0*l_discount AS rv FROM lineitem)""",
            f"""tried AS (SELECT tile, theta_deg, rv-(({_law('radians(theta_deg)-alpha')})-({_law('radians(theta_deg)')})) AS x FROM px,
    (SELECT 8e0+0.5e0*k AS theta_deg FROM generate_series(0,95) g(k)) WHERE radians(theta_deg)-alpha>radians(3e0) AND radians(theta_deg)-alpha<radians(87e0))""",
            """fitted AS (SELECT tile, theta_deg, b, n, sqrt(greatest(m2-2*b*m1+b*b,0e0)) AS rms FROM
    (SELECT tile, theta_deg, count(*) AS n, quantile_cont(x,0.5) AS b, avg(x) AS m1, avg(x*x) AS m2 FROM tried GROUP BY 1,2) WHERE n>=200)""",
            """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY round(rms,9), theta_deg) AS k FROM fitted) WHERE k=1)"""]


def supplier_patches(spark, sf):
    li = B.table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("tile"), F.atan((F.col("l_discount") - 0.05) * 8.0).alias("alpha"),
                     (F.col("l_quantity") / 5.0 - 8.0 - F.col("l_discount") * 40.0).alias("rv"))


def patch_fits(spark, sf):
    return fits.fit_patches(supplier_patches(spark, sf), "rv", "alpha", F.lit(True))


@query("patch_angles", "WITH " + ", ".join(_PATCHES) + f""" SELECT tile, {rs('theta_deg')} AS theta_deg, {rs('b')} AS brightness_db, {rs('rms')} AS residual_db, n AS n_pixels FROM best""")
def patch_angles(spark, sf):
    return rounded_cols(patch_fits(spark, sf))


_LATS = "b AS (SELECT *, (tile*37)%140-70+0.5e0 AS lat, CASE WHEN tile%2=0 THEN 'even' ELSE 'odd' END AS cycle FROM best)"


def _located_fits(spark, sf):
    f = patch_fits(spark, sf)
    return f.withColumns({"lat": F.pmod(F.col("tile") * 37, F.lit(140)) - 70 + 0.5,
                          "cycle": F.when(F.col("tile") % 2 == 0, "even").otherwise("odd")})


@query("angle_bands", "WITH " + ", ".join([*_PATCHES, _LATS]) + f""" SELECT {rs('band')} AS band_south, n, {rs('th')} AS theta_deg,
   {rs('mr')} AS median_residual_db, {rs('mt')} AS median_theta_deg, {rs('greatest(least(45e0-0.004e0*power(ml-10e0,2),45e0),17e0)')} AS standing_deg FROM
   (SELECT floor((lat+70e0)/20e0)*20e0-70e0 AS band, count(*) AS n, sum(w*theta_deg)/sum(w) AS th, avg(lat) AS ml, median(rms) AS mr, median(theta_deg) AS mt
    FROM (SELECT *, 1e0/power(greatest(rms,0.2e0),2) AS w FROM b WHERE lat>=-70 AND lat<90) GROUP BY 1) WHERE n>=3""")
def angle_bands(spark, sf):
    return rounded_cols(fits.band_table(_located_fits(spark, sf)))


@query("guarded_profile", "WITH " + ", ".join([*_PATCHES, _LATS]) + f""" SELECT cycle, n, {rs('railed')} AS railed,
   CASE WHEN n<12 THEN 'too few patches' WHEN railed>0.30 OR abs(peak)>90 THEN 'degenerate' ELSE 'ok' END AS status,
   {rs("CASE WHEN n>=12 AND railed<=0.30 AND abs(peak)<=90 THEN peak END", 4)} AS lat_peak_deg FROM
   (SELECT cycle, n, railed, CASE WHEN c<0 THEN -bb/(2*c) ELSE 0e0 END AS peak FROM
   (SELECT *, (cxt*v22-c2t*c12)/(v11*v22-c12*c12) AS bb, (c2t*v11-cxt*c12)/(v11*v22-c12*c12) AS c FROM
   (SELECT cycle, count(*) AS n, avg(CASE WHEN theta_deg>=54.99 THEN 1e0 ELSE 0e0 END) AS railed, var_pop(lat) AS v11, var_pop(lat*lat) AS v22,
     covar_pop(lat,lat*lat) AS c12, covar_pop(lat,theta_deg) AS cxt, covar_pop(lat*lat,theta_deg) AS c2t FROM b GROUP BY 1)))""")
def guarded_profile(spark, sf):
    return rounded_cols(fits.guarded_profile(_located_fits(spark, sf)).select(
        "cycle", "n", "railed", "status", "lat_peak_deg"), lat_peak_deg=4)


@query("patch_gate", sql("scene", f"""SELECT tile, n_pixels, {rs('sd')} AS slope_std_deg FROM (SELECT tile, count(CASE WHEN ok THEN 1 END) AS n_pixels, avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END) AS v,
   degrees(stddev_pop(CASE WHEN ok THEN alpha END)) AS sd FROM (SELECT tile, atan((ez-wz)/(ec-wc)/10000e0) AS alpha, dn_left<>0 AS ok FROM (SELECT *,
     coalesce(lag(z) OVER x, z) AS wz, coalesce(lead(z) OVER x, z) AS ez, coalesce(lag(c) OVER x, c) AS wc, coalesce(lead(c) OVER x, c) AS ec FROM scene
     WINDOW x AS (PARTITION BY tile, r ORDER BY c))) GROUP BY 1) WHERE v>=0.5 AND sd>=0.8"""))
def patch_gate(spark, sf):
    g = central_gradient(B.scene(spark, sf), "z", PX).withColumn("alpha", along_look("z_de", "z_dn", 1.0, 0.0))
    return rounded_cols(fits.patch_gate(g, "alpha", F.col("dn_left") != 0))


@query("datum_tie", sql("scene", f"""SELECT tile, r AS "row", c AS col, {rs('stereo-CASE WHEN n>64 THEN med END')} AS stereo FROM
   (SELECT tile, r, c, CASE WHEN dn_right<>0 THEN z_hat*0.982e0-795e0 END AS stereo FROM scene) s LEFT JOIN
   (SELECT tile, count(*) AS n, quantile_cont(z_hat*0.982e0-795e0-z,0.5) AS med FROM scene WHERE dn_right<>0 GROUP BY 1) m USING (tile)"""))
def datum_tie(spark, sf):
    s = B.scene(spark, sf).withColumn("stereo", F.when(F.col("dn_right") != 0, F.col("z_hat") * 0.982 - 795.0))
    return rounded_cols(fits.datum_tie(s.select("tile", "row", "col", "stereo", "z"), "stereo", "z").select(
        "tile", "row", "col", "stereo"))


@query("direction_correlation", sql("scene", f"""SELECT tile, azimuth_deg, {rs("corr(de*sin(radians(azimuth_deg))+dn*cos(radians(azimuth_deg)), rv)")} AS correlation, count(rv) AS n
   FROM (SELECT tile, r, c, de, dn, CASE WHEN dn_left<>0 THEN (dn_left-1e0)/5e0-20e0 END AS rv FROM scene JOIN sob USING (tile, r, c)),
     (SELECT k*22.5e0 AS azimuth_deg FROM generate_series(0,7) g(k)) GROUP BY 1, 2""", sobel_sql("sob", "scene", "z", str(H), str(W), f"{PX}e0")))
def direction_correlation(spark, sf):
    """Does the image brighten along the slope that the assumed look direction implies?"""
    g = sobel(B.scene(spark, sf), "z", PX).withColumn("rv", R.rv_from_dn("dn_left"))
    return rounded_cols(metrics.direction_correlation(g, "z_de", "z_dn", "rv", [22.5 * k for k in range(8)]))


# --- runs side by side ---------------------------------------------------------------------------------------------------------
def _renamed(ctes, tag, z, dn, flip, bright):
    """The rendering CTEs for another surface, look and brightness, under their own names."""
    out = []
    for text in ctes:
        text = text.replace("z_hat", z).replace("dn_left", dn).replace("+brightness", bright)
        text = text.replace("atan(sob.de)", "atan(-sob.de)") if flip else text
        for n in ("sob", "rendered", "resid"):
            text = text.replace(f"{n} AS", f"{tag}_{n} AS").replace(f"{n}_t AS", f"{tag}_{n}_t AS")
        text = text.replace("FROM sob_t", f"FROM {tag}_sob_t").replace("JOIN sob USING", f"JOIN {tag}_sob sob USING")
        text = text.replace("FROM rendered", f"FROM {tag}_rendered")
        out.append(text)
    return out


_RUNS = {"altimetry": ("z", ""), "model": ("z_hat", "+brightness")}
_EVAL_CTES, _EVAL_ROWS = [], []
for _run, (_z, _b) in _RUNS.items():
    _EVAL_CTES += _renamed(RENDERED, f"{_run}_l", _z, "dn_left", False, _b)
    _EVAL_CTES += _renamed(RENDERED, f"{_run}_r", _z, "dn_right", True, _b)
    _EVAL_ROWS.append(f"""SELECT '{_run}' AS run, avg(p) AS p, avg(x) AS x, avg(rel) AS rel, avg(sg) AS sg FROM
      (SELECT tile, avg(abs(res-o)) AS p FROM (SELECT *, avg(res) OVER (PARTITION BY tile) AS o FROM {_run}_l_resid WHERE usable) GROUP BY 1)
      JOIN (SELECT tile, 10e0*log10(2500e0/greatest(var_pop(res),1e-9)) AS x FROM {_run}_r_resid WHERE usable GROUP BY 1) USING (tile)
      JOIN (SELECT tile, stddev_samp({_z}-z) AS rel, avg({'NULL::DOUBLE' if _run == 'altimetry' else 'sigma'}) AS sg FROM scene GROUP BY 1) USING (tile)""")


@query("evaluation_table", sql("scene", f"""SELECT run, {rs('rel')} AS relief_m, {rs('sg')} AS sigma_m, {rs('p')} AS phys_resid_db, {rs('x')} AS cross_look_psnr,
   {rs("(SELECT p FROM runs WHERE run='altimetry')-p")} AS phys_gain_db, {rs("x-(SELECT x FROM runs WHERE run='altimetry')")} AS cross_gain_db FROM runs""",
   *_EVAL_CTES, "runs AS (SELECT * FROM (" + " UNION ALL ".join(_EVAL_ROWS) + "))"))
def evaluation_table(spark, sf):
    from .jobs import evaluate_runs
    from .terrain import located
    s = located(B.scene(spark, sf))
    targets = s.select("tile", "row", "col", F.col("z").alias("gtdr"), F.lit(True).alias("gtdr_valid"),
                       R.rv_from_dn("dn_left").alias("rv_left"), R.rv_from_dn("dn_right").alias("rv_right"),
                       F.col("theta").alias("theta_left"), F.col("theta").alias("theta_right"))
    none = F.lit(None).cast("double")
    runs = s.select(F.lit("altimetry").alias("run"), "tile", "row", "col", "z", none.alias("sigma"), none.alias("brightness")).unionByName(
        s.select(F.lit("model").alias("run"), "tile", "row", "col", F.col("z_hat").alias("z"), "sigma", "brightness"))
    return rounded_cols(evaluate_runs(targets, runs, PX, H, W, "altimetry"))
