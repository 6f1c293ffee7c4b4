"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geodesy as G
from ..functions import radiometry as R
from ..functions.base import mean_or_zero, mean_where
from . import bindings as B
from .bindings import flattened_sql, sql, theta_sql
from .registry import query, rounded, rounded_cols, rs


@query("decode_dn", sql("sar", f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, tile,
  CAST(dn AS BIGINT) AS dn, CASE WHEN dn<>0 THEN {rs('(dn-1e0)/5e0-20e0')} END AS rv,
  CASE WHEN dn<>0 THEN CAST(greatest(least(round_even(5e0*(greatest(least((dn-1e0)/5e0-20e0,30e0),-20e0)+20e0)+1e0,0),255e0),1e0) AS BIGINT) END AS dn_again
  FROM sar"""))
def decode_dn(spark, sf):
    d = B.sar(spark, sf).withColumn("rv", R.rv_from_dn("dn"))
    return d.select("l_orderkey", "l_linenumber", "tile", F.col("dn").cast("bigint").alias("dn"),
                    rounded("rv").alias("rv"), R.dn_from_rv("rv").cast("bigint").alias("dn_again"))


@query("scatter_law", sql("sar", f"""SELECT tile, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {rs(theta_sql('theta'), 9)} AS sigma0,
  {rs('10e0*log10(' + theta_sql('theta') + ')')} AS law_db,
  {rs('theta-alpha')} AS local_incidence, {rs(flattened_sql('theta-alpha', 'theta'))} AS rv_model,
  CASE WHEN dn<>0 THEN {rs('(dn-1e0)/5e0-20e0-10e0*log10(' + theta_sql('theta') + ')')} END AS flattened FROM sar"""))
def scatter_law(spark, sf):
    d = B.sar(spark, sf)
    return d.select("tile", "l_orderkey", "l_linenumber", rounded(R.scatter_law("theta"), 9).alias("sigma0"),
                    rounded(R.scatter_law_db("theta")).alias("law_db"),
                    rounded(R.local_incidence("alpha", "theta")).alias("local_incidence"),
                    rounded(R.flattened_db(R.local_incidence("alpha", "theta"), "theta")).alias("rv_model"),
                    rounded(R.flatten_sigma0(R.rv_from_dn("dn"), "theta")).alias("flattened"))


@query("altimetry_nodata", sql("obs", f"""SELECT event_type,
  count(*) AS posts, count(CASE WHEN raw<>-32768 THEN 1 END) AS valid,
  {rs('avg(CASE WHEN raw<>-32768 THEN raw END)')} AS mean_m,
  {rs('avg(CASE WHEN raw2<>-1 THEN raw2*0.0001e0+0.5e0 END)')} AS emissivity
  FROM (SELECT event_type, CASE WHEN event_id%7=0 THEN -32768 ELSE CAST(floor(value*20e0) AS INTEGER)-4000 END AS raw,
          CASE WHEN event_id%11=0 THEN -1e0 ELSE floor(value*10e0) END AS raw2 FROM obs) GROUP BY 1"""))
def altimetry_nodata(spark, sf):
    raw = F.when(F.col("event_id") % 7 == 0, F.lit(K.ALTIMETRY_NODATA)).otherwise(
        F.floor(F.col("value") * 20.0).cast("int") - 4000)
    raw2 = F.when(F.col("event_id") % 11 == 0, F.lit(-1.0)).otherwise(F.floor(F.col("value") * 10.0).cast("double"))
    d = B.obs(spark, sf).select("event_type", R.altimetry_from_raw(raw).alias("m"),
                                R.scaled(raw2, -1.0, 0.0001, 0.5).alias("e"))
    return d.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("posts"), F.count("m").alias("valid"), rounded(F.avg("m")).alias("mean_m"),
        rounded(F.avg("e")).alias("emissivity"))


@query("render_validity", sql("sar", f"""SELECT tile, count(*) AS n,
  CAST(count(CASE WHEN alpha*20 < theta-radians(5e0) AND alpha*20 > -(pi()/2-radians(5e0)) THEN 1 END) AS BIGINT) AS renderable,
  CAST(count(CASE WHEN theta-alpha*20 > radians(3e0) AND theta-alpha*20 < radians(87e0) THEN 1 END) AS BIGINT) AS usable
  FROM sar GROUP BY 1"""))
def render_validity(spark, sf):
    a = F.col("alpha") * 20
    return B.sar(spark, sf).groupBy("tile").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(R.renderable(a, "theta")).alias("renderable"),
        F.count_if(R.usable_facet(a, "theta")).alias("usable"))


_INC = {n: f"greatest(least({p}e0-{c}e0*power(lat-{a}e0,2),{p}e0),{m}e0)" for n, (a, p, c, m) in K.INCIDENCE.items()}
_LOOK = "CASE WHEN event_type IN ('click','view') THEN 'left' WHEN event_type='error' THEN 'right' ELSE 'stereo' END"


@query("viewing_geometry", sql("obs", f"""SELECT event_id, look, {rs('inc')} AS theta_deg, {rs('radians(inc)', 9)} AS theta_rad,
  {rs("CASE WHEN look='left' THEN -cos(radians(az)) ELSE cos(radians(az)) END", 9)} AS look_east,
  {rs("CASE WHEN look='left' THEN sin(radians(az)) ELSE -sin(radians(az)) END", 9)} AS look_north
  FROM (SELECT event_id, look, az, CASE look WHEN 'left' THEN {_INC['left']} WHEN 'right' THEN {_INC['right']} ELSE {_INC['stereo']} END AS inc
        FROM (SELECT event_id, lat, {_LOOK} AS look, 180e0+value/10e0 AS az FROM obs))"""))
def viewing_geometry(spark, sf):
    look = (F.when(F.col("event_type").isin("click", "view"), "left")
            .when(F.col("event_type") == "error", "right").otherwise("stereo"))
    d = B.obs(spark, sf).withColumn("look", look)
    v = G.look_vector("look", F.col("value") / 10.0 + 180.0)
    t = G.incidence_deg_by_look("lat", "look")
    return d.select("event_id", "look", rounded(t).alias("theta_deg"), rounded(F.radians(t), 9).alias("theta_rad"),
                    rounded(v["east"], 9).alias("look_east"), rounded(v["north"], 9).alias("look_north"))


@query("cylindrical_grid", sql("obs", f"""SELECT event_id,
  printf('q%02d_%02d', CAST(floor((lat+90)/12) AS INTEGER), CAST(floor(lon/12) AS INTEGER)) AS quad,
  {rs('(lon % 360e0)/(360e0/4096e0)-0.5e0')} AS col, {rs('(90e0-lat)/(180e0/2048e0)-0.5e0')} AS "row",
  {rs('radians(360e0/4096e0)*6051800e0*cos(radians(lat))', 4)} AS pixel_m,
  {rs('(((lon+180e0)%360e0)-180e0)*radians(1e0)*6051800e0', 3)} AS x, {rs('lat*radians(1e0)*6051800e0', 3)} AS y,
  {rs('CASE WHEN lon>180 THEN lon-360 ELSE lon END')} AS lon_display,
  {rs('CASE WHEN abs(lat)>70 THEN 0 ELSE cos(radians(lat)) END', 9)} AS weight FROM obs"""))
def cylindrical_grid(spark, sf):
    g = G.CylindricalGrid(4096, 2048)
    return B.obs(spark, sf).select(
        "event_id", G.quad_id("lat", "lon").alias("quad"), rounded(g.col("lon")).alias("col"),
        rounded(g.row("lat")).alias("row"), rounded(g.pixel_size_m("lat"), 4).alias("pixel_m"),
        rounded(G.projected_x("lon"), 3).alias("x"), rounded(G.projected_y("lat"), 3).alias("y"),
        rounded(G.lon_display("lon")).alias("lon_display"), rounded(G.cos_lat_weight("lat", 70.0), 9).alias("weight"))


@query("pixel_centres", sql("dem", f"""SELECT tile, r AS "row", c AS col, {rs('(c+0.5e0)*3.6e0')} AS lon,
  {rs('90e0-(r+0.5e0)*3.6e0')} AS lat, {rs('80e0-160e0*r/49e0')} AS lat_even FROM dem"""))
def pixel_centres(spark, sf):
    g = G.CylindricalGrid(B.W, B.H)
    return B.dem(spark, sf).select(
        "tile", "row", "col", rounded(g.lon("col")).alias("lon"), rounded(g.lat("row")).alias("lat"),
        rounded(G.latitude_of_row("row", B.H, 80.0, -80.0)).alias("lat_even"))


_POLAR = "2e0*6051800e0*tan(radians(45e0-sgn*lat/2e0))"


@query("polar_projection", sql("obs", f"""SELECT event_id, {rs('rho*sin(radians(lon))/20000e0+499.5e0')} AS col,
  {rs('-sgn*rho*cos(radians(lon))/20000e0+499.5e0')} AS "row", {rs('lon')} AS lon_back, {rs('lat')} AS lat_back,
  {rs('2e0/(1e0+sin(radians(abs(lat))))')} AS scale,
  {rs('0.5e0*(1e0-cos(pi()*greatest(least((abs(lat)-60e0)/15e0,1e0),0e0)))')} AS cap_weight
  FROM (SELECT *, {_POLAR} AS rho FROM (SELECT *, CASE WHEN lat>0 THEN 1e0 ELSE -1e0 END AS sgn FROM obs))"""))
def polar_projection(spark, sf):
    d = B.obs(spark, sf)
    out = None
    for half in (1, -1):
        cap = G.Cap(1000, 20000.0, half)
        row, col = G.cap_position("lon", "lat", cap)
        part = d.where(F.col("lat") > 0 if half > 0 else F.col("lat") <= 0).select("event_id", "lat", col.alias("col"), row.alias("row"))
        lon, lat = G.cap_lonlat("row", "col", cap)
        part = part.select("event_id", rounded("col").alias("col"), rounded("row").alias("row"),
                           rounded(lon).alias("lon_back"), rounded(lat).alias("lat_back"), rounded(G.cap_scale("lat")).alias("scale"),
                           rounded(G.cap_weight("lat", 75.0, 60.0)).alias("cap_weight"))
        out = part if out is None else out.unionByName(part)
    return out


@query("cap_grid_size", f"""SELECT c_custkey, {rs('px', 3)} AS pixel_m, n + n%2 AS size FROM
  (SELECT c_custkey, px, CAST(ceil(2e0*(2e0*6051800e0*tan(radians(45e0-lat/2e0)))/px) AS BIGINT) AS n
   FROM (SELECT c_custkey, 75e0+c_custkey%500 AS px, 70e0+c_nationkey/2e0 AS lat FROM customer))""")
def cap_grid_size(spark, sf):
    c = B.table(spark, sf, "customer")
    px, lat = F.lit(75.0) + F.col("c_custkey") % 500, F.lit(70.0) + F.col("c_nationkey") / 2.0
    return c.select("c_custkey", rounded(px, 3).alias("pixel_m"), G.cap_size(px, lat).alias("size"))


@query("ecef_points", sql("obs", f"""SELECT event_id, {rs('(6051800e0+value)*cos(radians(lat))*cos(radians(lon))', 3)} AS x,
  {rs('(6051800e0+value)*cos(radians(lat))*sin(radians(lon))', 3)} AS y, {rs('(6051800e0+value)*sin(radians(lat))', 3)} AS z,
  {rs('value*6371000e0/6051800e0')} AS earth_height FROM obs"""))
def ecef_points(spark, sf):
    p = G.ecef("lon", "lat", "value")
    return B.obs(spark, sf).select("event_id", *[rounded(p[k], 3).alias(k) for k in "xyz"],
                                   rounded(G.earth_scaled("value")).alias("earth_height"))


def _ramp_sql(ch):
    stops = [(m, rgb[ch]) for m, rgb in K.COLOUR_RAMP]
    text = f"CASE WHEN h<={stops[0][0]}e0 THEN {stops[0][1]}e0"
    for (a, u), (b, v) in zip(stops, stops[1:]):
        text += f" WHEN h<={b}e0 THEN {u}e0+(h-({a}e0))*({v}e0-{u}e0)/({b}e0-({a}e0))"
    return f"CAST(floor({text} ELSE {stops[-1][1]}e0 END + 1e-9) AS BIGINT)"


@query("display_ramps", sql("scene", f"""SELECT tile, r AS "row", c AS col, {_ramp_sql(0)} AS red, {_ramp_sql(1)} AS green, {_ramp_sql(2)} AS blue,
  CASE WHEN dn_left<>0 THEN CAST(floor(greatest(least((rv+12e0)/24e0*255e0,255e0),0e0)) AS BIGINT) END AS sar,
  CAST(floor(200e0*greatest(least((sigma-40e0)/300e0,1e0),0e0)) AS BIGINT) AS fog,
  CAST(CASE WHEN dn_right<>0 THEN 110 ELSE 0 END AS BIGINT) AS cover_alpha,
  CAST(floor(255e0*(1e0-n)) AS BIGINT) AS em_red, CAST(floor(120e0+80e0*n) AS BIGINT) AS em_green, CAST(floor(200e0*n) AS BIGINT) AS em_blue
  FROM (SELECT *, z*3e0-4000e0 AS h, (dn_left-1e0)/5e0-20e0 AS rv, greatest(least((0.5e0+sigma/300e0-0.5e0)/0.4e0,1e0),0e0) AS n FROM scene)"""))
def display_ramps(spark, sf):
    # a hair above the truncation edge, so that both engines agree on exact stops
    h = F.col("z") * 3.0 - 4000.0
    d = B.scene(spark, sf).withColumn("h", h)
    tint, em = R.colour_relief("h"), R.emissivity_tint(F.lit(0.5) + F.col("sigma") / 300.0)
    return d.select("tile", "row", "col", *[tint[k].alias(k) for k in ("red", "green", "blue")],
                    R.stretch_sar(R.rv_from_dn("dn_left")).alias("sar"), R.confidence_fog("sigma").alias("fog"),
                    R.coverage_tint(F.col("dn_right") != 0)["alpha"].alias("cover_alpha"),
                    *[em[k].alias(f"em_{k}") for k in ("red", "green", "blue")])


@query("model_head", sql("sar", f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, tile, {rs('zhat')} AS z_hat, {rs('lv')} AS logvar,
  {rs('exp(lv/2e0)')} AS sigma, {rs('exp((lv+2e0*ln(1.044e0))/2e0)')} AS sigma_scaled
  FROM (SELECT *, dn*10e0+tanh(alpha*10e0)*1500e0 AS zhat, -2e0+14e0/(1e0+exp(-(theta-0.5e0)*4e0)) AS lv FROM sar)"""))
def model_head(spark, sf):
    d = B.sar(spark, sf).withColumns({
        "z_hat": G.compose_height(F.col("dn") * 10.0, F.col("alpha") * 10.0),
        "logvar": G.compose_logvar((F.col("theta") - 0.5) * 4.0, -2.0, 12.0)})
    return d.select("l_orderkey", "l_linenumber", "tile", rounded("z_hat").alias("z_hat"), rounded("logvar").alias("logvar"),
                    rounded(G.sigma_of("logvar")).alias("sigma"),
                    rounded(G.sigma_of(G.temperature_scaled("logvar", 1.044))).alias("sigma_scaled"))


@query("penalties", sql("errors", f"""SELECT run, count(*) AS n, {rs('avg(sqrt(err*err+1e-6))')} AS charbonnier,
  {rs('avg(CASE WHEN abs(err)/50e0<=1 THEN 0.5e0*power(err/50e0,2) ELSE abs(err)/50e0-0.5e0 END)')} AS huber,
  {rs('sum(CASE WHEN err>0 THEN err ELSE 0 END)/greatest(count(CASE WHEN err>0 THEN 1 END),1)')} AS positive_mean,
  {rs('coalesce(sum(CASE WHEN sigma<0 THEN err END),0e0)/greatest(count(CASE WHEN sigma<0 THEN 1 END),1)')} AS empty_mean,
  CAST(NULL AS DOUBLE) AS empty_metric FROM errors GROUP BY 1"""))
def penalties(spark, sf):
    e = F.col("err")
    return B.errors(spark, sf).groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg(R.charbonnier(e))).alias("charbonnier"),
        rounded(F.avg(R.huber(e / 50.0))).alias("huber"),
        rounded(mean_or_zero(e, e > 0)).alias("positive_mean"),
        rounded(mean_or_zero(e, F.col("sigma") < 0)).alias("empty_mean"),
        rounded(mean_where(e, F.col("sigma") < 0)).alias("empty_metric"))


# --- reproducible noise -----------------------------------------------------------------------------------
def draw_sql(i: int, *seed: str) -> str:
    """The i-th uniform draw of a seed, as SQL."""
    return f"((CAST('0x'||substr(md5(concat_ws(':',{','.join(seed)})),{1 + 5 * i},5) AS BIGINT)+0.5e0)/1048576e0)"


_DEGRADED = f"""noisy AS (SELECT tile, r, c, (dn_left-1e0)/5e0-20e0 AS rv,
   {' + '.join(f"(-ln({draw_sql(i, 'tile', 'r', 'c', '0')}))" for i in range(6))} AS g,
   {draw_sql(0, 'tile', "'degrade'")}*160e0+40e0 AS wl, {draw_sql(1, 'tile', "'degrade'")}*2e0*pi() AS ph,
   {draw_sql(2, 'tile', "'degrade'")}*2e0-1e0 AS gain, dn_left<>0 AS seen FROM scene)"""


@query("degrade_radar", sql("scene", f"""SELECT tile, r AS "row", c AS col, CASE WHEN seen THEN {rs('sp')} END AS speckled,
  CASE WHEN seen THEN CAST(round_even(5e0*(greatest(least(sp+0.8e0*sin(2e0*pi()*c/wl+ph)+1.5e0*gain,30e0),-20e0)+20e0)+1e0,0) AS BIGINT) END AS dn
  FROM (SELECT *, 10e0*log10(greatest(power(10e0,rv/10e0)*g/6e0,1e-6)) AS sp FROM noisy)""", _DEGRADED))
def degrade_radar(spark, sf):
    d = B.scene(spark, sf).withColumn("rv", R.rv_from_dn("dn_left"))
    seed = (F.col("tile"), F.col("row"), F.col("col"))
    out = R.degrade(d, "rv", "col", (F.col("tile"),), seed)
    return out.select("tile", "row", "col", rounded("speckled").alias("speckled"), R.dn_from_rv("degraded").cast("bigint").alias("dn"))


@query("pyramid_plan", f"""SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_nationkey % 14 AS BIGINT) AS z,
  {rs('radians(180e0/power(2e0,n_nationkey%14))*6051800e0/64e0')} AS m_per_vertex,
  {rs('180e0/power(2e0,n_nationkey%14)/256e0*pi()*6051800e0/180e0')} AS m_per_pixel,
  CAST(power(2e0,2*(n_nationkey%14)+1) AS BIGINT) AS tiles FROM nation""")
def pyramid_levels(spark, sf):
    from ..operators.grids import pyramid_plan
    n = B.table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") % 14).alias("z"))
    return rounded_cols(pyramid_plan(n))
