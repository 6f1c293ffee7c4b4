"""Queries of features, transects, sources, tile stores, augmentation, run status and streams."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geodesy as G
from ..functions.base import attach
from ..operators import augment, features, profile
from ..session import workspace
from ..sources import catalogue, raw_array, raw_dem, tilestore
from ..streaming import monitor, mosaic
from . import bindings as B
from . import products as P
from .bindings import H, W, sql
from .radiometry import draw_sql
from .registry import query, rounded, rounded_cols, rs


# --- named features ----------------------------------------------------------------------------------------------
@query("parsed_features", sql("features", f"""SELECT name, kind, {rs('lon')} AS lon, {rs('lat')} AS lat, {rs('CASE k%4 WHEN 0 THEN diameter_km WHEN 1 THEN diameter_km ELSE 100e0 END')} AS diameter_km
   FROM (SELECT *, CAST(split_part(name,' ',-1) AS BIGINT) AS k FROM features) WHERE k%5<>0"""))
def parsed_features(spark, sf):
    """GeoJSON text built from the features with every spelling, parsed back."""
    f = B.features(spark, sf).withColumn("k", F.element_at(F.split("name", " "), -1).cast("bigint"))
    k = F.col("k") % 4
    size = (F.when(k == 0, F.to_json(F.struct(F.col("diameter_km").alias("diameter"))))
            .when(k == 1, F.to_json(F.struct("diameter_km"))).when(k == 2, F.lit('{"diameter":0}')).otherwise(F.lit("{}")))
    quoted = F.to_json(F.struct(F.col("name").alias("v")))
    named = F.when(k % 2 == 0, F.replace(quoted, F.lit('{"v":'), F.lit('"name":'))).otherwise(
        F.replace(quoted, F.lit('{"v":'), F.lit('"Name":')))
    kind = F.concat(F.when(k < 2, F.lit('"feature_type":"')).otherwise(F.lit('"type":"')), "kind", F.lit('"'))
    props = F.concat(F.rtrim(named, F.lit("}")), F.lit(","), kind,
                     F.when(size == "{}", "}").otherwise(F.concat(F.lit(","), F.substring(size, 2, 1000))))
    named_props = F.when(F.col("k") % 5 == 0, F.lit('{"type":"none"}')).otherwise(F.concat(F.lit("{"), props))
    geometry = F.concat(F.lit('{"coordinates":['), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]}"))
    doc = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":'), named_props,
                   F.lit(',"geometry":'), geometry, F.lit("}]}"))
    return rounded_cols(features.parse_features(f.select(doc.alias("value"))))


_SEARCH = """SELECT q, rank, name FROM (SELECT q, name, CASE WHEN p=1 THEN 0 ELSE p END AS rank, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN p=1 THEN 0 ELSE p END, name) AS k
   FROM (SELECT q, name, instr(strip_accents(lower(name)), strip_accents(lower(q))) AS p FROM features, (VALUES ('RED'),('gear'),('Wídget 1'),('99')) v(q)) WHERE p>0) WHERE k<=12"""


@query("feature_search", sql("features", _SEARCH))
def feature_search(spark, sf):
    f = B.features(spark, sf).select("name")
    out = None
    for q in ("RED", "gear", "Wídget 1", "99"):
        one = features.search(f, q).select(F.lit(q).alias("q"), F.col("rank").cast("bigint").alias("rank"), "name")
        out = one if out is None else out.unionByName(one)
    return out


@query("feature_frames", sql("features", f"""SELECT name, {rs('lo-h')} AS west, {rs('greatest(-89.5e0,lat-h)')} AS south, {rs('lo+h')} AS east, {rs('least(89.5e0,lat+h)')} AS north
   FROM (SELECT name, lat, CASE WHEN lon>180 THEN lon-360 ELSE lon END AS lo, greatest(0.15e0, diameter_km*1000e0*1.8e0/2e0/6051800e0*180e0/pi()) AS h FROM features)"""))
def feature_frames(spark, sf):
    v = G.view_frame("lon", "lat", "diameter_km")
    return B.features(spark, sf).select("name", *[rounded(v[k]).alias(k) for k in ("west", "south", "east", "north")])


# --- transects --------------------------------------------------------------------------------------------------------
_TRACK = """track AS (SELECT user_id AS profile, (epoch_us(ts)-1704067200000000)/1e5 AS distance_m, CASE WHEN event_type<>'error' THEN value*10e0 END AS height_m FROM events),
steps AS (SELECT profile, distance_m, height_m, CASE WHEN distance_m-ld>0 THEN abs(atan((height_m-lh)/(distance_m-ld))) END AS slope FROM
   (SELECT *, lag(distance_m) OVER w AS ld, lag(height_m) OVER w AS lh FROM track WHERE height_m IS NOT NULL WINDOW w AS (PARTITION BY profile ORDER BY distance_m, height_m)))"""


def tracks(spark, sf):
    e = B.table(spark, sf, "events")
    d = (B.epoch_micros("ts") - 1704067200000000) / 1e5
    return e.select(F.col("user_id").alias("profile"), d.alias("distance_m"),
                    F.when(F.col("event_type") != "error", F.col("value") * 10.0).alias("height_m"))


@query("profile_stats", "WITH " + _TRACK + f""" SELECT profile, {rs('min(height_m)')} AS min_m, {rs('max(height_m)')} AS max_m, {rs('max(height_m)-min(height_m)')} AS relief_m,
   {rs('(max(distance_m)-min(distance_m))/1000e0')} AS length_km, {rs('degrees(sum(slope)/greatest(count(slope),1))')} AS mean_slope_deg, {rs('degrees(greatest(max(slope),0e0))')} AS max_slope_deg
   FROM steps GROUP BY 1 HAVING count(*)>=2""")
def profile_stats(spark, sf):
    return rounded_cols(profile.profile_stats(tracks(spark, sf), segment_m=1_000_000.0))


@query("profile_slopes", "WITH " + _TRACK + f" SELECT profile, {rs('distance_m')} AS distance_m, {rs('slope', 9)} AS slope FROM steps WHERE slope IS NOT NULL")
def profile_slopes(spark, sf):
    return rounded_cols(profile.consecutive_slopes(tracks(spark, sf), segment_m=1_000_000.0), slope=9)


# --- sources ----------------------------------------------------------------------------------------------------------------
_FILES = ", ".join(f"({i + 1}, '{p[0]}', '{p[1]}', {p[4]}e0)" for i, p in enumerate(K.PRODUCTS))


@query("product_catalogue", f"""WITH product(ordinal, product, filename, gb) AS (VALUES {_FILES}), seen AS (SELECT l_linenumber, count(*) AS samples, count(*) FILTER (l_quantity=50 AND l_linenumber%2=1) AS local FROM lineitem GROUP BY 1)
   SELECT product, samples, {rs('gb')} AS gb, CASE WHEN local>0 THEN 'raw/' ELSE 'remote/' END || filename AS uri, {rs('sum(gb) OVER ()')} AS total_gb FROM product JOIN seen ON l_linenumber=ordinal""")
def product_catalogue(spark, sf):
    li, cat = B.table(spark, sf, "lineitem"), catalogue.catalogue(spark)
    seen = li.groupBy(F.col("l_linenumber").alias("ordinal")).agg(F.count(F.lit(1)).alias("samples"))
    have = li.where((F.col("l_quantity") == 50) & (F.col("l_linenumber") % 2 == 1)).select(F.col("l_linenumber").alias("ordinal")).distinct()
    listing = cat.join(have, "ordinal", "left_semi").select("filename")
    res = catalogue.resolve(cat, listing, "raw", "remote").join(seen, "ordinal")
    total = catalogue.total_volume(res).select(F.col("gb").alias("total_gb"))
    return rounded_cols(attach(res, total).select("product", "samples", "gb", "uri", "total_gb"))


@query("label_tags", f"""SELECT p_partkey, (p_partkey%500+10)::BIGINT AS height, (p_size*7+3)::BIGINT AS width, {rs('75e0+p_size/4e0')} AS pixel_m,
   {rs('-1000e0*p_partkey')} AS upper_left_x, {rs('p_retailprice*10e0')} AS upper_left_y, {rs('6040000e0+p_size')} AS value_offset FROM part""")
def label_tags(spark, sf):
    """Labels with and without a namespace, their elements in either order, read back into geometry."""
    k, size = F.col("p_partkey"), F.col("p_size")
    pre = F.when(k % 2 == 0, "pds:").otherwise("")

    def tag(name, value, attribute=""):
        return F.concat(F.lit("<"), pre, F.lit(name + attribute + ">\n  "), value.cast("string"), F.lit(" </"), pre, F.lit(name + ">"))

    place = F.concat(tag("upperleft_corner_x", k * -1000.0, ' unit="m"'), tag("upperleft_corner_y", F.col("p_retailprice") * 10.0))
    grain = F.concat(tag("pixel_resolution_x", size / 4.0 + 75.0, ' unit="m/pixel"'), tag("value_offset", size + F.lit(6_040_000.0)))
    axes = F.concat(tag("elements", k % 500 + 10), tag("elements", size * 7 + 3))
    body = F.when(k % 3 == 0, F.concat(place, axes, grain)).otherwise(F.concat(axes, grain, place))
    label = F.concat(F.lit('<Product xmlns:pds="urn:pds"><name>'), k.cast("string"), F.lit("</name>"), body, F.lit("</Product>"))
    out = raw_dem.read_labels(B.table(spark, sf, "part").select("p_partkey", label.alias("value")))
    return rounded_cols(out.select("p_partkey", "height", "width", "pixel_m", "upper_left_x", "upper_left_y", "value_offset"))


@query("payload_checksums", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def payload_checksums(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "text")
    return catalogue.payload_checksums(d, "text").select("doc_id", "sha256")


@query("array_arrival", f"""SELECT s_suppkey, w*h*4 AS expected_bytes, least(coalesce(n,0)*40//(w*4),h) AS available_rows, coalesce(n,0)*40>=w*h*4 AS complete,
   {rs('(uy-least(coalesce(n,0)*40//(w*4),h)*px)/(radians(1e0)*6051800e0)')} AS available_south_deg, {rs('(ux+w*px)/(radians(1e0)*6051800e0)')} AS east
   FROM (SELECT s_suppkey, 50+s_suppkey%50 AS w, 60+s_suppkey%90 AS h, 600e0+s_suppkey AS px, -1e6+s_suppkey*1e4 AS ux, 5e6-s_suppkey*2e4 AS uy FROM supplier)
   LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey=s_suppkey""")
def array_arrival(spark, sf):
    k = F.col("s_suppkey")
    arrived = B.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg((F.count(F.lit(1)) * 40).alias("length"))
    d = B.table(spark, sf, "supplier").select(
        "s_suppkey", (k % 50 + 50).alias("width"), (k % 90 + 60).alias("height"), (k + 600.0).alias("pixel_m"),
        (k * 1e4 - 1e6).alias("upper_left_x"), (F.lit(5e6) - k * 2e4).alias("upper_left_y")).join(arrived, "s_suppkey", "left")
    return rounded_cols(raw_dem.arrival(d).select("s_suppkey", "expected_bytes", "available_rows", "complete", "available_south_deg", "east"))


# --- tile store -------------------------------------------------------------------------------------------------------------
_TILE = """tiles AS (SELECT event_id AS tile, lat AS lat_deg, lon, event_type AS region, CASE WHEN value>250 THEN 1e0 ELSE 0e0 END AS has_right,
   CASE WHEN value>400 THEN 1e0 ELSE 0e0 END AS has_stereo, CASE WHEN value<100 THEN 1e0 ELSE 0e0 END AS has_stereo_dem, value/500e0 AS left_,
   printf('q%02d_%02d', CAST(floor((lat+90)/12) AS INTEGER), CAST(floor(lon/12) AS INTEGER)) AS quad FROM obs)"""


def tile_rows(spark, sf):
    v = F.col("value")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return B.obs(spark, sf).select(
        F.col("event_id").alias("tile"), F.col("lat").alias("lat_deg"), "lon", F.col("event_type").alias("region"),
        one(v > 250).alias("has_right"), one(v > 400).alias("has_stereo"), one(v < 100).alias("has_stereo_dem"),
        (v / 500.0).alias("left"), G.quad_id("lat", "lon").alias("quad"))


@query("split_tiles", sql("obs", f"""SELECT tile, quad, {rs('lat_deg')} AS lat_deg, CASE WHEN quad IN (SELECT quad FROM tiles GROUP BY 1 HAVING count(*)%3=0) THEN 'val' ELSE 'train' END AS part
   FROM tiles WHERE abs(lat_deg)<=60 AND has_stereo_dem>0.5""", _TILE))
def split_tiles(spark, sf):
    t = tile_rows(spark, sf)
    held = tilestore.quad_summary(t).where(F.col("tiles") % 3 == 0)
    out = None
    for part in ("train", "val"):
        one = tilestore.select_tiles(t, held, part, max_lat=60.0, require_stereo=True).withColumn("part", F.lit(part))
        out = one if out is None else out.unionByName(one)
    return rounded_cols(out.select("tile", "quad", "lat_deg", "part"))


@query("quad_summary", sql("obs", "SELECT quad, count(*) AS tiles FROM tiles GROUP BY 1", _TILE))
def quad_summary(spark, sf):
    return tilestore.quad_summary(tile_rows(spark, sf))


@query("region_summary", sql("obs", f"""SELECT region, count(*) AS tiles, {rs('avg(has_right)')} AS has_right, {rs('avg(has_stereo)')} AS has_stereo, {rs('avg(has_stereo_dem)')} AS has_stereo_dem
   FROM tiles GROUP BY ROLLUP(region)""", _TILE))
def region_summary(spark, sf):
    return rounded_cols(tilestore.region_summary(tile_rows(spark, sf)))


@query("coverage_report", sql("obs", f"""SELECT count(*) AS tiles, {rs('avg(left_)')} AS mean_left_look_valid, {rs('avg(has_right)')} AS frac_with_right_look, {rs('avg(has_stereo)')} AS frac_with_stereo_look,
   {rs('avg(has_stereo_dem)')} AS frac_with_stereo_dem, {rs('min(lat_deg)')} AS lat_min, {rs('max(lat_deg)')} AS lat_max FROM tiles""", _TILE))
def coverage_report(spark, sf):
    t = tile_rows(spark, sf)
    return rounded_cols(tilestore.coverage_report(t.drop("left"), t.select("tile", "left")))


@query("core_crops", sql("dem", f"""SELECT tile, r-5 AS "row", c-5 AS col, {rs('z', 4)} AS z, 'core' AS crop FROM dem WHERE r BETWEEN 5 AND 36 AND c BETWEEN 5 AND 36
   UNION ALL SELECT tile, r-r0, c-c0, {rs('z', 4)}, 'random' FROM (SELECT *, CAST(floor({draw_sql(0, '7', 'tile', "'crop'")}*19e0) AS BIGINT) AS r0, CAST(floor({draw_sql(1, '7', 'tile', "'crop'")}*19e0) AS BIGINT) AS c0 FROM dem)
   WHERE r-r0 BETWEEN 0 AND 31 AND c-c0 BETWEEN 0 AND 31"""))
def core_crops(spark, sf):
    d = B.dem(spark, sf)
    a = tilestore.core_crop(d, 5, 32).withColumn("crop", F.lit("core"))
    b = tilestore.random_crop(d, 7, 50, 32).withColumn("crop", F.lit("random"))
    return rounded_cols(a.unionByName(b), 4)


# --- augmentation and features ---------------------------------------------------------------------------------------------------
@query("dihedral_tiles", """SELECT vec_id AS tile, r AS "row", c AS col, floor(v*1e6+0.4371e0)/1e6 AS z, e AS look_east, n AS look_north FROM (
  SELECT vec_id, CASE WHEN fv THEN 7-r2 ELSE r2 END AS r, CASE WHEN fh THEN 7-c2 ELSE c2 END AS c, v, CASE WHEN fh THEN -e2 ELSE e2 END + 0e0 AS e, CASE WHEN fv THEN -n2 ELSE n2 END + 0e0 AS n FROM (
  SELECT vec_id, v, fh, fv, CASE k WHEN 1 THEN 7-c WHEN 2 THEN 7-r WHEN 3 THEN c ELSE r END AS r2, CASE k WHEN 1 THEN r WHEN 2 THEN 7-c WHEN 3 THEN 7-r ELSE c END AS c2,
    CASE k WHEN 1 THEN -0.6e0 WHEN 2 THEN -0.8e0 WHEN 3 THEN 0.6e0 ELSE 0.8e0 END AS e2, CASE k WHEN 1 THEN 0.8e0 WHEN 2 THEN -0.6e0 WHEN 3 THEN -0.8e0 ELSE 0.6e0 END AS n2 FROM (
  SELECT vec_id, (i-1)//8 AS r, (i-1)%8 AS c, CAST(embedding[i] AS DOUBLE)*1000e0 AS v, vec_id%4 AS k, (vec_id//4)%2=1 AS fh, (vec_id//8)%2=1 AS fv FROM embeddings, generate_series(1,64) g(i))))""")
def dihedral_tiles(spark, sf):
    t = F.col("tile")
    look = F.struct(F.lit(0.8).alias("east"), F.lit(0.6).alias("north"))
    d = augment.dihedral(B.patch(spark, sf).withColumn("look", look), t % 4, F.floor(t / 4) % 2 == 1,
                         F.floor(t / 8) % 2 == 1, 8, 8, ("look",))
    return d.select("tile", "row", "col", rounded("z").alias("z"), (F.col("look.east") + 0.0).alias("look_east"),
                    (F.col("look.north") + 0.0).alias("look_north"))


_DROP = f"""dropped AS (SELECT tile, r, c, dn_left, {draw_sql(0, '3', 'tile', "'right'")}<0.4 AS gr, {draw_sql(0, '3', 'tile', "'stereo'")}<0.4 AS gs,
   {draw_sql(0, '3', 'tile', "'gain left'")}*6e0-3e0 AS gl, {draw_sql(0, '3', 'tile', "'gain right'")}*6e0-3e0 AS gn, dn_right, dn_stereo FROM scene)"""


def decoded_scene(spark, sf):
    d = augment.decode_looks(B.scene(spark, sf), gain_db=3.0, seed=3)
    return augment.look_dropout(d, 3)


@query("look_dropout", sql("scene", f"""SELECT tile, r AS "row", c AS col, {rs('CASE WHEN dn_left<>0 THEN (dn_left-1e0)/5e0-20e0+gl END')} AS rv_left,
   {rs('CASE WHEN dn_right<>0 AND NOT gr THEN (dn_right-1e0)/5e0-20e0+gn END')} AS rv_right, dn_right<>0 AND NOT gr AS valid_right, dn_stereo<>0 AND NOT gs AS valid_stereo FROM dropped""", _DROP))
def look_dropout(spark, sf):
    return rounded_cols(decoded_scene(spark, sf).select("tile", "row", "col", "rv_left", "rv_right", "valid_right", "valid_stereo"))


def feature_inputs(spark, sf):
    d = augment.decode_looks(B.scene(spark, sf)).withColumns({
        "gtdr_up": F.col("z"), "emissivity": F.col("sigma") / 150.0, "lat_deg": (F.col("tile") * 7 % 60).cast("double")})
    return d.withColumns({**{f"theta_{n}": F.radians(G.incidence_deg("lat_deg", n)) for n in augment.LOOKS},
                          "look_left": G.look_vector(F.lit("left"))})


_T = {n: f"radians(greatest(least({p}e0-{c}e0*power((tile*7%60)-{a}e0,2),{p}e0),{m}e0))" for n, (a, p, c, m) in K.INCIDENCE.items()}


def _channel_sql(look):
    db = f"CASE WHEN dn_{look}<>0 THEN ((dn_{look}-1e0)/5e0-20e0)/5e0 ELSE 0e0 END"
    return ", ".join([f"{rs(db)} AS sar_{look}_db", f"CASE WHEN dn_{look}<>0 THEN 1e0 ELSE 0e0 END AS mask_{look}",
                      f"{rs(f'sin({_T[look]})')} AS theta_{look}_sin", f"{rs(f'cos({_T[look]})')} AS theta_{look}_cos"])


@query("input_channels", sql("scene", f"""SELECT tile, r AS "row", c AS col, {', '.join(_channel_sql(n) for n in augment.LOOKS)},
   {rs('coalesce(zv-avg(zv) OVER (PARTITION BY tile),0e0)/1000e0')} AS gtdr_up, {rs('(sigma/150e0-0.85e0)/0.05e0')} AS emissivity, 1e0 AS look_east, 0e0 AS look_north,
   {rs('sin(radians(tile*7%60))')} AS lat_sin, {rs('cos(radians(tile*7%60))')} AS lat_cos, 0e0 AS dropped_right FROM (SELECT *, CASE WHEN (r+c)%13<>0 THEN z END AS zv FROM scene)"""))
def input_channels(spark, sf):
    """All 18 channels, with gaps in the altimetry, and the right look after it is dropped."""
    seen = feature_inputs(spark, sf).withColumn("gtdr_up", F.when((F.col("row") + F.col("col")) % 13 != 0, F.col("gtdr_up")))
    ch = augment.assemble_channels(seen)
    one_look = augment.drop_second_looks(ch.select("*", *[F.col(f"{x}_{n}{y}").alias(f"kept_{x}_{n}") for n in ("right", "stereo") for x, y in (("sar", "_db"), ("mask", ""))]))
    ch = one_look.withColumn("dropped_right", F.col("sar_right_db")).withColumns(
        {f"{x}_{n}{y}": F.col(f"kept_{x}_{n}") for n in ("right", "stereo") for x, y in (("sar", "_db"), ("mask", ""))})
    return rounded_cols(ch.drop(*[f"kept_{x}_{n}" for n in ("right", "stereo") for x in ("sar", "mask")]))


@query("conditioning", sql("scene", f"""SELECT tile, {rs(f"sin({_T['left']})")} AS theta_left_sin, {rs(f"cos({_T['left']})")} AS theta_left_cos, {rs(f"sin({_T['right']})")} AS theta_right_sin,
   {rs(f"cos({_T['right']})")} AS theta_right_cos, {rs(f"sin({_T['stereo']})")} AS theta_stereo_sin, {rs(f"cos({_T['stereo']})")} AS theta_stereo_cos, 1e0 AS look_east, 0e0 AS look_north,
   max(CASE WHEN dn_right<>0 THEN 1e0 ELSE 0e0 END) AS has_right, max(CASE WHEN dn_stereo<>0 THEN 1e0 ELSE 0e0 END) AS has_stereo FROM scene GROUP BY tile"""))
def conditioning(spark, sf):
    return rounded_cols(augment.assemble_conditioning(feature_inputs(spark, sf)))


# --- run status and streams --------------------------------------------------------------------------------------------------------
_BEATS = """beats AS (SELECT user_id AS run, event_id AS step, CASE WHEN user_id%3=0 THEN event_id ELSE event_id+1000 END AS steps, value/100e0 AS rate, epoch(ts) AS updated FROM events)"""
NOW = 1706659200.0  # the end of the event table, epoch seconds


def heartbeats(spark, sf):
    e = B.table(spark, sf, "events")
    steps = F.when(F.col("user_id") % 3 == 0, F.col("event_id")).otherwise(F.col("event_id") + 1000)
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), steps.alias("steps"),
                    (F.col("value") / 100.0).alias("seconds_per_step"), (B.epoch_micros("ts") / 1e6).alias("updated"))


@query("run_status", "WITH " + _BEATS + f""" SELECT run, step, steps, state, CASE WHEN state='running' THEN {rs('greatest(rate*(steps-step),0e0)')} END AS eta_s, {rs('step/greatest(steps,1)')} AS share FROM
   (SELECT *, CASE WHEN step/greatest(steps,1)>=0.999 THEN 'done' WHEN {NOW}e0-updated>7200 THEN 'stalled' ELSE 'running' END AS state FROM
   (SELECT *, row_number() OVER (PARTITION BY run ORDER BY updated DESC, step DESC) AS k FROM beats) WHERE k=1)""".replace("7200", "180"))
def run_status(spark, sf):
    s = monitor.status(heartbeats(spark, sf), NOW)
    return rounded_cols(s.select("run", "step", "steps", "state", "eta_s", "share"))


_LOG = """logs AS (SELECT user_id AS run, event_id AS pos, CASE WHEN event_type='signup' THEN 'device=cpu steps=' || (event_id+500)
   WHEN event_type IN ('click','view') THEN 'step ' || event_id || ' loss=0.5 total=1.25 (' || (event_id%90+10) || '.25s/step)'
   WHEN event_type='purchase' AND event_id%97=0 THEN 'final val mae=3' ELSE 'note ' || event_id END AS line FROM events)"""


@query("log_progress", "WITH " + _LOG + f""" SELECT run, CASE WHEN fin THEN total ELSE step END AS step, total AS steps, fin AS finished, {rs('rate')} AS seconds_per_step,
   {rs('CASE WHEN fin THEN 0e0 ELSE rate*(total-step) END')} AS eta_s FROM (SELECT run, arg_max(CAST(nullif(regexp_extract(line,'steps=(\\d+)',1),'') AS BIGINT), pos) FILTER (regexp_matches(line,'steps=\\d+')) AS total,
   arg_max(CAST(nullif(regexp_extract(line,'^step\\s+(\\d+)',1),'') AS BIGINT), pos) FILTER (line LIKE 'step %') AS step, arg_max(CAST(nullif(regexp_extract(line,'\\((\\d+\\.\\d+)s/step',1),'') AS DOUBLE), pos) FILTER (line LIKE 'step %') AS rate,
   bool_or(line LIKE 'final val%') AS fin FROM logs GROUP BY 1) WHERE step IS NOT NULL AND total>0""")
def log_progress(spark, sf):
    e, i = B.table(spark, sf, "events"), F.col("event_id")
    line = (F.when(F.col("event_type") == "signup", F.concat(F.lit("device=cpu steps="), (i + 500).cast("string")))
            .when(F.col("event_type").isin("click", "view"), F.concat(F.lit("step "), i.cast("string"), F.lit(" loss=0.5 total=1.25 ("),
                                                                     (i % 90 + 10).cast("string"), F.lit(".25s/step)")))
            .when((F.col("event_type") == "purchase") & (i % 97 == 0), F.lit("final val mae=3"))
            .otherwise(F.concat(F.lit("note "), i.cast("string"))))
    p = monitor.progress_from_logs(e.select(F.col("user_id").alias("run"), i.alias("pos"), line.alias("line")))
    return rounded_cols(p.select("run", "step", "steps", "finished", "seconds_per_step", "eta_s"))


@query("streamed_mosaic", sql("dem", f"""SELECT r AS grow, c AS gcol, {rs('sum(w*z)/sum(w)')} AS z FROM placed GROUP BY 1,2""", *P._TILED))
def streamed_mosaic(spark, sf):
    """Height tiles streamed from the table, each twice, blended once into a common mosaic."""
    name = "orders.parquet"
    rows = (spark.readStream.schema(B.table(spark, sf, "orders").schema).option("pathGlobFilter", name).parquet(sf))
    k = F.col("o_orderkey")
    px = rows.select(F.floor(k / (H * W)).cast("bigint").alias("tile"), F.floor(F.pmod(k, F.lit(H * W)) / W).cast("int").alias("grow"),
                     F.pmod(k, F.lit(W)).cast("int").alias("gcol"), (F.col("o_totalprice") / 100.0).alias("z"))
    twice = px.withColumn("_again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_again")
    from ..operators.blend import assign_tiles
    t = assign_tiles(twice, H, W, P.TILE, P.OVER)
    t = t.withColumn("z", F.col("z") + (F.col("orow") % 7) * 3.0 - (F.col("ocol") % 5) * 2.0)
    log, state = workspace(spark, "mosaic-log"), workspace(spark, "mosaic-state")
    mosaic.blend_stream(t, ["z"], log, state, (P.TILE, P.TILE), ("tile", "orow", "ocol")).awaitTermination()
    return rounded_cols(mosaic.read_mosaic(spark, log, ["z"]))


@query("streamed_band", "SELECT o_orderkey//5000 AS dem, max((o_orderkey%5000)//100)+1 AS available_rows FROM orders GROUP BY 1")
def streamed_band(spark, sf):
    """Rows that have arrived of each height array, tracked over a stream of row blocks."""
    rows = spark.readStream.schema(B.table(spark, sf, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    k = F.col("o_orderkey")
    blocks = rows.select(F.floor(k / (H * W)).cast("bigint").alias("dem"), F.floor(F.pmod(k, F.lit(H * W)) / W).cast("bigint").alias("row"))
    log, state = workspace(spark, "band-log"), workspace(spark, "band-state")
    mosaic.log_band(blocks, log, state).awaitTermination()
    return mosaic.arrived_band(spark.read.schema(blocks.schema).parquet(log))


# --- raw arrays read by byte ranges -----------------------------------------------------------------------------------
_VALUE_OFFSET = K.RADIUS_M - 512.25
_GAPPED = "dem_ AS (SELECT tile AS dem, r AS \"row\", c AS col, CASE WHEN (r*3+c)%41<>0 THEN CAST(CAST(z AS FLOAT) AS DOUBLE)-512.25e0 END AS z FROM dem)"


def _arrays(spark, sf, rows, folder):
    """Each height tile as a raw file with gaps, of the rows that `rows` keeps; the tiles' number is what is listed."""
    px = B.dem(spark, sf).withColumn("z", F.when((F.col("row") * 3 + F.col("col")) % 41 != 0, F.col("z")))
    raw_array.write_arrays(px.where(rows), "z", folder, W, "tile").write.format("noop").mode("overwrite").save()
    names = [str(r["tile"]) for r in px.select("tile").distinct().collect()]  # one label per array, as a catalogue has
    return [raw_array.RawArray(n, f"{folder}/{n}.img", H, W) for n in names]


@query("raw_array_scan", sql("dem", f"""SELECT dem, "row", col, {rs('z', 4)} AS z FROM dem_ WHERE "row" BETWEEN 5 AND 39""", _GAPPED))
def raw_array_scan(spark, sf):
    """Rows 5 to 39 of every height tile, written as raw float arrays and read by byte ranges."""
    arrays = _arrays(spark, sf, F.col("row") >= 0, workspace(spark, "arrays"))
    z = raw_array.heights(raw_array.scan(spark, arrays, 8, 5, 40), _VALUE_OFFSET)
    return rounded_cols(z.withColumn("dem", F.col("dem").cast("bigint")), 4)


@query("growing_arrays", sql("dem", f"""SELECT dem, "row", col, CAST(1 AS BIGINT) AS deliveries, {rs('z', 4)} AS z FROM dem_""", _GAPPED))
def growing_arrays(spark, sf):
    """Arrays that grow under a stream: a northern band in the first run, the rest in the second, each pixel once."""
    folder, log, state = (workspace(spark, n) for n in ("arrays", "array-log", "array-state"))
    for rows in (F.col("row") < 10 + F.pmod(F.col("tile"), F.lit(3)) * 7, F.col("row") >= 0):
        rows_now = raw_array.heights(raw_array.scan_stream(spark, _arrays(spark, sf, rows, folder), 16), _VALUE_OFFSET)
        mosaic.log_band(rows_now, log, state).awaitTermination()
    seen = spark.read.schema(rows_now.schema).parquet(log).groupBy(F.col("dem").cast("bigint").alias("dem"), "row", "col")
    return rounded_cols(seen.agg(F.count(F.lit(1)).alias("deliveries"), F.max("z").alias("z")), 4)


# --- stalled runs in a stream -----------------------------------------------------------------------------------------
_RUNS = "runs AS (SELECT user_id, user_id%5 AS k, CAST(user_id AS VARCHAR) AS run, count(*) AS n FROM events GROUP BY 1)"


@query("run_stream", "WITH " + _RUNS + f""" SELECT run, step, 2*n AS steps, state, {rs('CASE state WHEN $$running$$ THEN 1.5e0*(2*n-step) WHEN $$done$$ THEN 0e0 END')} AS eta_s, count(*) AS reports FROM (
     SELECT run, n, CASE k WHEN 0 THEN 2*n ELSE n END AS step, CASE k WHEN 0 THEN 'done' ELSE 'running' END AS state FROM runs
     UNION ALL SELECT run, n, n, 'stalled' FROM runs WHERE k>=3 AND n<2*n
     UNION ALL SELECT run, n, n+1, CASE WHEN n+1>=2*n THEN 'done' ELSE 'running' END FROM runs WHERE k IN (1,2)
     UNION ALL SELECT run, n, n+1, 'running' FROM runs WHERE k=1 AND n+1<2*n
     UNION ALL SELECT run, n, 2*n, 'done' FROM runs WHERE k=2 AND n+1<2*n
     UNION ALL SELECT run, n, n, 'running' FROM runs WHERE k=3) GROUP BY ALL""")
def run_stream(spark, sf):
    """State changes of every run over three deliveries: silent runs stall, late beats change nothing, stalled ones resume."""
    runs = B.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    k, n = F.col("user_id") % 5, F.col("n")
    deliveries = [(F.lit(True), F.when(k == 0, 2 * n).otherwise(n), 10.0),
                  (k.isin(1, 2), n + 1, 20.0),
                  (k != 4, F.when(k == 2, 2 * n).when(k == 3, n).otherwise(n - 1), F.when(k.isin(0, 1), 5.0).otherwise(30.0))]
    src, log, state = (workspace(spark, name) for name in ("beats", "beat-log", "beat-state"))
    for chosen, step, updated in deliveries:
        beats = runs.where(chosen).select(F.col("user_id").cast("string").alias("run"), step.cast("bigint").alias("step"), (2 * n).alias("steps"),
                                          F.lit(1.5).alias("seconds_per_step"), (F.lit(updated) if isinstance(updated, float) else updated).alias("updated"))
        beats.write.mode("append").parquet(src)
        changes = monitor.status_stream(spark.readStream.schema(beats.schema).parquet(src), stale_s=1.0, mode="append")
        mosaic.log_band(changes, log, state).awaitTermination()
        time.sleep(1.1)  # longer than stale_s: whoever sends nothing in the next delivery has stalled
    out = spark.read.schema(changes.schema).parquet(log)
    return rounded_cols(out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("reports")))
