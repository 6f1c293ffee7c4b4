"""The test tables read as raster and terrain data, for Spark and as SQL text.

dem      orders as dense 50 x 100 height tiles (one tile per 5000 keys), metres
scene    dem with radar looks, a prediction and its sigma aggregated from lineitem
sar      lineitem as single radar samples with viewing angles
patch    embeddings as 8 x 8 height tiles
obs      events as scattered observations with longitude and latitude
feature  part as named features
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

H, W = 50, 100
PX = 10_000.0  # metres per pixel of dem tiles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_micros(ts: str):
    """Microseconds since 1970 of a timestamp without zone, whatever the session zone is."""
    since = F.col(ts).cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(20,6)") * 1000000).cast("bigint")


def _grid(key):
    k = F.col(key)
    return {"tile": F.floor(k / (H * W)).cast("bigint"),
            "row": F.floor(F.pmod(k, F.lit(H * W)) / W).cast("int"),
            "col": F.pmod(k, F.lit(W)).cast("int")}


def dem(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    g = _grid("o_orderkey")
    return o.select(*[c.alias(n) for n, c in g.items()], (F.col("o_totalprice") / 100.0).alias("z"))


def _look_by_key(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")

    def mean_of(value, cond=None):
        v = F.rint(value).cast("bigint")
        v = v if cond is None else F.when(cond, v)
        return F.sum(v) / F.count(v)

    return li.groupBy("l_orderkey").agg(
        F.floor(mean_of(q) * 5.0 + 0.5).cast("double").alias("dn_left"),
        F.coalesce(F.floor(mean_of(q, F.col("l_linestatus") == "O") * 5.0 + 0.5).cast("double"),
                   F.lit(0.0)).alias("dn_right"),
        F.coalesce(F.floor(mean_of(q, F.col("l_returnflag") == "R") * 5.0 + 0.5).cast("double"),
                   F.lit(0.0)).alias("dn_stereo"),
        mean_of(F.col("l_discount") * 100.0).alias("disc"),
        mean_of(F.col("l_tax") * 100.0).alias("tax"), mean_of(q).alias("qty"))


def scene(spark, sf_dir) -> DataFrame:
    """Height, looks and prediction on one grid; looks are 0 or NULL where no sample fell."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    j = o.join(_look_by_key(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    g = _grid("o_orderkey")
    z = F.col("o_totalprice") / 100.0
    return j.select(
        *[c.alias(n) for n, c in g.items()], z.alias("z"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("dn_left", "dn_right", "dn_stereo")],
        (z + F.coalesce((F.col("disc") - 5.0) * 40.0, F.lit(0.0))).alias("z_hat"),
        (F.coalesce(F.col("qty"), F.lit(25.0)) * 2.0 + 20.0).alias("sigma"),
        F.coalesce(F.col("tax") - 4.0, F.lit(0.0)).alias("brightness"))


def sar(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    hole = (F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1)
    return li.select(
        F.col("l_suppkey").alias("tile"), "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("run"),
        F.when(hole, F.lit(0.0)).otherwise(F.col("l_quantity") * 5.0).alias("dn"),
        (F.col("l_discount") * 6.0 + 0.2).alias("theta"), (F.col("l_tax") - 0.04).alias("alpha"),
        F.pmod(F.col("l_partkey") * 137.508, F.lit(360.0)).alias("lon"),
        (F.pmod(F.col("l_orderkey") * 0.618034, F.lit(1.0)) * 160.0 - 80.0).alias("lat"))


def patch(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select(F.col("vec_id").alias("tile"), F.floor(F.col("i") / 8).cast("int").alias("row"),
                    F.pmod(F.col("i"), F.lit(8)).alias("col"), (F.col("v").cast("double") * 1000.0).alias("z"))


def obs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", "event_type", "value", "ts",
        F.pmod(F.col("event_id") * 137.508, F.lit(360.0)).alias("lon"),
        (F.pmod(F.col("event_id") * 0.754878, F.lit(1.0)) * 160.0 - 80.0).alias("lat"))


def errors(spark, sf_dir) -> DataFrame:
    """Error and sigma pairs per run."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("run"), "l_orderkey", "l_suppkey",
        ((F.col("l_extendedprice") - F.col("l_quantity") * 2000.0) / 100.0).alias("err"),
        (F.col("l_quantity") * 4.0 + 10.0).alias("sigma"))


def boxes(spark, sf_dir) -> DataFrame:
    """One box per supplier; every fourth crosses or nears the meridian."""
    s = table(spark, sf_dir, "supplier")
    west = F.pmod(F.col("s_suppkey") * 97.31, F.lit(360.0))
    south = F.pmod(F.col("s_suppkey") * 31.7, F.lit(120.0)) - 70.0
    span = F.pmod(F.col("s_suppkey") * 7, F.lit(20)) + 5
    return s.select(F.col("s_suppkey").alias("box"), west.alias("west"), south.alias("south"),
                    F.pmod(west + span, F.lit(360.0)).alias("east"), (south + span * 0.5).alias("north"))


def features(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.replace("p_name", F.lit("e"), F.lit("é")), F.lit(" "), F.col("p_partkey").cast("string")
                 ).alias("name"),
        F.col("p_type").alias("kind"), F.pmod(F.col("p_partkey") * 137.508, F.lit(360.0)).alias("lon"),
        (F.pmod(F.col("p_partkey") * 0.754878, F.lit(1.0)) * 160.0 - 80.0).alias("lat"),
        (F.col("p_size") * 20.0).alias("diameter_km"))


# --- the same bindings as SQL ---------------------------------------------------------------------
def _mod(x: str, m: str) -> str:
    return f"((({x}) % {m} + {m}) % {m})"


SQL = {
    "dem": f"""dem AS (SELECT o_orderkey // {H * W} AS tile, (o_orderkey % {H * W}) // {W} AS r,
        o_orderkey % {W} AS c, o_totalprice / 100e0 AS z FROM orders)""",
    "look": """look AS (SELECT l_orderkey,
        floor(sum(l_quantity)/count(*)*5e0+0.5e0) AS dn_left,
        coalesce(floor(sum(l_quantity) FILTER (l_linestatus='O') / count(*) FILTER (l_linestatus='O') * 5e0 + 0.5e0), 0e0) AS dn_right,
        coalesce(floor(sum(l_quantity) FILTER (l_returnflag='R') / count(*) FILTER (l_returnflag='R') * 5e0 + 0.5e0), 0e0) AS dn_stereo,
        sum(round_even(l_discount*100e0, 0))/count(*) AS disc, sum(round_even(l_tax*100e0, 0))/count(*) AS tax,
        sum(l_quantity)/count(*) AS qty FROM lineitem GROUP BY 1)""",
    "scene": f"""scene AS (SELECT o_orderkey // {H * W} AS tile, (o_orderkey % {H * W}) // {W} AS r,
        o_orderkey % {W} AS c, o_totalprice / 100e0 AS z, coalesce(dn_left,0e0) AS dn_left,
        coalesce(dn_right,0e0) AS dn_right, coalesce(dn_stereo,0e0) AS dn_stereo,
        o_totalprice/100e0 + coalesce((disc-5e0)*40e0, 0e0) AS z_hat, coalesce(qty,25e0)*2e0+20e0 AS sigma,
        coalesce(tax-4e0, 0e0) AS brightness FROM orders LEFT JOIN look ON l_orderkey = o_orderkey)""",
    "sar": f"""sar AS (SELECT l_suppkey AS tile, l_orderkey, l_linenumber, l_returnflag AS run,
        CASE WHEN l_linestatus='O' AND l_linenumber=1 THEN 0e0 ELSE l_quantity*5e0 END AS dn,
        l_discount*6e0+0.2e0 AS theta, l_tax-0.04e0 AS alpha,
        {_mod('l_partkey*137.508e0', '360e0')} AS lon,
        {_mod('l_orderkey*0.618034e0', '1e0')}*160e0-80e0 AS lat FROM lineitem)""",
    "patch": """patch AS (SELECT vec_id AS tile, (i-1)//8 AS r, (i-1)%8 AS c,
        CAST(embedding[i] AS DOUBLE)*1000e0 AS z FROM embeddings, generate_series(1,64) AS g(i))""",
    "obs": f"""obs AS (SELECT event_id, user_id, event_type, value, ts,
        {_mod('event_id*137.508e0', '360e0')} AS lon,
        {_mod('event_id*0.754878e0', '1e0')}*160e0-80e0 AS lat FROM events)""",
    "errors": """errors AS (SELECT l_returnflag AS run, l_orderkey, l_suppkey,
        (l_extendedprice - l_quantity*2000e0)/100e0 AS err, l_quantity*4e0+10e0 AS sigma FROM lineitem)""",
    "boxes": f"""boxes AS (SELECT *, west_ AS west, ((west_+span) % 360e0) AS east, south_ AS south,
        south_+span*0.5e0 AS north FROM (SELECT s_suppkey AS box, {_mod('s_suppkey*97.31e0', '360e0')} AS west_,
        {_mod('s_suppkey*31.7e0', '120e0')}-70e0 AS south_, (s_suppkey*7)%20+5 AS span FROM supplier))""",
    "features": f"""features AS (SELECT replace(p_name,'e','é')||' '||p_partkey AS name, p_type AS kind,
        {_mod('p_partkey*137.508e0', '360e0')} AS lon, {_mod('p_partkey*0.754878e0', '1e0')}*160e0-80e0 AS lat,
        p_size*20e0 AS diameter_km FROM part)""",
}
_NEEDS = {"scene": ("look",)}


def sql(names: str, body: str, *extra: str) -> str:
    """A query text: the named bindings, further CTEs, then the body."""
    parts, seen = [], set()
    for n in names.split():
        for m in (*_NEEDS.get(n, ()), n):
            if m not in seen:
                seen.add(m)
                parts.append(SQL[m])
    text = "WITH " + ",\n".join([*parts, *extra]) + "\n" + body
    return re.sub(r"(?m)^(\s*|WITH |.*\), )(\w+) AS \((?=SELECT|WITH)", r"\1\2 AS MATERIALIZED (", text)


# SQL building blocks of the checks
def theta_sql(t: str) -> str:
    """The scattering law at an angle expression."""
    t = f"greatest(least({t}, pi()/2-1e-3), 1e-3)"
    return f"(0.0118e0*cos({t})/greatest(power(sin({t})+0.111e0*cos({t}),3),1e-8))"


def flattened_sql(local: str, nominal: str) -> str:
    return f"(10e0*log10(greatest({theta_sql(local)}/greatest({theta_sql(nominal)},1e-8),1e-8)))"


def sobel_sql(name: str, src: str, v: str, h: str, w: str, px: str, cols: str = "tile") -> str:
    """CTE (keys, r, c, de, dn): nine clamped taps as a self join."""
    keys = cols.replace(" ", ", ")
    on = " AND ".join(f"b.{k}=t.{k}" for k in cols.split())
    mine = ", ".join(f"t.{k}" for k in cols.split())
    return f"""{name}_t AS (SELECT {keys}, r, c, kx, ky, greatest(least(r+dr,{h}-1),0) AS nr, greatest(least(c+dc,{w}-1),0) AS nc
      FROM {src} CROSS JOIN (VALUES (-1,-1,-1,-1),(-1,0,0,-2),(-1,1,1,-1),(0,-1,-2,0),(0,1,2,0),
        (1,-1,-1,1),(1,0,0,2),(1,1,1,1)) k(dr,dc,kx,ky)),
{name} AS (SELECT {mine}, t.r, t.c, sum(t.kx*b.{v})/8e0/{px} AS de, -sum(t.ky*b.{v})/8e0/{px} AS dn
      FROM {name}_t t JOIN {src} b ON {on} AND b.r=t.nr AND b.c=t.nc GROUP BY {mine}, t.r, t.c)"""


def downsample_sql(name: str, src: str, bands: str, f: int, scale: float, h: int, w: int) -> str:
    """CTE (tile, r, c, bands): kept cells times clamped taps."""
    import math
    half = math.ceil(2.5 * scale * f)
    off = f // 2
    s = scale * f
    sums = ", ".join(f"sum(t.w*b.{x}) AS {x}" for x in bands.split())
    return f"""{name}_k AS (SELECT t, exp(-0.5e0*power(t/{s}e0,2))/sum(exp(-0.5e0*power(t/{s}e0,2))) OVER () AS w
        FROM generate_series(-{half},{half}) g(t)),
{name}_t AS (SELECT q.r, q.c, nr, nc, sum(kr.w*kc.w) AS w FROM (SELECT i AS r, j AS c FROM
           generate_series(0,({h}-{off}-1)//{f}) a(i), generate_series(0,({w}-{off}-1)//{f}) b(j)) q,
        {name}_k kr, {name}_k kc, LATERAL (SELECT greatest(least({off}+q.r*{f}+kr.t,{h}-1),0) AS nr,
          greatest(least({off}+q.c*{f}+kc.t,{w}-1),0) AS nc) GROUP BY 1,2,3,4),
{name} AS (SELECT b.tile, t.r, t.c, {sums} FROM {name}_t t JOIN {src} b ON b.r=t.nr AND b.c=t.nc GROUP BY 1,2,3)"""
