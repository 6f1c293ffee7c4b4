"""Spatial joins written as equi-joins plus an exact test."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geodesy as G
from ..functions.base import as_col, attach


def region_frame(spark, boxes: dict, held_out=()) -> DataFrame:
    """A box dictionary as (region, west, south, east, north, held_out)."""
    rows = [(n, *map(float, b), n in held_out) for n, b in boxes.items()]
    return spark.createDataFrame(
        rows, "region string, west double, south double, east double, north double, held_out boolean")


MAX_DEPTH = 12  # finest cells: 0.088 degrees of longitude by 0.044 of latitude


def _span(west, east):
    """Degrees from west to east, going east; a box of 360 degrees and more is the whole circle."""
    return F.when(F.col(east) - F.col(west) >= 360.0, F.lit(360.0)).otherwise(
        F.pmod(F.col(east) - F.col(west), F.lit(360.0)))


def _depth(whole: float, extent):
    """Depth of the finest cells that are no smaller than an extent, at most MAX_DEPTH."""
    least = F.greatest(extent, F.lit(whole / 2 ** MAX_DEPTH))
    return F.greatest(F.floor(F.log2(F.lit(whole) / least)), F.lit(0)).cast("int")


def box_cells(boxes: DataFrame) -> DataFrame:
    """Boxes with the cells that cover them, as (_dx, _dy, _cx, _cy) beside `_w` and `_span`.

    Longitude and latitude are halved `_dx` and `_dy` times, each as often as the box's own extent allows, so
    two cells an axis cover a box of any size and shape, and the cells are at most 16 times its area.
    """
    b = boxes.where(F.col("south") <= F.col("north")).withColumns(
        {"_w": G.lon360("west"), "_span": _span("west", "east")})
    b = b.withColumns({"_dx": _depth(360.0, F.col("_span")), "_dy": _depth(180.0, F.col("north") - F.col("south"))})
    nx, ny = F.pow(F.lit(2.0), "_dx"), F.pow(F.lit(2.0), "_dy")

    def cells(low, high, count):  # a little wider, so rounding loses no point on an edge
        first = F.floor(low * count - 1e-9).cast("int")
        return first, F.floor(high * count + 1e-9).cast("int")

    west, east = cells(F.col("_w") / 360.0, (F.col("_w") + F.col("_span")) / 360.0, nx)
    south, north = cells((F.col("south") + 90.0) / 180.0, (F.col("north") + 90.0) / 180.0, ny)
    round_ = F.least(east, west + nx.cast("int") - 1)  # a full circle visits each cell once
    return (b.withColumn("_cx", F.explode(F.sequence(west, round_)))
            .withColumn("_cx", F.pmod(F.col("_cx"), nx.cast("int")))
            .withColumn("_cy", F.explode(F.sequence(south, north))))


def points_in_boxes(points: DataFrame, boxes: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points with every box that holds them; a box with west > east crosses the meridian.

    An equi-join on cells with the exact test on the matches. A box is covered at its own depth (`box_cells`),
    and a point has one cell at each pair of depths that some box has (at most 169, usually a few), so no pair
    appears twice and the pairs compared follow the matches, whether boxes are tiny, huge or long strips.
    Points or boxes with a NULL side match nothing.
    """
    b = box_cells(boxes)
    depths = b.agg(F.array_sort(F.collect_set(F.struct("_dx", "_dy"))).alias("_depths"))
    p = attach(points, depths).withColumn("_d", F.explode("_depths")).drop("_depths")
    x, y = G.lon360(lon) / 360.0, (as_col(lat) + 90.0) / 180.0
    p = p.withColumns({
        "_dx": F.col("_d._dx"), "_dy": F.col("_d._dy"),
        "_cx": F.floor(x * F.pow(F.lit(2.0), "_d._dx")).cast("int"),
        "_cy": F.floor(y * F.pow(F.lit(2.0), "_d._dy")).cast("int")}).drop("_d")
    p, b = p.alias("p"), b.alias("b")
    inside = ((F.pmod(F.col(f"p.{lon}") - F.col("b._w"), F.lit(360.0)) <= F.col("b._span"))
              & (F.col(f"p.{lat}") >= F.col("b.south")) & (F.col(f"p.{lat}") <= F.col("b.north")))
    same = F.lit(True)
    for c in ("_dx", "_dy", "_cx", "_cy"):
        same = same & (F.col(f"p.{c}") == F.col(f"b.{c}"))
    return p.join(b, same & inside).select(*[F.col(f"p.{c}") for c in points.columns],
                                           *[F.col(f"b.{c}") for c in boxes.columns])


STRIP_BITS, STRIP_LEVELS = 4, 5  # a tree of longitude strips: 16 to a strip, the finest 0.00034 degrees wide
FINEST = 1 << STRIP_BITS * STRIP_LEVELS


def _strips_inside(first, end):
    """The fewest strips (level, node) that make up the finest strips from `first` to before `end`."""
    runs = []

    def strip(level):
        return lambda k: F.struct(F.lit(level).alias("_level"), F.pmod(k, F.lit(1 << STRIP_BITS * level)).cast("bigint").alias("_node"))

    for level in range(1, STRIP_LEVELS + 1):
        size = 1 << STRIP_BITS * (STRIP_LEVELS - level)
        low, high = F.ceil(first / size).cast("bigint"), F.floor(end / size).cast("bigint")
        if level == 1:
            parts = [(low, high)]
        else:
            fits = above[0] <= above[1]  # what the level above leaves on either side of its strips
            parts = [(low, F.when(fits, above[0] * 16).otherwise(high)), (F.when(fits, above[1] * 16).otherwise(high), high)]
        for a, b in parts:
            nodes = F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
            runs.append(F.transform(nodes, strip(level)))
        above = low, high
    return F.when(first < end, F.concat(*runs))


def box_sums(points: DataFrame, boxes: DataFrame, value: str, key: str = "box", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(key, n, n_value, sum_value) of the points inside each box, for boxes that hold some.

    The same pairs as `points_in_boxes`, but none is made: their number grows with points times boxes. Longitude is a
    tree of strips. The strips wholly inside a box are at most 30 a level, and in each the points up to the box's
    northern edge less those before its southern one are two places in a running sum along the latitude. Only points in
    the finest strips under a box's western and eastern edge are compared with it. A point is one row a level,
    and a running sum is cut by bands of latitude, so a strip of many points is not one task.
    """
    x = G.lon360(lon)
    p = points.where(x.isNotNull() & ~F.isnan(x) & as_col(lat).isNotNull() & ~F.isnan(as_col(lat))).select(
        F.col(lon).cast("double").alias("_lon"), F.col(lat).cast("double").alias("_lat"), F.col(value).cast("double").alias("_value"))
    p = p.groupBy("_lon", "_lat").agg(F.count(F.lit(1)).alias("_n"), F.count("_value").alias("_m"), F.sum("_value").alias("_s"))
    p = p.withColumns({"_s": F.coalesce("_s", F.lit(0.0)),
                       "_cell": F.least(F.floor(G.lon360("_lon") / 360.0 * FINEST), F.lit(FINEST - 1)).cast("bigint")})
    b = boxes.where(F.col("south") <= F.col("north")).select(
        F.col(key), "south", "north", G.lon360("west").alias("_w"), _span("west", "east").alias("_span"))
    west, east = F.col("_w") / 360.0 * FINEST, (F.col("_w") + F.col("_span")) / 360.0 * FINEST
    near = 1e-6  # a little wider, so rounding puts no point of an edge into the inside
    w0, w1, e0, e1 = (F.floor(v).cast("bigint") for v in (west - near, west + near, east - near, east + near))
    whole = F.col("_span") >= 360.0
    b = b.where(F.col("_w").isNotNull() & F.col("_span").isNotNull()).withColumns({
        "_first": F.when(whole, F.lit(0)).otherwise(w1 + 1).cast("bigint"), "_end": F.when(whole, F.lit(FINEST)).otherwise(e0).cast("bigint"),
        "_edges": F.when(~whole, F.array_distinct(F.transform(F.array(w0, w1, e0, e1), lambda c: F.pmod(c, F.lit(FINEST)).cast("bigint"))))})

    levels = F.array(*[F.struct(F.lit(j).alias("_level"), F.shiftright("_cell", STRIP_BITS * (STRIP_LEVELS - j)).alias("_node"))
                       for j in range(1, STRIP_LEVELS + 1)])
    sides = F.array(F.struct(F.col("south").alias("_lat"), F.lit(0).alias("_turn")), F.struct(F.col("north").alias("_lat"), F.lit(2).alias("_turn")))
    at = b.withColumn("_strip", F.explode(_strips_inside(F.col("_first"), F.col("_end")))).withColumn("_side", F.explode(sides))
    none = F.lit(0).cast("bigint")
    rows = p.withColumn("_strip", F.explode(levels)).select("_strip.*", "_lat", F.lit(1).alias("_turn"), F.lit(None).cast(
        boxes.schema[key].dataType).alias(key), "_n", "_m", "_s").unionByName(at.select(
            "_strip.*", "_side.*", key, none.alias("_n"), none.alias("_m"), F.lit(0.0).alias("_s")))
    bands = F.pow(F.lit(2.0), F.greatest(F.lit(16) - F.col("_level") * STRIP_BITS, F.lit(0)))
    rows = rows.withColumn("_band", F.least(F.floor(F.greatest((F.col("_lat") + 90.0) / 180.0, F.lit(0.0)) * bands), bands - 1).cast("int"))
    sums, strip = ("_n", "_m", "_s"), ("_level", "_node")
    before = Window.partitionBy(*strip).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.where(F.col("_level") * STRIP_BITS < 16)  # the others have one band; at most 200,000 bands in all
    base = cut.groupBy(*strip, "_band").agg(*[F.sum(c).alias(c) for c in sums]).select(
        *strip, "_band", *[F.sum(c).over(before).alias(f"_base{c}") for c in sums])
    upto = Window.partitionBy(*strip, "_band").orderBy("_lat", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    read = rows.select(*strip, "_band", "_turn", key, *[F.sum(c).over(upto).alias(c) for c in sums]).where(F.col("_turn") != 1)
    sign = F.col("_turn") - 1
    inside = read.join(base, [*strip, "_band"], "left").select(key, *[((F.col(c) + F.coalesce(f"_base{c}", F.lit(0))) * sign).alias(c) for c in sums])
    edge = b.withColumn("_cell", F.explode("_edges")).hint("merge").join(p, "_cell").where(
        (F.pmod(F.col("_lon") - F.col("_w"), F.lit(360.0)) <= F.col("_span")) & F.col("_lat").between(F.col("south"), F.col("north")))
    both = inside.unionByName(edge.select(key, *sums)).groupBy(key).agg(
        F.sum("_n").alias("n"), F.sum("_m").alias("n_value"), F.sum("_s").alias("sum_value"))
    return both.where(F.col("n") > 0)


def split(tiles: DataFrame, held_out: DataFrame, part: str, on: str = "quad") -> DataFrame:
    """Spatial split by whole quadrangle or region: never by tile.

    `held_out` is a list of names; the semi/anti join keeps it out of the plan text and lets
    Spark broadcast it by its measured size.
    """
    how = "left_semi" if part == "val" else "left_anti"
    return tiles.join(held_out.select(on).distinct(), on, how)


def lattice_pixels(fine: DataFrame, stride: int, offset: int | None = None) -> DataFrame:
    """Fine pixels that sit on altimetry posts, with their post indices."""
    off = stride // 2 if offset is None else offset
    r, c = F.col("row") - off, F.col("col") - off
    return (fine.where((r >= 0) & (c >= 0) & (F.pmod(r, F.lit(stride)) == 0)
                       & (F.pmod(c, F.lit(stride)) == 0))
            .withColumns({"prow": (r / stride).cast("int"), "pcol": (c / stride).cast("int")}))


def read_window(pixels: DataFrame, row0: int, col0: int, size: int, width: int) -> DataFrame:
    """A square window that wraps in longitude, re-based to (0, 0)."""
    c = F.pmod(F.col("col") - col0, F.lit(width))
    rows = (F.col("row") >= row0) & (F.col("row") < row0 + size)
    if col0 + size <= width:  # a plain range reaches the scan
        cols = (F.col("col") >= col0) & (F.col("col") < col0 + size)
    else:
        cols = (F.col("col") >= col0) | (F.col("col") < col0 + size - width)
    return pixels.where(rows & cols).withColumns({"row": F.col("row") - row0, "col": c})


def sites_in_tiles(sites: DataFrame, max_level: int) -> DataFrame:
    """(z, x, y, name, px, py) of every site on every level, by arithmetic rather than a range join.

    A site exactly on a tile edge belongs to both tiles, as closed tile boxes require.
    """
    lon = G.lon_edge("lon")
    z = sites.withColumns({"_lon": lon, "z": F.explode(F.sequence(F.lit(0), F.lit(max_level)))})
    z = z.withColumn("_span", G.tile_span("z"))

    def hits(pos, count):
        k = F.floor(pos).cast("int")
        both = F.when(pos == k, F.array(k - 1, k)).otherwise(F.array(k))
        return F.explode(F.filter(both, lambda i: (i >= 0) & (i < count)))

    nx = F.pow(F.lit(2.0), F.col("z") + 1)
    ny = F.pow(F.lit(2.0), F.col("z"))
    z = z.withColumn("x", hits((F.col("_lon") + 180.0) / F.col("_span"), nx))
    z = z.withColumn("y", hits((F.col("lat") + 90.0) / F.col("_span"), ny))
    px = ((F.col("_lon") + 180.0) / F.col("_span") - F.col("x")) * 256.0
    py = (F.col("y") + 1 - (F.col("lat") + 90.0) / F.col("_span")) * 256.0
    return z.select("z", "x", "y", "name", px.alias("px"), py.alias("py"))


def graticule(tiles: DataFrame, spacing: float = 10.0) -> DataFrame:
    """Meridians and parallels that cross each (z, x, y), as (z, x, y, axis, degrees, px)."""
    t = tiles.withColumns({"_e": G.tile_extent("z", "x", "y"), "_span": G.tile_span("z")})

    def lines(axis, low, high, px):
        first, last = F.ceil(low / spacing).cast("int"), F.floor((high + 1e-9) / spacing).cast("int")
        return (t.where(first <= last)
                .withColumn("_k", F.explode(F.sequence(first, last)))
                .withColumn("degrees", F.col("_k") * F.lit(spacing))
                .select("z", "x", "y", F.lit(axis).alias("axis"), "degrees", px.alias("px")))

    d = F.col("degrees")
    return lines("meridian", F.col("_e.west"), F.col("_e.east"),
                 (d - F.col("_e.west")) / F.col("_span") * 256.0).unionByName(
        lines("parallel", F.col("_e.south"), F.col("_e.north"),
              (F.col("_e.north") - d) / F.col("_span") * 256.0))
