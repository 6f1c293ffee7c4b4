"""Whole jobs: tile ingest, region product and evaluation of runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geodesy as G
from ..functions import radiometry as R
from ..functions.base import attach
from ..operators import blend, grids, masks, metrics
from ..operators.blocks import spread
from ..operators.coregister import DEFAULTS, ProductGrid, reached, sample_source
from ..operators.fits import tile_datum_offset
from ..operators.resample import Footprint
from ..session import materialise
from ..sources import tilestore
from ..sources.sinks import product_summary

TILES_PER_FILE = 16
FILE_PX = 1 << 18  # small tiles share a file up to so many pixels
SMALL_SOURCE_PX = 1 << 16  # a source that is broadcast: at most 10 MB as cubic patches


@dataclass(frozen=True)
class Product:
    """A raster to sample: its pixels (row, col, band), geometry and resampling."""

    raster: DataFrame
    band: str
    grid: ProductGrid
    method: str = "bilinear"


@dataclass(frozen=True)
class IngestSpec:
    pixel_m: float = 75.0
    core_px: int = 512
    margin_px: int = 0
    min_valid: float = 0.55
    max_lat: float = 78.0
    per_region: int = 0
    defaults: dict = field(default_factory=lambda: dict(DEFAULTS))


def plan_tiles(regions: DataFrame, spec: IngestSpec) -> DataFrame:
    """(tile, region, lon, lat, quad, west..north): what an ingest will read."""
    c = grids.tile_centres(regions, spec.core_px, spec.pixel_m, spec.max_lat, "eastward").select("region", "lon", "lat", "eastward")
    if spec.per_region:
        c = grids.strided_pick(c, spec.per_region, order=("lat", "eastward"))
    span = (spec.core_px + 2 * spec.margin_px) * spec.pixel_m
    c = c.withColumns({"tile": F.xxhash64("region", "lon", "lat"), "quad": G.quad_id("lat", "lon"),
                       "_b": grids.centred_box("lon", "lat", span)})
    return c.select("tile", "region", "quad", F.col("lon").alias("tile_lon"), F.col("lat").alias("tile_lat"), "_b.*")


def _laid_out(plan: DataFrame, products: dict[str, Product], spec: IngestSpec) -> DataFrame:
    """Pixels of every tile with enough radar coverage, with all products, as they are written: tile after tile in
    the slices of `tilestore.sliced`, each with what is known of its tile (`_tile`) and the shares that the looks cover of it (`_cover`).

    Tile rows are dealt out once; their pixels are made, sampled, gated and tied where they are. Sources small enough are
    broadcast; with a larger one the pixels do meet it in a shuffle, and are dealt by slice again.
    """
    windows = plan.select("west", "south", "east", "north")
    sources = {name: materialise(reached(windows, spec.pixel_m, p.raster, p.grid), f"source-{name}") for name, p in products.items()}
    few = {name: s.count() <= SMALL_SOURCE_PX for name, s in sources.items()}
    side = spec.core_px + 2 * spec.margin_px
    dealt, slices = tilestore.sliced(plan, plan, max(TILES_PER_FILE, FILE_PX // side ** 2))
    dealt = dealt.repartition(slices, "quad", "_s").withColumn("_tile", F.struct(
        "region", F.col("tile_lon").alias("lon"), F.col("tile_lat").alias("lat_deg")))
    px = grids.window_pixels(dealt, spec.pixel_m, spread_rows=False).select("quad", "_s", "tile", "_tile", "row", "col", "lon", "lat")

    def sampled(px, names, in_order):
        for name in names:
            p = products[name]
            px = sample_source(px, sources[name], p.band, p.grid, p.method, name, few[name])
        moved = not all(few[name] for name in names)
        px = px.repartition(slices, "quad", "_s") if moved else px
        return px.sortWithinPartitions("quad", "_s", "tile", "row", "col") if moved or not in_order else px

    tile, n = Window.partitionBy("quad", "_s", "tile"), float(side ** 2)
    px = sampled(px, ["dn_left"], False).withColumn("_left", F.count("dn_left").over(tile) / n).where(F.col("_left") >= spec.min_valid)
    px = sampled(px, [name for name in products if name != "dn_left"], True)
    shares = {short: F.count(name).over(tile) / n for name, short in (
        ("dn_right", "right"), ("dn_stereo", "stereo"), ("stereo_dem", "stereo_dem")) if name in products}
    if "stereo_dem" in products and "gtdr_up" in products:
        offset = tile_datum_offset("stereo_dem", "gtdr_up", tile)
        px = px.withColumns({"_tie": offset} | {f"_{k}": v for k, v in shares.items()})
        px = px.withColumns({"stereo_dem": F.col("stereo_dem") - F.col("_tie"),
                             "_stereo_dem": F.when(F.col("_tie").isNull(), 0.0).otherwise(F.col("_stereo_dem"))}).drop("_tie")
    else:
        px = px.withColumns({f"_{k}": v for k, v in shares.items()})
    cover = ["left", *shares]
    px = px.withColumn("_cover", F.struct(*[F.col(f"_{k}").alias(k) for k in cover])).drop("_s", *[f"_{k}" for k in cover])
    if "rms_slope" in products:  # stored in degrees
        px = px.withColumn("rms_slope", F.radians(F.coalesce("rms_slope", F.lit(0.0))))
    return px.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in spec.defaults.items() if c in products})


def tile_facts(px: DataFrame, kept, facts=()) -> DataFrame:
    """The `kept` columns of stored pixels beside facts of their tile, or all of them: place, coverage, flags, incidence and
    look vectors. No join: stored pixels carry what these follow from."""
    tiles = masks.presence_flags(px.select(F.struct(*kept).alias("_kept"), "_tile.*", "_cover.*"))
    tiles = tiles.withColumns({f"theta_{k}": F.radians(G.incidence_deg("lat_deg", k)) for k in K.INCIDENCE}
                              | {f"look_{k}": G.look_vector(F.lit(k)) for k in K.INCIDENCE})
    return tiles.select("_kept.*", *(facts or [c for c in tiles.columns if c != "_kept"]))


def _tile_rows(px: DataFrame) -> DataFrame:
    """A row per kept tile, from its first pixel."""
    return tile_facts(px.where("row = 0 AND col = 0"), ("tile", "quad"))


def ingest(regions: DataFrame, products: dict[str, Product], spec: IngestSpec) -> tuple[DataFrame, DataFrame]:
    """Co-registered (pixels, tiles) of every region tile with enough radar coverage.

    `products` needs "dn_left"; "dn_right", "dn_stereo", "gtdr_up", "stereo_dem", "emissivity"
    and "rms_slope" are optional. The left look is sampled and gated first, so gappy tiles cost
    nothing more. The pixels are written once; the tile rows are read from them.
    """
    plan = materialise(spread(plan_tiles(regions, spec), "tile"), "ingest-plan")
    px = materialise(_laid_out(plan, products, spec), "ingest")
    return px.drop("_tile", "_cover"), materialise(_tile_rows(px), "ingest-tiles")


def ingest_to_store(regions: DataFrame, products: dict[str, Product], spec: IngestSpec, path: str,
                    mode: str = "errorifexists"):
    """Ingest into a tile store at `path`, partitioned by quadrangle, that `tilestore.read_tiles` reads back.

    Pixels are written to the store as they are made, and nowhere else.
    """
    plan = materialise(spread(plan_tiles(regions, spec), "tile"), "ingest-plan")
    tilestore.write_sorted(_laid_out(plan, products, spec), path, mode)
    tiles = _tile_rows(plan.sparkSession.read.parquet(f"{path}/pixel"))
    meta = {k: v for k, v in asdict(spec).items() if k != "defaults"}
    tilestore.write_tiles(tiles, path, meta | {"bands": sorted(products)}, mode)


def region_product(regions: DataFrame, span_m: float, pixel_m: float, tile_px: int, overlap_px: int,
                   tile_values: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(blended product, summary) of a square box per region.

    `tile_values` gets the tile pixels (region, orow, ocol, row, col, lon, lat) and returns them
    with `z`, `sigma`, `rv` and `gtdr`: a join with stored predictions, or a user model.
    """
    tiles = grids.region_grid(regions, tile_px, pixel_m, overlap_px, span_m)
    canvas = tiles.select("region", (F.col("height") * F.col("width")).alias("_canvas")).distinct()
    deg = pixel_m / K.M_PER_DEG
    step = F.sequence(F.lit(0), F.lit(tile_px - 1))
    lines = spread(tiles.withColumn("row", F.explode(step)), "region", "orow", "ocol", "row")
    px = lines.withColumn("col", F.explode(step))
    px = px.select("region", "orow", "ocol", "row", "col",
                   (F.col("west") + (F.col("ocol") + F.col("col") + 0.5) * deg).alias("lon"),
                   (F.col("north") - (F.col("orow") + F.col("row") + 0.5) * deg).alias("lat"))
    v = tile_values(px).withColumns({
        "grow": F.col("orow") + F.col("row"), "gcol": F.col("ocol") + F.col("col"),
        "w": G.feather2d("row", "col", tile_px, overlap_px)})
    product = blend.blend(v, ["z", "sigma", "rv", "gtdr"], ("region",))
    s = product_summary(product, ("region",)).join(canvas, "region")
    covered = product.groupBy("region").agg(F.count("z").alias("_k"))
    s = s.join(covered, "region").withColumn("coverage", F.col("_k") / F.col("_canvas")).drop("_k", "_canvas")
    return product, s


def evaluate_runs(targets: DataFrame, predictions: DataFrame, pixel_m: float, height: int, width: int,
                  baseline: str, stride: int | None = None, footprint: Footprint | None = None,
                  scale_m: float | None = None) -> DataFrame:
    """One row per run: mean over tiles of each score, and the gain over the baseline run.

    targets: tile, row, col, gtdr, gtdr_valid, rv_left, rv_right, theta_left, theta_right (radians)
    and, with `scale_m`, stereo_dem and trust. predictions: run, tile, row, col, z, sigma,
    brightness. Scores without data are NULL.
    """
    keys = ("run", "tile")
    d = materialise(predictions.join(targets, ["tile", "row", "col"]), "evaluation")
    looks = {"left": (1.0, 0.0), "right": (-1.0, 0.0)}
    resid = {k: metrics.rendered_residual(d, "z", f"rv_{k}", F.col(f"rv_{k}").isNotNull(), f"theta_{k}", v, pixel_m,
                                          F.coalesce("brightness", F.lit(0.0)), keys) for k, v in looks.items()}
    parts = [
        d.groupBy(*keys).agg(F.stddev_samp(F.col("z") - F.col("gtdr")).alias("relief_m"), F.avg("sigma").alias("sigma_m")),
        metrics.physics_residual(resid["left"], "residual", F.col("usable"), keys).select(*keys, "phys_resid_db"),
        resid["right"].groupBy(*keys).agg(metrics.look_psnr("residual", F.col("usable")).alias("cross_look_psnr"))]
    if stride:
        parts.append(metrics.altimetry_residual(d, "z", "gtdr", "gtdr_valid", footprint or Footprint(), pixel_m,
                                                height, width, stride, keys=keys))
    if scale_m:
        parts.append(metrics.stereo_scores(d, "z", "stereo_dem", "trust", pixel_m, height, width, scale_m, keys).select(
            *keys, "stereo_mae_m"))
    wide = parts[0]
    for p in parts[1:]:
        wide = wide.join(p, list(keys), "left")
    names = [c for c in wide.columns if c not in keys]
    table = metrics.metric_table(wide.unpivot(list(keys), names, "metric", "value"), names)
    base = table.where(F.col("run") == baseline).select(
        F.col("phys_resid_db").alias("_p"), F.col("cross_look_psnr").alias("_x"))
    return attach(table, base).withColumns({
        "phys_gain_db": F.col("_p") - F.col("phys_resid_db"),
        "cross_gain_db": F.col("cross_look_psnr") - F.col("_x")}).drop("_p", "_x")
