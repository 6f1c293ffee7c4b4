"""Array layout of rasters: one row per block, for stencils that would make a window row of every pixel.

A `chunk` frame has the key columns, the block number (`br`, `bc`), the size of the block (`rows`,
`cols`, clipped to the last pixel it holds) and one row-major array per band, with `present` telling
absent pixels from NULL ones. NaN counts as NULL.

Neighbours exchange border strips, not pixels: a block sends at most eight slices of its arrays, cut
by array functions, and a task works on one block and its frame at a time. A block holds at most
block^2 pixels whatever the raster's size, so one giant tile spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCK_PX
from .resample import gaussian_taps

_PIECE = ("top", "left", "rows", "cols")
OUT_PX = 1_000_000  # pixels of one output batch


@dataclass
class Window:
    """A block with its frame of neighbours: `bands` and `present` reach `halo` pixels past each side.

    `top` and `left` are the raster position of the block's own first pixel.
    """

    bands: dict[str, np.ndarray]
    present: np.ndarray
    halo: int
    top: int
    left: int
    rows: int
    cols: int

    def core(self, a: np.ndarray) -> np.ndarray:
        h = self.halo
        return a[h:h + self.rows, h:h + self.cols]


# --- between pixel rows and blocks ------------------------------------------------------------------
def to_chunks(pixels: DataFrame, bands, keys=("tile",), block: int = BLOCK_PX) -> DataFrame:
    """Pixel rows as blocks; of repeated rows of one position any one is kept.

    One exchange of the pixels, whose groups are bounded by the block size.
    """
    bands, keys = _names(bands), list(keys)
    side = F.lit(block)
    cell = F.struct(F.pmod("row", side).cast("int").alias("r"), F.pmod("col", side).cast("int").alias("c"),
                    *[F.col(b).cast("double").alias(b) for b in bands])
    grouped = (pixels.withColumns({"br": F.floor(F.col("row") / block).cast("int"),
                                   "bc": F.floor(F.col("col") / block).cast("int"), "_cell": cell})
               .groupBy(*keys, "br", "bc").agg(F.collect_list("_cell").alias("_cells")))
    schema = _schema(grouped, keys, bands)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_cells")
            cells, ends = lists.flatten(), np.cumsum(np.r_[0, lists.value_lengths().to_numpy()])
            r, c = (cells.field(n).to_numpy() for n in ("r", "c"))
            values = {b: _doubles(cells.field(b)) for b in bands}

            def one(lo, hi):
                at = (r[lo:hi], c[lo:hi])
                shape = (int(at[0].max()) + 1, int(at[1].max()) + 1)
                here = np.zeros(shape, bool)
                here[at] = True
                arrays = {}
                for b in bands:
                    arrays[b] = np.full(shape, np.nan)
                    arrays[b][at] = values[b][lo:hi]
                return here, arrays

            yield from _batches(batch, keys, bands, map(one, ends[:-1], ends[1:]))

    return grouped.mapInArrow(build, schema)


def to_pixels(chunks: DataFrame, bands, keys=("tile",), block: int = BLOCK_PX) -> DataFrame:
    """Blocks as pixel rows (keys, row, col, bands); absent pixels give no row."""
    bands, keys = _names(bands), list(keys)
    lines = chunks.select(*keys, "br", "bc", "cols", F.posexplode(
        F.arrays_zip("present", *bands)).alias("_i", "_v"))
    return lines.where("_v.present").select(
        *keys, (F.col("br") * block + F.floor(F.col("_i") / F.col("cols"))).cast("int").alias("row"),
        (F.col("bc") * block + F.col("_i") % F.col("cols")).cast("int").alias("col"),
        *[F.col(f"_v.{b}").alias(b) for b in bands])


# --- neighbourhoods -----------------------------------------------------------------------------------
def map_windows(chunks: DataFrame, fn: Callable[[Window], dict[str, np.ndarray]], bands, out, halo: int,
                keys=("tile",), block: int = BLOCK_PX) -> DataFrame:
    """Apply `fn` to every block with `halo` pixels around it; a chunk frame with the `out` bands.

    `fn` returns one array of the block's own shape per band; `present` is that of the input.
    """
    bands, out, keys = _names(bands), _names(out), list(keys)
    framed = _with_frames(chunks, bands, halo, keys, block).where(F.exists("_pieces", lambda p: p["own"]))
    schema = _schema(framed, keys, out)

    def run(batches):
        for batch in batches:
            done = ((w.core(w.present), fn(w)) for w in _windows(batch, bands, halo, block))
            yield from _batches(batch, keys, out, done)

    return framed.mapInArrow(run, schema)


def _with_frames(chunks, bands, halo, keys, block) -> DataFrame:
    """(keys, br, bc, _pieces): what a block and its neighbours give to the block's window."""
    if halo > block:
        raise ValueError(f"a frame of {halo} pixels needs blocks of at least that size, not {block}")
    names = [*bands, "present"]
    pieces = []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if halo or (dy, dx) == (0, 0):
                pieces.append(_strip(names, dy, dx, halo, block))
    sent = (chunks.withColumn("_p", F.explode(F.array(*pieces)))
            .where((F.col("_p.rows") > 0) & (F.col("_p.cols") > 0)))
    return sent.groupBy(*keys, (F.col("br") + F.col("_p.dy")).alias("br"), (F.col("bc") + F.col("_p.dx")).alias("bc")).agg(
        F.collect_list(F.struct(*[F.col(f"_p.{n}").alias(n) for n in ("own", *_PIECE, *names)])).alias("_pieces"))


def _strip(names, dy: int, dx: int, halo: int, block: int):
    """The part of a block that its neighbour at (dy, dx) sees, placed relative to that neighbour."""
    def axis(step, size):  # first position and count within the block
        if step == 0:
            return F.lit(0), F.col(size)
        if step > 0:  # the far edge, as the neighbour follows
            return F.lit(block - halo), F.greatest(F.col(size) - (block - halo), F.lit(0))
        return F.lit(0), F.least(F.col(size), F.lit(halo))

    (r0, nr), (c0, nc) = axis(dy, "rows"), axis(dx, "cols")
    some = (nr > 0) & (nc > 0)

    def cut(name):
        if (dy, dx) == (0, 0):
            return F.col(name)
        lines = F.transform(F.sequence(r0, r0 + nr - 1), lambda r: F.slice(F.col(name), r * F.col("cols") + c0 + 1, nc))
        return F.when(some, F.flatten(lines))

    return F.struct(
        F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit((dy, dx) == (0, 0)).alias("own"),
        (r0 - dy * block).cast("int").alias("top"), (c0 - dx * block).cast("int").alias("left"),
        F.when(some, nr).otherwise(0).cast("int").alias("rows"), F.when(some, nc).otherwise(0).cast("int").alias("cols"),
        *[cut(n).alias(n) for n in names])


def _windows(batch: pa.RecordBatch, bands, halo: int, block: int) -> Iterator[Window]:
    lists = batch.column("_pieces")
    flat, ends = lists.flatten(), np.cumsum(np.r_[0, lists.value_lengths().to_numpy()])
    place = {n: flat.field(n).to_numpy(zero_copy_only=False) for n in ("own", *_PIECE)}
    arrays = {n: _doubles(flat.field(n).flatten()) for n in bands}
    here = flat.field("present").flatten().to_numpy(zero_copy_only=False).astype(bool)
    start = np.cumsum(np.r_[0, place["rows"].astype("int64") * place["cols"]])
    br, bc = (batch.column(n).to_numpy() for n in ("br", "bc"))
    for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
        own = [k for k in range(lo, hi) if place["own"][k]]
        rows, cols = (int(place["rows"][own[0]]), int(place["cols"][own[0]])) if own else (block, block)
        shape = (block + 2 * halo, block + 2 * halo)
        got = {b: np.full(shape, np.nan) for b in bands}
        present = np.zeros(shape, bool)
        for k in range(lo, hi):
            n, m = int(place["rows"][k]), int(place["cols"][k])
            at = (slice(place["top"][k] + halo, place["top"][k] + halo + n),
                  slice(place["left"][k] + halo, place["left"][k] + halo + m))
            part = slice(start[k], start[k + 1])
            present[at] = here[part].reshape(n, m)
            for b in bands:
                got[b][at] = arrays[b][part].reshape(n, m)
        yield Window(got, present, halo, int(br[i]) * block, int(bc[i]) * block, rows, cols)


# --- the stencils -----------------------------------------------------------------------------------------
def _near(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The value (dy, dx) pixels away, NaN past the window."""
    out = np.full(a.shape, np.nan)
    h, w = a.shape
    out[max(0, -dy):h - max(0, dy), max(0, -dx):w - max(0, dx)] = a[max(0, dy):h + min(0, dy), max(0, dx):w + min(0, dx)]
    return out


def _edge(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """Like `_near`, but where there is no value the centre is repeated."""
    n = _near(a, dy, dx)
    return np.where(np.isnan(n), a, n)


def sobel(chunks: DataFrame, bands, pixel_m: float, keys=("tile",), block: int = BLOCK_PX) -> DataFrame:
    """Bands `<band>_de` and `<band>_dn`: 3x3 /8 gradient, replicate edge, north positive."""
    bands = _names(bands)

    def slopes(w: Window):
        out = {}
        for b in bands:
            v = w.bands[b]
            west, east = _edge(v, 0, -1), _edge(v, 0, 1)
            across = np.where(w.present, east - west, np.nan)
            smooth = np.where(w.present, west + 2.0 * v + east, np.nan)
            de = _edge(across, -1, 0) + 2.0 * across + _edge(across, 1, 0)
            dn = _edge(smooth, -1, 0) - _edge(smooth, 1, 0)
            out[f"{b}_de"], out[f"{b}_dn"] = (w.core(x) / 8.0 / pixel_m for x in (de, dn))
        return out

    return map_windows(chunks, slopes, bands, [f"{b}_{d}" for b in bands for d in ("de", "dn")], 1, keys, block)


def neighbour_steps(chunks: DataFrame, band: str, keys=("tile",), block: int = BLOCK_PX) -> DataFrame:
    """Bands `step_e`, `step_s` and `laplacian`; NULL where a neighbour is missing."""
    def steps(w: Window):
        v = w.bands[band]
        north, south, west, east = (_near(v, *d) for d in ((-1, 0), (1, 0), (0, -1), (0, 1)))
        return {"step_e": w.core(east - v), "step_s": w.core(south - v),
                "laplacian": w.core(south + north + east + west - 4.0 * v)}

    return map_windows(chunks, steps, band, ["step_e", "step_s", "laplacian"], 1, keys, block)


def central_gradient(chunks: DataFrame, band: str, pixel_m: float, keys=("tile",), block: int = BLOCK_PX) -> DataFrame:
    """Bands `<band>_de` and `<band>_dn`: central differences, one-sided at the border."""
    def axis(v, dy, dx):
        before, after = _near(v, -dy, -dx), _near(v, dy, dx)
        one = np.where(np.isnan(after), v - before, after - v)
        g = np.where(np.isnan(before) | np.isnan(after), one, (after - before) / 2.0)
        return np.where(np.isnan(g) & ~np.isnan(v), 0.0, g) / pixel_m

    def gradient(w: Window):
        v = w.bands[band]
        return {f"{band}_de": w.core(axis(v, 0, 1)), f"{band}_dn": w.core(-axis(v, 1, 0))}

    return map_windows(chunks, gradient, band, [f"{band}_de", f"{band}_dn"], 1, keys, block)


def _dilated(mask: np.ndarray, radius: int) -> np.ndarray:
    for axis in (0, 1):
        sums = np.cumsum(np.pad(mask, [(radius + 1, radius) if a == axis else (0, 0) for a in (0, 1)]), axis=axis, dtype="int32")
        n, span = mask.shape[axis], 2 * radius + 1
        mask = np.take(sums, range(span, n + span), axis) > np.take(sums, range(n), axis)
    return mask


def dilate(chunks: DataFrame, mask: str, radius: int, keys=("tile",), block: int = BLOCK_PX) -> DataFrame:
    """Band `mask`: 1 within `radius` pixels of a value other than zero, else 0; also across absent pixels."""
    def grow(w: Window):
        hit = np.nan_to_num(w.bands[mask]) != 0
        return {mask: w.core(_dilated(hit, radius)).astype(float)}

    return map_windows(chunks, grow, mask, mask, radius, keys, block)


def stereo_trust_mask(chunks: DataFrame, dem: str, rv: str, keys=("tile",), jump_m: float = 150.0,
                      seam_dilation: int = 4, threshold_db: float = -12.0, dark_dilation: int = 3,
                      block: int = BLOCK_PX) -> DataFrame:
    """Bands `seam_ok` and `dark_ok` (1 or 0) from one exchange: away from jumps and from radar-dark pixels.

    A NULL `rv` is not dark, so its validity is its being there.
    """
    def flags(w: Window):
        z = w.bands[dem]
        with np.errstate(invalid="ignore"):
            seam = np.zeros(z.shape, bool)
            for d in ((-1, 0), (1, 0), (0, -1), (0, 1)):
                seam |= np.abs(z - _near(z, *d)) > jump_m
            dark = w.bands[rv] < threshold_db
        return {"seam_ok": w.core(~_dilated(seam, seam_dilation)).astype(float),
                "dark_ok": w.core(~_dilated(dark, dark_dilation)).astype(float)}

    return map_windows(chunks, flags, [dem, rv], ["seam_ok", "dark_ok"], max(seam_dilation + 1, dark_dilation), keys, block)


def gaussian_downsample(chunks: DataFrame, bands, factor: int, height: int, width: int, sigma_scale: float = 0.5,
                        keys=("tile",), block: int = BLOCK_PX) -> DataFrame:
    """Gaussian prefilter and decimation at cell centres, as (keys, row, col, bands) of the coarse grid.

    A block answers for the cells whose centre it holds, with two small products of its window. Past
    the raster the border pixel is repeated. NULL pixels add nothing; a cell without a value is NULL, and a
    cell that no pixel reaches gives no row.
    """
    bands, keys = _names(bands), list(keys)
    if factor <= 1:
        return to_pixels(chunks, bands, keys, block)
    taps = np.array(gaussian_taps(factor, sigma_scale))
    half, off = len(taps) // 2, factor // 2
    framed = _with_frames(chunks, bands, half, keys, block).where(
        (F.col("br") >= 0) & (F.col("bc") >= 0) & (F.col("br") * block < height) & (F.col("bc") * block < width))
    schema = T.StructType([framed.schema[k] for k in keys] + [T.StructField(n, T.IntegerType()) for n in ("row", "col")]
                          + [T.StructField(b, T.DoubleType()) for b in bands])

    def weights(first: int, size: int):
        """The cells centred in block positions first.., and their weights over the window."""
        low = max(0, -((off - first) // factor))
        cells = np.arange(low, (min(first + block, size) - 1 - off) // factor + 1)
        m = np.zeros((len(cells), block + 2 * half))
        for n, cell in enumerate(cells):
            at = np.clip(cell * factor + off + np.arange(-half, half + 1), 0, size - 1) - first + half
            np.add.at(m[n], at, taps)
        return cells, m

    def run(batches):
        for batch in batches:
            of, parts = [], []
            for i, w in enumerate(_windows(batch, bands, half, block)):
                rows, down = weights(w.top, height)
                cols, across = weights(w.left, width)

                def reach(mask):
                    return (down > 0).astype(float) @ mask.astype(float) @ (across > 0).astype(float).T > 0

                some = reach(w.present)
                grid = np.meshgrid(rows, cols, indexing="ij")
                one = [grid[0][some], grid[1][some]]
                for b in bands:
                    v = w.bands[b]
                    value = down @ np.nan_to_num(v) @ across.T
                    one.append(np.where(reach(~np.isnan(v)), value, np.nan)[some])
                of.append(np.full(int(some.sum()), i))
                parts.append(one)
            if not parts:
                continue
            take = pa.array(np.concatenate(of))
            cols = [np.concatenate(p) for p in zip(*parts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(take) for k in keys] + [pa.array(c.astype("int32")) for c in cols[:2]]
                + [pa.array(c, from_pandas=True) for c in cols[2:]], names=[*keys, "row", "col", *bands])

    return framed.mapInArrow(run, schema)


# --- arrays in and out of Arrow -----------------------------------------------------------------------------
def _names(bands) -> list[str]:
    return [bands] if isinstance(bands, str) else list(bands)


def _doubles(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype("float64", copy=False)


def _schema(df: DataFrame, keys, bands) -> T.StructType:
    ints = [T.StructField(n, T.IntegerType()) for n in ("br", "bc", "rows", "cols")]
    arrays = [T.StructField("present", T.ArrayType(T.BooleanType()))]
    arrays += [T.StructField(b, T.ArrayType(T.DoubleType())) for b in bands]
    return T.StructType([df.schema[k] for k in keys] + ints + arrays)


def _batches(batch: pa.RecordBatch, keys, bands, blocks) -> Iterator[pa.RecordBatch]:
    """Blocks, given as (present, arrays by band), as rows beside their input rows, a million pixels at a time."""
    held, first, pixels = [], 0, 0
    for n, (present, arrays) in enumerate(blocks, 1):
        held.append((present, [arrays[b] for b in bands]))
        pixels += present.size
        if pixels >= OUT_PX or n == batch.num_rows:
            yield _rows(batch.slice(first, n - first), keys, bands, held)
            held, first, pixels = [], n, 0


def _rows(batch: pa.RecordBatch, keys, bands, blocks) -> pa.RecordBatch:
    shapes = np.array([p.shape for p, _ in blocks], "int32")
    offsets = pa.array(np.cumsum(np.r_[0, shapes.prod(axis=1)]).astype("int32"))

    def lists(parts):
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p.ravel() for p in parts]), from_pandas=True))

    columns = [batch.column(k) for k in (*keys, "br", "bc")] + [pa.array(shapes[:, 0]), pa.array(shapes[:, 1])]
    columns.append(lists([p for p, _ in blocks]))
    columns += [lists(parts) for parts in zip(*[a for _, a in blocks])]
    return pa.RecordBatch.from_arrays(columns, names=[*keys, "br", "bc", "rows", "cols", "present", *bands])
