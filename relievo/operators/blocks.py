"""Block layout with halo: the one shuffle that every neighbourhood operator shares.

A raster of any size is cut into square blocks. Each pixel is sent to its own block and, if it
lies within `halo` pixels of a block border, to the neighbours too, so a block can work alone.
Blocks are bounded by (block + 2 * halo)^2 pixels, so a mosaic that is one huge tile spreads over
as many tasks as it has blocks. Row-wise and column-wise windows inside a block both reuse the
single exchange on the block key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_PX = 256


@dataclass(frozen=True)
class Blocked:
    """A blocked raster with its key columns."""

    df: DataFrame
    keys: tuple[str, ...]
    block: int

    @property
    def by_row(self):
        """Pixels of one raster row inside a block, west to east."""
        return Window.partitionBy(*self.keys, "_br", "_bc", "row").orderBy("col")

    @property
    def by_col(self):
        """Pixels of one raster column inside a block, north to south."""
        return Window.partitionBy(*self.keys, "_br", "_bc", "col").orderBy("row")

    def with_columns(self, cols: dict[str, Column]) -> "Blocked":
        return Blocked(self.df.withColumns(cols), self.keys, self.block)

    def core(self) -> DataFrame:
        """Drop the halo copies and the block columns."""
        inside = (_block_of("row", self.block) == F.col("_br")) & (
            _block_of("col", self.block) == F.col("_bc"))
        return self.df.where(inside).drop("_br", "_bc")


def _block_of(position, block: int) -> Column:
    return F.floor(F.col(position) / block).cast("int")


def _touching(position: str, halo: int, block: int) -> Column:
    first = F.floor((F.col(position) - halo) / block).cast("int")
    last = F.floor((F.col(position) + halo) / block).cast("int")
    return F.sequence(F.greatest(first, F.lit(0)), last)


def spread(df: DataFrame, *cols) -> DataFrame:
    """Repartition rows that are about to multiply.

    The count is given, so AQE does not merge the partitions by their size before the expansion.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


def with_halo(df: DataFrame, halo: int, keys=("tile",), block: int = BLOCK_PX,
              expands: bool = False) -> Blocked:
    """Cut into blocks of `block` pixels with `halo` pixels of context.

    `expands` keeps blocks in separate partitions for operators that make many rows of each.
    """
    block = max(block, halo, 1)
    cut = (df.withColumn("_br", F.explode(_touching("row", halo, block)))
           .withColumn("_bc", F.explode(_touching("col", halo, block))))
    where = (*keys, "_br", "_bc")
    return Blocked(spread(cut, *where) if expands else cut.repartition(*where), tuple(keys), block)


def neighbour(value, position: str, window, step: int) -> Column:
    """The value `step` pixels ahead along a window, NULL if that pixel is absent.

    The position test keeps a gap from passing a farther pixel off as the neighbour.
    """
    value = F.col(value) if isinstance(value, str) else value
    pos = F.col(position)
    if step < 0:
        return F.when(F.lag(pos, -step).over(window) == pos + step, F.lag(value, -step).over(window))
    return F.when(F.lead(pos, step).over(window) == pos + step, F.lead(value, step).over(window))


def edge_neighbour(value: str, position: str, window, step: int) -> Column:
    """Like `neighbour`, but an absent pixel repeats the centre (replicate edge)."""
    return F.coalesce(neighbour(value, position, window, step), F.col(value))
