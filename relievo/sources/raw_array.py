"""Headerless float32 rasters as a Spark data source: byte ranges of whole rows, in batch and as a stream.

Nothing but a file's length is looked at on the driver; a task reads its rows through an Arrow file system
(local or mounted folders, object stores, HDFS), a few rows at a time.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .. import constants as K

SCHEMA = "dem string, row int, col int, raw float"
ROWS_PER_TASK = 256
BATCH_VALUES = 1 << 18  # values of one Arrow batch, unless one row is longer
TASK_VALUES = 1 << 18  # values up to which ranges of small arrays share a task


def located(path: str):
    """(file system, path inside it); a path without a scheme is a folder that every node mounts."""
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path.removeprefix("file:")


@dataclass(frozen=True)
class RawArray:
    """One array: where it is and how many rows of how many float32 values it will have."""

    dem: str
    path: str
    height: int
    width: int

    def arrived(self) -> int:
        """Whole rows present: a file that is still being copied is a northern band; 0 without a file."""
        system, inside = located(self.path)
        size = system.get_file_info(inside).size
        return min(self.height, (size or 0) // (self.width * 4))


@dataclass
class RowRange:
    """The rows from `first` to before `last` of one array."""

    array: RawArray
    first: int
    last: int


def row_ranges(array: RawArray, first: int, last: int, step: int) -> list[RowRange]:
    return [RowRange(array, i, min(i + step, last)) for i in range(first, last, step)]


@dataclass
class Ranges(InputPartition):
    """What one task reads."""

    ranges: list[RowRange]


def together(ranges: list[RowRange]) -> list[Ranges]:
    """Ranges dealt to tasks: those of one array apart, those of many small arrays by TASK_VALUES, so thousands of arrays
    are not as many tasks."""
    turn, open_tasks, out = Counter(), {}, []
    for r in ranges:
        i, n = turn[r.array.dem], (r.last - r.first) * r.array.width
        turn[r.array.dem] += 1
        task, held = open_tasks.get(i, (None, 0))
        if task is None or held + n > TASK_VALUES:
            task, held = Ranges([]), 0
            out.append(task)
        task.ranges.append(r)
        open_tasks[i] = task, held + n
    return out


def read_ranges(part: Ranges | None) -> Iterator[pa.RecordBatch]:
    """Rows of some ranges as Arrow batches of about BATCH_VALUES."""
    held, n = [], 0
    for one in part.ranges if part is not None else ():
        for batch in read_rows(one):
            held.append(batch)
            n += batch.num_rows
            if n >= BATCH_VALUES:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def read_rows(part: RowRange) -> Iterator[pa.RecordBatch]:
    """Rows of one range as Arrow batches; a file shorter than the range is an error, not fewer rows."""
    a = part.array
    system, inside = located(a.path)
    step = max(1, BATCH_VALUES // a.width)
    with system.open_input_file(inside) as f:
        for first in range(part.first, part.last, step):
            n = min(step, part.last - first)
            data = f.read_at(n * a.width * 4, first * a.width * 4)
            if len(data) < n * a.width * 4:
                raise OSError(f"{a.path} ends before row {first + n}")
            yield pa.record_batch({
                "dem": pa.array([a.dem] * (n * a.width), pa.string()),
                "row": pa.array(np.repeat(np.arange(first, first + n, dtype="int32"), a.width)),
                "col": pa.array(np.tile(np.arange(a.width, dtype="int32"), n)),
                "raw": pa.array(np.frombuffer(data, "<f4"))})


class RawArraySource(DataSource):
    """`spark.read.format("raw_array")` and `spark.readStream.format("raw_array")`.

    Options: `arrays` (JSON list of dem, path, height, width), `rowsPerTask` (the rows of one range; small ranges share a task), and for batch reads
    `firstRow` and `endRow`, which cut the byte ranges. Only rows that have arrived are read.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_array"

    def schema(self) -> str:
        return SCHEMA

    def arrays(self) -> list[RawArray]:
        return [RawArray(**a) for a in json.loads(self.options["arrays"])]

    def step(self) -> int:
        return int(self.options.get("rowsPerTask", ROWS_PER_TASK))

    def reader(self, schema) -> "ArrivedRows":
        o = self.options
        return ArrivedRows(self.arrays(), self.step(), int(o.get("firstRow", 0)), o.get("endRow"))

    def streamReader(self, schema) -> "GrowingRows":
        return GrowingRows(self.arrays(), self.step())


class _Light:
    """A reader goes to the tasks without its list of arrays: a task's ranges name theirs."""

    def __getstate__(self):
        return {**self.__dict__, "arrays": []}


class ArrivedRows(_Light, DataSourceReader):
    def __init__(self, arrays: list[RawArray], step: int, first: int, end: str | None):
        self.arrays, self.step, self.first, self.end = arrays, step, first, end

    def partitions(self) -> list[Ranges]:
        out = []
        for a in self.arrays:
            last = a.arrived() if self.end is None else min(a.arrived(), int(self.end))
            out += row_ranges(a, self.first, last, self.step)
        return together(out)

    def read(self, partition):
        return read_ranges(partition)


class GrowingRows(_Light, DataSourceStreamReader):
    """The offset is the arrived row of each array, so a micro-batch is what has arrived since the last one."""

    def __init__(self, arrays: list[RawArray], step: int):
        self.arrays, self.step = arrays, step

    def initialOffset(self) -> dict:
        return {a.dem: 0 for a in self.arrays}

    def latestOffset(self) -> dict:
        return {a.dem: a.arrived() for a in self.arrays}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        out = []
        for a in self.arrays:
            first, last = start.get(a.dem, 0), end.get(a.dem, 0)
            if last < first:
                raise ValueError(f"{a.path} went from {first} rows back to {last}; arrays only grow")
            out += row_ranges(a, first, last, self.step)
        return together(out)

    def read(self, partition):
        return read_ranges(partition)


def _options(arrays, rows_per_task: int) -> dict:
    listed = [{"dem": a.dem, "path": a.path, "height": a.height, "width": a.width} for a in arrays]
    return {"arrays": json.dumps(listed), "rowsPerTask": str(rows_per_task)}


def scan(spark: SparkSession, arrays, rows_per_task: int = ROWS_PER_TASK, first: int = 0,
         end: int | None = None) -> DataFrame:
    """(dem, row, col, raw) of the arrived rows in [first, end) of every array."""
    spark.dataSource.register(RawArraySource)
    options = _options(arrays, rows_per_task) | {"firstRow": str(first)} | ({} if end is None else {"endRow": str(end)})
    return spark.read.format("raw_array").options(**options).load()


def scan_stream(spark: SparkSession, arrays, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The same rows as a stream that follows the growing files."""
    spark.dataSource.register(RawArraySource)
    return spark.readStream.format("raw_array").options(**_options(arrays, rows_per_task)).load()


def heights(rows: DataFrame, value_offset) -> DataFrame:
    """(dem, row, col, z): elevation above the sphere, NULL on gaps."""
    raw = F.col("raw").cast("double")
    good = ~F.isnan(raw) & (F.abs(raw) < float("inf")) & (raw > K.STEREO_SENTINEL)
    return rows.select("dem", "row", "col", F.when(good, raw + value_offset - K.RADIUS_M).alias("z"))


def write_arrays(pixels: DataFrame, band: str, folder: str, width: int, key: str = "dem") -> DataFrame:
    """Write each array of (key, row, col, band) to `folder`/<key>.img; returns (key, rows written).

    NULL and absent pixels become NaN. An array is one file and so one task, which sees sorted pixels as flat
    columns and holds one line of them. A file is written beside its target and moved there whole, so a task that
    is run again changes nothing.
    """
    flat = (pixels.select(F.col(key).cast("string").alias("dem"), F.col("row").cast("int").alias("row"),
                          F.col("col").cast("int").alias("col"), F.col(band).cast("float").alias("v"))
            .repartition("dem").sortWithinPartitions("dem", "row", "col"))

    def write(batches):
        from pyspark import TaskContext
        system, base = located(folder)
        system.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        name, out, at, line = None, None, -1, None

        def close_line():
            if at >= 0:
                out.write(line.tobytes())

        def finish():
            close_line()
            out.close()
            system.move(f"{base}/_{name}-{attempt}", f"{base}/{name}.img")
            return pa.record_batch([pa.array([name]), pa.array([at + 1], pa.int64())], ["dem", "rows"])

        for batch in batches:
            dem = batch.column(0).dictionary_encode()
            code, names = dem.indices.to_numpy(), dem.dictionary.to_pylist()
            row, col, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            starts = np.flatnonzero(np.concatenate((np.ones(min(len(row), 1), bool), (code[1:] != code[:-1]) | (row[1:] != row[:-1]))))
            for lo, hi in zip(starts, [*starts[1:], len(row)]):
                if names[code[lo]] != name:
                    if name is not None:
                        yield finish()
                    name, at, line = names[code[lo]], -1, None
                    out = system.open_output_stream(f"{base}/_{name}-{attempt}")
                if row[lo] != at:
                    close_line()
                    for _ in range(at + 1, row[lo]):  # lines without a pixel
                        out.write(np.full(width, np.nan, "<f4").tobytes())
                    at, line = int(row[lo]), np.full(width, np.nan, "<f4")
                line[col[lo:hi]] = v[lo:hi]
        if name is not None:
            yield finish()

    return flat.mapInArrow(write, "dem string, rows bigint")
