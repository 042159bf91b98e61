"""Array files as a data source: three int32 sizes, float32 frames, float32 angles; byte ranges in, byte ranges out.

Reading is planned by blocks of frames, and of rows where a frame is larger than a block: a file of any size is read by
as many tasks as it has blocks. Bounds on proj and slice reach the plan, so only their bytes are read. Writing puts each
detector row at its own offset of a temporary file that takes the final name on commit; a failed job leaves nothing.
"""

from __future__ import annotations

import math
import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "path string, proj bigint, slice int, theta float, px array<float>"
HEADER, BLOCK = 12, 64 << 20  # bytes of the sizes, and of a block, about
KIND = pa.schema([("path", pa.string()), ("proj", pa.int64()), ("slice", pa.int32()), ("theta", pa.float32()), ("px", pa.list_(pa.float32()))])


@dataclass
class Shape:
    """Sizes of a file and the places of its parts."""

    n: int
    height: int
    width: int

    def at(self, proj: int, row: int = 0) -> int:
        return HEADER + 4 * self.width * (proj * self.height + row)

    @property
    def angles(self) -> int:
        return self.at(self.n)


@dataclass
class Block(InputPartition):
    """Frames first .. last - 1 of a file, rows top .. bottom - 1 of each."""

    path: str
    shape: Shape
    first: int
    last: int
    top: int
    bottom: int


def local_or_remote(path: str) -> tuple[pafs.FileSystem, str]:
    """A path's file system, any that pyarrow knows, and its name there."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def opened(path: str) -> pa.NativeFile:
    """A file for reads at offsets."""
    system, name = local_or_remote(path)
    return system.open_input_file(name)


def files(path: str) -> list[str]:
    """The file itself, or those of a folder, by name; hidden ones are none."""
    system, name = local_or_remote(path)
    info = system.get_file_info(name)
    if info.type == pafs.FileType.File:
        return [path]
    found = sorted(f.base_name for f in system.get_file_info(pafs.FileSelector(name)) if f.type == pafs.FileType.File)
    return [f"{path.rstrip('/')}/{f}" for f in found if f[0] not in "._"]


def shape_of(path: str) -> Shape:
    with opened(path) as f:
        shape = Shape(*struct.unpack("<3i", f.read_at(HEADER, 0)))
        if min(shape.n, shape.height, shape.width) < 0 or f.size() != shape.angles + 4 * shape.n:
            raise ValueError(f"{path}: {f.size()} bytes don't fit {shape}")
    return shape


class Reader(DataSourceReader):
    def __init__(self, path: str, block: int) -> None:
        self.path, self.block = path, block
        self.bounds = {"proj": (0, math.inf), "slice": (0, math.inf)}  # from, below

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on proj and slice are kept here, all other filters go back to Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name not in self.bounds or not isinstance(getattr(f, "value", None), int):
                yield f
                continue
            low, high = self.bounds[name]
            match f:
                case EqualTo():
                    low, high = max(low, f.value), min(high, f.value + 1)
                case GreaterThan():
                    low = max(low, f.value + 1)
                case GreaterThanOrEqual():
                    low = max(low, f.value)
                case LessThan():
                    high = min(high, f.value)
                case LessThanOrEqual():
                    high = min(high, f.value + 1)
                case _:
                    yield f
                    continue
            self.bounds[name] = low, high

    def partitions(self) -> list[Block]:
        out = []
        for path in files(self.path):
            shape = shape_of(path)
            (first, last), (top, bottom) = ((low, min(high, most)) for (low, high), most in zip(self.bounds.values(), (shape.n, shape.height), strict=True))
            if first >= last or top >= bottom or not shape.width:
                continue
            rows = max(1, min(bottom - top, self.block // (4 * shape.width)))
            frames = max(1, self.block // (4 * shape.width * rows))
            out += [Block(path, shape, p, min(p + frames, last), r, min(r + rows, bottom)) for p in range(first, last, frames) for r in range(top, bottom, rows)]
        return out or [Block("", Shape(0, 0, 0), 0, 0, 0, 0)]

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        if block.first >= block.last:
            return
        shape, rows = block.shape, block.bottom - block.top
        with opened(block.path) as f:
            theta = np.frombuffer(f.read_at(4 * (block.last - block.first), shape.angles + 4 * block.first), "<f4")
            whole = rows == shape.height
            some = max(1, (1 << 20) // max(1, 4 * shape.width * rows)) if whole else 1  # frames that are read at once
            for p in range(block.first, block.last, some):
                n = min(some, block.last - p)
                px = np.frombuffer(f.read_at(4 * shape.width * rows * n, shape.at(p, block.top)), "<f4")
                offsets = pa.array(np.arange(0, len(px) + 1, shape.width, dtype=np.int32))
                columns = [
                    pa.array([block.path] * (n * rows)),
                    pa.array(np.repeat(np.arange(p, p + n), rows)),
                    pa.array(np.tile(np.arange(block.top, block.bottom, dtype=np.int32), n)),
                    pa.array(np.repeat(theta[p - block.first : p - block.first + n], rows)),
                    pa.ListArray.from_arrays(offsets, pa.array(px)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=KIND)


@dataclass
class Written(WriterCommitMessage):
    rows: int


class Writer(DataSourceArrowWriter):
    """Rows (proj, slice, theta, px) of one array; the file's folder must be mounted where tasks run."""

    def __init__(self, path: str, shape: Shape) -> None:
        self.path, self.shape = path, shape
        self.temporary = f"{os.path.dirname(path)}/.{os.path.basename(path)}-{uuid.uuid4().hex}"
        with open(self.temporary, "wb") as f:
            f.write(struct.pack("<3i", shape.n, shape.height, shape.width))
            f.truncate(shape.angles + 4 * shape.n)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Each row goes to its own place, so a task that runs twice writes the same."""
        shape, rows = self.shape, 0
        with open(self.temporary, "r+b") as f:
            for batch in iterator:
                for r in batch.select(["proj", "slice", "theta", "px"]).to_pylist():
                    if not (0 <= r["proj"] < shape.n and 0 <= r["slice"] < shape.height and len(r["px"]) == shape.width):
                        raise ValueError(f"row ({r['proj']}, {r['slice']}) of {len(r['px'])} values doesn't fit {shape}")
                    f.seek(shape.at(r["proj"], r["slice"]))
                    f.write(np.array(r["px"], "<f4").tobytes())
                    if r["slice"] == 0:
                        f.seek(shape.angles + 4 * r["proj"])
                        f.write(struct.pack("<f", r["theta"]))
                    rows += 1
        return Written(rows)

    def commit(self, messages: list[Written | None]) -> None:
        """The array takes its name once every row is there."""
        rows = sum(m.rows for m in messages if m)
        if rows != self.shape.n * self.shape.height:
            self.abort(messages)
            raise ValueError(f"{rows} rows of {self.shape.n * self.shape.height}")
        os.replace(self.temporary, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.temporary):
            os.remove(self.temporary)


class ArrayFiles(DataSource):
    """Options: path; to read, block (bytes); to write, n, height, width."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("block", BLOCK)))

    def writer(self, schema, overwrite: bool) -> Writer:
        path = self.options["path"].removeprefix("file://")
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(path)
        return Writer(path, Shape(*(int(self.options[k]) for k in ("n", "height", "width"))))


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(ArrayFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_arrays(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(path, proj, slice, theta, px): a row for each detector row of a file, or of all files of a folder. Filters on proj and slice bound what is read."""
    return registered(spark).read.format("arrays").option("block", block).load(path)


def write_array(rows: DataFrame, path: str, n: int, height: int, width: int) -> None:
    """rows (proj, slice, theta, px) as one file, which is there whole or not at all. Too few rows, or one that doesn't fit, raise an error; of repeated rows the job fails too, as others are missing."""
    registered(rows.sparkSession)
    rows.select("proj", "slice", "theta", "px").write.format("arrays").mode("overwrite").options(n=n, height=height, width=width).save(path)
