"""A folder of array files as a stream that holds the newest file back: it may still be written."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from lumenfold.sources.arrays import BLOCK, SCHEMA, Block, Reader, local_or_remote


class FinishedReader(DataSourceStreamReader):
    """Files by time of change, then name; an offset is the last file of a batch. Of all files the newest is never part of one."""

    def __init__(self, path: str, block: int) -> None:
        self.path, self.block = path, block

    def _known(self) -> list[tuple[int, str]]:
        system, name = local_or_remote(self.path)
        found = system.get_file_info(pafs.FileSelector(name, allow_not_found=True))
        return sorted((f.mtime_ns or 0, f.base_name) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._")

    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        done = self._known()[:-1]
        return {"time": done[-1][0], "name": done[-1][1]} if done else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Block]:
        """Blocks of the files after `start` up to `end`; a batch that runs again gets the same ones."""
        low, high = ((o["time"], o["name"]) for o in (start, end))
        own = [name for time, name in self._known() if low < (time, name) <= high]
        return [b for name in own for b in Reader(f"{self.path.rstrip('/')}/{name}", self.block).partitions()]

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        yield from Reader(block.path, self.block).read(block)


class FinishedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "finished_arrays"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FinishedReader:
        return FinishedReader(self.options["path"], int(self.options.get("block", BLOCK)))


def finished_arrays(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """(path, proj, slice, theta, px) of the folder's array files as they are finished: a file is read once a newer one has appeared.

    A restart from a checkpoint repeats no file. A file that comes with an older time than those already read is not
    seen; writers that take a final name on finishing, as sources.arrays does, give it a new time.
    """
    spark.dataSource.register(FinishedFiles)
    return spark.readStream.format("finished_arrays").option("path", folder).option("block", block).load()
