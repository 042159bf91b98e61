"""Cutting lineage in iterated plans, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}  # folders made here, by application
_SCOPES: list[list[tuple[SparkSession, str]]] = []  # what open scopes are to delete


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session in local mode (all in one process, as in tests) gets a folder of its own; a cluster
    must name one, as a folder of one machine is of no use to the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-")
    return _OWN[app]


@contextmanager
def stashes() -> Iterator[None]:
    """Within it, what queries write to the shared folder on their way is noted; at its end all of that is deleted, so results must have been written or collected by then."""
    own: list[tuple[SparkSession, str]] = []
    _SCOPES.append(own)
    try:
        yield
    finally:
        _SCOPES.remove(own)
        for spark, path in own:
            delete(spark, path)


def noted(spark: SparkSession, path: str) -> str:
    """The path, which goes at the end of the scopes that are open."""
    for scope in _SCOPES:
        scope.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def stash(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """df written once to the shared folder and read back: its lineage ends there, and lost executors don't cost a recomputation.

    by: a column to partition the files by, so that later filters on it read only what they need.
    """
    path = noted(df.sparkSession, f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}")
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stash_path = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes the files of a stash that nothing reads any more."""
    path = getattr(df, "stash_path", None)
    if path:
        delete(df.sparkSession, path)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut."""
    return stash(df, "cut")
