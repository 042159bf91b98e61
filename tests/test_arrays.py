"""Array files: blocks, pushed bounds, bytes that are read, commits and failures."""

import os
import struct

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from lumenfold.sources import arrays
from lumenfold.streaming import finished, sources


def made(path, n=7, height=5, width=4):
    px = np.random.default_rng(1).normal(size=(n, height, width)).astype("<f4")
    theta = np.linspace(0, 3, n).astype("<f4")
    path.write_bytes(struct.pack("<3i", n, height, width) + px.tobytes() + theta.tobytes())
    return px, theta


def table(df):
    return {(r.proj, r["slice"]): (r.theta, r.px) for r in df.collect()}


@pytest.mark.parametrize("block", [1, 20, 100, 1 << 20])
def test_all_rows_whatever_the_block(spark, tmp_path, block):
    px, theta = made(tmp_path / "a.data")
    got = table(arrays.read_arrays(spark, str(tmp_path / "a.data"), block))
    assert len(got) == 35
    for (p, s), (t, row) in got.items():
        assert t == theta[p] and row == px[p, s].tolist()


def test_bounds_reach_the_plan_and_only_their_bytes_are_read(spark, tmp_path):
    px, _ = made(tmp_path / "a.data", 40, 6, 8)
    reader = arrays.Reader(str(tmp_path / "a.data"), 200)
    rest = list(reader.pushFilters([arrays.GreaterThanOrEqual(("slice",), 2), arrays.LessThan(("slice",), 4), arrays.GreaterThan(("proj",), 9), arrays.LessThanOrEqual(("proj",), 19), arrays.EqualTo(("path",), "x")]))
    assert [f.attribute for f in rest] == [("path",)]
    blocks = reader.partitions()
    assert sum((b.last - b.first) * (b.bottom - b.top) for b in blocks) == 10 * 2 and len(blocks) > 1
    read = []
    real = arrays.opened

    class Counted:
        def __init__(self, path):
            self.file = real(path)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read_at(self, n, at):
            read.append(n)
            return self.file.read_at(n, at)

    arrays.opened = Counted
    try:
        rows = sum(batch.num_rows for b in blocks for batch in reader.read(b))
    finally:
        arrays.opened = real
    assert rows == 20 and sum(read) == 20 * 8 * 4 + sum(4 * (b.last - b.first) for b in blocks)
    df = arrays.read_arrays(spark, str(tmp_path / "a.data"), 200).filter((F.col("slice") >= 2) & (F.col("slice") < 4) & (F.col("proj") == 11))
    assert df.rdd.getNumPartitions() == 1 and {k: v[1] for k, v in table(df).items()} == {(11, s): px[11, s].tolist() for s in (2, 3)}


def test_a_file_of_more_than_two_gigabytes(spark, tmp_path):
    """A sparse file of 2.2 GB: planned by blocks, and a row near its end is read from its own place."""
    n, height, width = 550, 1000, 1000
    path = tmp_path / "large.data"
    shape = arrays.Shape(n, height, width)
    with open(path, "wb") as f:
        f.write(struct.pack("<3i", n, height, width))
        f.truncate(shape.angles + 4 * n)
        f.seek(shape.at(549, 998))
        f.write(np.arange(1000, dtype="<f4").tobytes())
    assert os.path.getsize(path) > 2 << 30 and len(arrays.Reader(str(path), arrays.BLOCK).partitions()) > 30
    [r] = arrays.read_arrays(spark, str(path)).filter("slice = 998 AND proj >= 549").collect()
    assert r.px == list(map(float, range(1000)))


def test_folders_and_files_that_do_not_fit(spark, tmp_path):
    made(tmp_path / "a.data")
    made(tmp_path / "b.data", 2, 3, 4)
    (tmp_path / "_ignored").write_bytes(b"x")
    assert arrays.read_arrays(spark, str(tmp_path)).groupBy("path").count().count() == 2
    assert arrays.read_arrays(spark, str(tmp_path)).filter("slice > 99").count() == 0
    (tmp_path / "c.data").write_bytes(struct.pack("<3i", 9, 9, 9))
    with pytest.raises(Exception, match="don't fit"):
        arrays.read_arrays(spark, str(tmp_path)).count()


def test_written_rows_come_back(spark, tmp_path):
    px, theta = made(tmp_path / "a.data")
    own = arrays.read_arrays(spark, str(tmp_path / "a.data"), 50)
    arrays.write_array(own.repartition(4), str(tmp_path / "copy.data"), 7, 5, 4)
    assert (tmp_path / "copy.data").read_bytes() == (tmp_path / "a.data").read_bytes()
    assert sorted(os.listdir(tmp_path)) == ["a.data", "copy.data"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(35).select((F.col("id") / 5).cast("long").alias("proj"), (F.col("id") % 5).cast("int").alias("slice"), F.lit(0.5).cast("float").alias("theta"), F.array_repeat(F.lit(1.0).cast("float"), 4).alias("px"))
    bad = rows.withColumn("px", F.when(F.col("proj") == 6, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("px"))).repartition(5)
    for broken in (bad, rows.filter("proj < 6")):
        with pytest.raises((PythonException, Exception)):
            arrays.write_array(broken, str(tmp_path / "out.data"), 7, 5, 4)
        assert os.listdir(tmp_path) == []
    arrays.write_array(rows, str(tmp_path / "out.data"), 7, 5, 4)
    assert arrays.read_arrays(spark, str(tmp_path / "out.data")).count() == 35


def test_a_watched_folder_holds_the_newest_file_back(spark, tmp_path):
    """A file under writing is never opened, a restart repeats nothing, and files of one time go by name."""
    folder, top = tmp_path / "in", str(tmp_path / "run")
    folder.mkdir()

    def put(name, second, n=2):
        made(folder / name, n, 3, 4)
        os.utime(folder / name, (second, second))

    def seen():
        out = sources.run_to_end(finished.finished_arrays(spark, str(folder), 20), top)
        return sorted((r.path.split("/")[-1], r["count"]) for r in out.groupBy("path").count().collect())

    assert seen() == []
    put("b.data", 1000)
    put("a.data", 1000)
    (folder / "c.data").write_bytes(b"half a file")
    os.utime(folder / "c.data", (2000, 2000))
    assert seen() == [("a.data", 6), ("b.data", 6)]
    assert seen() == [("a.data", 6), ("b.data", 6)]
    put("c.data", 2001, 5)
    put("d.data", 3000)
    assert seen() == [("a.data", 6), ("b.data", 6), ("c.data", 15)]
