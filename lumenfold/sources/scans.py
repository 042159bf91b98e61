"""Scans with per-axis slices, angle fallbacks and block reads."""

from __future__ import annotations

import math
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.payload import encoded

END = 0  # kind of message that ends a scan (fixed value)


def in_slice(idx: Column, start: int, stop: int, step: int = 1) -> Column:
    """idx in start, start + step, ... below stop; pushed to the scan as far as it is a range."""
    return (idx >= start) & (idx < stop) & ((idx - start) % step == 0)


def slice_length(start: Column, stop: Column, step: Column) -> Column:
    """Rows of such a slice, none if it is empty."""
    return F.greatest(F.ceil((stop - start) / step), F.lit(0)).cast("long")


def theta_or(theta_deg: Column, idx: Column, n: int, start: float | None = None, step: float | None = None) -> Column:
    """Radians: as stored, else start + step * idx if both are known, else evenly over 180 degrees."""
    even = idx.cast("double") * F.lit(180.0) / F.lit(float(max(n - 1, 1)))
    rule = F.lit(start) + idx * F.lit(step) if start is not None and step is not None else even
    return F.radians(F.coalesce(theta_deg, rule))


def fields_or(found: Column, constant: float | None) -> Column:
    """A flat or dark field as measured; where there is none, or a single one that is all zeros, the constant (null without one)."""
    return F.coalesce(found, F.lit(constant).cast("double"))


def flat_and_dark(m: DataFrame, flat_value: float | None = None, dark_value: float | None = None) -> DataFrame:
    """(chan, flat, dark) of messages (chan, itype, val): means of the measured fields, else the acquisition's constants.

    A channel without fields of a kind, or with one only that is zero, takes the constant.
    """
    def mean(kinds: tuple[int, ...]) -> Column:
        own = F.when(F.col("itype").isin(*kinds), F.col("val"))
        empty = (F.count(own) == 1) & (F.max(own) == 0)
        return F.when(~empty, F.avg(own))

    return m.groupBy("chan").agg(fields_or(mean((2, 4)), flat_value).alias("flat"), fields_or(mean((3, 5)), dark_value).alias("dark"))


def dataset_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """Column `name` of a scan cast to `kind`; nulls where the scan has no such dataset."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def simulation_angle(theta: Column) -> Column:
    """Angles as a simulated acquisition sends them: 32-bit radians, back in degrees."""
    return (theta.cast("float") * F.lit(180.0) / F.lit(math.pi)).cast("float")


def read_theta(df: DataFrame, name: str = "theta") -> DataFrame:
    """(proj, theta) of a table of angles, one number a row; a column of any other rank raises ValueError."""
    kind = dict(df.dtypes)[name]
    if kind not in ("float", "double"):
        raise ValueError(f"angles must be one number each, not {kind}")
    return df.select("proj", F.col(name).cast("double").alias("theta"))


def row_range(df: DataFrame, idx: str, first: int, n: int, rows: int) -> DataFrame:
    """Rows first .. first + n - 1 of an axis of `rows`; a range that goes beyond raises ValueError."""
    if first < 0 or n < 0 or first + n > rows:
        raise ValueError(f"rows {first} to {first + n} of {rows}")
    return df.filter((F.col(idx) >= first) & (F.col(idx) < first + n))


def read_acquisitions(spark: SparkSession, path: str) -> DataFrame:
    """(path, proj, theta, px) of binary acquisition files: three int32 sizes, float32 frames, float32 angles. One file a row of work."""

    def frames(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in rows:
            for name, content in zip(f.path, f.content, strict=True):
                n, height, width = struct.unpack_from("<3i", content)
                px = np.frombuffer(content, "<f4", n * height * width, 12).reshape(n, -1)
                theta = np.frombuffer(content, "<f4", n, 12 + px.nbytes)
                yield pd.DataFrame({"path": name, "proj": np.arange(n), "theta": theta, "px": list(px)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(frames, "path string, proj bigint, theta float, px array<float>")


def write_image(image: DataFrame, path: str, every: int = 1) -> None:
    """Reconstructions (pass, slice, pix, val) of every `every`-th pass, a folder each, named by the pass in six digits."""
    own = image.filter(F.col("pass") % every == 0).withColumn("name", F.lpad(F.col("pass").cast("string"), 6, "0"))
    own.repartition("name", "slice").sortWithinPartitions("slice", "pix").write.mode("overwrite").partitionBy("name").parquet(path)


def write_iterations(image: DataFrame, path: str, outer: int, restarted: bool = False) -> str:
    """The image (slice, pix, val) after an outer iteration, in a folder named as the solver names its outputs; returns the folder."""
    folder = f"{path}/{'cont_' if restarted else ''}recon_{outer}"
    image.select("slice", "pix", F.col("val").cast("float")).write.mode("overwrite").parquet(folder)
    return folder


def read_checkpoint(spark: SparkSession, folder: str, first: int = 0, n: int | None = None) -> DataFrame:
    """An image to go on from, of slices first .. first + n - 1 (all after first if n is None)."""
    image = spark.read.parquet(folder).withColumn("val", F.col("val").cast("double")).filter(F.col("slice") >= first)
    return image if n is None else image.filter(F.col("slice") < first + n)


def volume_messages(image: DataFrame, n: int, slices: int | None = None) -> DataFrame:
    """A reconstruction (pass, slice, pix, val) as the messages that publish it, float32 pixels, the kind that ends a scan.

    slices: how many slices a message has; messages of a pass are numbered by seq, and a task holds one. Without it a
    volume is one message, as its subscribers expect it, which is for volumes that fit into a task.
    """
    if slices is not None:
        image = image.withColumn("seq", F.floor(F.col("slice") / slices).cast("int"))
    by = ["pass"] if slices is None else ["pass", "seq"]
    cells = F.sort_array(F.collect_list(F.struct("slice", "pix", F.col("val").cast("float").alias("val"))))
    whole = image.groupBy(*by).agg(cells.alias("c"), F.countDistinct("slice").cast("int").alias("z"))
    dims = F.struct(F.col("z"), F.lit(n).alias("y"), F.lit(n).alias("x")).alias("dims")
    zero = lambda name, kind: F.lit(0).cast(kind).alias(name)
    return whole.select("pass", zero("seq", "int") if slices is None else "seq", dims, zero("rotation", "float"), zero("center", "float"), zero("unique_id", "int"), F.lit(END).cast("tinyint").alias("itype"), encoded(F.col("c.val")).alias("tdata"))


def extract_sinogram(frames: DataFrame, width: int, row: int = 0) -> DataFrame:
    """frames with one detector row each: the sinogram of that row."""
    return frames.withColumn("px", F.slice("px", row * width + 1, width))


def acquisition_contents(frames: DataFrame, height: int, width: int) -> DataFrame:
    """(scan, content): frames (scan, proj, theta, px) as the bytes of acquisition files that read_acquisitions reads; a task holds one scan."""

    def packed(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("proj")
        sizes = struct.pack("<3i", len(own), height, width)
        content = sizes + np.stack(own["px"].to_list()).astype("<f4").tobytes() + own["theta"].to_numpy("<f4").tobytes()
        return pd.DataFrame({"scan": [int(own["scan"].iloc[0])], "content": [content]})

    return frames.select("scan", "proj", "theta", "px").groupBy("scan").applyInPandas(packed, "scan bigint, content binary")


def write_acquisitions(frames: DataFrame, folder: str, height: int, width: int) -> None:
    """Each scan as <folder>/<scan>.data; the folder must be mounted where tasks run."""

    def write(rows: Iterator) -> None:
        for r in rows:
            own = f"{folder}/.{r.scan}-{uuid.uuid4().hex}"
            with open(own, "wb") as out:
                out.write(bytes(r.content))
            os.replace(own, f"{folder}/{r.scan}.data")  # a task that fails leaves no half of a scan

    acquisition_contents(frames, height, width).foreachPartition(write)
