"""Message payloads: bytes to pixel values and back, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a payload is read: the type its bytes are, each value then cast to float.
KINDS = {"uint8": "<u1", "uint16": "<u2", "float32": "<f4"}


def decoded(payload: Column, kind: str) -> Column:
    """array<float>: uint8 and uint16 are cast value by value, float32 is the bits as they are. Null stays null."""
    dtype = KINDS[kind]

    @F.pandas_udf("array<float>")
    def run(payloads: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.frombuffer(bytes(x), dtype).astype("float32") for x in payloads], dtype=object)

    return run(payload)


def encoded(px: Column, kind: str = "float32") -> Column:
    dtype = KINDS[kind]

    @F.pandas_udf("binary")
    def run(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.asarray(x).astype(dtype).tobytes() for x in arrays], dtype=object)

    return run(px)


def as_messages(frames: DataFrame, rotation_step: float = 0.25, side: int = 8) -> DataFrame:
    """(seq, dims, rotation, center, unique_id, itype, tdata) of frames (proj, px), as they are sent.

    frames may bring columns rotation, center, unique_id, itype and dims (y, x, or z, y, x). What is missing or null is
    made up: unique_id is proj, rotation is unique_id * rotation_step, center half the width, the kind a projection; an
    image of two dimensions is one of depth 1.
    """
    have = lambda name, kind: (F.col(name) if name in frames.columns else F.lit(None)).cast(kind)
    unique = F.coalesce(have("unique_id", "int"), F.col("proj").cast("int"))
    if "dims" in frames.columns:
        depth = F.col("dims.z") if "z" in frames.schema["dims"].dataType.names else F.lit(1)
        dims = F.struct(depth.cast("int").alias("z"), F.col("dims.y").cast("int").alias("y"), F.col("dims.x").cast("int").alias("x"))
    else:
        dims = F.struct(F.lit(1).alias("z"), F.lit(side).alias("y"), F.lit(side).alias("x"))
    return frames.select(
        F.col("proj").cast("int").alias("seq"),
        dims.alias("dims"),
        F.coalesce(have("rotation", "float"), (unique * rotation_step).cast("float")).alias("rotation"),
        F.coalesce(have("center", "float"), (dims["x"] / 2.0).cast("float")).alias("center"),
        unique.alias("unique_id"),
        F.coalesce(have("itype", "tinyint"), F.lit(1).cast("tinyint")).alias("itype"),
        encoded(F.col("px")).alias("tdata"),
    )


def from_old_schema(messages: DataFrame) -> DataFrame:
    """Messages of the older schema (dims of y and x, no kind) as those of today: depth 1, the kind a projection."""
    out = messages
    if "z" not in messages.schema["dims"].dataType.names:
        out = out.withColumn("dims", F.struct(F.lit(1).alias("z"), F.col("dims.y").alias("y"), F.col("dims.x").alias("x")))
    kind = F.coalesce("itype", F.lit(1)) if "itype" in messages.columns else F.lit(1)
    return out.withColumn("itype", kind.cast("tinyint"))


def inferred_kind(payload: Column, dims: Column) -> Column:
    """The type of a payload's values, told by whole bytes a pixel: 1, 2 or 4; any other raises."""
    size = F.floor(F.octet_length(payload) / (dims["z"] * dims["y"] * dims["x"]))
    unknown = F.raise_error(F.concat(F.lit("unknown size of a pixel: "), size.cast("string"))).cast("string")
    return F.when(payload.isNull() | (size == 4), "float32").when(size == 1, "uint8").when(size == 2, "uint16").otherwise(unknown)


def received(messages: DataFrame) -> DataFrame:
    """messages with px (array<float>): each payload read as the type its size tells, squeezed to a flat image."""
    kind = inferred_kind(F.col("tdata"), F.col("dims"))
    read = F.when(kind == "uint8", decoded(F.col("tdata"), "uint8"))
    for other in ("uint16", "float32"):
        read = read.when(kind == other, decoded(F.when(kind == other, F.col("tdata")), other))
    return messages.withColumn("px", read)
