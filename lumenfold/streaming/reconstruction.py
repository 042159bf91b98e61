"""Reconstruction while projections arrive: each slice's image and window are its state, published images go out idempotently."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenfold.operators.count_window import CountWindow
from lumenfold.operators.raytrace import SlidingImage
from lumenfold.plans.cut import noted, shared_dir
from lumenfold.sources.scans import END
from lumenfold.streaming.sources import LENGTH, acquire, keep_state_on_disk, opened

NAN = float("nan")
IMAGES = "pass int, slice int, image array<double>"
FRAME = "proj bigint, itype int, theta double, center double, px array<double>"
IMAGE = "number int, length int, image array<double>"
MEMBERS = "is_new boolean, proj bigint, theta double, center double, val array<double>"


class Slice(StatefulProcessor):
    """One slice: an image that goes on from window to window, and the window's projections, one list entry each."""

    def __init__(self, n: int, length: int, step: int, emit_every: int, iterations: int, center: float) -> None:
        self.n, self.length, self.step, self.emit_every, self.iterations, self.center = n, length, step, emit_every, iterations, center

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.image, self.members = handle.getValueState("image", IMAGE), handle.getListState("members", MEMBERS)

    def _load(self, at: int) -> tuple[SlidingImage, CountWindow]:
        own, window = SlidingImage(self.n, self.iterations, self.center), CountWindow(self.length, self.step)
        if self.image.exists():
            window.number, window.length, image = self.image.get()
            own.image = np.array(image)
            for is_new, proj, theta, center, val in self.members.get():
                (window.new if is_new else window.held).append((at, proj, theta, NAN if center is None else center, np.arange(len(val)), np.array(val)))
        return own, window

    def _store(self, own: SlidingImage, window: CountWindow) -> None:
        self.image.update((window.number, window.length, own.image.tolist()))
        self.members.put([(is_new, p[1], p[2], None if np.isnan(p[3]) else p[3], p[5].tolist()) for is_new, part in ((False, window.held), (True, window.new)) for p in part])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """A micro-batch's messages of a slice, in order of projection; a new length (kind LENGTH) holds from its place on, an end comes last."""
        m = pd.concat(list(rows), ignore_index=True)
        m["late"] = m["itype"].map({LENGTH: 1, END: 2}).fillna(0)
        m = m.sort_values(["proj", "late"], kind="stable")
        own, window = self._load(key[0])
        out = []
        for r in m.itertuples(index=False):
            if r.itype == END:
                out += self._published(key[0], own, window.close())
                own, window = SlidingImage(self.n, self.iterations, self.center), CountWindow(self.length, self.step)
            elif r.itype == LENGTH:
                window.length = max(1, int(r.theta))
            else:
                val = np.array(r.val, float)
                out += self._published(key[0], own, window.feed((key[0], r.proj, r.theta, NAN if r.center is None else r.center, np.arange(len(val)), val)))
        if window.number or window.new:
            self._store(own, window)
        else:
            self.image.clear()
            self.members.clear()
        yield pd.DataFrame(out, columns=["pass", "slice", "image"])

    def _published(self, at: int, own: SlidingImage, passes: list) -> list[tuple]:
        out = []
        for number, members in passes:
            own.update(members)
            if number % self.emit_every == 0:
                out.append((number, at, own.image.tolist()))
        return out


def images(stream: DataFrame, n: int, slices: int, length: int = 32, step: int = 1, emit_every: int = 1, iterations: int = 1, center: float = 0.0) -> DataFrame:
    """(pass, slice, image) of a stream of frames (FRAME; px has a row of n values a slice): every emit_every-th pass of a sliding count window.

    As raytrace.sirt_windowed gives it over all rows. Frames of kind END drain all slices, kind LENGTH sets the window's
    length (in theta). Slices are dealt out; a task holds one slice's window and image at a time. A frame without px has zeros.
    """
    keep_state_on_disk(stream.sparkSession)
    part = F.slice("px", F.col("slice") * n + 1, n)
    rows = stream.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select("slice", "proj", "itype", "theta", "center", F.coalesce(part, F.array_repeat(F.lit(0.0), n)).alias("val"))
    return rows.groupBy("slice").transformWithStateInPandas(Slice(n, length, step, emit_every, iterations, center), IMAGES, "Append", "None")


def publish(out: DataFrame, top: str) -> None:
    """Writes images as they come, a folder a micro-batch: a batch that runs again after a failure replaces its own folder, so nothing is there twice.

    Goes on where an earlier call with the same `top` stopped.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/images/batch={number}")

    out.writeStream.foreachBatch(one).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()


def published(spark: SparkSession, top: str) -> DataFrame:
    """(pass, slice, pix, val) of all that has been published."""
    return spark.read.schema(IMAGES).parquet(f"{top}/images/*").select("pass", "slice", F.posexplode("image").alias("pix", "val"))


def frame_stream(frames: DataFrame, folder: str, parts: int = 4) -> DataFrame:
    """Frames (proj, theta, center, px) as an acquisition sends them, then an end message."""
    own = frames.select("proj", F.lit(1).alias("itype"), "theta", "center", "px")
    ends = frames.agg(F.max("proj").alias("proj")).select("proj", F.lit(END).alias("itype"), F.lit(0.0).alias("theta"), F.lit(None).cast("double").alias("center"), F.lit(None).cast("array<double>").alias("px"))
    acquire(own, "proj", ends, folder, parts)
    return opened(frames.sparkSession, folder, FRAME)


def reconstructed(frames: DataFrame, n: int, slices: int, parts: int = 4, **how) -> DataFrame:
    """(pass, slice, pix, val): frames sent as a stream, reconstructed on the way, published, and read back."""
    top = noted(frames.sparkSession, f"{shared_dir(frames.sparkSession)}/live-{uuid.uuid4().hex}")
    publish(images(frame_stream(frames, f"{top}/frames", parts), n, slices, **how), top)
    return published(frames.sparkSession, top)
