"""The sequential solver: rays correct the image one after the other; slices are independent.

A correction is an affine map of the image, and maps compose: where images are small (DENSE pixels), chunks of projections
become maps in parallel, and only these are folded in order. Larger images are one ordered fold a slice, as a map
has the square of their size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.raytrace import MARGIN, by_slice, projections, segments, traced
from lumenfold.plans.cut import cut, stash

DENSE = 256  # pixels of an image up to which chunks of projections are composed
PROJECTIONS, MAPS = 2048, 64  # of a chunk, and chunks whose maps are composed at a time
RAYS = 16  # that are solved for together: one triangular system
TRACED = 4096  # rays traced at a time

def shift(n: int, center: float) -> float:
    """The detector's shift to the center: off whole numbers by at least MARGIN, then by half a pixel (scalars.mov_sequential)."""
    mov = (n - 1) * 0.5 - center
    return (mov + MARGIN if mov - math.floor(mov) < MARGIN else mov) + 0.5


def art_segments(rays: DataFrame, n: int, center: float | None = None) -> DataFrame:
    """The sequential solver's system: its shift, crossings at least MARGIN inside, pixels numbered y + n * x."""
    return segments(rays, n, shift(n, n / 2 if center is None else center), MARGIN, by_column=True)


def composed(pix: np.ndarray, leng: np.ndarray, val: np.ndarray, own: np.ndarray) -> np.ndarray:
    """own (pixels, columns) after the corrections by rays in order; val is for its last column, 0 for the others.

    Of rays a with images f, the residuals r of RAYS corrections one after the other solve (lower triangle of a a') r = val - a f.
    """
    norm = (leng * leng).sum(1)
    there = np.flatnonzero(norm)
    count = -(-len(there) // RAYS)
    a, diagonal, b = np.zeros((count * RAYS, len(own))), np.ones(count * RAYS), np.zeros(count * RAYS)
    np.add.at(a, (np.arange(len(there))[:, None], pix[there]), leng[there])
    diagonal[: len(there)], b[: len(there)] = norm[there], val[there]
    a, b = a.reshape(count, RAYS, -1), b.reshape(count, RAYS)
    lower = np.tril(a @ a.transpose(0, 2, 1), -1)
    lower[:, range(RAYS), range(RAYS)] = diagonal.reshape(count, RAYS)
    for rays, solved, values in zip(a, np.linalg.inv(lower), b, strict=True):
        rest = -(rays @ own)
        rest[:, -1] += values
        own += rays.T @ (solved @ rest)
    return own


def maps(rays: DataFrame, n: int, mov: float, projections: int = PROJECTIONS, together: int = MAPS) -> DataFrame:
    """(slice, part, map): what a part's projections, in order, make of an image: n * n rows of n * n factors and a number to add."""
    kind = "slice int, part bigint, map binary"

    def one(own: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((own["col"].to_numpy(), own["proj"].to_numpy()))
        theta, col, val = (own[c].to_numpy()[order] for c in ("theta", "col", "val"))
        out = np.eye(n * n, n * n + 1)
        for k in range(0, len(val), TRACED):
            pix, leng = traced(theta[k : k + TRACED], col[k : k + TRACED], n, mov, MARGIN, by_column=True)
            out = composed(pix, leng, val[k : k + TRACED], out)
        return pd.DataFrame({"slice": own["slice"].iloc[:1], "part": own["part"].iloc[:1], "map": [out.tobytes()]})

    def chain(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        out = np.eye(n * n, n * n + 1)
        for x in own.sort_values("part")["map"]:
            out = after(x, out, n)
        return pd.DataFrame({"slice": [key[0]], "part": [key[1]], "map": [out.tobytes()]})

    part = F.floor(F.col("proj") / projections).cast("bigint").alias("part")
    rows = rays.select(F.col("slice").cast("int"), part, F.col("proj").cast("bigint").alias("proj"), F.col("theta").cast("double"), F.col("col").cast("int"), F.col("val").cast("double"))
    first = rows.groupBy("slice", "part").applyInPandas(one, kind)
    return first.groupBy("slice", F.floor(F.col("part") / together).alias("whole")).applyInPandas(chain, kind)


def after(packed: bytes, own: np.ndarray, n: int) -> np.ndarray:
    """A packed map of own, whose last column is an image, others factors."""
    by = np.frombuffer(packed).reshape(n * n, n * n + 1)
    out = by[:, :-1] @ own
    out[:, -1] += by[:, -1]
    return out


def applied(own: DataFrame, image: DataFrame | None, n: int) -> DataFrame:
    """(slice, pix, val) after the maps of each slice, from an image or zeros. Slices of either side have a row a pixel."""
    kind = "slice int, pix int, val double"
    start = own.sparkSession.createDataFrame([], kind) if image is None else image.select(F.col("slice").cast("int"), F.col("pix").cast("int"), F.col("val").cast("double"))

    def run(key: tuple, mine: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((n * n, 1))
        out[before["pix"].to_numpy(np.int64), 0] = before["val"]
        for x in mine.sort_values("part")["map"]:
            out = after(x, out, n)
        return pd.DataFrame({"slice": key[0], "pix": np.arange(n * n, dtype=np.int32), "val": out[:, 0]})

    return own.groupBy("slice").cogroup(start.groupBy("slice")).applyInPandas(run, kind)


def art(rays: DataFrame, n: int, iterations: int = 1, image: DataFrame | None = None, center: float | None = None, dense: int = DENSE) -> DataFrame:
    """(slice, pix, val): for each projection and column in order, (ray - simulated) / sum of squares goes back along the ray.

    rays: (proj, theta, slice, col, val). image: where to go on from (a checkpoint); else zeros. center: the detector's
    middle if None. Images of up to DENSE pixels: chunks of projections are traced and composed once, in as many tasks
    as there are chunks. Larger ones: each iteration is one pass of the sorted rays through the tasks of their slices,
    which hold one projection and one image; the image is cut between iterations.
    """
    mov = shift(n, n / 2 if center is None else center)
    if n * n <= dense:
        own = stash(maps(rays, n, mov), "maps")
        for _ in range(iterations):
            image = applied(own, image, n)
        return image

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own, pixels = None, np.zeros(0), np.arange(n * n, dtype=np.int32)
        for number, proj, theta, _, col, val in projections(frames):
            if number != at:
                if at is not None:
                    yield pd.DataFrame({"slice": at, "pix": pixels, "val": own})
                at, own = number, np.zeros(n * n)
            if proj < 0:
                own[col] = val
                continue
            pix, leng = traced(theta, col, n, mov, MARGIN, by_column=True)
            norm = (leng * leng).sum(1)
            for k in np.flatnonzero(norm).tolist():
                p, d = pix[k], leng[k]
                np.add.at(own, p, (val[k] - own[p] @ d) / norm[k] * d)
        if at is not None:
            yield pd.DataFrame({"slice": at, "pix": pixels, "val": own})

    for k in range(iterations):
        image = by_slice(rays, image).mapInPandas(run, "slice int, pix int, val double")
        if k < iterations - 1:
            image = cut(image)
    return image


def vector_forward(system: DataFrame, image: DataFrame, *keys: str) -> DataFrame:
    """Two-component model (mx, my) along rays of direction (cos, sin): sum of (mx vx + my vy) leng."""
    along = F.col("mx") * F.cos("theta") + F.col("my") * F.sin("theta")
    return system.join(image, [*keys, "pix"]).groupBy(*keys, "proj", "slice", "col").agg(F.sum(along * F.col("leng")).alias("sim"))


def volume_as_slices(volume: DataFrame, n: int, axis: int) -> DataFrame:
    """(..., slice, pix, mx, my) of a three-component volume (z, y, x, mx, my, mz) as rays across `axis` see it.

    Axis 0: slices are z, a ray's grid is (y, x) and its components are x and y. Axis 1: slices are x, the grid is
    (y, z), components y and z. Axis 2: slices are y, the grid is (x, z), components x and z.
    """
    place, row, column, first, second = {0: ("z", "y", "x", "mx", "my"), 1: ("x", "y", "z", "my", "mz"), 2: ("y", "x", "z", "mx", "mz")}[axis]
    rest = [c for c in volume.columns if c not in ("z", "y", "x", "mx", "my", "mz")]
    pix = (F.col(column) + n * F.col(row)).cast("int")
    return volume.select(*rest, F.col(place).alias("slice"), pix.alias("pix"), F.col(first).alias("__a"), F.col(second).alias("__b")).withColumnsRenamed({"__a": "mx", "__b": "my"})
