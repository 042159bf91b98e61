"""Rays through a pixel grid, and the simultaneous solver over them.

As a table function: points where a ray crosses grid lines stay in one array a ray until they are segments, without
shuffle or window. The system table depends on angle and column only, so all slices share it. Where a solver folds
over projections in order (windows that carry the image on, sequential correction), the same geometry is traced in
numpy, a projection at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.scalars import center_or, center_override
from lumenfold.functions.scalars import mov as mov_of
from lumenfold.plans.cut import cut

MARGIN = 0.01  # of the sequential solver: how far inside the grid a crossing must lie, inclusive
NUDGE = 1e-6  # of the simultaneous solver: keeps rays off grid points


def segments(rays: DataFrame, n: int, mov: float | Column = NUDGE, margin: float | None = None, by_column: bool = False) -> DataFrame:
    """(proj, theta, col, seg, pix, leng) for rays (proj, theta, col): the pieces of each ray inside n x n pixels, by x.

    mov: shift of the detector, a number or a column of rays. margin: crossings must lie at least so far inside, as the
    sequential solver has it; None: strictly inside. Pixels are numbered x + n * y, or y + n * x if by_column.
    """
    half = n / 2
    yi = F.lit((1 - n) / 2) + (mov if isinstance(mov, Column) else F.lit(float(mov))) + F.col("col")
    line = rays.withColumns(
        {
            "sx": F.lit(-2.0 * n) * F.cos("theta") - yi * F.sin("theta"),
            "sy": F.lit(-2.0 * n) * F.sin("theta") + yi * F.cos("theta"),
            "slope": F.sin("theta") / F.cos("theta"),
        }
    )
    grid = F.array(*[F.lit(k - half) for k in range(n + 1)])
    crossing = lambda g: F.struct(((g - F.col("sy")) / F.col("slope") + F.col("sx")).alias("x"), F.lit(1).alias("kind"), g.alias("y"))
    across = F.when(F.col("slope") != 0, F.transform(grid, crossing)).otherwise(F.array().cast("array<struct<x:double,kind:int,y:double>>"))
    along = F.transform(grid, lambda g: F.struct(g.alias("x"), F.lit(0).alias("kind"), (F.col("slope") * (g - F.col("sx")) + F.col("sy")).alias("y")))

    def inside(v: Column) -> Column:
        return (v > -half) & (v < half) if margin is None else (v >= margin - half) & (v <= half - margin)

    both = F.concat(F.filter(across, lambda p: inside(p["x"])), F.filter(along, lambda p: inside(p["y"])))
    points = line.select("proj", "theta", "col", F.sort_array(both).alias("pts")).filter(F.size("pts") > 1)
    one, next_one = F.slice("pts", 1, F.size("pts") - 1), F.slice("pts", 2, F.size("pts") - 1)
    pieces = F.zip_with(one, next_one, lambda p, q: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1")))
    each = points.select("proj", "theta", "col", F.posexplode(pieces).alias("seg", "s"))
    dx, dy = F.col("s.x1") - F.col("s.x0"), F.col("s.y1") - F.col("s.y0")
    px, py = F.floor((F.col("s.x0") + F.col("s.x1")) / 2 + half), F.floor((F.col("s.y0") + F.col("s.y1")) / 2 + half)
    pix = (py + n * px if by_column else px + n * py).cast("int")
    return each.select("proj", "theta", "col", "seg", pix.alias("pix"), F.sqrt(dx * dx + dy * dy).alias("leng")).filter(F.col("pix") < n * n)


def traced(theta: float | np.ndarray, col: np.ndarray, n: int, mov: float | np.ndarray, margin: float | None = None, by_column: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The same for rays of one theta and mov, or of one each: (pix, leng), a row a ray; places without a segment have length 0."""
    half, grid = n / 2, np.arange(n + 1) - n / 2
    theta, mov = (np.reshape(v, (-1, 1)) for v in (theta, mov))
    yi = (1 - n) / 2 + mov + col[:, None]
    sin, cos = np.sin(theta), np.cos(theta)
    sx, sy, slope = -2.0 * n * cos - yi * sin, -2.0 * n * sin + yi * cos, sin / cos
    with np.errstate(divide="ignore", invalid="ignore"):
        across = (grid - sy) / slope + sx
    along = slope * (grid - sx) + sy
    low, high = (-half, half) if margin is None else (margin - half, half - margin)
    within = (lambda v: (v > low) & (v < high)) if margin is None else lambda v: (v >= low) & (v <= high)
    even = np.broadcast_to(grid, across.shape)
    keep = np.hstack([within(across) & (slope != 0), within(along)])
    x, y = np.where(keep, np.hstack([across, even]), np.inf), np.hstack([even, along])
    kind = np.repeat([1, 0], n + 1)
    order = np.lexsort((y, np.broadcast_to(kind, x.shape), x), axis=1)
    x, y = np.take_along_axis(x, order, 1), np.take_along_axis(y, order, 1)
    there = np.isfinite(x[:, 1:])
    x0, x1, y0, y1 = (np.where(there, v, 0) for v in (x[:, :-1], x[:, 1:], y[:, :-1], y[:, 1:]))
    px, py = np.floor((x0 + x1) / 2 + half).astype(np.int64), np.floor((y0 + y1) / 2 + half).astype(np.int64)
    pix = py + n * px if by_column else px + n * py
    there &= pix < n * n
    return np.where(there, pix, 0), np.where(there, np.hypot(x1 - x0, y1 - y0), 0.0)


def ray_norms(system: DataFrame) -> DataFrame:
    return system.groupBy("proj", "col").agg(F.sum(F.col("leng") * F.col("leng")).alias("nrm"))


def coverage(system: DataFrame) -> DataFrame:
    """Total length in each pixel: the denominators of the update."""
    return system.groupBy("pix").agg(F.sum("leng").alias("den"), F.count(F.lit(1)).alias("n"))


def forward(system: DataFrame, image: DataFrame, *keys: str) -> DataFrame:
    """(keys, proj, slice, col, sim): an image (slice, pix, val) seen along every ray; missing pixels are 0.

    keys: columns of both, as a volume's number, where each volume has rays of its own.
    """
    return system.join(image, [*keys, "pix"]).groupBy(*keys, "proj", "slice", "col").agg(F.sum(F.col("val") * F.col("leng")).alias("sim"))


def sirt_step(system: DataFrame, rays: DataFrame, image: DataFrame | None) -> DataFrame:
    """The image after one pass: every ray's residual, spread back along it, averaged over each pixel's lengths."""
    norms = ray_norms(system).filter("nrm > 0")
    data = rays.select("proj", "slice", "col", F.col("val").alias("ray")).join(norms, ["proj", "col"])
    if image is not None:
        data = data.join(forward(system, image), ["proj", "slice", "col"], "left").withColumn("ray", F.col("ray") - F.coalesce("sim", F.lit(0.0)))
    upd = data.select("proj", "slice", "col", (F.col("ray") / F.col("nrm")).alias("upd"))
    sums = [F.sum(F.col("leng") * F.col("upd")).alias("num"), F.sum("leng").alias("den")]
    acc = system.join(upd, ["proj", "col"]).groupBy("slice", "pix").agg(*sums)
    change = acc.select("slice", "pix", F.coalesce(F.try_divide("num", "den"), F.lit(0.0)).alias("change"))
    if image is None:
        return change.select("slice", "pix", F.col("change").alias("val"))
    whole = F.coalesce("val", F.lit(0.0)) + F.coalesce("change", F.lit(0.0))
    return image.join(change, ["slice", "pix"], "full").select("slice", "pix", whole.alias("val"))


def sirt(rays: DataFrame, n: int, iterations: int = 1, image: DataFrame | None = None, center: float = 0.0) -> DataFrame:
    """(slice, pix, val) after so many passes over the same rays.

    rays: (proj, theta, slice, col, val) and perhaps center, a projection's own rotation center, which `center` replaces
    unless it is 0; without either the detector's middle counts. Rays are traced once; lineage is cut there, and after
    each pass but the last.
    """
    own = rays.select("proj", "theta", "col", *(["center"] if "center" in rays.columns else [])).distinct()
    middle = F.lit(n / 2)
    given = center_override(F.coalesce("center", middle) if "center" in rays.columns else middle, center)
    system = cut(segments(own, n, mov_of(center_or(given, F.lit(n), "reconstruct"), F.lit(n))))
    for k in range(iterations):
        image = sirt_step(system, rays, image)
        if k < iterations - 1:
            image = cut(image)
    return image


# ---- folds over the projections of a slice


def by_slice(rays: DataFrame, image: DataFrame | None = None) -> DataFrame:
    """rays dealt by slice and sorted by projection within, for folds: one exchange. A start image comes first, as projection -1 with pixels for columns."""
    center = F.col("center").cast("double") if "center" in rays.columns else F.lit(None).cast("double")
    rows = rays.select("slice", F.col("proj").cast("long").alias("proj"), F.col("col").cast("int").alias("col"), F.col("theta").cast("double"), F.col("val").cast("double"), center.alias("center"))
    if image is not None:
        none = F.lit(None).cast("double")
        start = image.select("slice", F.lit(-1).cast("long").alias("proj"), F.col("pix").cast("int").alias("col"), none.alias("theta"), F.col("val").cast("double"), none.alias("center"))
        rows = rows.unionByName(start)
    return rows.repartition("slice").sortWithinPartitions("slice", "proj", "col")


def projections(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, float, float, np.ndarray, np.ndarray]]:
    """(slice, proj, theta, center, columns, values) of sorted rows; a projection that a batch may have cut waits for the next."""
    rest: pd.DataFrame | None = None
    for frame in frames:
        rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        slices, projs = rest["slice"].to_numpy(), rest["proj"].to_numpy()
        new = np.flatnonzero((slices[1:] != slices[:-1]) | (projs[1:] != projs[:-1])) + 1
        for a, b in zip([0, *new[:-1]], new, strict=False):
            yield _projection(rest.iloc[a:b])
        if len(new):
            rest = rest.iloc[new[-1] :]
    if rest is not None and len(rest):
        yield _projection(rest)


def _projection(rows: pd.DataFrame) -> tuple[int, int, float, float, np.ndarray, np.ndarray]:
    first = rows.iloc[0]
    return int(first["slice"]), int(first["proj"]), float(first["theta"]), float(first["center"]), rows["col"].to_numpy(), rows["val"].to_numpy()


class SlidingImage:
    """One slice's image, carried on from window to window."""

    def __init__(self, n: int, iterations: int, center: float) -> None:
        self.n, self.iterations, self.center, self.image = n, iterations, int(center), np.zeros(n * n)
        self.mov, self.rays = None, {}

    def mov_for(self, center: float) -> float:
        center = self.center or (self.n / 2 if np.isnan(center) else center)
        return self.n / 2 - (center if center > 0 else self.n / 2 + 1) + NUDGE

    def update(self, window: list[tuple]) -> None:
        """One pass over the window, with the center of its last projection; rays stay traced while the center does."""
        mov = self.mov_for(window[-1][3])
        kept = self.rays if mov == self.mov else {}
        self.mov, self.rays = mov, {p[1]: kept.get(p[1]) or traced(p[2], p[4], self.n, mov) for p in window}
        pix, leng = (np.concatenate([self.rays[p[1]][k] for p in window]) for k in range(2))
        val, norm = np.concatenate([p[5] for p in window]), (leng * leng).sum(1)
        seen = norm > 0
        pix, leng, val, norm = pix[seen], leng[seen], val[seen], norm[seen]
        den = np.bincount(pix.ravel(), leng.ravel(), self.n * self.n)
        for _ in range(self.iterations):
            upd = (val - (self.image[pix] * leng).sum(1)) / norm
            num = np.bincount(pix.ravel(), (leng * upd[:, None]).ravel(), self.n * self.n)
            self.image += np.divide(num, den, out=np.zeros_like(num), where=den > 0)


def sirt_windowed(rays: DataFrame, n: int, length: int = 32, step: int = 1, emit_every: int = 1, iterations: int = 1, center: float = 0.0) -> DataFrame:
    """(pass, slice, pix, val) of every emit_every-th count window of `length` projections that slides by `step`, then drains.

    The image goes on from window to window, so a slice is one fold in order of projection; slices are independent. A
    task holds one window of one slice. center: replaces the projections' own unless it is 0 (cut to a whole number).
    """
    from lumenfold.operators.count_window import CountWindow

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pixels = np.arange(n * n, dtype=np.int32)

        def emitted(own: SlidingImage, at: int, done: list) -> Iterator[pd.DataFrame]:
            for number, members in done:
                own.update(members)
                if number % emit_every == 0:
                    yield pd.DataFrame({"pass": number, "slice": at, "pix": pixels, "val": own.image.copy()})

        at = None
        for p in projections(frames):
            if p[0] != at:
                if at is not None:
                    yield from emitted(own, at, window.close())
                at, own, window = p[0], SlidingImage(n, iterations, center), CountWindow(length, step)
            yield from emitted(own, at, window.feed(p))
        if at is not None:
            yield from emitted(own, at, window.close())

    return by_slice(rays).mapInPandas(run, "pass int, slice int, pix int, val double")
