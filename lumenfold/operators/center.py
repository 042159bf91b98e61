"""Search for the rotation center of each slice, coarse to fine, by the entropy of its reconstruction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.plans.cut import stash

BINS = 64  # fixed value: of the histogram
TOGETHER = 4  # candidates of a slice that one row of work has
PIXELS = 1 << 16  # of all projections that are projected back at a time
LEAST = 1e-12  # fixed value: added to each bin's share


def ramp_filtered(sinogram: np.ndarray) -> np.ndarray:
    """Projections (rows) convolved with the ramp filter's samples: 1/4 at 0, -1 / (pi k)^2 at odd k, 0 at even k."""
    n = sinogram.shape[1]
    k = np.arange(-n + 1, n)
    ramp = np.where(k % 2 != 0, -1 / (np.pi * np.where(k == 0, 1, k)) ** 2, np.where(k == 0, 0.25, 0.0))
    size = 1 << (3 * n - 2).bit_length()
    out = np.fft.irfft(np.fft.rfft(sinogram, size) * np.fft.rfft(ramp, size), size)
    return out[:, n - 1 : 2 * n - 1]


def back_projected(filtered: np.ndarray, theta: np.ndarray, center: float) -> np.ndarray:
    """The square image about the rotation axis, which the detector sees at column `center`; beyond the detector there is nothing."""
    n = filtered.shape[1]
    at = np.arange(n) - (n - 1) / 2
    out = np.zeros((n, n))
    together = max(1, PIXELS // (n * n))
    for k in range(0, len(theta), together):
        own, angle = filtered[k : k + together], theta[k : k + together, None, None]
        column = center + np.cos(angle) * at[None, :] + np.sin(angle) * at[:, None]
        left = np.clip(column.astype(np.int64), 0, n - 1)
        place = left + np.arange(len(own))[:, None, None] * n
        steps = np.append(np.diff(own, axis=1), np.zeros((len(own), 1)), axis=1)
        seen = steps.take(place) * (column - left) + own.take(place)
        np.add.reduce(np.where((column >= 0) & (column <= n - 1), seen, 0.0), 0, out=seen[0])
        out += seen[0]
    return out * np.pi / len(theta)


def inside(n: int) -> np.ndarray:
    """Pixels within the circle that all angles see."""
    at = np.arange(n) - (n - 1) / 2
    return at[None, :] ** 2 + at[:, None] ** 2 <= (n / 2) ** 2


def limits(image: np.ndarray) -> tuple[float, float]:
    """Bounds of the histogram: the image's own, each moved away by half of it or all of it."""
    low, high = float(image.min()), float(image.max())
    return 2 * low if low < 0 else low / 2, 2 * high if high > 0 else high / 2


def entropy(image: np.ndarray, bounds: tuple[float, float]) -> float:
    """Bits of the histogram's shares; what is outside the bounds isn't counted."""
    low, high = bounds
    share = np.histogram(image, BINS, (low, high if high > low else low + 1))[0] / image.size + LEAST
    return float(-(share * np.log2(share)).sum())


def scores(sinogram: np.ndarray, theta: np.ndarray, candidates: list[float], middle: float) -> list[float]:
    """The entropy of the reconstruction about each candidate, in bounds that the one about `middle` sets."""
    filtered, circle = ramp_filtered(sinogram), inside(sinogram.shape[1])
    image = lambda c: back_projected(filtered, theta, c) * circle
    bounds = limits(image(middle))
    return [entropy(image(c), bounds) for c in candidates]


def sinograms(rays: DataFrame, by: list[str], value: str = "val") -> DataFrame:
    """(by..., theta, px, width): a row a sinogram, projection by projection; null, missing and not finite pixels count as 0."""

    def one(own: pd.DataFrame) -> pd.DataFrame:
        row, _ = pd.factorize(own["proj"], sort=True)
        column = own["col"].to_numpy(np.int64)
        theta, px = np.zeros(row.max() + 1), np.zeros((row.max() + 1, column.max() + 1))
        theta[row] = own["theta"].to_numpy(float)
        px[row, column] = np.nan_to_num(own[value].to_numpy(float, na_value=np.nan), nan=0.0, posinf=0.0, neginf=0.0)
        head = {name: [own[name].iloc[0]] for name in by}
        return pd.DataFrame(head | {"theta": [theta], "px": [px.ravel()], "width": [px.shape[1]]})

    kinds = ", ".join(f"`{name}` {rays.schema[name].dataType.simpleString()}" for name in by)
    return rays.select(*by, "proj", "theta", "col", value).groupBy(*by).applyInPandas(one, f"{kinds}, theta array<double>, px array<double>, width int")


def each_scored(by: list[str]):
    """Scores batches (by..., theta, px, width, part): rows (by..., center, score)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {name: [] for name in [*by, "center", "score"]}
            for r in batch.itertuples(index=False):
                centers = list(r.part)
                sinogram = np.array(r.px).reshape(-1, r.width)
                out["center"] += centers
                out["score"] += scores(sinogram, np.array(r.theta), centers, (r.width - 1) / 2)
                for name in by:
                    out[name] += [getattr(r, name)] * len(centers)
            yield pd.DataFrame(out)  # one a batch: making a frame costs as much as scoring a small sinogram

    return each


def scored(sinos: DataFrame, candidates: DataFrame, by: list[str]) -> DataFrame:
    """(by..., center, score) of all candidates (by..., centers array) in one job: rows of work are a sinogram with TOGETHER of its candidates."""
    parts = F.expr(f"transform(sequence(0, cast((size(centers) - 1) div {TOGETHER} as int)), k -> slice(centers, k * {TOGETHER} + 1, {TOGETHER}))")
    work = candidates.select(*by, F.posexplode(parts).alias("k", "part")).join(sinos, by).repartition(*by, "k")
    kinds = ", ".join(f"`{name}` {sinos.schema[name].dataType.simpleString()}" for name in by)
    return work.select(*by, "theta", "px", "width", "part").mapInPandas(each_scored(by), f"{kinds}, center double, score double")


def find_centers(rays: DataFrame, by: list[str], reach: float, step: float = 2.0, tolerance: float = 0.5, around: float | None = None, value: str = "val") -> DataFrame:
    """(by..., center, score): the column of the rotation axis of each slice of rays (by..., proj, theta, col, value).

    The first round tries centers `step` apart up to `reach` from `around` (the detector's middle without one), each
    further one a quarter of the step, up to one step of the round before from its best, until the step is at most
    `tolerance`. The least entropy wins, of equal ones the least center. A round is one job over all slices and
    candidates; its number doesn't depend on the data. A slice without a ray has no row.
    """
    sinos = stash(sinograms(rays, by, value), "sinograms")
    n = int(reach // step)
    middle = F.lit(float(around)) if around is not None else (F.col("width") - 1) / 2
    offsets = [step * k for k in range(-n, n + 1)]
    own = sinos.select(*by, F.transform(F.array(*map(F.lit, offsets)), lambda o: middle + o).alias("centers"))
    while True:
        best = stash(scored(sinos, own, by).groupBy(*by).agg(F.min(F.struct("score", "center")).alias("best")).select(*by, "best.center", "best.score"), "centers")
        if step <= tolerance:
            return best
        step /= 4
        own = best.select(*by, F.transform(F.array(*[F.lit(step * k) for k in range(-4, 5)]), lambda o: F.col("center") + o).alias("centers"))
