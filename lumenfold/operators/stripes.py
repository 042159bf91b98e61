"""Stripe removal: vertical details of a sinogram's wavelet transform lose what varies slowly along the projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.wavelets import level as transform


def damping(m: int, sigma: float) -> np.ndarray:
    """Factors of m frequencies, lowest first as fftshift has them: 0 about the middle, 1 far from it."""
    y = (np.arange(-m, m, 2) + 1) / 2
    return -np.expm1(-(y**2) / (2 * sigma**2))


def damped(v: np.ndarray, sigma: float) -> np.ndarray:
    """v, its columns damped in frequency; the last two axes are rows and columns."""
    spectrum = np.fft.fftshift(np.fft.fft(v, axis=-2), axes=-2) * damping(v.shape[-2], sigma)[:, None]
    return np.fft.ifft(np.fft.ifftshift(spectrum, axes=-2), axis=-2).real


def without_stripes(sinograms: np.ndarray, levels: int = 7, kind: str = "sym", order: int = 16, sigma: float = 1.0, pad: bool = True) -> np.ndarray:
    """Sinograms (..., projections, columns) without stripes along the projections.

    pad: an eighth more projections of zeros, half on each side. A level is a separable transform of both axes; of its
    parts only that of low rows and high columns is damped. Levels beyond the size of a sinogram go on with what its
    mirrored ends give, as the filters are longer.
    """
    n, columns = sinograms.shape[-2:]
    rows = n + n // 8 if pad else n
    top = (rows - n) // 2
    a = np.zeros((*sinograms.shape[:-2], rows, columns))
    a[..., top : top + n, :] = sinograms
    kept = []
    for _ in range(levels):
        size = a.shape[-2:]
        down, across = transform(size[0], kind, order), transform(size[1], kind, order)
        low, high = down[0] @ a, down[1] @ a
        vertical = damped(low @ across[1].T, sigma)
        kept.append((vertical, high @ across[0].T, high @ across[1].T, down, across))
        a = low @ across[0].T
    for vertical, horizontal, diagonal, down, across in reversed(kept):
        low = a @ across[2].T + vertical @ across[3].T
        a = down[2] @ low + down[3] @ (horizontal @ across[2].T + diagonal @ across[3].T)
    return a[..., top : top + n, :]


def remove_stripes(rays: DataFrame, by: list[str], value: str = "val", **how) -> DataFrame:
    """rays (by..., proj, col, value) without the stripes of their sinograms, one for each `by` (a scan's slice, usually).

    A task holds one sinogram; scans and slices are dealt out. A missing or null pixel counts as 0 and a null stays null.
    Rows that share a place are an error of the scan: the sinogram takes the last, each row its own change.
    """

    def one(own: pd.DataFrame) -> pd.DataFrame:
        row, projections = pd.factorize(own["proj"], sort=True)
        column = own["col"].to_numpy(np.int64)
        sinogram = np.zeros((len(projections), int(column.max()) + 1))
        values = own[value].to_numpy(float, na_value=np.nan)
        sinogram[row, column] = np.nan_to_num(values, nan=0.0, posinf=0.0, neginf=0.0)
        change = without_stripes(sinogram, **how) - sinogram
        return own.assign(**{value: values + change[row, column]})

    kind = ", ".join(f"`{f.name}` {'double' if f.name == value else f.dataType.simpleString()}" for f in rays.schema)
    out = rays.groupBy(*by).applyInPandas(one, kind)
    return out.withColumn(value, F.when(~F.isnan(value), F.col(value)))


def remove_stripes_of_frames(frames: DataFrame, width: int, px: str = "px", **how) -> DataFrame:
    """frames (px array, rows of `width`) one at a time, as a stream has them: each row of a frame is a sinogram of a single projection. No exchange."""

    def all_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            if len(own):
                values = np.stack([np.array(x, float) for x in own[px]])
                clean = without_stripes(values.reshape(-1, 1, width), **how).reshape(values.shape)
                own = own.assign(**{px: list(clean)})
            yield own

    kind = ", ".join(f"`{f.name}` {'array<double>' if f.name == px else f.dataType.simpleString()}" for f in frames.schema)
    return frames.mapInPandas(all_of, kind)
