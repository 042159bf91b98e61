"""Full-reference image quality over pairs (pair, a, b) of flat images."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.scalars import min_max, quantised

LEVEL_WEIGHTS = [0.0448, 0.2856, 0.3001, 0.2363, 0.1333]  # fixed values
SIGMA, K, RANGE, EXPONENT, NOISE = 1.2, (0.01, 0.03), 1.0, 4.0, 2.0  # fixed values


def check(side: int, levels: int, sigma: float, value_range: float = 1.0) -> None:
    if levels < 1 or sigma < 1.2 or side / 2 ** (levels - 1) < 2 * sigma or value_range <= 0:
        raise ValueError("needs levels of at least 1, sigma of at least 1.2, a positive range, and images not too small for the levels")


def mse_psnr(pairs: DataFrame) -> DataFrame:
    """Mean squared error of the rescaled images, and peak signal to noise of their bytes (null for equal bytes)."""
    two = pairs.select("pair", min_max(F.col("a")).alias("a"), min_max(F.col("b")).alias("b"))
    square = lambda a, b: F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y))
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v) / F.size(xs)
    each = two.select("pair", mean(square(F.col("a"), F.col("b"))).alias("mse"), mean(square(quantised(F.col("a")), quantised(F.col("b")))).alias("mse8"))
    return each.select("pair", "mse", F.when(F.col("mse8") > 0, 10 * F.log10(F.lit(255.0 * 255.0) / F.col("mse8"))).alias("psnr"))


def pixels(pairs: DataFrame) -> DataFrame:
    return pairs.select("pair", F.posexplode(F.arrays_zip("a", "b")).alias("pix", "v")).select("pair", "pix", "v.a", "v.b")


def pearson(pairs: DataFrame, mask: Column | None = None) -> DataFrame:
    """Correlation of the pixels; mask: over pix, only where it holds."""
    px = pixels(pairs)
    return (px if mask is None else px.filter(mask)).groupBy("pair").agg(F.corr("a", "b").alias("pcc"))


def box_sums(images: np.ndarray, block: int) -> np.ndarray:
    """Sums over all block x block tiles of images (..., y, x): four look-ups each in the prefix sums over both axes."""
    table = np.zeros((*images.shape[:-2], images.shape[-2] + 1, images.shape[-1] + 1))
    table[..., 1:, 1:] = images.cumsum(-2).cumsum(-1)
    return table[..., block:, block:] - table[..., :-block, block:] - table[..., block:, :-block] + table[..., :-block, :-block]


def uqi(pairs: DataFrame, side: int, block: int = 4) -> DataFrame:
    """Universal quality index over block x block tiles at every place, averaged; tiles without variance count 1 if equal in mean, else the luminance term.

    A pair stays one row: no exchange. What is under a billionth of the sums that it is left of counts as no variance.
    """
    n = float(block * block)

    @F.pandas_udf("double")
    def index(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = (np.array(v, float).reshape(side, side) for v in (x, y))
            sa, sb, sab, saa, sbb = (box_sums(v, block) for v in (x, y, x * y, x * x, y * y))
            cross, squares = sa * sb, sa * sa + sb * sb
            spread = n * (saa + sbb) - squares
            flat = np.abs(spread) <= 1e-9 * n * (saa + sbb)
            luminance = np.divide(2 * cross, squares, out=np.ones_like(cross), where=squares != 0)
            contrast = np.divide(2 * (n * sab - cross), spread, out=np.ones_like(cross), where=~flat)
            out.append(float(np.where(flat | (squares == 0), luminance, contrast * luminance).mean()))
        return pd.Series(out)

    return pairs.select("pair", index("a", "b").alias("uqi"))


def gaussian(sigma: float) -> tuple[int, list[float]]:
    radius = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return radius, (w / w.sum()).tolist()


def reflected(i: int, n: int) -> int:
    """Index i of a row of n mirrored at its edges."""
    i %= 2 * n
    return i if i < n else 2 * n - 1 - i


def blur_table(side: int, sigma: float) -> list[tuple[int, int, float]]:
    """(from, to, weight) along one axis."""
    radius, w = gaussian(sigma)
    total: dict[tuple[int, int], float] = {}
    for to in range(side):
        for d in range(-radius, radius + 1):
            total[reflected(to + d, side), to] = total.get((reflected(to + d, side), to), 0.0) + w[d + radius]
    return [(a, b, x) for (a, b), x in sorted(total.items())]


def spline_table(n: int) -> np.ndarray:
    """A matrix that resamples n values at n / 2 (rounded) places from end to end, by cubic splines through the values, mirrored at the ends."""
    out = max(round(n / 2), 1)
    through = np.zeros((n, n))
    for k in range(n):
        for d, w in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
            through[k, mirrored(k + d, n)] += w
    at = np.zeros((out, n))
    for k in range(out):
        x = k * (n - 1) / (out - 1) if out > 1 else 0.0
        low = int(np.floor(x))
        for j in range(low - 1, low + 3):
            t = abs(x - j)
            weight = (2 / 3 - t * t + t**3 / 2) if t < 1 else (2 - t) ** 3 / 6 if t < 2 else 0.0
            at[k, mirrored(j, n)] += weight
    return at @ np.linalg.inv(through)


def mirrored(i: int, n: int) -> int:
    """Index i of a row of n mirrored at the middle of its outermost values."""
    if n == 1:
        return 0
    i = abs(i) % (2 * n - 2)
    return i if i < n else 2 * n - 2 - i


def nearest(n: int, out: int) -> np.ndarray:
    """The place among n values that each of `out` values, spread from end to end, is nearest to."""
    return np.floor(np.arange(out) * (n - 1) / max(out - 1, 1) + 0.5).astype(int)


def ssim(pairs: DataFrame, side: int, sigma: float = SIGMA, alpha: float = EXPONENT, beta_gamma: float = EXPONENT, value_range: float = RANGE) -> DataFrame:
    """Structural similarity by blurring five maps (a, b, a*a, b*b, a*b) along both axes with a kernel table, then averaging the clamped index.

    Variances below 0, which only rounding makes, count as 0. A negative index to a power that isn't whole is left out of the mean.
    """
    check(side, 1, sigma, value_range)
    spark = pairs.sparkSession
    rows = ",".join(f"({a},{b},{x!r}D)" for a, b, x in blur_table(side, sigma))
    kernel = F.broadcast(spark.sql(f"SELECT * FROM VALUES {rows} AS k(src, dst, w)"))  # at most side * side rows
    products = [F.col("a"), F.col("b"), (F.col("a") * F.col("a")).alias("aa"), (F.col("b") * F.col("b")).alias("bb"), (F.col("a") * F.col("b")).alias("ab")]
    px = pixels(pairs).select("pair", (F.col("pix") % side).alias("x"), F.floor(F.col("pix") / side).cast("int").alias("y"), *products)
    sums = [F.sum(F.col(c) * F.col("w")).alias(c) for c in ("a", "b", "aa", "bb", "ab")]
    wide = px.join(kernel, px.x == kernel.src).groupBy("pair", "y", F.col("dst").alias("x")).agg(*sums)
    both = wide.join(kernel, wide.y == kernel.src).groupBy("pair", "x", F.col("dst").alias("y")).agg(*sums)
    c1, c2 = (K[0] * value_range) ** 2, (K[1] * value_range) ** 2
    va, vb = F.greatest(F.col("aa") - F.col("a") * F.col("a"), F.lit(0.0)), F.greatest(F.col("bb") - F.col("b") * F.col("b"), F.lit(0.0))
    cov, sd = F.col("ab") - F.col("a") * F.col("b"), F.sqrt(va) * F.sqrt(vb)
    lum = (2 * F.col("a") * F.col("b") + c1) / (F.col("a") * F.col("a") + F.col("b") * F.col("b") + c1)
    rest = ((2 * sd + c2) / (va + vb + c2)) * ((cov + c2 / 2) / (sd + c2 / 2))
    index = F.least(F.greatest(F.pow(lum, F.lit(float(alpha))) * F.pow(rest, F.lit(float(beta_gamma))), F.lit(-1.0)), F.lit(1.0))
    return both.withColumn("s", index).groupBy("pair").agg(F.avg(F.when(~F.isnan("s"), F.col("s"))).alias("ssim"))


@functools.cache
def _blur_matrix(side: int, sigma: float) -> np.ndarray:
    m = np.zeros((side, side))
    for a, b, x in blur_table(side, sigma):
        m[b, a] = x
    return m


def _blur(stack: np.ndarray, sigma: float) -> np.ndarray:
    """A batch of images (k, side, side), along both axes."""
    m = _blur_matrix(stack.shape[1], sigma)
    return m @ stack @ m.T


def _halved(stack: np.ndarray) -> np.ndarray:
    m = spline_table(stack.shape[1])
    return m @ stack @ m.T


def ssim_maps(a: np.ndarray, b: np.ndarray, sigma: float, value_range: float, alpha: float, beta_gamma: float) -> np.ndarray:
    c1, c2 = (K[0] * value_range) ** 2, (K[1] * value_range) ** 2
    ma, mb = _blur(a, sigma), _blur(b, sigma)
    va, vb = np.maximum(_blur(a * a, sigma) - ma * ma, 0), np.maximum(_blur(b * b, sigma) - mb * mb, 0)
    cov, sd = _blur(a * b, sigma) - ma * mb, np.sqrt(va) * np.sqrt(vb)
    rest = (2 * sd + c2) * (cov + c2 / 2) / ((va + vb + c2) * (sd + c2 / 2))
    with np.errstate(invalid="ignore"):
        return np.clip(((2 * ma * mb + c1) / (ma * ma + mb * mb + c1)) ** alpha * rest**beta_gamma, -1, 1)


def msssim_maps(a: np.ndarray, b: np.ndarray, levels: int, sigma: float, value_range: float) -> np.ndarray:
    """The product over levels of their index maps, each spread to full size; the luminance enters at the last level only. NaN counts as 1."""
    side, product = a.shape[1], np.ones(a.shape)
    for level in range(levels):
        if level:
            a, b = _halved(a), _halved(b)
        own = ssim_maps(a, b, sigma, value_range, EXPONENT if level == levels - 1 else 0.0, EXPONENT * LEVEL_WEIGHTS[level])
        at = nearest(a.shape[1], side)
        product *= np.nan_to_num(own, nan=1.0)[:, at][:, :, at]
    return product


def vif_maps(a: np.ndarray, b: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """(value, map times its size) of one level's visual information fidelity; NaN where the first image has no variance."""
    da, db = a - _blur(a, sigma), b - _blur(b, sigma)
    va, vb, cov = _blur(da * da, sigma), _blur(db * db, sigma), _blur(da * db, sigma)
    g = cov / (va + 1e-10)
    top, low = np.log2(1 + g * g * va / (vb - g * cov + NOISE)), np.log2(1 + va / NOISE).sum((1, 2))
    with np.errstate(divide="ignore", invalid="ignore"):
        shares = top / low[:, None, None]
    return shares.sum((1, 2)), shares * shares[0].size


def _measured(method: str, side: int, levels: int, sigma: float, value_range: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            a, b = (np.stack(f[c].to_list()).reshape(-1, side, side) for c in "ab")

            def rows(level: int, scale: float, values: np.ndarray, maps: np.ndarray) -> pd.DataFrame:
                own = {"pair": f["pair"], "channel": f["channel"], "level": level, "scale": scale}
                return pd.DataFrame(own | {"value": np.where(np.isnan(values), None, values), "map": list(maps.reshape(len(f), -1))})

            if method == "VIFp":
                for level in range(levels):
                    if level:
                        a, b = _halved(a), _halved(b)
                    yield rows(level, sigma * 2**level, *vif_maps(a, b, sigma))
            else:
                one = method == "SSIM"
                maps = ssim_maps(a, b, sigma, value_range, EXPONENT, EXPONENT) if one else msssim_maps(a, b, levels, sigma, value_range)
                scale = sigma if one else sigma * side / _side_at(side, levels - 1)
                yield rows(0 if one else levels - 1, scale, np.nanmean(maps, (1, 2)), maps)

    return run


def _side_at(side: int, level: int) -> int:
    return side if level == 0 else _side_at(max(round(side / 2), 1), level - 1)


def quality(pairs: DataFrame, side: int, method: str = "MSSSIM", levels: int = 5, sigma: float = SIGMA, value_range: float = RANGE) -> DataFrame:
    """(pair, channel, level, scale, value, map) of square images (pair, a, b): SSIM and MSSSIM one row an image, VIFp one a level.

    Images are judged channel by channel where pairs has a column `channel` (see channels()), else channel is 0. map is
    the flat quality map, value its mean (VIFp: its sum before the map is scaled). Whole Arrow batches at a time. An
    unknown method, images too small for the levels, and other values out of range raise ValueError.
    """
    if method not in ("SSIM", "MSSSIM", "VIFp"):
        raise ValueError(f"no method {method}")
    check(side, 1 if method == "SSIM" else levels, sigma, value_range)
    if method == "MSSSIM" and levels > len(LEVEL_WEIGHTS):
        raise ValueError(f"there are weights for {len(LEVEL_WEIGHTS)} levels")
    channel = F.col("channel").cast("int") if "channel" in pairs.columns else F.lit(0)
    schema = "pair bigint, channel int, level int, scale double, value double, map array<double>"
    return pairs.select("pair", channel.alias("channel"), "a", "b").mapInPandas(_measured(method, side, levels, sigma, value_range), schema)


def channels(pairs: DataFrame, n: int) -> DataFrame:
    """(pair, channel, a, b): images of n interleaved channels, one row a channel."""
    one = lambda px: F.transform(F.sequence(F.lit(0), F.floor(F.size(px) / n).cast("int") - 1), lambda k: F.get(px, (k * n + F.col("channel")).cast("int")))
    each = pairs.select("pair", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("channel"))
    return each.select("pair", "channel", one(F.col("a")).alias("a"), one(F.col("b")).alias("b"))


def joined_metrics(*metrics: DataFrame) -> DataFrame:
    """(scale, values, maps): several results of quality(), put together by scale, in order of pair and channel."""
    every = functools.reduce(DataFrame.unionByName, metrics)
    both = F.sort_array(F.collect_list(F.struct("pair", "channel", "value", "map")))
    return every.groupBy("scale").agg(both.alias("m")).select("scale", F.col("m.value").alias("values"), F.col("m.map").alias("maps"))
