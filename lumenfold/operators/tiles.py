"""The simultaneous solver on tiles: a tile is some projections of one slice, dense; partial images are what is exchanged.

The relational form exchanges a row for each segment and slice in each pass. Here rays are traced where they are used,
each task adds its tiles' contributions up in a dense image, and only these partial sums and the image itself move.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.raytrace import NUDGE, traced
from lumenfold.plans.cut import stash

PROJECTIONS = 64  # of a tile
GROUPS = 16  # that a slice's tiles are dealt over: as many tasks can work on one slice
PIXELS = 4096  # of a block of partial sums
CELLS = 1 << 18  # crossings traced at a time


def tiles(rays: DataFrame, n: int, projections: int = PROJECTIONS, groups: int = GROUPS) -> DataFrame:
    """(slice, g, theta, center, px) of rays (proj, theta, slice, col, val and perhaps center): a row a tile, px its projections' n values one after the other, NaN where there is none."""
    center = F.col("center").cast("double") if "center" in rays.columns else F.lit(None).cast("double")
    tile = F.floor(F.col("proj") / projections).cast("bigint")
    rows = rays.select("slice", tile.alias("tile"), F.col("proj").cast("bigint").alias("proj"), F.col("theta").cast("double"), center.alias("center"), F.col("col").cast("int"), F.col("val").cast("double"))

    def one(own: pd.DataFrame) -> pd.DataFrame:
        row, projs = pd.factorize(own["proj"], sort=True)
        px, theta, centers = np.full((len(projs), n), np.nan), np.zeros(len(projs)), np.full(len(projs), np.nan)
        px[row, own["col"].to_numpy()], theta[row], centers[row] = own["val"], own["theta"], own["center"]
        return pd.DataFrame({"slice": [own["slice"].iloc[0]], "g": [int(own["tile"].iloc[0] % groups)], "theta": [theta], "center": [centers], "px": [px.ravel()]})

    kind = rays.schema["slice"].dataType.simpleString()
    return rows.groupBy("slice", "tile").applyInPandas(one, f"slice {kind}, g int, theta array<double>, center array<double>, px array<double>")


def contribution(theta: np.ndarray, center: np.ndarray, px: np.ndarray, image: np.ndarray, n: int, fixed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted updates and weights by pixel, of one tile against an image; fixed: a center for all projections unless 0."""
    num, den, columns, rows = np.zeros(n * n), np.zeros(n * n), np.arange(n), px.reshape(-1, n)
    own = np.full(len(theta), float(fixed)) if fixed else np.where(np.isnan(center), n / 2, center)
    mov = n / 2 - np.where(own > 0, own, n / 2 + 1) + NUDGE
    together = max(1, CELLS // (2 * n * (n + 1)))
    for k in range(0, len(theta), together):
        values = rows[k : k + together]
        pix, leng = traced(np.repeat(theta[k : k + together], n), np.tile(columns, len(values)), n, np.repeat(mov[k : k + together], n))
        values, norm = values.ravel(), (leng * leng).sum(1)
        seen = (norm > 0) & ~np.isnan(values)
        pix, leng = pix[seen], leng[seen]
        update = (values[seen] - (image[pix] * leng).sum(1)) / norm[seen]
        num += np.bincount(pix.ravel(), (leng * update[:, None]).ravel(), n * n)
        den += np.bincount(pix.ravel(), leng.ravel(), n * n)
    return num, den


def step(own: DataFrame, image: DataFrame | None, n: int, fixed: int, groups: int = GROUPS) -> DataFrame:
    """(slice, block, val): one pass of all tiles over images (slice, block, val; zeros without one). A task holds one slice's image, one tile, and partial sums."""
    kind = own.schema["slice"].dataType.simpleString()
    out = f"slice {kind}, block int, num array<double>, den array<double>"
    blocks = -(-n * n // PIXELS)

    def partial(key: tuple, mine: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        now = np.zeros(n * n)
        for block, val in zip(before["block"], before["val"], strict=True):
            now[block * PIXELS : (block + 1) * PIXELS] = val
        num, den = np.zeros(n * n), np.zeros(n * n)
        for theta, center, px in zip(mine["theta"], mine["center"], mine["px"], strict=True):
            a, b = contribution(np.asarray(theta), np.asarray(center, float), np.asarray(px), now, n, fixed)
            num, den = num + a, den + b
        cut = [slice(k * PIXELS, (k + 1) * PIXELS) for k in range(blocks)] if len(mine) else []
        return pd.DataFrame({"slice": [key[0]] * len(cut), "block": range(len(cut)), "num": pd.Series([num[c] for c in cut], dtype=object), "den": pd.Series([den[c] for c in cut], dtype=object)})

    start = own.sparkSession.createDataFrame([], f"slice {kind}, block int, val array<double>") if image is None else image
    spread = start.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    parts = own.groupBy("slice", "g").cogroup(spread.groupBy("slice", "g")).applyInPandas(partial, out)

    def total(mine: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({"slice": [], "block": [], "val": pd.Series([], dtype=object)})
        num, den = np.sum(np.stack(mine["num"]), 0), np.sum(np.stack(mine["den"]), 0)
        val = np.asarray(before["val"].iloc[0]) if len(before) else np.zeros(len(num))
        return pd.DataFrame({"slice": mine["slice"].iloc[:1], "block": mine["block"].iloc[:1], "val": [val + np.divide(num, den, out=np.zeros_like(num), where=den > 0)]})

    return parts.groupBy("slice", "block").cogroup(start.groupBy("slice", "block")).applyInPandas(total, f"slice {kind}, block int, val array<double>")


def sirt(rays: DataFrame, n: int, iterations: int = 1, center: float = 0.0, projections: int = PROJECTIONS, groups: int = GROUPS) -> DataFrame:
    """(slice, pix, val) after so many passes, as raytrace.sirt gives it but for pixels that no ray meets, which are 0 here.

    Ranges that exchange: a slice's tiles once a pass, its image to each group of its tiles, and a partial image from each.
    A null value is a ray that wasn't measured. Of rays that share a place the last counts.
    """
    own, image = stash(tiles(rays, n, projections, groups), "tiles"), None
    for k in range(iterations):
        image = step(own, image, n, int(center), groups)
        if k < iterations - 1:
            image = stash(image, "image")
    return image.select("slice", F.posexplode("val").alias("p", "val"), "block").select("slice", (F.col("block") * PIXELS + F.col("p")).cast("int").alias("pix"), "val")
