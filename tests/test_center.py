"""Centers planted in phantoms, and the search against a plain loop."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenfold.operators import center
from lumenfold.plans import catalog

DATA = "/root/testdata/sf0.001"


def phantom(n, angles, axis, discs):
    """Line integrals through discs (x, y, radius, density) about an axis that the detector sees at `axis`."""
    out = np.zeros((len(angles), n))
    for x, y, radius, density in discs:
        at = axis + np.cos(angles)[:, None] * x + np.sin(angles)[:, None] * y
        out += density * 2 * np.sqrt(np.maximum(radius**2 - (np.arange(n)[None, :] - at) ** 2, 0))
    return out


def test_planted_centers_are_found(spark):
    n, angles = 48, np.arange(60) * math.pi / 60
    axes = {0: 23.5, 1: 20.0, 2: 26.25, 3: 28.5}
    rows = []
    for s, axis in axes.items():
        px = phantom(n, angles, axis, [(0, 0, 15, 0.05), (6, 3, 3, 0.2), (-5, 7, 2, 0.3), (2, -8, 2.5, -0.05)])
        rows += [(s, p, float(angles[p]), c, float(px[p, c])) for p in range(60) for c in range(n)]
    rays = spark.createDataFrame(rows, "slice int, proj long, theta double, col int, val double")
    found = {r["slice"]: r.center for r in center.find_centers(rays, ["slice"], 8.0, 2.0, 0.5).collect()}
    assert found.keys() == axes.keys()
    for s, axis in axes.items():
        assert abs(found[s] - axis) <= 0.5, (s, found[s])


def plain_score(px, theta, c, bounds=None):
    """Filtered by np.convolve, projected back pixel by pixel, shares counted one by one; the bounds too if None are given."""
    n = px.shape[1]
    ramp = [0.25 if k == 0 else -1 / (math.pi * k) ** 2 if k % 2 else 0.0 for k in range(-n + 1, n)]
    filtered = [np.convolve(row, ramp)[n - 1 : 2 * n - 1] for row in px]
    image = []
    for y in range(n):
        for x in range(n):
            u, v = x - (n - 1) / 2, y - (n - 1) / 2
            total = 0.0
            for row, a in zip(filtered, theta, strict=True):
                at = c + u * math.cos(a) + v * math.sin(a)
                k = min(math.floor(at), n - 2)
                if 0 <= at <= n - 1:
                    total += row[k] + (at - k) * (row[k + 1] - row[k])
            image.append(total * math.pi / len(theta) if u * u + v * v <= (n / 2) ** 2 else 0.0)
    low, high = min(image), max(image)
    if bounds is None:
        return (2 * low if low < 0 else low / 2), (2 * high if high > 0 else high / 2)
    counts = [0] * 64
    for v in image:
        if bounds[0] <= v <= bounds[1]:
            counts[min(63, int((v - bounds[0]) / (bounds[1] - bounds[0]) * 64))] += 1
    return -sum((k / len(image) + 1e-12) * math.log2(k / len(image) + 1e-12) for k in counts)


def test_query_is_the_plain_search(spark):
    rays = catalog._scans_with_angles(spark, DATA).filter("scan < 2 and slice < 3").toPandas()
    got = {(r.scan, r["slice"]): (r.center, r.score) for r in catalog.find_centers(spark, DATA).filter("scan < 2 and slice < 3").collect()}
    assert len(got) == 6
    for (scan, slice_), own in rays.groupby(["scan", "slice"]):
        table = own.pivot(index="proj", columns="col", values="val").to_numpy()
        theta = own.groupby("proj")["theta"].first().to_numpy()
        bounds = plain_score(table, theta, 3.5)
        step, tried = 1.0, [3.5 + k for k in range(-2, 3)]
        while True:
            best = min((round(plain_score(table, theta, c, bounds), 9), c) for c in tried)
            if step <= 0.25:
                break
            step /= 4
            tried = [best[1] + step * k for k in range(-4, 5)]
        assert got[scan, slice_] == (best[1], round(best[0], 6))


def test_odd_rays(spark):
    schema = "slice int, proj long, theta double, col int, val double, center string"
    rows = [(0, p, p * 0.3, c, None if c == p else float("nan") if c == p + 1 else float(c), "x") for p in range(6) for c in range(5)] + [(1, 0, 0.0, 0, 1.0, "x")]
    found = {r["slice"]: r for r in center.find_centers(spark.createDataFrame(rows, schema), ["slice"], 1.0, 1.0).collect()}
    assert found.keys() == {0, 1} and all(math.isfinite(r.score) for r in found.values())
    assert center.find_centers(spark.createDataFrame([], schema), ["slice"], 1.0).count() == 0


def test_a_batch_of_sinograms_is_one_frame(spark):
    """Frames made while scoring: one a batch of rows, not one a row."""
    rays = spark.range(40 * 6).selectExpr("id div 6 AS slice", "id % 6 AS proj", "(id % 6) * 0.5D AS theta", "explode(sequence(0, 4)) AS col").withColumn("val", (F.col("slice") + F.col("col") * F.col("proj")).cast("double"))
    sinos = center.sinograms(rays, ["slice"]).coalesce(1).cache()
    batch = sinos.toPandas().assign(part=[np.array([1.5, 2.0])] * 40)
    got = list(center.each_scored(["slice"])(iter([batch])))
    assert len(got) == 1 and len(got[0]) == 80
    assert got[0].columns.tolist() == ["slice", "center", "score"]
