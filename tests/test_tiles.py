"""The tiled solver against the relational one, and what both exchange."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import raytrace, tiles

N = 6


def rays(spark, count=40, slices=3, centers=False, n=N):
    rnd = np.random.default_rng(3)
    rows = [(p, 0.013 + p * 0.077, s, c, float(rnd.normal())) for p in range(count) for s in range(slices) for c in range(n)]
    own = spark.createDataFrame(rows, "proj long, theta double, slice int, col int, val double")
    return own.withColumn("center", F.when(F.col("proj") % 4 == 0, 0.0).otherwise(2.5 + (F.col("proj") % 4) * 0.25)) if centers else own


def image(df):
    return {(r["slice"], r.pix): r.val for r in df.collect()}


@pytest.mark.parametrize("iterations, centers, center", [(1, False, 0.0), (3, False, 0.0), (2, True, 0.0), (2, True, 2.8)])
def test_equal_to_the_relational_solver(spark, iterations, centers, center):
    own = rays(spark, centers=centers).cache()
    want = image(raytrace.sirt(own, N, iterations, center=center))
    got = image(tiles.sirt(own, N, iterations, center, projections=7, groups=3))
    assert len(got) == 3 * N * N
    assert all(got[k] == pytest.approx(want.get(k) or 0.0, abs=1e-6) for k in got) and want.keys() <= got.keys()


def written(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_less_than_a_third_is_exchanged(spark):
    """With tables too large for a broadcast, as they are at scale."""
    own = rays(spark, 300, n=16).cache()
    own.count()
    marks = [written(spark)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for solver in (raytrace.sirt, lambda *x: tiles.sirt(*x, groups=2)):
            solver(own, 16, 2).agg(F.sum("val")).collect()
            marks.append(written(spark))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    before, after = np.diff(marks)
    print("bytes exchanged", before, after)
    assert 0 < after < before / 3


def test_missing_and_empty(spark):
    own = rays(spark, 10).withColumn("val", F.when(F.col("col") != 2, F.col("val")))
    want = image(raytrace.sirt(own.filter("val IS NOT NULL"), N))
    got = image(tiles.sirt(own, N))
    assert all(got[k] == pytest.approx(want.get(k) or 0.0, abs=1e-6) for k in got)
    assert tiles.sirt(own.filter("false"), N, 2).count() == 0


@pytest.mark.parametrize("fixed", [0, 3])
def test_a_tile_is_traced_in_few_calls(monkeypatch, fixed):
    """Rays of all its projections at once, with the sums of one projection after the other."""
    rnd, calls = np.random.default_rng(4), []
    theta, center, px = 0.01 + np.arange(30) * 0.1, np.where(np.arange(30) % 3, 2.5, np.nan), rnd.random(30 * N)
    trace = tiles.traced
    monkeypatch.setattr(tiles, "traced", lambda *x: calls.append(1) or trace(*x))
    whole = tiles.contribution(theta, center, px, rnd.random(N * N), N, fixed)
    assert len(calls) == 1
    rnd = np.random.default_rng(4)
    rnd.random(30 * N)
    image = rnd.random(N * N)
    single = [tiles.contribution(theta[k : k + 1], center[k : k + 1], px[k * N : (k + 1) * N], image, N, fixed) for k in range(30)]
    for k in range(2):
        assert whole[k] == pytest.approx(np.sum([s[k] for s in single], 0), abs=1e-9)
