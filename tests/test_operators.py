"""Analytic and property tests of what SQL can't state."""

import math
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lumenfold.functions import payload
from lumenfold.operators import art, count_window, image_quality, prefix, raytrace, reorder
from lumenfold.plans import catalog
from lumenfold.sources import scans

N = 8


def sizes(windows):
    return [hi - lo for lo, hi in windows]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_windows():
    assert sizes(count_window.window_passes(10, 4, 1)) == [1, 2, 3, 4, 4, 4, 4, 4, 4, 4, 3, 2, 1]
    assert count_window.window_passes(10, 4, 3) == [(0, 3), (0, 6), (5, 9), (8, 10)]
    assert count_window.window_passes(7, 4, 2) == [(0, 2), (0, 4), (2, 6), (4, 7), (6, 7)]


@pytest.mark.parametrize(("n", "length", "step"), [(7, 4, 2), (10, 4, 1), (12, 4, 4), (5, 8, 2), (1, 4, 2)])
def test_closed_form_windows(spark, n, length, step):
    got = [(r.lo, r.hi) for r in count_window.passes(spark, n, length, step).orderBy("pass").collect()]
    assert got == count_window.window_passes(n, length, step)


def test_any_step_of_windows(spark):
    """Closed form, and members fed one by one, against the passes one after the other."""
    for n in (0, 1, 5, 9, 23):
        for length in (1, 4, 7):
            for step in (1, 3, 4, 9):
                want = count_window.window_passes(n, length, step)
                own = count_window.CountWindow(length, step)
                fed = [x for k in range(n) for x in own.feed(k)] + own.close()
                assert [(m[0], m[-1] + 1) for _, m in fed] == want and [p for p, _ in fed] == list(range(len(want)))
    got = [(r.lo, r.hi) for r in count_window.passes(spark, 10, 4, 3).orderBy("pass").collect()]
    assert got == [(0, 3), (0, 6), (5, 9), (8, 10)]


def test_length_changes_at_run_time():
    own = count_window.CountWindow(4, 1)
    sizes_ = []
    for k in range(10):
        own.length = 4 if k < 6 else 2
        sizes_ += [len(m) for _, m in own.feed(k)]
    assert sizes_ == [1, 2, 3, 4, 4, 4, 2, 2, 2, 2] and [len(m) for _, m in own.close()] == [1]


@pytest.mark.parametrize(("n", "want"), [(7, [0, 3, 6, 1, 2, 4, 5]), (8, [0, 4, 2, 6, 1, 3, 5, 7]), (10, [0, 5, 2, 4, 6, 8, 1, 3, 7, 9])])
def test_halving(spark, n, want):
    got = spark.range(n).withColumn("level", reorder.halving_level(F.col("id"), n)).orderBy("level", "id")
    assert [r.id for r in got.collect()] == want


def test_subsets_and_blocks(spark):
    idx = F.col("id")
    assert [r.id for r in spark.range(10).orderBy(*reorder.subset_key(idx, 3)).collect()] == [0, 3, 6, 9, 1, 4, 7, 2, 5, 8]
    assert [(r.start, r["size"]) for r in reorder.blocks_table(spark, 10, 4).orderBy("block").collect()] == [(0, 3), (3, 3), (6, 2), (8, 2)]


def one_system(spark, thetas):
    rays = spark.createDataFrame([(p, float(x), c) for p, x in enumerate(thetas) for c in range(N)], "proj long, theta double, col int")
    return raytrace.segments(rays, N)


def chord(theta, col):
    """Length of the ray inside the square, by clipping."""
    y = (1 - N) / 2 + col + 1e-6
    p, d = (-y * math.sin(theta), y * math.cos(theta)), (math.cos(theta), math.sin(theta))
    lo, hi = -1e9, 1e9
    for k in range(2):
        a, b = sorted(((-N / 2 - p[k]) / d[k], (N / 2 - p[k]) / d[k]))
        lo, hi = max(lo, a), min(hi, b)
    return max(0.0, hi - lo)


def test_chords(spark):
    thetas = [0.3, 1.1, 2.0, 2.9]
    got = {(r.proj, r.col): r.s for r in one_system(spark, thetas).groupBy("proj", "col").agg(F.sum("leng").alias("s")).collect()}
    for p, x in enumerate(thetas):
        for c in range(N):
            assert got.get((p, c), 0.0) == pytest.approx(chord(x, c), abs=1e-6)


def test_traced_as_the_table_function(spark):
    """The numpy form gives the segments of the DataFrame form, for both solvers."""
    thetas = [0.0, 0.3, 1.1, 2.0, 2.9]
    rays = spark.createDataFrame([(p, x, c) for p, x in enumerate(thetas) for c in range(N)], "proj long, theta double, col int")
    for system, mov, margin in ((raytrace.segments(rays, N), 1e-6, None), (art.art_segments(rays, N, 3.8), art.shift(N, 3.8), 0.01)):
        want = {}
        for r in system.collect():
            want.setdefault((r.proj, r.col), {})[r.pix] = want.get((r.proj, r.col), {}).get(r.pix, 0.0) + r.leng
        for p, x in enumerate(thetas):
            pix, leng = raytrace.traced(x, np.arange(N), N, mov, margin, by_column=margin is not None)
            for c in range(N):
                got = np.bincount(pix[c], leng[c], N * N)
                own = want.get((p, c), {})
                assert got == pytest.approx([own.get(k, 0.0) for k in range(N * N)], abs=1e-9)


def crossed(theta, col, mov, margin):
    """{(px, py): length} of a ray, from its crossings with every grid line; written out, for the tests."""
    y0 = (1 - N) / 2 + col + mov
    sx, sy = -2 * N * math.cos(theta) - y0 * math.sin(theta), -2 * N * math.sin(theta) + y0 * math.cos(theta)
    slope, points = math.tan(theta), []
    for k in range(N + 1):
        g = k - N / 2
        for x, y in ([((g - sy) / slope + sx, g)] if slope else []) + [(g, slope * (g - sx) + sy)]:
            test = y if x == g and not (y == g and slope) else x
            if (margin is None and -N / 2 < test < N / 2) or (margin is not None and margin - N / 2 <= test <= N / 2 - margin):
                points.append((x, y))
    points.sort()
    out = {}
    for (a, b), (c, d) in zip(points, points[1:]):
        cell = math.floor((a + c) / 2 + N / 2), math.floor((b + d) / 2 + N / 2)
        out[cell] = out.get(cell, 0.0) + math.hypot(c - a, d - b)
    return out


def scan(spark, thetas, slices=2, center=None):
    rng = np.random.default_rng(4)
    values = {(p, s, c): float(rng.random()) for p in range(len(thetas)) for s in range(slices) for c in range(N)}
    rows = [(p, float(thetas[p]), s, c, v, center and float(center[p])) for (p, s, c), v in values.items()]
    return values, spark.createDataFrame(rows, "proj long, theta double, slice int, col int, val double, center double")


def test_art_as_a_loop(spark):
    """Two iterations and a restart against the loop over projections and columns."""
    thetas, center = np.linspace(0.05, 3.0, 7), 3.8
    values, rays = scan(spark, thetas)
    mov = art.shift(N, center)
    want = np.zeros((2, N * N))

    def iterate():
        for p, x in enumerate(thetas):
            for c in range(N):
                cells = crossed(x, c, mov, 0.01)
                norm = sum(v * v for v in cells.values())
                for s in range(2):
                    if norm:
                        step = (values[p, s, c] - sum(want[s, b + N * a] * v for (a, b), v in cells.items())) / norm
                        for (a, b), v in cells.items():
                            want[s, b + N * a] += step * v

    as_array = lambda df: np.array([r.val for r in df.orderBy("slice", "pix").collect()]).reshape(2, -1)
    iterate()
    once = art.art(rays, N, center=center).cache()
    assert as_array(once) == pytest.approx(want, abs=1e-6)
    iterate()
    assert as_array(art.art(rays, N, 2, center=center)) == pytest.approx(want, abs=1e-6)
    assert as_array(art.art(rays, N, 1, once, center)) == pytest.approx(want, abs=1e-6)
    assert raytrace.by_slice(rays, once).count() == 7 * 2 * N + 2 * N * N


def test_composed_chunks_are_the_fold(spark):
    """Chunks of projections as maps, composed over two levels, against one fold a slice: missing rays, a start image, slices without rays."""
    _, rays = scan(spark, np.linspace(0.05, 3.0, 23))
    rays = rays.filter("(proj + 2 * col + slice) % 5 <> 0")
    start = spark.createDataFrame([(s, p, 0.1 * p - s) for s in (0, 7) for p in range(N * N)], "slice int, pix int, val double")
    table = lambda df: {(r["slice"], r.pix): r.val for r in df.collect()}
    for image in (None, start):
        want = table(art.art(rays, N, 2, image, dense=0))
        assert table(art.art(rays, N, 2, image)) == pytest.approx(want, abs=1e-9)
        own = art.maps(rays, N, art.shift(N, N / 2), projections=4, together=3).cache()
        assert own.filter("slice = 0").count() == 2
        assert table(art.applied(own, art.applied(own, image, N), N)) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(("given", "length", "step"), [(0.0, 4, 2), (0.0, 3, 2), (3.6, 5, 3)])
def test_sirt_windows_as_a_loop(spark, given, length, step):
    """Windows that slide, drain and carry the image on, each about the center of its last projection, against a loop."""
    thetas = np.linspace(0.05, 3.0, 9)
    centers = [4.0, 3.5, 0.0, 4.25, 3.9, 4.0, 4.1, 3.7, 4.4]
    values, rays = scan(spark, thetas, 2, centers)
    got = {}
    for r in raytrace.sirt_windowed(rays, N, length, step, iterations=2, center=given).collect():
        got.setdefault((r["pass"], r["slice"]), np.zeros(N * N))[r.pix] = r.val
    image = np.zeros((2, N * N))
    passes = count_window.window_passes(9, length, step)
    for number, (lo, hi) in enumerate(passes):
        c = int(given) or (centers[hi - 1] if centers[hi - 1] > 0 else N / 2 + 1)
        cells = {(p, k): crossed(thetas[p], k, N / 2 - c + 1e-6, None) for p in range(lo, hi) for k in range(N)}
        for s in range(2):
            for _ in range(2):
                num, den = np.zeros(N * N), np.zeros(N * N)
                for (p, k), own in cells.items():
                    norm = sum(v * v for v in own.values())
                    if norm:
                        step_ = (values[p, s, k] - sum(image[s, a + N * b] * v for (a, b), v in own.items())) / norm
                        for (a, b), v in own.items():
                            num[a + N * b] += v * step_
                            den[a + N * b] += v
                image[s] += np.divide(num, den, out=np.zeros(N * N), where=den > 0)
            assert got[number, s] == pytest.approx(image[s], abs=1e-6)
    assert len(got) == 2 * len(passes)


def test_zero_stays_zero_and_art_converges(spark):
    thetas = np.linspace(0.05, 3.0, 12)
    zero = spark.createDataFrame([(p, float(x), 0, c, 0.0) for p, x in enumerate(thetas) for c in range(N)], "proj long, theta double, slice int, col int, val double")
    system = art.art_segments(zero.select("proj", "theta", "col"), N).cache()
    assert raytrace.sirt(zero, N, 2).filter("val <> 0").count() == 0
    truth = spark.createDataFrame([(0, k, float(k % 5)) for k in range(N * N)], "slice int, pix int, val double")
    data = raytrace.forward(system, truth).join(zero.select("proj", "theta", "col"), ["proj", "col"]).withColumnRenamed("sim", "val")
    errors, image = [], None
    for _ in range(3):
        image = art.art(data, N, 1, image).cache()
        sim = raytrace.forward(system, image)
        errors.append(data.join(sim, ["proj", "slice", "col"]).agg(F.sum(F.pow(F.col("val") - F.col("sim"), 2))).first()[0])
    assert errors[2] <= errors[1] <= errors[0]


def test_running_sums_over_blocks(spark):
    """Channels over many days, null channels and values: as one pass over each channel."""
    rows = [(None if k % 7 == 0 else k % 3, k, None if k % 11 == 0 else float(k % 5)) for k in range(300)]
    df = spark.createDataFrame(rows, "chan long, k long, val double").withColumn("arrival", F.timestamp_seconds(F.col("k") * 5000))
    got = prefix.running(df, ["chan"], "arrival", {"total": F.col("val")}, {"before": F.col("val")}).collect()
    total, last, want = {}, {}, {}
    for chan, k, val in rows:
        want[k] = (total.get(chan, 0.0) + (val or 0.0), last.get(chan))
        total[chan] = want[k][0]
        last[chan] = val if val is not None else last.get(chan)
    assert {r.k: (r.total or 0.0, r.before) for r in got} == want and len(got) == 300


def test_equal_images(spark):
    px = [float(k * 7 % 11) for k in range(64)]
    pairs = spark.createDataFrame([(1, px, px)], "pair long, a array<double>, b array<double>")
    row = image_quality.mse_psnr(pairs).first()
    assert row.mse == 0 and row.psnr is None
    assert image_quality.pearson(pairs).first().pcc == pytest.approx(1)
    assert image_quality.ssim(pairs, 8).first().ssim == pytest.approx(1)
    for method, levels in (("SSIM", 1), ("MSSSIM", 2), ("VIFp", 2)):
        got = image_quality.quality(pairs, 8, method, levels).collect()
        assert [r.value for r in got] == pytest.approx([1] * len(got), abs=1e-6) and all(len(r.map) >= 16 for r in got)
        assert image_quality.quality(pairs.limit(0), 8, method, levels).count() == 0


def test_quality_by_channel(spark):
    """Interleaved channels are judged each for itself; both forms of SSIM agree; results join by scale."""
    rng = np.random.default_rng(2)
    a, b = rng.random((2, 64)), rng.random((2, 64))
    whole = spark.createDataFrame([(1, a.T.ravel().tolist(), b.T.ravel().tolist())], "pair long, a array<double>, b array<double>")
    parts = spark.createDataFrame([(k, a[k].tolist(), b[k].tolist()) for k in range(2)], "pair long, a array<double>, b array<double>")
    for method in ("SSIM", "MSSSIM", "VIFp"):
        by_channel = image_quality.quality(image_quality.channels(whole, 2), 8, method, 2).orderBy("channel", "level").collect()
        alone = image_quality.quality(parts, 8, method, 2).orderBy("pair", "level").collect()
        assert [r.value for r in by_channel] == pytest.approx([r.value for r in alone])
    direct = {r.pair: r.ssim for r in image_quality.ssim(parts, 8).collect()}
    assert {r.pair: r.value for r in image_quality.quality(parts, 8, "SSIM").collect()} == pytest.approx(direct)
    joined = image_quality.joined_metrics(image_quality.quality(parts, 8, "SSIM"), image_quality.quality(parts, 8, "VIFp", 2)).collect()
    assert sorted(len(r["values"]) for r in joined) == [2, 4]
    with pytest.raises(ValueError):
        image_quality.quality(parts, 8, "FSIM")


def test_resampling_goes_through_a_line():
    m = image_quality.spline_table(8)
    assert m.sum(1) == pytest.approx(np.ones(4)) and m[0, 0] == pytest.approx(1) and m[-1, -1] == pytest.approx(1)
    assert image_quality.nearest(4, 8).tolist() == [0, 0, 1, 1, 2, 2, 3, 3]


def test_quality_checks():
    for bad in ((8, 0, 1.2), (8, 1, 1.0), (8, 5, 1.2)):
        with pytest.raises(ValueError):
            image_quality.check(*bad)


def test_acquisition_file(spark, tmp_path):
    px, theta = np.arange(24, dtype="<f4"), np.array([0.1, 0.2], "<f4")
    (tmp_path / "a.bin").write_bytes(struct.pack("<3i", 2, 3, 4) + px.tobytes() + theta.tobytes())
    got = scans.read_acquisitions(spark, str(tmp_path)).orderBy("proj").collect()
    assert [r.px[0] for r in got] == [0.0, 12.0] and got[1].theta == pytest.approx(0.2)


def test_acquisition_written_and_read_back(spark, tmp_path):
    frames = spark.createDataFrame([(7, p, 0.5 * p, [float(p * 6 + k) for k in range(6)]) for p in (2, 0, 1)], "scan long, proj long, theta double, px array<double>")
    scans.write_acquisitions(scans.extract_sinogram(frames, 3), str(tmp_path), 1, 3)
    got = scans.read_acquisitions(spark, str(tmp_path / "7.data")).orderBy("proj").collect()
    assert [(list(r.px), r.theta) for r in got] == [([6.0 * p, 6.0 * p + 1, 6.0 * p + 2], 0.5 * p) for p in range(3)]


def test_outputs_of_outer_iterations(spark, tmp_path):
    image = spark.createDataFrame([(s, k, float(s + k)) for s in range(3) for k in range(4)], "slice int, pix int, val double")
    assert scans.write_iterations(image, str(tmp_path), 1).endswith("/recon_1")
    folder = scans.write_iterations(image, str(tmp_path), 0, restarted=True)
    assert folder.endswith("/cont_recon_0") and scans.read_checkpoint(spark, folder).count() == 12
    assert sorted({r["slice"] for r in scans.read_checkpoint(spark, folder, 1, 1).collect()}) == [1]


def test_scan_errors(spark):
    df = spark.createDataFrame([(1, [0.1])], "proj long, theta array<double>")
    with pytest.raises(ValueError):
        scans.read_theta(df)
    with pytest.raises(ValueError):
        scans.row_range(df, "proj", 5, 4, 8)
    assert scans.read_theta(spark.createDataFrame([(1, 0.5)], "proj long, theta float")).first().theta == 0.5


def test_payload_types(spark):
    """A payload's type is told by its size; given values stay as they are; an unknown size raises."""
    rows = [(1, bytes(range(4))), (2, np.arange(4, dtype="<u2").tobytes()), (3, np.arange(4, dtype="<f4").tobytes()), (4, None)]
    m = spark.createDataFrame(rows, "seq int, tdata binary").withColumn("dims", F.expr("struct(1 AS z, 2 AS y, 2 AS x)"))
    assert [r.px and list(r.px) for r in payload.received(m).orderBy("seq").collect()] == [[0.0, 1.0, 2.0, 3.0]] * 3 + [None]
    with pytest.raises(Exception, match="unknown size"):
        payload.received(m.limit(1).withColumn("tdata", F.lit(bytes(12)))).collect()


def test_written_images(spark, tmp_path):
    image = spark.createDataFrame([(p, 0, k, 1.0) for p in range(4) for k in range(3)], "pass int, slice int, pix int, val double")
    scans.write_image(image, str(tmp_path / "out"), 2)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["name=000000", "name=000002"]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows_only(spark, name):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
