"""Wavelets by their properties, stripe removal against a direct convolution and on planted stripes."""

import math

import numpy as np
import pytest

from lumenfold.functions.wavelets import level, scaling_filter
from lumenfold.operators import stripes

KINDS = [("haar", 1), ("db", 2), ("db", 5), ("db", 10), ("sym", 4), ("sym", 8), ("sym", 16)]


@pytest.mark.parametrize("kind, order", KINDS)
def test_filters_are_orthonormal_with_vanishing_moments(kind, order):
    h = scaling_filter(kind, order)
    assert len(h) == 2 * order
    for k in range(order):
        assert abs((h[2 * k :] * h[: len(h) - 2 * k]).sum() - (k == 0)) < 1e-10
    g = h[::-1] * (-1.0) ** np.arange(len(h))
    for moment in range(min(order, 4)):
        assert abs((g * (np.arange(len(g)) / len(g)) ** moment).sum()) < 1e-8


def test_known_filters():
    root = math.sqrt(3)
    assert np.allclose(scaling_filter("db", 2), np.array([1 + root, 3 + root, 3 - root, 1 - root]) / (4 * math.sqrt(2)))
    sym = scaling_filter("sym", 8)
    assert np.abs(sym).argmax() in (7, 8)  # the middle: nearly symmetric


@pytest.mark.parametrize("kind, order", KINDS)
@pytest.mark.parametrize("n", [1, 2, 7, 8, 33, 64])
def test_perfect_reconstruction(kind, order, n):
    x = np.random.default_rng(n).normal(size=n)
    low, high, from_low, from_high = level(n, kind, order)
    assert np.abs(from_low @ (low @ x) + from_high @ (high @ x) - x).max() < 1e-9


def direct(s, levels, kind, order, sigma, pad):
    """The same with loops: symmetric extension, convolution, every second value; a plain sum for each frequency."""
    h = scaling_filter(kind, order)
    g = h[::-1] * (-1.0) ** np.arange(len(h))
    size = len(h)

    def split(x, f):
        m, n = (len(x) + size - 1) // 2, len(x)
        mirrored = lambda at: x[at % (2 * n)] if at % (2 * n) < n else x[2 * n - 1 - at % (2 * n)]
        return np.array([sum(f[j] * mirrored(2 * k + 2 - size + j) for j in range(size)) for k in range(m)])

    def join(a, d, n):
        out = np.zeros(2 * len(a) + size)
        for k in range(len(a)):
            out[2 * k : 2 * k + size] += a[k] * h + d[k] * g
        return out[size - 2 : size - 2 + n]

    rows = len(s) + len(s) // 8 if pad else len(s)
    top = (rows - len(s)) // 2
    a = np.zeros((rows, s.shape[1]))
    a[top : top + len(s)] = s
    kept = []
    for _ in range(levels):
        low, high = (np.apply_along_axis(split, 0, a, f) for f in (h, g))
        parts = {(i, j): np.apply_along_axis(split, 1, x, f) for i, x in enumerate((low, high)) for j, f in enumerate((h, g))}
        v = parts[0, 1]
        m = len(v)
        out = np.zeros_like(v, complex)
        for k in range(m):
            centred = (k + m // 2) % m - m // 2 if m % 2 == 0 else (k + (m - 1) // 2) % m - (m - 1) // 2
            y = centred + (0.5 if m % 2 == 0 else 0.0)
            wave = np.exp(2j * np.pi * k * np.arange(m) / m)
            out += np.outer(wave, wave.conj() @ v) / m * (1 - math.exp(-(y**2) / (2 * sigma**2)))
        parts[0, 1] = out.real
        kept.append((parts, a.shape))
        a = parts[0, 0]
    for parts, (n, columns) in reversed(kept):
        low = np.array([join(x, d, columns) for x, d in zip(a, parts[0, 1], strict=True)])
        high = np.array([join(x, d, columns) for x, d in zip(parts[1, 0], parts[1, 1], strict=True)])
        a = np.array([join(x, d, n) for x, d in zip(low.T, high.T, strict=True)]).T
    return a[top : top + len(s)]


@pytest.mark.parametrize("kind, order, levels, pad", [("haar", 1, 1, False), ("haar", 1, 3, True), ("db", 5, 2, True), ("sym", 16, 3, True)])
@pytest.mark.parametrize("shape", [(1, 8), (9, 8), (32, 12)])
def test_equal_to_a_direct_convolution(kind, order, levels, pad, shape):
    s = np.random.default_rng(1).normal(size=shape)
    want = direct(s, levels, kind, order, 1.5, pad)
    assert np.abs(stripes.without_stripes(s, levels, kind, order, 1.5, pad) - want).max() < 1e-8


def test_planted_stripes_go_and_the_rest_stays():
    n, columns = 180, 128
    angle, at = np.linspace(0, np.pi, n)[:, None], np.arange(columns)
    smooth = np.exp(-((at - 64 - 25 * np.cos(angle)) ** 2) / 120) + np.exp(-((at - 60 - 30 * np.sin(2 * angle)) ** 2) / 80)
    planted = np.zeros(columns)
    planted[[20, 45, 46, 90, 110]] = [0.5, -0.4, 0.3, 0.6, -0.5]
    clean, kept = (stripes.without_stripes(x, 4, "sym", 16, 2.0) for x in (smooth + planted, smooth))
    inner = slice(30, n - 30)
    edges = lambda x: np.abs(np.diff(x[inner], axis=1))  # noqa: E731 - a stripe is a jump between neighbouring columns
    assert edges(clean - kept).max() < 0.1 * np.abs(np.diff(planted)).max()
    assert np.abs(edges(clean) - edges(smooth)).mean() < 0.2 * np.abs(edges(smooth + planted) - edges(smooth)).mean()
    rest = lambda x: x - x.mean(0)  # noqa: E731 - what varies along the projections
    assert np.abs(rest(clean[inner]) - rest(smooth[inner])).mean() < 0.05 * np.abs(rest(smooth[inner])).mean()


def test_wide_damping_takes_slow_changes_too():
    s = np.random.default_rng(4).normal(size=(40, 24))
    narrow, wide = (np.abs(stripes.without_stripes(s, 3, "sym", 8, sigma) - s).mean() for sigma in (0.5, 20.0))
    assert narrow < wide


def test_odd_rays(spark):
    rows = [(s, p, c, None if (p, c) == (2, 1) else float(p * c + s), "x") for s in (0, 1) for p in (5, 2, 9) for c in range(4)]
    rays = spark.createDataFrame(rows, "slice int, proj long, col int, val double, note string")
    out = stripes.remove_stripes(rays, ["slice"], levels=1, kind="haar", order=1)
    assert out.columns == rays.columns
    got = {(r.slice, r.proj, r.col): r.val for r in out.collect()}
    for s in (0, 1):
        own = np.array([[0.0 if (p, c) == (2, 1) else p * c + s for c in range(4)] for p in (2, 5, 9)])
        want = stripes.without_stripes(own, 1, "haar", 1)
        for i, p in enumerate((2, 5, 9)):
            for c in range(4):
                assert got[s, p, c] is None if (p, c) == (2, 1) else abs(got[s, p, c] - want[i, c]) < 1e-12
    assert stripes.remove_stripes(rays.filter("false"), ["slice"]).count() == 0


def test_frames_one_at_a_time(spark):
    rnd = np.random.default_rng(6).normal(size=(5, 24))
    frames = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rnd)], "proj long, px array<double>")
    for r in stripes.remove_stripes_of_frames(frames, 8).collect():
        want = [stripes.without_stripes(row[None, :])[0] for row in rnd[r.proj].reshape(3, 8)]
        assert np.abs(np.array(r.px) - np.concatenate(want)).max() < 1e-9
