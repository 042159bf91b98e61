"""Orthogonal wavelets by rule, and one level of the discrete transform as matrices (half-point symmetric at the ends)."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np


def _roots(order: int) -> np.ndarray:
    """Roots of sum over k < order of C(order - 1 + k, k) y^k, polished in long doubles."""
    coefficients = np.array([math.comb(order - 1 + k, k) for k in range(order)][::-1], np.clongdouble)
    if order == 1:
        return np.array([], np.clongdouble)
    slope = np.polyder(np.poly1d(coefficients))
    y = np.roots(coefficients.astype(complex)).astype(np.clongdouble)
    for _ in range(8):
        y = y - np.polyval(coefficients, y) / slope(y)
    return y


def _filter(order: int, inside: list[complex]) -> np.ndarray:
    """The scaling filter of these zeros, one of z and 1 / z for each root; its sum is the root of 2."""
    h = np.array([1], np.clongdouble)
    for zero in [-1] * order + inside:
        h = np.convolve(h, np.array([1, -zero], np.clongdouble))
    h = h.real
    return (h * np.sqrt(np.longdouble(2)) / h.sum()).astype(float)


@functools.cache
def scaling_filter(kind: str, order: int) -> np.ndarray:
    """2 * order numbers. kind "haar" (order 1), "db" (all zeros inside the unit circle), "sym" (the choice of zeros with the phase nearest to linear)."""
    if kind == "haar":
        order = 1
    y = _roots(order)
    z = (1 - 2 * y) + np.sqrt((1 - 2 * y) ** 2 - 1)
    z = np.where(abs(z) < 1, z, 1 / z)
    if kind != "sym":
        return _filter(order, list(z))
    groups = [[v] for v in z if abs(v.imag) < 1e-12] + [[v, v.conjugate()] for v in z if v.imag >= 1e-12]
    at = np.exp(-1j * np.linspace(0.05, 2.5, 60))

    def bend(zeros: list[complex]) -> float:
        """How far the phase is from a line."""
        phase = np.unwrap(np.angle(np.prod([1 - v * at for v in map(complex, zeros)], axis=0)))
        line = np.polyfit(np.angle(at), phase, 1)
        return float(np.abs(phase - np.polyval(line, np.angle(at))).max())

    choices = ([v if keep else 1 / v for g, keep in zip(groups, kept, strict=True) for v in g] for kept in itertools.product((True, False), repeat=len(groups)) if not groups or kept[0])
    return _filter(order, min(choices, key=bend))


@functools.cache
def level(n: int, kind: str, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, from_low, from_high): analysis of n values into (n + length - 1) // 2 each, and synthesis of n from them.

    low @ x and high @ x are the coefficients; from_low @ a + from_high @ d is x again.
    """
    h = scaling_filter(kind, order)
    size = len(h)
    g = h[::-1] * (-1.0) ** np.arange(size)  # the high pass
    m = (n + size - 1) // 2
    low, high, from_low, from_high = np.zeros((m, n)), np.zeros((m, n)), np.zeros((n, m)), np.zeros((n, m))
    for k in range(m):
        for j in range(size):
            at = 2 * k + 2 - size + j  # a place of the sequence that its mirror images go on from
            back = at % (2 * n)
            low[k, min(back, 2 * n - 1 - back)] += h[j]
            high[k, min(back, 2 * n - 1 - back)] += g[j]
            if 0 <= at < n:
                from_low[at, k] += h[j]
                from_high[at, k] += g[j]
    return low, high, from_low, from_high
