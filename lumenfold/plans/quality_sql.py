"""SQL of the multi-level image quality metrics for DuckDB, at two levels of SIDE x SIDE images: blurs and resampling as joins with kernel tables."""

from __future__ import annotations

from lumenfold.operators import image_quality as iq
from lumenfold.sources.tables import SIDE, SQL

HALF = SIDE // 2
C1, C2 = (iq.K[0] * iq.RANGE) ** 2, (iq.K[1] * iq.RANGE) ** 2


def _values(rows) -> str:
    return ", ".join(f"({a}, {b}, {x!r}::DOUBLE)" for a, b, x in rows)


def _spline() -> list[tuple[int, int, float]]:
    m = iq.spline_table(SIDE)
    return [(j, i, float(m[i, j])) for i in range(HALF) for j in range(SIDE)]


def _both_axes(source: str, kernel: str, columns: list[str]) -> str:
    """Each column times the kernel along x, then y; columns may be expressions 'expr AS name'."""
    named = [c if " AS " in c else f"{c} AS {c}" for c in columns]
    sums = ", ".join(f"sum(({c.split(' AS ')[0]}) * h.w * v.w) AS {c.split(' AS ')[1]}" for c in named)
    return f"SELECT pair, h.dst AS x, v.dst AS y, {sums} FROM {source} JOIN {kernel} h ON h.src = x JOIN {kernel} v ON v.src = y GROUP BY 1, 2, 3"


def _tables() -> str:
    near = iq.nearest(HALF, SIDE).tolist()
    return f"""p AS ({SQL["p"]}),
        k0(src, dst, w) AS (VALUES {_values(iq.blur_table(SIDE, iq.SIGMA))}),
        k1(src, dst, w) AS (VALUES {_values(iq.blur_table(HALF, iq.SIGMA))}),
        z(src, dst, w) AS (VALUES {_values(_spline())}),
        up(src, dst) AS (VALUES {", ".join(f"({s}, {d})" for d, s in enumerate(near))}),
        px0 AS (SELECT pair, (k - 1) % {SIDE} AS x, (k - 1) // {SIDE} AS y, a[k] AS a, b[k] AS b
            FROM (SELECT *, unnest(range(1, {SIDE * SIDE + 1})) AS k FROM p)),
        px1 AS ({_both_axes("px0", "z", ["a", "b"])})"""


def _index(level: int, alpha: float, beta: float) -> str:
    moments = _both_axes(f"px{level}", f"k{level}", ["a", "b", "a * a AS aa", "b * b AS bb", "a * b AS ab"])
    return f"""m{level} AS ({moments}),
        q{level} AS (SELECT pair, x, y, a, b, ab - a * b AS cov, greatest(aa - a * a, 0) AS va, greatest(bb - b * b, 0) AS vb FROM m{level}),
        s{level} AS (SELECT *, sqrt(va) * sqrt(vb) AS sd FROM q{level}),
        r{level} AS (SELECT pair, x, y, (2 * a * b + {C1!r}) / (a * a + b * b + {C1!r}) AS lum,
            (2 * sd + {C2!r}) * (cov + {C2 / 2!r}) / ((va + vb + {C2!r}) * (sd + {C2 / 2!r})) AS rest FROM s{level}),
        i{level} AS (SELECT pair, x, y, CASE WHEN rest < 0 THEN 1.0::DOUBLE
            ELSE least(greatest(pow(lum, {alpha!r}) * pow(rest, {beta!r}), -1), 1) END AS i FROM r{level})"""


def msssim() -> str:
    w = [iq.EXPONENT * x for x in iq.LEVEL_WEIGHTS]
    return f"""WITH {_tables()}, {_index(0, 0.0, w[0])}, {_index(1, iq.EXPONENT, w[1])}
        SELECT i0.pair, round(avg(i0.i * i1.i), 5) AS value FROM i0 JOIN up h ON h.dst = i0.x JOIN up v ON v.dst = i0.y
        JOIN i1 ON i1.pair = i0.pair AND i1.x = h.src AND i1.y = v.src GROUP BY 1"""


def _vif(level: int) -> str:
    return f"""b{level} AS ({_both_axes(f"px{level}", f"k{level}", ["a", "b"])}),
        d{level} AS (SELECT o.pair, o.x, o.y, o.a - b.a AS a, o.b - b.b AS b FROM px{level} o JOIN b{level} b ON b.pair = o.pair AND b.x = o.x AND b.y = o.y),
        v{level} AS ({_both_axes(f"d{level}", f"k{level}", ["a * a AS va", "b * b AS vb", "a * b AS cov"])}),
        g{level} AS (SELECT *, cov / (va + 1e-10::DOUBLE) AS g FROM v{level}),
        f{level} AS (SELECT pair, {level} AS level, {iq.SIGMA * 2**level!r}::DOUBLE AS scale,
            sum(log2(1 + g * g * va / (vb - g * cov + {iq.NOISE!r}))) / sum(log2(1 + va / {iq.NOISE!r})) AS value FROM g{level} GROUP BY pair)"""


def vifp() -> str:
    both = " UNION ALL ".join(f"SELECT pair, level, scale, round(value, 6) AS value FROM f{k}" for k in (0, 1))
    return f"WITH {_tables()}, {_vif(0)}, {_vif(1)} {both}"
