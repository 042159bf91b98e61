"""Whitening against plain integer arithmetic and a plain eigendecomposition."""

import math

import numpy as np
import pytest

from lumenfold.llm import whitening

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, component string, id string, vec string, n string"


def plain(vectors):
    """n, sums, covariance, all by Python's whole numbers."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, width = len(x), len(x[0])
    s = [sum(r[d] for r in x) for d in range(width)]
    v = np.array([[(n * sum(r[i] * r[j] for r in x) - s[i] * s[j]) / n**2 for j in range(width)] for i in range(width)])
    return x, n, s, v


def check(rows, vectors, ids, k):
    x, n, s, v = plain(vectors)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    centred = np.array([[a - b / n for a, b in zip(r, s, strict=True)] for r in x])
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    got = np.zeros((n, k))
    place = {i: p for p, i in enumerate(ids)}
    assert len(rows) == n * k
    for r in rows:
        p = place[r.vec_id]
        assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(x[p], s, strict=True))
        assert abs(r.explained - values[r.component - 1] / np.trace(v)) < 1e-9
        got[p, r.component - 1] = r.whitened
    signs = np.sign((got * want).sum(0))
    assert np.abs(got * signs - want).max() < 1e-6
    assert len({r.identity_error for r in rows}) == 1 and 0 <= rows[0].identity_error < 1e-6


def test_query_is_plain_arithmetic(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    rows = whitening.op13_whitening(spark, DATA).collect()
    check(rows, [r.embedding for r in table], [r.vec_id for r in table], 32)


def test_products_are_exact_at_any_size(spark):
    rnd = np.random.default_rng(1)
    values = rnd.normal(size=(300, 5)) * [1e-3, 1, 1e3, 1e9, 1e13]
    values[:, 0] = 7.0  # has no plane
    table = spark.createDataFrame([(v.tolist(),) for v in values], "v array<double>").repartition(3)
    m = whitening.moments(table, "v")
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in values.tolist()]
    assert (m.n, m.sums) == (300, [sum(r[d] for r in x) for d in range(5)])
    y = [[a - low for a, low in zip(r, m.least, strict=True)] for r in x]
    assert whitening.products(table, "v", m) == [[sum(r[i] * r[j] for r in y) for j in range(5)] for i in range(5)]
    far = np.array(x[:3])
    assert whitening.deviations(far, m) == [v if v < 1 << 63 else None for v in (sum((m.n * a - b) ** 2 for a, b in zip(r, m.sums, strict=True)) for r in x[:3])]


def test_blocks_and_planes():
    rnd = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 1000):
        y = rnd.integers(0, 37, (n, 4))
        bits = [6, 6, 6, 6]
        packed = whitening.planes(y, bits)
        counts = whitening.overlaps(packed, np.repeat([0, 6, 12, 18], 6))
        for i in range(4):
            for j in range(i, 4):
                own = sum(int(counts[6 * i + a, 6 * j + b]) << a + b for a in range(6) for b in range(6))
                assert own == int((y[:, i] * y[:, j]).sum())


def test_odd_rows(spark):
    rnd = np.random.default_rng(3)
    good = [(k, rnd.normal(size=3).tolist()) for k in range(40)]
    same = [(k, [0.5, 0.25, -0.5]) for k in range(100, 120)]  # a group of copies
    bad = [(900, None), (901, [1.0, None, 2.0]), (902, [1.0, float("nan"), 2.0]), (903, [float("inf"), 1.0, 2.0]), (904, []), (905, [1.0]), (906, [1.0, 1e38, 0.0])]
    table = spark.createDataFrame([(i, v, "a", "b", "c", None) for i, v in good + same + bad], SCHEMA).repartition(5)
    stored = {r.vec_id: r.embedding for r in table.collect()}
    ids = [i for i, _ in good + same]
    check(whitening.whiten(table).collect(), [stored[i] for i in ids], ids, 3)
    twice = whitening.whiten(table.unionByName(table.withColumn("vec_id", table.vec_id * 0 + None)))
    assert twice.count() == 2 * 60 * 3 and twice.filter("vec_id is null").count() == 60 * 3


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_no_variance_gives_no_row(spark, rows):
    own = whitening.whiten(spark.createDataFrame([(i, v, None, None, None, None) for i, v in rows], SCHEMA))
    assert own.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and own.count() == 0


def test_a_dependent_dimension_has_no_component(spark):
    rows = [(k, [float(k % 7), float(k % 5), float(k % 7)], None, None, None, None) for k in range(70)]
    own = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert own.agg({"component": "max"}).first()[0] == 2
