"""Embedding whitening on exact covariances: bit-sliced scatter, integer centring, then an eigendecomposition.

A vector's entries become whole numbers x = floor(64 * c) + 1,000,000. What is left above each dimension's least x is cut
into bit planes, and each plane's bits over many rows are packed into 64-bit words. The sum over rows of a product of two
dimensions is then the sum over pairs of their planes of 2^(a+b) times the ones of plane a AND plane b: whole numbers,
so sums over tasks in any order are exact, and centring (n * sum of products - product of sums) loses nothing. Only the
covariance, correctly rounded, meets floating point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000  # fixed values
ROWS = 16_384  # that are packed together
LARGEST = 1 << 61  # of |x|: entries beyond it (|c| of 2^55 and more) can't be told as long
NO_COMPONENT = 1e-12  # a component with less than this share of the variance has none

COUNTS = [("plane", pa.int32()), ("counts", pa.list_(pa.int64()))]

Batches = Iterator[pa.RecordBatch]


def cleaned(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """The rows whose vector, as doubles, has no null and no entry that isn't finite, whatever their other columns.

    A dimension is a place in the longest such vector; shorter vectors (empty ones too) have none for some places and
    are dropped as well. So are vectors with an entry of 2^55 or more, which has no long.
    """
    least = F.lit(float(LARGEST // SCALE))
    good = F.col(vec).isNotNull() & F.forall(F.col(vec).cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < least))
    return vectors.filter(F.coalesce(good, F.lit(False)))


def entries(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """x of the vectors of this width, a row each, and where they are."""
    column = column.cast(pa.list_(pa.float64()))
    there = np.diff(column.offsets.to_numpy()) == width
    own = column.filter(pa.array(there))
    flat = own.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.floor(flat * SCALE).astype(np.int64) + OFFSET, there


@dataclass
class Moments:
    """Of all vectors: how many, and by dimension the least x, the greatest, and their sum."""

    n: int
    least: list[int]
    most: list[int]
    sums: list[int]

    @property
    def width(self) -> int:
        return len(self.least)


def moments(vectors: DataFrame, vec: str) -> Moments:
    """One pass; each task gives a row a dimension."""
    width = vectors.agg(F.max(F.size(vec))).first()[0] or 0
    if not width:
        return Moments(0, [], [], [])

    def part(batches: Batches) -> Batches:
        n, least, most, sums = 0, None, None, [0] * width
        for batch in batches:
            x, _ = entries(batch.column(0), width)
            if len(x):
                low, high = x.min(0), x.max(0)
                least, most = (low, high) if n == 0 else (np.minimum(least, low), np.maximum(most, high))
                n += len(x)
                sums = [a + int(b) for a, b in zip(sums, exact_sums(x), strict=True)]
        if n:
            kinds = [("d", pa.int32()), ("n", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("total", pa.string())]
            yield pa.RecordBatch.from_pydict({"d": list(range(width)), "n": [n] * width, "least": least, "most": most, "total": list(map(str, sums))}, schema=pa.schema(kinds))

    kinds = "d int, n bigint, least bigint, most bigint, total string"
    found = vectors.select(vec).mapInArrow(part, kinds).groupBy("d").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    rows = sorted(found.collect())  # one a dimension
    return Moments(rows[0].n, [r.least for r in rows], [r.most for r in rows], [int(r.total) for r in rows])


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums by column, from halves that can't overflow."""
    high, low = x >> 31, x & 0x7FFFFFFF
    return [(int(a) << 31) + int(b) for a, b in zip(high.sum(0), low.sum(0), strict=True)]


def planes(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bit planes of y (rows, dimensions), packed over rows: a row of 64-bit words a plane, bits[d] of them for dimension d, lowest first."""
    words = -(-len(y) // 64)
    out = np.zeros((sum(bits), words * 8), np.uint8)
    k = 0
    for d, n in enumerate(bits):
        for b in range(n):
            own = np.packbits((y[:, d] >> b & 1).astype(np.uint8))
            out[k, : len(own)] = own
            k += 1
    return out.view(np.uint64)


def overlaps(packed: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Ones of each plane AND each plane from its own dimension on; the others stay 0."""
    out = np.zeros((len(packed), len(packed)), np.int64)
    for k, first in enumerate(firsts):
        out[k, first:] = np.bitwise_count(packed[k] & packed[first:]).sum(1, dtype=np.int64)
    return out


def products(vectors: DataFrame, vec: str, m: Moments) -> list[list[int]]:
    """Sums over all vectors of y_i * y_j, y being x less the dimension's least; exact at any size.

    Each task packs blocks of rows and counts; it gives a row for each plane. The driver weights the counts: as many
    rows as planes (at most 63 a dimension), each with a count a plane.
    """
    width, least, bits = m.width, np.array(m.least), [(b - a).bit_length() for a, b in zip(m.least, m.most, strict=True)]
    owner = np.repeat(np.arange(width), bits)  # the dimension of a plane
    starts = np.concatenate(([0], np.cumsum(bits)))
    firsts, n_planes = starts[owner], int(starts[-1])
    if not n_planes:
        return [[0] * width for _ in range(width)]

    def part(batches: Batches) -> Batches:
        counts, held, size = np.zeros((n_planes, n_planes), np.int64), [], 0

        def count(y: np.ndarray) -> None:
            for k in range(0, len(y), ROWS):
                counts.__iadd__(overlaps(planes(y[k : k + ROWS], bits), firsts))

        for batch in batches:
            x, _ = entries(batch.column(0), width)
            held, size = [*held, x - least], size + len(x)
            if size >= ROWS:
                count(np.concatenate(held))
                held, size = [], 0
        if held:
            count(np.concatenate(held))
        yield pa.RecordBatch.from_pydict({"plane": list(range(n_planes)), "counts": list(counts)}, schema=pa.schema(COUNTS))

    def summed(batches: Batches) -> Batches:
        """Counts of a task's planes, by plane: what tasks give is added up on the way, so each plane's rows stay few."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().reshape(-1, n_planes)
            for k, row in zip(batch.column(0).to_pylist(), rows, strict=True):
                sums[k] = sums[k] + row if k in sums else row
        yield pa.RecordBatch.from_pydict({"plane": list(sums), "counts": list(sums.values())}, schema=pa.schema(COUNTS))

    kinds = "plane int, counts array<bigint>"
    found = vectors.select(vec).mapInArrow(part, kinds).repartition("plane").mapInArrow(summed, kinds)
    out = [[0] * width for _ in range(width)]
    weight = [1 << int(k - s) for k, s in enumerate(firsts)]
    for r in found.toLocalIterator():
        i = int(owner[r.plane])
        for j in range(i, width):
            out[i][j] += weight[r.plane] * sum(weight[k] * r.counts[k] for k in range(starts[j], starts[j + 1]))
    for i in range(width):
        for j in range(i):
            out[i][j] = out[j][i]
    return out


@dataclass
class Whitening:
    """A fitted whitening: moments, the matrix that a centred x is multiplied by, and each component's share of the variance."""

    moments: Moments
    matrix: np.ndarray
    explained: list[float]


def fit(vectors: DataFrame, vec: str = "embedding", components: int = 32) -> Whitening:
    """Whitening of all vectors of `vectors` (as cleaned gives them), by falling variance; components without variance are left out."""
    m = moments(vectors, vec)
    if not m.n:
        return Whitening(m, np.zeros((0, 0)), [])
    above = [s - m.n * low for s, low in zip(m.sums, m.least, strict=True)]  # sums of y; centring doesn't see the shift
    crossed = products(vectors, vec, m)
    centred = [[m.n * crossed[i][j] - above[i] * above[j] for j in range(m.width)] for i in range(m.width)]
    covariance = np.array([[c / (m.n * m.n) for c in row] for row in centred])  # whole numbers: each quotient is rounded once
    trace = sum(centred[i][i] for i in range(m.width)) / (m.n * m.n)
    values, axes = np.linalg.eigh(covariance)
    order = [k for k in np.argsort(-values, kind="stable") if values[k] > NO_COMPONENT * trace][:components]
    axes = axes[:, order]
    largest = axes[np.abs(axes).argmax(0), np.arange(len(order))]
    axes = axes * np.where(largest < 0, -1.0, 1.0)  # the sign is free: the largest entry is positive
    return Whitening(m, axes / np.sqrt(values[order]), (values[order] / trace).tolist())


def projected(x: np.ndarray, w: Whitening) -> np.ndarray:
    """Rows of x, centred and whitened. The centre is split so that no digit of x - S / n is lost to the size of x."""
    m = w.moments
    whole = np.array([s // m.n for s in m.sums])
    rest = np.array([(s % m.n) / m.n for s in m.sums])
    return ((x - whole).astype(np.float64) - rest) @ w.matrix


def deviations(x: np.ndarray, m: Moments) -> list[int | None]:
    """Sums over dimensions of (n * x - S)^2, exact; None where that is no long."""
    most = max(m.n * max(abs(high * m.n - s), abs(low * m.n - s)) // m.n for low, high, s in zip(m.least, m.most, m.sums, strict=True))
    if m.width * most * most < 1 << 63:
        whole = m.n * x - np.array(m.sums)
        return (whole * whole).sum(1).tolist()
    found = [sum((m.n * v - s) ** 2 for v, s in zip(row, m.sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in found]


def identity_error(vectors: DataFrame, w: Whitening, vec: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, over all rows."""
    k, width = len(w.explained), w.moments.width

    def part(batches: Batches) -> Batches:
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            out = projected(entries(batch.column(0), width)[0], w)
            total, square = total + out.sum(0), square + out.T @ out
        yield pa.RecordBatch.from_pydict({"cell": list(range(k * k + k)), "v": np.concatenate((square.ravel(), total))}, schema=pa.schema([("cell", pa.int32()), ("v", pa.float64())]))

    cells = vectors.select(vec).mapInArrow(part, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    found = np.array([v for _, v in sorted(cells.collect())])  # components * (components + 1) rows
    square, total = found[: k * k].reshape(k, k) / w.moments.n, found[k * k :] / w.moments.n
    return float(np.abs(square - np.outer(total, total) - np.eye(k)).max())


OUT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", components: int = 32) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained and identity_error of each vector and component.

    Nulls: a row without a vector, or with a null or not finite entry, is dropped (see cleaned); a null id stays, and
    repeated rows are vectors of their own. Vectors that are all alike, and an empty table, have no component and give
    an empty result. Other columns, whatever their names, play no part. Tied variances come in any order.
    """
    own = cleaned(vectors.select(F.col(id_col).alias("id"), F.col(vec).alias("vec")), "vec")
    spark, kind = own.sparkSession, own.schema["id"].dataType.simpleString()
    w = fit(own, "vec", components)
    k = len(w.explained)
    if not k:
        return spark.createDataFrame([], f"{id_col} {kind}, {OUT}")
    error, m = identity_error(own, w, "vec"), w.moments

    def rows(batches: Batches) -> Batches:
        for batch in batches:
            x, there = entries(batch.column(1), m.width)
            ids = batch.column(0).filter(pa.array(there))
            for a in range(0, len(x), 2000):
                part = x[a : a + 2000]
                each = np.repeat(np.arange(len(part)), k)
                columns = [ids[a : a + 2000].take(pa.array(each)), np.tile(np.arange(1, k + 1, dtype=np.int32), len(part)), np.full(len(each), m.n), pa.array(deviations(part, m), pa.int64()).take(pa.array(each))]
                columns += [projected(part, w).ravel(), np.tile(w.explained, len(part)), np.full(len(each), error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[id_col, *(c.split()[0] for c in OUT.split(", "))])

    return own.select("id", "vec").mapInArrow(rows, f"{id_col} {kind}, {OUT}")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLES = {}
