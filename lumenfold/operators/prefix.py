"""Running sums and last values in order of arrival, in one ordered pass: the rows are exchanged once, for all of them.

Rows are dealt by ranges of (key, order), whose boundaries Spark samples so that each range has about as many rows,
however a key's rows lie in time: a key with a third of all rows, or one with all its rows in a day, is dealt over as
many tasks as its rows need. Each range is scanned from its start. What a range doesn't know is the state that its first
key brings from the ranges before: sums since the last reset, and last values. States merge (a reset, or another key,
forgets what was before), so the ends of all ranges, a row each, give what enters each range, and that is added to the
rows that come before the first reset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lumenfold.plans.cut import stash

Sum = Column | tuple[Column, Column]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df has no column of."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def changes(column: pa.Array) -> np.ndarray:
    """Where a value isn't the one before; nulls are alike. Not asked about the first."""
    if not len(column):
        return np.zeros(0, bool)
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    no_a, no_b = pc.is_null(a), pc.is_null(b)
    other = pc.if_else(pc.or_(no_a, no_b), pc.xor(no_a, no_b), pc.fill_null(pc.not_equal(a, b), False))
    return np.concatenate(([False], other.to_numpy(zero_copy_only=False)))


def in_order(values: np.ndarray, start: np.ndarray, before: float) -> np.ndarray:
    """Sums that begin anew at each start, added one value after the other as SQL adds them, the first to `before`.

    Not compensated, as pandas' are: where a value equals a mean of others, the last bit decides whether a difference is zero.
    """
    out = values.astype(float)
    if len(out) and not start[0]:
        out[0] += before
    cuts = [0, *np.flatnonzero(start).tolist(), len(out)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = np.add.accumulate(out[a:b])
    return out


class RangeScan:
    """The scan of one range, batch by batch. A sum or last value is open until a key or reset in this range determines it alone."""

    def __init__(self, keys: list[str], sums: dict[str, tuple[str, str | None]], lasts: dict[str, str]) -> None:
        self.keys, self.sums, self.lasts = keys, sums, lasts
        self.key: list | None = None
        self.sum = dict.fromkeys(sums, 0)
        self.last: dict[str, object] = dict.fromkeys(lasts)
        self.open = dict.fromkeys([*sums, *lasts], True)

    def feed(self, batch: pa.RecordBatch) -> dict[str, tuple[pa.Array, np.ndarray]]:
        """For each name: the rows' values as far as this range knows, and which are still open."""
        new = np.zeros(batch.num_rows, bool)
        for name in self.keys:
            new |= changes(batch.column(name))
        first = [batch.column(name)[0].as_py() for name in self.keys]
        new[0] = self.key is not None and first != self.key
        self.key = [batch.column(name)[-1].as_py() for name in self.keys]
        return {n: self._sum(n, batch, new) for n in self.sums} | {n: self._last(n, batch, new) for n in self.lasts}

    def _sum(self, name: str, batch: pa.RecordBatch, new: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        value, reset = self.sums[name]
        start = new if reset is None else new | pc.fill_null(batch.column(reset), False).to_numpy(zero_copy_only=False)
        part = np.cumsum(start)
        values = pc.fill_null(batch.column(value), 0).to_numpy(zero_copy_only=False)
        if values.dtype.kind == "f":
            out = in_order(values, start, self.sum[name])
        else:
            out = pd.Series(values).groupby(part).cumsum().to_numpy()
            out = np.where(part == 0, out + self.sum[name], out)
        still = (part == 0) & self.open[name]
        self.sum[name], self.open[name] = out[-1], bool(still[-1])
        return pa.array(out), still

    def _last(self, name: str, batch: pa.RecordBatch, new: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        values, place = batch.column(self.lasts[name]), np.arange(batch.num_rows)
        there = pc.is_valid(values).to_numpy(zero_copy_only=False)
        begin = np.maximum.accumulate(np.where(new, place, 0))  # where the row's key begins in this batch
        newest = np.maximum.accumulate(np.where(there, place, -1))
        before = np.concatenate(([-1], newest[:-1]))  # the newest value before the row, of any key
        own = before >= begin
        out = values.take(pa.array(np.where(own, before, 0), mask=~own))
        first_key = np.cumsum(new) == 0
        out = pc.if_else(pa.array(first_key & ~own), pa.scalar(self.last[name], values.type), out)
        still = first_key & ~own & self.open[name]
        if there[begin[-1] :].any():
            self.last[name], self.open[name] = values[int(newest[-1])].as_py(), False
        elif not first_key[-1]:
            self.last[name], self.open[name] = None, False
        return out, still


def entering(ends: list[Row], sums: dict[str, float], lasts: list[str]) -> list[tuple]:
    """(range, each sum, each last value) that enter each range, from the ends of all ranges in order; sums: what they begin with."""
    out, key, state = [], None, sums | dict.fromkeys(lasts)
    for r in ends:
        if key is None or r.first != key:
            state = sums | dict.fromkeys(lasts)
        out.append((r.range, *[state[n] for n in [*sums, *lasts]]))
        one, key, own = r.first == r.last, r.last, r.state.asDict()
        for n in sums:
            state[n] = own[f"s_{n}"] + (state[n] if one and own[f"o_{n}"] else sums[n])
        for n in lasts:
            state[n] = state[n] if one and own[f"o_{n}"] else own[f"s_{n}"]
    return out


def running(df: DataFrame, keys: list[str], at: str | list[str], sums: dict[str, Sum] | None = None, lasts: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """df with, by key and up to each row in order of `at`: sums (the row included), and lasts (the last value before the row, nulls skipped).

    A sum is a column, or (column, reset): where reset is true, the sum begins anew with that row. Sums are long or double,
    0 where there is nothing yet. Null keys are a key of their own; null values add nothing, null resets are none. Rows that
    agree in `at` follow in any order and stay in one range. An empty table gives an empty result; a column that a result
    is named as is replaced. ranges: how many, by default as many as the session's shuffle partitions.
    """
    sums, lasts, order = sums or {}, lasts or {}, [at] if isinstance(at, str) else at
    pairs = {n: c if isinstance(c, tuple) else (c, None) for n, c in sums.items()}
    names = [*sums, *lasts]
    block, place = fresh(df, "range", "place")
    value, reset, known, is_open = ({n: x for n, x in zip(names, fresh(df, *[f"{tag}_{n}" for n in names]), strict=True)} for tag in ("value", "reset", "known", "open"))
    work = df.withColumns({value[n]: c for n, (c, _) in pairs.items()} | {value[n]: c for n, c in lasts.items()} | {reset[n]: r for n, (_, r) in pairs.items() if r is not None})
    kind = {n: "bigint" if n in sums and dict(work.dtypes)[value[n]] in ("tinyint", "smallint", "int", "bigint", "boolean") else "double" for n in sums}
    work = work.withColumns({value[n]: F.col(value[n]).cast(kind[n]) for n in sums})
    kind |= {n: dict(work.dtypes)[value[n]] for n in lasts}
    by = [*keys, *order]
    ranged = work.repartitionByRange(*by) if ranges is None else work.repartitionByRange(ranges, *by)
    sum_columns, last_columns = {n: (value[n], reset[n] if r is not None else None) for n, (_, r) in pairs.items()}, {n: value[n] for n in lasts}
    passed = df.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, seen = RangeScan(keys, sum_columns, last_columns), TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            found, n = own.feed(batch), batch.num_rows
            columns = [batch.column(c) for c in passed] + [found[c][0] for c in names] + [pa.array(found[c][1]) for c in names]
            columns += [pa.array(np.full(n, number, np.int32)), pa.array(np.arange(seen, seen + n))]
            seen += n
            yield pa.RecordBatch.from_arrays(columns, names=[*passed, *(known[c] for c in names), *(is_open[c] for c in names), block, place])

    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{known[n]}` {kind[n]}" for n in names] + [f"`{is_open[n]}` boolean" for n in names] + [f"`{block}` int", f"`{place}` bigint"]
    own = stash(ranged.sortWithinPartitions(*by).mapInArrow(scan, ", ".join(shape)), "scan")
    key = F.struct(*keys)
    state = F.struct(*[F.col(known[n]).alias(f"s_{n}") for n in names], *[F.col(is_open[n]).alias(f"o_{n}") for n in names])
    if lasts:  # the last row's own value comes after what it has seen
        raw = {n: F.coalesce(lasts[n].cast(kind[n]), F.col(known[n])) for n in lasts}
        state = F.struct(*[raw.get(n, F.col(known[n])).alias(f"s_{n}") for n in names], *[(F.col(is_open[n]) & (lasts[n].isNull() if n in lasts else F.lit(True))).alias(f"o_{n}") for n in names])
    ends = own.groupBy(F.col(block).alias("range")).agg(F.min_by(key, place).alias("first"), F.max_by(key, place).alias("last"), F.max_by(state, place).alias("state"))
    zeros = {n: 0.0 if kind[n] == "double" else 0 for n in sums}
    rows = entering(sorted(ends.collect(), key=lambda r: r.range), zeros, list(lasts))  # a row a range
    carried = df.sparkSession.createDataFrame(rows, ", ".join([f"`{block}` int", *[f"`{value[n]}` {kind[n]}" for n in names]]))
    both = own.join(F.broadcast(carried), block)
    total = {n: F.when(F.col(is_open[n]), F.col(known[n]) + F.col(value[n])).otherwise(F.col(known[n])) for n in sums}
    total |= {n: F.when(F.col(is_open[n]), F.col(value[n])).otherwise(F.col(known[n])) for n in lasts}
    return both.select(*[F.col(c) for c in df.columns if c not in names], *[c.alias(n) for n, c in total.items()])
