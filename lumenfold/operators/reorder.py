"""Orders of acquisition and block partitions, as computed keys: no operator here gathers rows, ranks come from a two-level count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.plans.cut import stash


ROWS_A_RANGE = 1_000_000  # of dense_index, about


def dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with its 0-based rank by key (long, unique).

    Rows are exchanged by ranges of the key with about ROWS_A_RANGE rows each (boundaries from Spark's sample, so a dense
    part of the key gets more ranges) and written, as the boundaries must not change; they are numbered within, and the
    counts of the ranges before are added: no window spans all rows.
    """
    ranged = df.repartitionByRange(df.count() // ROWS_A_RANGE + 1, key)
    own = stash(ranged.withColumn("__b", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("__b").count().select("__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__s"))  # as many rows as ranges
    placed = own.withColumn("__n", F.row_number().over(Window.partitionBy("__b").orderBy(key)) - 1)
    return placed.join(F.broadcast(starts), "__b").withColumn(name, F.col("__s") + F.col("__n")).drop("__b", "__s", "__n")


def subset_key(idx: Column, n_subsets: int) -> list[Column]:
    """Order by (idx mod n, idx): subsets one after the other."""
    return [F.pmod(idx, F.lit(n_subsets)), idx]


def subset_place(idx: Column, n: int, n_subsets: int) -> Column:
    """The place of idx in that order: rows of earlier subsets, then its number in its own."""
    r, (base, rest) = F.pmod(idx, F.lit(n_subsets)), divmod(n, n_subsets)
    return (r * base + F.least(r, F.lit(rest)) + F.floor(idx / n_subsets)).cast("long")


def halving_levels(n: int) -> list[list[float]]:
    """The steps of the halving order: n / 2 first (maybe fractional), then whole halves down to 1."""
    steps: list[float] = [n / 2]
    while int(steps[-1] / 2) > 0:
        steps.append(int(steps[-1] / 2))
    return steps


def halving_level(idx: Column, n: int) -> Column:
    """The first level that reaches idx: multiples of the step, at level 0 also ceil or floor of the half as running sums are cut to whole numbers."""
    steps = halving_levels(n)
    first, x = [], 0.0
    while int(x) < n:  # at most four numbers
        first.append(int(x))
        x = int(x) + steps[0]
        if len(first) > 3:
            break
    out = F.when(idx.isin(first), 0)
    for level, step in enumerate(steps[1:], 1):
        out = out.when(idx % int(step) == 0, level)
    return out.otherwise(len(steps))


def ordered(df: DataFrame, idx: str, n: int, order: int) -> DataFrame:
    """df sorted as acquired under the order parameter: 0 as it is, above 0 so many interleaved subsets, below 0 by halving."""
    if order > 0:
        return df.orderBy(*subset_key(F.col(idx), order))
    return df.orderBy(idx) if order == 0 else df.orderBy(halving_level(F.col(idx), n), idx)


def place_in(idx: Column, n: int, order: int) -> Column:
    """The sort key of that order as one number: subset (or level) * n + idx."""
    if order > 0:
        return F.pmod(idx, F.lit(order)) * n + idx
    return idx if order == 0 else halving_level(idx, n) * F.lit(n) + idx


def gathered(rows: DataFrame, permutation: DataFrame, idx: str = "idx") -> DataFrame:
    """rows in the order of an index vector (place, idx), which may name a row twice or not at all; an equi-join."""
    return permutation.join(rows, idx)


def block_of(idx: Column, n: int, blocks: int) -> Column:
    """The block of a row when n rows go to blocks of sizes at most one apart, larger ones first."""
    base, rest = divmod(n, blocks)
    large = (base + 1) * rest
    return F.when(idx < large, F.floor(idx / (base + 1))).otherwise(rest + F.floor((idx - large) / max(base, 1))).cast("long")


def blocks_table(spark, n: int, blocks: int) -> DataFrame:
    """(block, start, size) of that partition."""
    base, rest = divmod(n, blocks)
    r = F.col("id")
    return spark.range(blocks).select(r.alias("block"), F.when(r < rest, (base + 1) * r).otherwise((base + 1) * rest + base * (r - rest)).alias("start"), (F.lit(base) + (r < rest).cast("long")).alias("size"))


def repeat_scan(df: DataFrame, times: int) -> DataFrame:
    """df once for each iteration, numbered."""
    return df.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
