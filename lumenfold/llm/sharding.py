"""Sharding by histogram sort: near-equal bytes a shard, equal texts side by side.

Rows are ordered by (text hash, id, row number). Boundaries of equal bytes are found by counting, not by sorting: each
round counts the exact bytes below evenly spaced probes inside every interval that still holds a boundary, keeps the
probe interval that contains it, and goes on until the bytes that a boundary may be off meet the tolerance. An interval
that has shrunk to one text hash (a hot text) goes on over the ids within it, and one that has shrunk to one text and id
over row numbers, so no group of equal rows is too large to split. Only then is the data exchanged, once. Boundaries are
set for ranges of at most PART_BYTES inside each shard, so tasks stay equally large at any size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from lumenfold.llm.common import documents, fresh, stash, text_or_empty

OVERHEAD = 8  # bytes of a row besides its text
PROBES, COUNTS = 64, 1 << 17  # probes in an interval, and counts in a round, at most
PART_BYTES = 1 << 30  # of a range within a shard, about
LOWEST, HIGHEST = -(2**63), 2**63 - 1
KEY = ["__h", "__id", "__row"]


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with their size and sort key; written, as row numbers must be the same in each of the passes."""
    text = text_or_empty(text_col)
    own = docs.withColumns(
        {
            "__h": F.xxhash64(text),
            "__id": F.coalesce(F.col(id_col).cast("long") if isinstance(docs.schema[id_col].dataType, NumericType) else F.xxhash64(id_col), F.lit(LOWEST)),
            "__row": F.monotonically_increasing_id(),
            "size": (F.octet_length(text) + OVERHEAD).cast("long"),
        }
    )
    return stash(own, "shard-rows")


@dataclass
class Interval:
    """Keys that agree in the first `level` parts with `fixed` and whose next part is from lo to hi; bytes below them, and the targets inside."""

    level: int
    fixed: tuple[int, ...]
    lo: int
    hi: int
    below: int
    targets: list[tuple[int, int]]


def longs(xs) -> Column:
    """A literal array<bigint>, as one string that folds to a constant."""
    return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")


def literal(x: int) -> str:
    """A bigint in SQL, which has no literal for the lowest."""
    return f"(-{HIGHEST}L - 1L)" if x == LOWEST else f"{x}L"


def at(xs: Column, k: Column) -> Column:
    return F.get(xs, k.cast("int"))


def first_above(starts: list[int]) -> tuple[Column, Column]:
    """(from, to): among ascending `starts`, those up to place `from` are at or below __h for sure, those after `to` are not.

    By the top bits of h, so many that about one start is left to compare.
    """
    bits = max(1, len(starts).bit_length() + 1)
    width = 2 ** (64 - bits)
    heads = [0] * (2**bits + 1)
    for h in starts:
        heads[(h - LOWEST) // width + 1] += 1
    for k in range(2**bits):
        heads[k + 1] += heads[k]
    bucket = F.shiftright("__h", 64 - bits).cast("int") + 2 ** (bits - 1)
    table = longs(heads)
    return F.get(table, bucket), F.get(table, bucket + 1)


def count_below(starts: list[int], is_below) -> Column:
    """How many of the ascending starts are below the row, where is_below(place) tells for those in its bucket."""
    first, after = first_above(starts)
    steps = F.when(after > first, F.sequence(first, after - 1)).otherwise(F.array().cast("array<bigint>"))
    return (first + F.size(F.filter(steps, is_below))).cast("int")


def counted(keys: DataFrame, intervals: list[Interval], probes: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """{interval: [(probe, bytes, lowest, highest key part)]}. Intervals over hashes are looked up by the hash's top bits; those within one hash meet by an equi-join."""
    spark, found = keys.sparkSession, []
    steps = [max(1, -(-(x.hi - x.lo + 1) // probes)) for x in intervals]
    for level in sorted({x.level for x in intervals}):
        own = [i for i, x in enumerate(intervals) if x.level == level]
        value = F.col(KEY[level])
        if level == 0:
            own.sort(key=lambda i: intervals[i].lo)
            lows = [intervals[i].lo for i in own]
            los, his, sizes, names = longs(lows), longs([intervals[i].hi for i in own]), [steps[i] for i in own], longs(own)
            place = count_below(lows, lambda k: at(los, k) <= F.col("__h")) - 1
            step = at(F.split(F.lit(",".join(map(str, sizes))), ",").cast("array<decimal(20,0)>"), F.col("__k"))
            rows = keys.withColumn("__k", place).filter((F.col("__k") >= 0) & (value <= at(his, F.col("__k"))))
            rows = rows.select("size", value.alias("v"), at(names, F.col("__k")).cast("int").alias("i"), at(los, F.col("__k")).alias("lo"), step.alias("step"))
        else:
            data = ",".join(f"({i},{','.join(map(literal, (*intervals[i].fixed, intervals[i].lo, intervals[i].hi)))},{steps[i]}BD)" for i in own)
            fixed = ",".join(f"f{k}" for k in range(level))
            table = spark.sql(f"SELECT * FROM VALUES {data} AS t(i,{fixed},lo,hi,step)")
            table = F.broadcast(table.withColumn("step", F.col("step").cast("decimal(20,0)")))  # at most as many rows as boundaries
            on = [keys[KEY[k]] == table[f"f{k}"] for k in range(level)]
            rows = keys.join(table, on).filter((value >= F.col("lo")) & (value <= F.col("hi")))
            rows = rows.select("size", value.alias("v"), "i", "lo", "step")
        probe = F.floor((F.col("v").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)")) / F.col("step")).cast("int")
        found.append(rows.groupBy("i", probe.alias("probe")).agg(F.sum("size").alias("bytes"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    for r in every.collect():  # COUNTS rows, or two an interval, at most
        by.setdefault(r.i, []).append((r.probe, r.bytes, r.lo, r.hi))
    return by


def find_splitters(keys: DataFrame, n_ranges: int, tolerance: int) -> dict[tuple[int, int, int], int]:
    """Ascending boundaries (h, id, row), each with its number from 1 to n_ranges - 1; where several coincide, the last.

    A row belongs below a boundary if its key is smaller.

    keys: __h, __id, __row, size. A boundary's exact bytes below differ from an equal share by at most tolerance, or by
    one row if that weighs more. The driver gets at most COUNTS counts a round (two for each open interval if that is more).
    """
    found = keys.agg(F.sum("size"), F.min("__h"), F.max("__h")).first()
    total = found[0] or 0
    if not total or n_ranges < 2:
        return {}
    intervals = [Interval(0, (), found[1], found[2], 0, [(total * k // n_ranges, k) for k in range(1, n_ranges)])]
    done: dict[tuple[int, int, int], int] = {}
    while intervals:
        by = counted(keys, intervals, max(2, min(PROBES, COUNTS // len(intervals))))
        following = []
        for i, x in enumerate(intervals):
            below = x.below
            for k, (_, weight, lo, hi) in enumerate(sorted(by[i])):
                here = [t for t in x.targets if below < t[0] <= below + weight or (k == 0 and t[0] <= below)]
                rest_of_key = (LOWEST,) * (2 - x.level)
                start = (*x.fixed, lo, *rest_of_key)
                end = (*x.fixed, hi + 1, *rest_of_key) if hi < HIGHEST else start
                rest = []
                for t, number in here:
                    if below + weight - t <= tolerance:
                        done[end] = max(number, done.get(end, 0))
                    elif t - below <= tolerance:
                        done[start] = max(number, done.get(start, 0))
                    elif lo < hi or x.level < 2:
                        rest.append((t, number))
                    else:  # one row: its nearer side
                        side = start if t - below <= below + weight - t else end
                        done[side] = max(number, done.get(side, 0))
                if rest and lo < hi:
                    following.append(Interval(x.level, x.fixed, lo, hi, below, rest))
                elif rest:
                    following.append(Interval(x.level + 1, (*x.fixed, lo), LOWEST, HIGHEST, below, rest))
                below += weight
        intervals = following
    return dict(sorted(done.items()))


def range_index(splitters: list[tuple[int, int, int]]) -> Column:
    """How many splitters are at or below a row's key."""
    if not splitters:
        return F.lit(0)
    parts = [longs([s[k] for s in splitters]) for k in range(3)]

    def is_below(k: Column) -> Column:
        h, i, row = (at(p, k) for p in parts)
        return (h < F.col("__h")) | ((h == F.col("__h")) & ((i < F.col("__id")) | ((i == F.col("__id")) & (row <= F.col("__row")))))

    return count_below([s[0] for s in splitters], is_below)


def shard_documents(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, tolerance: float = 0.002) -> DataFrame:
    """docs with size, shard and slot: shards of near-equal bytes, slots gapless from 0 in the order (text hash, id).

    tolerance: the share of a shard's bytes by which a boundary may be off; a row isn't split, so one longer than that
    (a very long text) moves the boundary by up to its size. Ids are numbers, or of another type and then sorted by hash. Nulls: a null text has size OVERHEAD, a
    null id sorts first. Ties and repeated rows: rows that agree in text and id follow in the order in which they are
    stored, and may be dealt over several shards. A column of the input named size, shard or slot is replaced. An empty
    table gives an empty result; fewer rows than shards leave shards empty.
    """
    own = [c for c in docs.columns if c.startswith("__")]  # names that are also used here: other ones meanwhile
    aside = dict(zip(own, fresh(docs, *[f"of{c}" for c in own]), strict=True))
    rows = numbered(docs.withColumnsRenamed(aside), aside.get(id_col, id_col), aside.get(text_col, text_col))
    keys = rows.select(*KEY, "size")
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // (n_shards * part_bytes)))
    found = find_splitters(keys, n_shards * parts, max(1, int(total / n_shards * tolerance)))
    splitters = list(found)
    shard = F.get(longs([0, *(k // parts for k in found.values())]), F.col("__range")).cast("int")
    counts = keys.groupBy(range_index(splitters).alias("__range")).agg(F.count(F.lit(1)).alias("rows")).withColumn("shard", shard)
    before = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = stash(counts.select("__range", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__start")), "shard-starts")
    order = Window.partitionBy("__range").orderBy(*KEY)
    placed = rows.drop("shard", "slot").withColumn("__range", range_index(splitters)).withColumn("__n", F.row_number().over(order))
    both = placed.join(F.broadcast(starts), "__range")  # a row a range
    return both.withColumn("slot", (F.col("__start") + F.col("__n") - 1).cast("long")).drop(*KEY, "__range", "__n", "__start").withColumnsRenamed({b: a for a, b in aside.items()})


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(documents(spark, sf_dir).select("doc_id", "text"), 24)
    crc = F.crc32(text_or_empty()).alias("text_crc32")
    return placed.select("doc_id", "size", crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_sharding": op2_sharding}
ORACLES = {}
