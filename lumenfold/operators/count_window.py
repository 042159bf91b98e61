"""Count-based sliding windows: length L, step S, over a stream of n projections; at its end they drain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class CountWindow:
    """The windows of one stream, member by member, with no more than a window and a step in memory.

    Each pass first cuts what is held to the length, makes room by a step if it is full, then takes up to a step of new
    members. At the end the window gives up a step a pass until it is empty. The length may change between members.
    """

    def __init__(self, length: int, step: int) -> None:
        self.length, self.step, self.number = length, step, 0
        self.held: list = []
        self.new: list = []

    def _pass(self) -> tuple[int, list]:
        full = len(self.held) >= self.length
        kept = self.held[-self.length :] if self.length else []
        self.held = (kept[self.step :] if full else kept) + self.new
        self.new = []
        self.number += 1
        return self.number - 1, list(self.held)

    def feed(self, member) -> list[tuple[int, list]]:
        """The pass (number, members) that this member completes, if any."""
        self.new.append(member)
        return [self._pass()] if len(self.new) == self.step else []

    def close(self) -> list[tuple[int, list]]:
        """The last passes: what is left of a step, then the drain."""
        out = [self._pass()] if self.new else []
        while True:
            self.held = self.held[-self.length :][self.step :]
            if not self.held:
                return out
            out.append((self.number, list(self.held)))
            self.number += 1


def bounds(p: Column, n: Column, length: int, step: int) -> tuple[Column, Column]:
    """(lo, hi) of pass p over n members, for any step: hi - lo is 0 where there is no such pass.

    While feeding, passes end at whole steps and begin at 0 until `length` members have been held, then `length` before
    the end. Draining, the last window (cut to length) loses a step a pass.
    """
    feeding = F.ceil(n / F.lit(step))
    last = lambda q: F.when(q * step >= length, F.least(q * step, (q + 1) * step - length)).otherwise(F.lit(0))
    drained = F.greatest(last(feeding - 1), n - length) + (p - feeding + 1) * step
    lo = F.when(p < feeding, last(p)).otherwise(F.least(drained, n))
    return lo.cast("long"), F.least((p + 1) * step, n).cast("long")


def n_passes(n: Column, length: int, step: int) -> Column:
    """How many passes n members have at most."""
    return F.ceil(n / F.lit(step)) + F.lit(-(-length // step))


def passes(spark: SparkSession, n: int, length: int, step: int) -> DataFrame:
    """(pass, lo, hi) of every pass over n members, in closed form on the executors."""
    most = max(0, -(-n // step) + -(-length // step))
    lo, hi = bounds(F.col("id"), F.lit(n), length, step)
    return spark.range(most).select(F.col("id").alias("pass"), lo.alias("lo"), hi.alias("hi")).filter("lo < hi")


def window_passes(n: int, length: int, step: int) -> list[tuple[int, int]]:
    """(lo, hi) of every pass as the stream gives them, one after the other; for tests and small n."""
    lo = hi = 0
    out = []
    while True:
        lo = max(lo, hi - length)
        pulled = min(step, n - hi)
        if not pulled:
            lo = min(hi, lo + step)
            if lo == hi:
                return out
        elif hi - lo >= length:
            lo = min(hi, lo + step)
        hi += pulled
        out.append((lo, hi))


def members(windows: DataFrame, projections: DataFrame, idx: str = "proj") -> DataFrame:
    """projections with the passes that hold them: an equi-join on the windows' indices, each about length / step times."""
    each = windows.select("pass", F.explode(F.sequence("lo", F.col("hi") - 1)).alias(idx))
    return each.join(projections, idx)
