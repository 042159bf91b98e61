"""Routing, sequence checks, sampling and rates over messages (arrival, seq, chan, itype, val)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.prefix import running

FLATS, DARKS = (2, 4), (3, 5)


def route_counts(m: DataFrame) -> DataFrame:
    return m.groupBy("itype").agg(F.count(F.lit(1)).alias("n"), (F.count("val") * 8).alias("n_bytes"))


def lost(m: DataFrame) -> DataFrame:
    """Messages missing in each channel: positive gaps between neighbours in arrival."""
    gaps = running(m, ["chan"], "arrival", lasts={"before": F.col("seq")}).withColumn("gap", F.col("seq") - F.col("before") - 1)
    return gaps.groupBy("chan").agg(F.count(F.lit(1)).alias("received"), F.coalesce(F.sum(F.greatest("gap", F.lit(0))), F.lit(0)).alias("lost"))


def out_of_sequence(m: DataFrame) -> DataFrame:
    """Messages whose number, counted from the channel's least, isn't their place in arrival."""
    first = m.groupBy("chan").agg(F.min("seq").alias("first"))
    placed = running(m, ["chan"], "arrival", sums={"place": F.lit(1).cast("long")})
    both = placed.join(first, placed.chan.eqNullSafe(first.chan)).drop(first.chan)
    return both.select("chan", "seq", (F.col("seq") - F.col("first")).alias("number"), (F.col("place") - 1).alias("place")).filter("number <> place")


def every_kth(m: DataFrame, k: int) -> DataFrame:
    """The projections among every k-th message received (all kinds count), rotation and id cleared."""
    counted = running(m, ["chan"], "arrival", sums={"received": F.lit(1).cast("long")})
    kept = counted.filter((F.col("received") % k == 0) & (F.col("itype") == 1))
    return kept.select("chan", "seq", "received", "val", F.lit(0).cast("long").alias("unique_id"), F.lit(0.0).alias("rotation"))


def rates(df: DataFrame, key: str, at: str, size: Column) -> DataFrame:
    """Messages, bytes, seconds and both rates by key; a rate over no time is null."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    span = (F.max(t) - F.min(t)) / F.lit(1e6)
    got = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("n_bytes"), span.alias("seconds"))
    return got.withColumns(
        {
            "per_second": F.round(F.try_divide(F.col("n").cast("double"), "seconds"), 6),
            "mib_per_second": F.round(F.try_divide(F.col("n_bytes") / F.lit(1048576.0), "seconds"), 9),
            "seconds": F.round("seconds", 6),
        }
    )


def newest_but_one(df: DataFrame, key: str, at: str) -> DataFrame:
    """The second newest row of each key, the newest being perhaps unfinished. Aggregated before the exchange: two rows a key and task."""
    row = F.struct(F.col(at).alias("__at"), *[F.col(c) for c in df.columns if c not in (key, at)])
    two = df.groupBy(key).agg(F.max(row).alias("one"))
    older = df.withColumn("__row", row).join(two.withColumnRenamed(key, "__k"), F.col(key).eqNullSafe(F.col("__k"))).filter("__row < one")
    best = older.groupBy(key).agg(F.max("__row").alias("r"))
    return best.select(key, F.col("r.__at").alias(at), *[F.col(f"r.{c}") for c in df.columns if c not in (key, at)]).select(*df.columns)


def acquisition_counts(m: DataFrame) -> DataFrame:
    """For each projection the flats and darks that came before it in its channel, latched at arrival."""
    count = lambda kinds: F.col("itype").isin(*kinds).cast("long")
    counted = running(m, ["chan"], "arrival", sums={"flats": count(FLATS), "darks": count(DARKS)})
    return counted.filter("itype = 1").select("chan", "seq", "flats", "darks")
