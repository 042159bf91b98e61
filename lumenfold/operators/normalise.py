"""Flat and dark field correction as of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.scalars import minus_log, remove_invalids
from lumenfold.operators.prefix import running
from lumenfold.operators.stream_checks import DARKS, FLATS

LEAST = 1e-6  # fixed value: what flat - dark counts at least


def with_fields(m: DataFrame) -> DataFrame:
    """m with flat and dark: means of the fields since the last reset (which counts as a field), as of each message; null before the first."""
    field = lambda kinds: F.col("itype").isin(*kinds) & F.col("val").isNotNull()
    sums = {}
    for name, kinds, reset in (("flat", FLATS, 4), ("dark", DARKS, 5)):
        fresh_start = F.col("itype") == reset
        sums |= {f"{name}_sum": (F.when(field(kinds), F.col("val")).cast("double"), fresh_start), f"{name}_n": (field(kinds).cast("long"), fresh_start)}
    out = running(m, ["chan"], "arrival", sums=sums)
    return out.withColumns({name: F.try_divide(f"{name}_sum", F.col(f"{name}_n").cast("double")) for name in ("flat", "dark")}).drop(*sums)


def normalised(m: DataFrame, least: float = LEAST) -> DataFrame:
    """Projections with out = (val - dark) / max(flat - dark, least); as they are until a flat and a dark have been seen."""
    scaled = (F.col("val") - F.col("dark")) / F.greatest(F.col("flat") - F.col("dark"), F.lit(least))
    either = F.col("flat").isNull() | F.col("dark").isNull()
    return with_fields(m).filter("itype = 1").withColumn("out", F.when(either, F.col("val")).otherwise(scaled))


def preprocessed(m: DataFrame, least: float = LEAST) -> DataFrame:
    """Normalise, -log, clean up, in that order."""
    return normalised(m, least).withColumn("out", remove_invalids(minus_log(F.col("out"))))
