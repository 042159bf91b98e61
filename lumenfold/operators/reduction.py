"""Sums over replicas, and halo exchange between neighbouring slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def total(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, total, n): partial sums in each task, then one exchange of a row a key and task."""
    return df.groupBy(key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def halo(px: DataFrame) -> DataFrame:
    """(proj, slice, col, val, below, above): each pixel with those of the neighbouring slices, null at the ends.

    Neighbours are those numbered one less and one more; one exchange by (proj, col), whose groups are as large as the
    detector has rows.
    """
    along = Window.partitionBy("proj", "col").orderBy("slice")
    near = lambda f, step: F.when(f("slice").over(along) == F.col("slice") + step, f("val").over(along))
    return px.select("proj", "slice", "col", "val", near(F.lag, -1).alias("below"), near(F.lead, 1).alias("above"))
