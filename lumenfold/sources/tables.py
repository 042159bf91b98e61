"""Typed views of the input tables: detector messages, projections (rays) and images."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Message kinds (fixed values).
PROJECTION, WHITE, DARK, WHITE_RESET, DARK_RESET = 1, 2, 3, 4, 5
SIDE = 8  # pixels of an image's side; also slices and columns of a projection


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arrival, seq, chan, itype, val): events as one-pixel detector messages, chan by chan in order of arrival."""
    kind = F.create_map(*[F.lit(x) for k in (("view", PROJECTION), ("click", WHITE), ("error", DARK), ("signup", WHITE_RESET), ("purchase", DARK_RESET)) for x in k])
    return read(spark, sf_dir, "events").select(F.col("ts").alias("arrival"), F.col("event_id").alias("seq"), F.col("user_id").alias("chan"), kind[F.col("event_type")].alias("itype"), F.col("value").alias("val"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(proj, px array<double>): embeddings as flat frames of SIDE x SIDE values."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("proj"), F.col("embedding").cast("array<double>").alias("px"))


def n_frames(spark: SparkSession, sf_dir: str) -> int:
    return read(spark, sf_dir, "embeddings").count()


def angle(proj: Column, n: int) -> Column:
    """Radians over half a turn, a little off the axes."""
    return F.lit(0.01) + proj * F.lit(math.pi) / F.lit(float(n))


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(proj, theta, slice, col, val), one row a detector pixel; frames are small enough to explode in place."""
    n = n_frames(spark, sf_dir)
    return frames(spark, sf_dir).select("proj", F.posexplode("px").alias("e", "val")).select("proj", angle(F.col("proj"), n).alias("theta"), F.expr(f"int(e div {SIDE})").alias("slice"), (F.col("e") % SIDE).cast("int").alias("col"), "val")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair, a, b): each image beside the one after it, found by an equi-join."""
    one = frames(spark, sf_dir)
    after = one.select((F.col("proj") - 1).alias("proj"), F.col("px").alias("b"))
    return one.join(after, "proj").select(F.col("proj").alias("pair"), F.col("px").alias("a"), "b")


#: The same views for DuckDB.
SQL = {
    "m": "SELECT ts AS arrival, event_id AS seq, user_id AS chan, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 WHEN 'signup' THEN 4 WHEN 'purchase' THEN 5 END AS itype, value AS val FROM events",
    "f": "SELECT vec_id AS proj, embedding::DOUBLE[] AS px FROM embeddings",
    "r": f"SELECT proj, 0.01::DOUBLE + proj * pi() / (SELECT count(*) FROM embeddings)::DOUBLE AS theta, (e // {SIDE})::INT AS slice, (e % {SIDE})::INT AS col, val FROM (SELECT vec_id AS proj, unnest(range(64)) AS e, unnest(embedding::DOUBLE[]) AS val FROM embeddings)",
    "p": "SELECT x.vec_id AS pair, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1",
}


def with_views(names: str, body: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + body
