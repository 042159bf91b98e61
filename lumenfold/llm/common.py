"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.operators.prefix import fresh
from lumenfold.plans.cut import discard, shared_dir, stash

__all__ = ["discard", "fresh", "shared_dir", "stash"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space; words are the runs between.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else untouched. Pure ASCII text takes the much faster lower()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: higher-order functions would else compute it again for each element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text, an array."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def keep_rows(docs: DataFrame, keys: list[tuple[str, Column]], kept: DataFrame) -> DataFrame:
    """The rows of docs whose keys are in kept (columns named as the keys, nulls match); of rows that agree in all keys, one.

    keys: name and expression over docs. kept must have distinct rows. Only kept's keys and docs are shuffled, once.
    """
    own = [n for n, _ in keys]
    number, *names = fresh(docs, "__n", *[f"__{n}" for n in own], *[f"__k{n}" for n in own])
    left, right = names[: len(own)], names[len(own) :]
    marked = docs.withColumns({n: c for n, (_, c) in zip(left, keys, strict=True)})
    kept = kept.select(*[F.col(n).alias(k) for n, k in zip(own, right, strict=True)])
    rows = marked.join(kept, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)], "left_semi")
    again = Window.partitionBy(*left).orderBy(*left)
    return rows.withColumn(number, F.row_number().over(again)).filter(F.col(number) == 1).drop(number, *left)


def join_classes(rows: DataFrame, classes: DataFrame, key: str, size: str) -> DataFrame:
    """rows with the columns of classes, one row a key, of which `size` counts the rows.

    Classes of at least one row in 10,000, so at most 10,000 of them, are broadcast to their rows; the others are
    exchanged, and none is large there.
    """
    classes = classes.withColumnRenamed(key, "__key")
    least = rows.count() / 10_000
    hot = F.broadcast(classes.filter(F.col(size) >= least))
    cold, names = classes.filter(F.col(size) < least), F.broadcast(classes.filter(F.col(size) >= least).select("__key"))
    on = F.col(key) == F.col("__key")
    return rows.join(hot, on).unionByName(rows.join(names, on, "left_anti").join(cold, on)).drop("__key")
