"""The corpus pipeline: documents to token ids in five stages, each over all that the one before kept.

Stages keep all columns but the last. What holds for each of them: an empty table gives an empty result; very long texts
are taken whole; columns of any other name, and nulls in them, pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import bpe, exact_dedup, mixing, quality
from lumenfold.llm.common import documents, stash
from lumenfold.llm.near_copies import drop_near_copies


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. A null or empty text goes; repeated rows stay or go together; null ids stay."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (A-Z lower-cased), that with the largest id; a null id loses to any other. Of rows with the same id and text one stays."""
    return exact_dedup.drop_exact_copies(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (op4's fingerprints within four bits, or five-word similarity of 0.8), that with the smallest id and text hash; null ids come last. Null texts count as empty."""
    return drop_near_copies(docs, fingerprints=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned to the target weights. Drawn by id and text, so rows that share an id, or have none, are drawn each for itself; rows that agree in both stay or go as one."""
    return mixing.thin(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every document; a null text has no ids."""
    ids = docs.select("doc_id", "source", bpe.listed(docs.text).alias("ids"))
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near-duplicate removal", near_copies),
    ("mixing to target weights", mix),
    ("encoding", encode),
]
#: Fingerprints, fitted rates and merges can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, name.replace(" ", "-"))
    return docs
