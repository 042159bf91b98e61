"""Exact dedup: sorted digest runs, merged in rounds of a binomial tree.

Level 0 makes one run for each input partition: an entry for each different text, with the best row and the count.
In round r, the runs of fan_in**r neighbouring partitions meet: entries move to the task that owns (run group, digest
range), are sorted there and merged; while groups grow by fan_in, digest ranges narrow by as much, so that tasks stay
equally large and none ever holds a whole run of the corpus. A hot text has one entry a run, however many rows it has.
Entries merge only when the 64-bit sort digest, the SHA-256 and the byte length agree. Winners travel back by
(digest) to the level-0 entries and from there by (run, digest) to the rows, so that no join sees a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import documents, keep_rows, lower_ascii, stash, text_or_empty

DIGEST = ["h64", "sha", "n_bytes"]


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, run, id, h64, sha, n_bytes) of each row; written, as row and run numbers must not change."""
    norm = docs.select(F.col(id_col).alias("id"), lower_ascii(text_or_empty(text_col)).alias("t"))
    return stash(
        norm.select(
            F.monotonically_increasing_id().alias("rid"),
            F.spark_partition_id().alias("run"),
            "id",
            F.xxhash64("t").alias("h64"),
            F.unhex(F.sha2("t", 256)).alias("sha"),
            F.octet_length("t").alias("n_bytes"),
        ),
        "digests",
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 16) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. keep: which id of a group stays, "smallest" or "largest".
    Nulls: a null text counts as empty; a null id loses to any other. Very long texts are hashed whole. Ties: of rows with the same id and text one, and
    only one, has kept = true. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    rows = digests(docs, id_col, text_col)
    sign = {"smallest": F.min, "largest": F.max}[keep]
    null_rank = F.col("id").isNull() if keep == "smallest" else F.col("id").isNotNull()
    best = sign(F.struct(null_rank.alias("rank"), "id", "rid")).alias("best")
    level0 = rows.groupBy("run", *DIGEST).agg(best, F.count(F.lit(1)).alias("size"))
    entries = level0.withColumn("group", F.col("run"))
    last_run = rows.agg(F.max("run")).first()[0] or 0
    span, ranges = 1, 1
    while span == 1 or span <= last_run:
        span, ranges = span * fan_in, ranges * fan_in
        moved = entries.withColumns({"group": (F.col("run") / span).cast("long") if "run" in entries.columns else (F.col("group") / fan_in).cast("long"), "range": F.pmod("h64", F.lit(ranges))})
        sorted_runs = moved.repartition("group", "range").sortWithinPartitions("group", "range", *DIGEST)
        entries = sorted_runs.groupBy("group", "range", *DIGEST).agg(sign("best").alias("best"), F.sum("size").alias("size"))
    winners = entries.select(*DIGEST, "best", "size")
    back = level0.select("run", *DIGEST).join(winners, DIGEST)
    return rows.join(back, ["run", *DIGEST]).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """docs without exact copies; all columns stay. Of rows with the same id and text, one stays.

    Nulls, long texts and ties as in exact_groups; an empty table gives an empty result.
    """
    kept = exact_groups(docs, keep=keep).filter("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    return keep_rows(docs, [("id", F.col("doc_id")), ("sha", F.sha2(lower_ascii(text_or_empty()), 256))], kept)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir), keep="largest")


ASCII_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLES = {
    "op7_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {ASCII_LOWER_SQL} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM t JOIN g USING (t)"""
}
