"""Importance resampling towards a target: hashed features, weights from an array of gains, Gumbel scores, an exact top share.

The cutoff of the draw is bracketed by a quantile sketch of the scores. Counts of what lies above and inside the bracket are
exact: they prove that the cutoff is inside, or the bracket is widened. Only the rows in the bracket are sorted to find it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.llm.common import documents, stash

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
KEPT = 500_000  # words whose buckets a worker keeps
ACCURACY = 2000  # of the sketch: ranks are off by at most a row in so many
ROWS_A_RANGE = 1_000_000  # that are numbered together, about
#: Bytes of a word: 0-9, a-z, and all beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

Batches = Iterator[pa.RecordBatch]


class Hashed(dict):
    """The buckets of features, kept as they are met."""

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[feature] = out = zlib.crc32(feature) % BUCKETS
        return out


def features(text: bytes | None, longest: int, bucket: Hashed) -> tuple[int, np.ndarray]:
    """How many words a text has, and the buckets of its runs of 1 to `longest` words. bytes.lower() changes A-Z only."""
    words = WORD.findall(text.lower()) if text else []
    own = list(map(bucket.__getitem__, words))
    for n in range(2, longest + 1):
        own += [bucket[b" ".join(x)] for x in zip(*(islice(words, k, None) for k in range(n)), strict=False)]
    return len(words), np.array(own, np.int64)


def bucket_counts(texts: DataFrame, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket; each task gives a row a bucket at most, the driver gets one a bucket."""

    def part(batches: Batches) -> Batches:
        counts, bucket = np.zeros(BUCKETS, np.int64), Hashed()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts += np.bincount(features(text, longest, bucket)[1], minlength=BUCKETS)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": there, "n": counts[there]})

    out = np.zeros(BUCKETS, np.int64)
    for k, n in texts.mapInArrow(part, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[k] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain, in thousandths of a nat: how much likelier the target has it than the source, one added to each count."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    each = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in each], np.int64)


def noise(id_col: str, seed: int) -> Column:
    """A Gumbel draw in thousandths, by hash of seed and id (null: nothing after the colon)."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(id, n_words, n_features, weight) of docs (id, text as binary): the floored mean of the gains of a text's features, 0 without any."""
    gain_of = docs.sparkSession.sparkContext.broadcast(gain)  # an array of BUCKETS numbers

    def part(batches: Batches) -> Batches:
        bucket = Hashed()
        for batch in batches:
            found = [features(text, longest, bucket) for text in batch.column(1).to_pylist()]
            sizes = [len(x) for _, x in found]
            weights = [int(gain_of.value[x].sum()) // len(x) if len(x) else 0 for _, x in found]
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in ([n for n, _ in found], sizes, weights))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(part, f"id {docs.schema['id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint")


def order_key() -> Column:
    """Sorts by falling score, then id (nulls last); rows that agree in both have numbers of their own."""
    return F.struct((-F.col("score")).alias("s"), F.col("id").isNull().alias("z"), F.col("id").alias("i"), F.col("row").alias("r"))


def ranked(rows: DataFrame, key: str = "key") -> DataFrame:
    """rows with their rank from 1 by a unique key: ranges of it are numbered on their own, after the counts of those before."""
    spark = rows.sparkSession
    ranges = max(rows.count() // ROWS_A_RANGE + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = stash(rows.repartitionByRange(ranges, key).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))  # a row a range
    numbered = own.withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy(key)))
    return numbered.join(F.broadcast(starts), "range").withColumn("rank", (F.col("start") + F.col("rank")).cast("long")).drop("range", "start")


def bracket(rows: DataFrame, k: int, n: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """(low, high, above): scores between which the k-th highest of n rows lies, and how many rows have more than high; by exact counts."""
    off = 2 / accuracy
    while True:
        shares = [max(0.0, 1 - k / n - off), min(1.0, 1 - k / n + off)]
        low, high = rows.agg(F.percentile_approx("score", shares, accuracy)).first()[0]
        if off >= 1:
            low, high = rows.agg(F.min("score"), F.max("score")).first()
        above, inside = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < k <= above + inside:
            return low, high, above
        off *= 4  # the sketch was off by more than it says, or scores tie beyond it


def drawn(rows: DataFrame, k: int, n: int, accuracy: int = ACCURACY) -> DataFrame:
    """The k first of n rows (id, score, row, key) in order of key, with their rank."""
    low, high, above = bracket(rows, k, n, accuracy)
    last = ranked(rows.filter(F.col("score").between(low, high)).select("key")).filter(F.col("rank") == k - above)
    return ranked(rows.join(F.broadcast(last.select(F.col("key").alias("last"))), F.col("key") <= F.col("last")).drop("last"))  # last: one row


def resample(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """id, n_features, weight, score and rank of every document: `percent` of those with `least_words` words are drawn, others have a null rank.

    Nulls: a null or empty text has no feature, weight 0, and isn't drawn; a null id ties last. Repeated rows are documents
    of their own, and of rows that agree in score and id any comes first. Very long texts are taken whole. An empty table
    gives an empty result, an empty target gains like any other. Other columns, whatever their names, play no part.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    gain = gains(bucket_counts(texts.select("text"), longest), bucket_counts(target.select(F.col(target_text).cast("binary").alias("text")), longest))
    scored = weighted(texts, gain, longest).withColumn("score", F.col("weight") + noise("id", seed)).withColumn("row", F.monotonically_increasing_id())
    rows = stash(scored, "scored").withColumn("key", order_key())
    able = rows.filter(F.col("n_words") >= least_words)
    n = able.count()
    k = percent * n // 100
    out = rows.withColumn("rank", F.lit(None).cast("long"))
    if k:
        first = stash(drawn(able, k, n), "drawn")
        last = first.agg(F.max("key").alias("last"))
        beyond = (F.col("n_words") < least_words) | (F.col("key") > F.col("last"))
        out = out.join(F.broadcast(last), beyond).drop("last").unionByName(first)  # last: one row
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 of each distinct word by its table: the remainders of all bytes under the polynomial, eight halvings each.
SQL = """
WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) s(i)),
words AS (
    SELECT 0 AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents
    UNION ALL SELECT 1, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
bytes AS (SELECT w, list_transform(range(1, strlen(w) + 1), lambda k: ('0x' || substr(hex(encode(w)), 2 * k - 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT w FROM words)),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS k FROM bytes, crc),
found AS (SELECT side, id, k FROM words JOIN hashed USING (w)),
totals AS (SELECT count(*) FILTER (side = 0)::DOUBLE AS s_all, count(*) FILTER (side = 1)::DOUBLE AS t_all FROM found),
counts AS (SELECT k, count(*) FILTER (side = 0)::DOUBLE AS s, count(*) FILTER (side = 1)::DOUBLE AS t FROM found GROUP BY k),
gain AS (SELECT k, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS g FROM counts, totals),
per AS (SELECT id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM found JOIN gain USING (k) WHERE side = 0 GROUP BY id),
scored AS (
    SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM documents LEFT JOIN per ON id = doc_id),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
QUERIES = {"op12_resampling": op12_resampling}
ORACLES = {"op12_resampling": SQL}
