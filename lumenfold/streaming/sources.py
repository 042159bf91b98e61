"""Message streams: folders that an acquisition writes, ended by a message of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.plans.cut import noted, shared_dir
from lumenfold.sources.scans import END

LENGTH = 6  # kind of message that sets a channel's window length, its value
FILES = 4  # of a part, which is what one micro-batch takes


def acquire(messages: DataFrame, order: str, ends: DataFrame, folder: str, parts: int = 4) -> None:
    """messages written to a folder in `parts` of about equal counts, in order of the column `order` (a number or timestamp), the last with `ends`, the messages that end their channels.

    A part has FILES files, empty rows where there is nothing else, so a micro-batch is a part: all its rows come before
    the next part's. Within a part they may lie in any order.
    """
    filler = messages.sparkSession.range(FILES).select(F.col("id").cast("int").alias("file"))

    def write(part: DataFrame) -> None:
        dealt = part.withColumn("file", F.pmod(F.monotonically_increasing_id(), F.lit(FILES)).cast("int"))
        dealt.unionByName(filler, allowMissingColumns=True).repartition("file").write.mode("append").partitionBy("file").parquet(folder)

    time = dict(messages.dtypes)[order].startswith("timestamp")
    at = F.col(order).cast("timestamp").cast("double") if time else F.col(order).cast("double")
    steps = [k / parts for k in range(1, parts)]
    cuts = messages.select(at.alias("at")).approxQuantile("at", steps, 0.001) if steps else []
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:], strict=False):
        own = messages if low is None else messages.filter(at > low)
        own = own.unionByName(ends) if high is None else own.filter(at <= high)
        write(own)


def opened(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The folder as a stream, FILES files a micro-batch in order of their writing. Nothing is known of what is to come."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(folder)
    return stream.filter("itype IS NOT NULL").drop("file")


def message_stream(messages: DataFrame, parts: int = 4) -> DataFrame:
    """Messages (chan, arrival, seq, itype, val) as an acquisition sends them: in order of arrival, then an end message for each channel."""
    spark = messages.sparkSession
    folder = noted(spark, f"{shared_dir(spark)}/messages-{uuid.uuid4().hex}")
    own = messages.select("chan", "arrival", "seq", "itype", "val")
    ends = own.groupBy("chan").agg(F.max("arrival").alias("arrival")).select("chan", "arrival", F.lit(0).cast("bigint").alias("seq"), F.lit(END).alias("itype"), F.lit(None).cast("double").alias("val"))
    acquire(own, "arrival", ends, folder, parts)
    return opened(spark, folder, own.schema)


def keep_state_on_disk(spark: SparkSession) -> None:
    """The store that stateful processors need: state lives on the executors' disks, with its changes in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_to_end(out: DataFrame, top: str) -> DataFrame:
    """What a stream gives for all its input so far, in <top>/out; its place and state are in <top>/state, so a later call with the same top goes on there."""
    writer = out.writeStream.format("parquet").option("checkpointLocation", f"{top}/state").option("path", f"{top}/out")
    writer.trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{top}/out")


def replayed(out: DataFrame) -> DataFrame:
    """What a stream gives once all its input is there, by way of a sink in the shared folder."""
    return run_to_end(out, noted(out.sparkSession, f"{shared_dir(out.sparkSession)}/stream-{uuid.uuid4().hex}"))
