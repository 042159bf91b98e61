"""The segmented scan against a loop: resets, hot keys, batches and ranges of all sizes."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import normalise, prefix
from lumenfold.plans import catalog

SCHEMA = "chan long, k long, arrival timestamp, val double, name string, reset boolean, place string"


def table(spark, rows):
    own = spark.createDataFrame([(c, k, v, n, r, "p") for c, k, v, n, r in rows], "chan long, k long, val double, name string, reset boolean, place string")
    return own.withColumn("arrival", F.timestamp_seconds(F.col("k"))).repartition(5)  # all within a day


def loop(rows):
    total, count, since, last, out = {}, {}, {}, {}, {}
    for c, k, v, n, r in sorted(rows, key=lambda x: x[1]):
        count[c] = count.get(c, 0) + 1
        total[c] = total.get(c, 0.0) + (v or 0.0)
        since[c] = (0.0 if r else since.get(c, 0.0)) + (v or 0.0)
        out[k] = (total[c], count[c], since[c], last.get(c, (None, None)))
        seen = last.get(c, (None, None))
        last[c] = (v if v is not None else seen[0], n if n is not None else seen[1])
    return out


def made(seed, n, channels, hot):
    rnd = random.Random(seed)
    chan = lambda: None if rnd.random() < 0.05 else 0 if rnd.random() < hot else rnd.randrange(channels)
    return [(chan(), k, None if rnd.random() < 0.2 else float(rnd.randrange(100)), None if rnd.random() < 0.7 else f"n{k}", None if rnd.random() < 0.1 else rnd.random() < 0.02) for k in range(n)]


def result(df, **how):
    sums = {"total": F.col("val"), "n": F.lit(1), "since": (F.col("val"), F.col("reset"))}
    lasts = {"before": F.col("val"), "named": F.col("name")}
    return prefix.running(df, ["chan"], "arrival", sums, lasts, **how)


@pytest.mark.parametrize("seed, n, channels, hot, ranges", [(1, 400, 4, 0.5, 7), (2, 400, 200, 0.0, 7), (3, 300, 1, 1.0, 40), (4, 5, 2, 0.5, 9), (5, 200, 3, 0.3, None)])
def test_equal_to_a_loop(spark, seed, n, channels, hot, ranges):
    rows = made(seed, n, channels, hot)
    got = result(table(spark, rows), ranges=ranges).collect()
    assert {r.k: (r.total, r.n, r.since, (r.before, r.named)) for r in got} == loop(rows) and len(got) == n


def test_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = made(6, 300, 3, 0.6)
        got = result(table(spark, rows), ranges=3).collect()
        assert {r.k: (r.total, r.n, r.since, (r.before, r.named)) for r in got} == loop(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_columns_stay_and_an_empty_table_is_empty(spark):
    df = table(spark, made(7, 50, 2, 0.5)).withColumns({"range": F.lit("x"), "known_total": F.lit("y"), "open_total": F.lit("z"), "total": F.lit("old")})
    out = result(df)
    assert sorted(out.columns) == sorted([*df.columns, "n", "since", "before", "named"])
    assert {(r.range, r.known_total, r.open_total, r.place) for r in out.collect()} == {("x", "y", "z", "p")}
    assert result(df.filter("false")).count() == 0


def test_a_hot_channel_in_one_day_is_dealt_over_ranges(spark):
    """All rows of one channel within a day: no range has a large share, and the rows are exchanged once."""
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("chan"), F.timestamp_millis(F.col("id")).alias("arrival"), F.col("id").cast("double").alias("val"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = df.repartitionByRange(8, "chan", "arrival").groupBy(F.spark_partition_id()).count().collect()
        assert len(ranged) == 8 and max(r["count"] for r in ranged) < 2 * 20_000 / 8
        got = prefix.running(df, ["chan"], "arrival", {"n": F.lit(1)}, ranges=8)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 0  # after the scan rows meet only the broadcast ends
        assert got.filter("n <> val + 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_fields_with_resets_as_a_detector_keeps_them(spark):
    rnd = random.Random(8)
    rows = [(k % 2, k, rnd.choice([1, 1, 1, 2, 3, 4, 5]), None if rnd.random() < 0.1 else rnd.random() * 50) for k in range(400)]
    m = spark.createDataFrame(rows, "chan long, seq long, itype int, val double").withColumn("arrival", F.timestamp_seconds("seq"))
    sets, want = {0: ([], []), 1: ([], [])}, {}
    for chan, k, kind, val in rows:
        flats, darks = sets[chan]
        if kind in (4, 5):
            sets[chan] = ([], darks) if kind == 4 else (flats, [])
            flats, darks = sets[chan]
        if val is not None and kind != 1:
            (flats if kind in (2, 4) else darks).append(val)
        if kind == 1:
            f, d = (sum(x) / len(x) if x else None for x in (flats, darks))
            want[k] = val if val is None or f is None or d is None else (val - d) / max(f - d, 1e-6)
    got = {r.seq: r.out for r in normalise.normalised(m).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] or got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_a_value_that_equals_the_mean_of_its_dark_fields(spark, tmp_path):
    """The last bit of the sum decides between 0 and a large logarithm, so sums are those of the SQL: one value after the other."""
    values = [15.11, 71.3, 28.08, 14.15, 5.51]
    rows = [(k, 1, "error", v) for k, v in enumerate(values)] + [(5, 1, "click", 90.0), (6, 1, "view", 26.83)]
    own = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("event_id")).withColumn("props", F.lit(""))
    own.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["preprocess_chain"]).fetchall()
    assert want[0][2] > 30
    assert [tuple(r) for r in catalog.preprocess_chain(spark, str(tmp_path)).collect()] == want


def test_sums_are_added_in_order(spark):
    """Bit by bit, over batches that end anywhere, and with resets."""
    rnd = random.Random(8)
    rows = [(0, k, round(rnd.uniform(1, 99), 2), None, rnd.random() < 0.05) for k in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = result(table(spark, rows), ranges=1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = loop(rows)
    assert {r.k: (r.total, r.since) for r in got} == {k: (v[0], v[2]) for k, v in want.items()}
