"""Streams against their batch forms: many micro-batches, restarts, ends, silence, changes of length."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import count_window, normalise, raytrace, stream_checks
from lumenfold.sources.scans import END
from lumenfold.streaming import channels, reconstruction, sources

SCHEMA = "chan long, arrival timestamp, seq long, itype int, val double"


def messages(spark, seed=1, n=240, chans=(None, 1, 2, 3, 4)):
    """Messages of a few channels, some lost, some without a value, one channel with a third of them."""
    rnd, seq, rows = random.Random(seed), {}, []
    for k in range(n):
        chan = 1 if rnd.random() < 0.3 else rnd.choice(chans)
        seq[chan] = seq.get(chan, 100) + rnd.choice([1, 1, 1, 1, 3])
        rows.append((chan, k, seq[chan], rnd.choice([1, 1, 1, 2, 3, 4, 5]), None if rnd.random() < 0.05 else round(rnd.random() * 50, 2)))
    own = spark.createDataFrame(rows, "chan long, k long, seq long, itype int, val double")
    return own.select("chan", F.timestamp_seconds("k").alias("arrival"), "seq", "itype", "val")


def rows_of(df, *names):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect()), key=key)


def test_windows_as_arrays_are_windows_member_by_member():
    rnd = random.Random(4)
    for length in (1, 2, 4, 7):
        for step in (1, 2, 3, 9):
            plain = count_window.CountWindow(length, step)
            state, got, want = None, [], []
            k = 0
            for _ in range(rnd.randint(1, 12)):
                new = np.arange(k, k + rnd.randint(0, 11))
                k += len(new)
                own = channels.Window(state, length, step)
                if rnd.random() < 0.3:
                    own.length = plain.length = rnd.randint(1, 8)
                got += own.feed(new, new * 1.5)
                want += [x for m in new.tolist() for x in plain.feed(m)]
                state = own.state()
            got += channels.Window(state, length, step).close()
            want += plain.close()
            assert got == [(p, len(m), m[0], m[-1], sum(1.5 * x for x in m)) for p, m in want]


@pytest.mark.parametrize("parts", [1, 6])
def test_preprocessing_in_a_stream_is_that_of_all_rows(spark, parts):
    m = messages(spark).cache()
    got = sources.replayed(channels.normalised(sources.message_stream(m, parts), blocks=3))
    want = normalise.normalised(m).join(stream_checks.acquisition_counts(m).withColumnRenamed("chan", "c2"), "seq")
    want = want.filter(F.col("chan").eqNullSafe(F.col("c2")))
    assert rows_of(got, "chan", "seq", "flat", "dark", "out", "flats", "darks") == rows_of(want, "chan", "seq", "flat", "dark", "out", "flats", "darks")
    received = {r.chan: r for r in stream_checks.lost(m).collect()}
    last = {r.chan: r for r in got.orderBy("received").collect()}
    assert all(r.received <= received[c].received and r.lost <= received[c].lost for c, r in last.items()) and last.keys() == received.keys()


def test_a_restart_in_the_middle_changes_nothing(spark, tmp_path):
    """The stream stops after half the acquisition; the second run goes on from its checkpoint."""
    m = messages(spark, 2).cache()
    half = F.timestamp_seconds(F.lit(120))
    folder, top = str(tmp_path / "in"), str(tmp_path / "run")
    none = m.filter("false")
    sources.acquire(m.filter(F.col("arrival") < half), "arrival", none, folder, 2)
    for gives in ("out", "passes"):
        open_ = lambda: sources.opened(spark, folder, m.schema)
        build = lambda: channels.normalised(open_(), blocks=4) if gives == "out" else channels.count_windows(open_(), 4, 2, blocks=4)  # noqa: B023, E731
        before = sources.run_to_end(build(), f"{top}-{gives}").count()
        assert before > 0
    ends = m.groupBy("chan").agg(F.max("arrival").alias("arrival")).select("chan", "arrival", F.lit(0).cast("long").alias("seq"), F.lit(END).alias("itype"), F.lit(None).cast("double").alias("val"))
    sources.acquire(m.filter(F.col("arrival") >= half), "arrival", ends, folder, 2)
    again = sources.run_to_end(channels.normalised(sources.opened(spark, folder, m.schema), blocks=4), f"{top}-out")
    assert rows_of(again, "chan", "seq", "out") == rows_of(normalise.normalised(m), "chan", "seq", "out")
    passes = sources.run_to_end(channels.count_windows(sources.opened(spark, folder, m.schema), 4, 2, blocks=4), f"{top}-passes")
    whole = sources.replayed(channels.count_windows(sources.message_stream(m, 1), 4, 2, blocks=4))
    assert rows_of(passes, *passes.columns) == rows_of(whole, *whole.columns) and passes.count() > 0


def test_lengths_change_and_ends_drain(spark):
    """Channel 1 gets a new length after its sixth message and ends, channel 2 begins anew after its end."""
    rows = [(1, k, k, 1, float(k)) for k in range(9)] + [(1, 5, 0, sources.LENGTH, 2.0)] + [(2, k, 100 + k, 1, 1.0) for k in range(3)] + [(2, 2, 0, END, None)] + [(2, 5 + k, 200 + k, 1, 1.0) for k in range(2)]
    m = spark.createDataFrame(rows, "chan long, k long, seq long, itype int, val double").withColumn("arrival", F.timestamp_seconds("k")).drop("k")
    got = sources.replayed(channels.count_windows(sources.message_stream(m, 3), 4, 2, raw=True, blocks=2)).collect()
    assert sorted((r["pass"], r.n, r.first_seq, r.last_seq) for r in got if r.chan == 1) == [(0, 2, 0, 1), (1, 4, 0, 3), (2, 4, 2, 5), (3, 2, 6, 7), (4, 1, 8, 8)]
    assert sorted((r["pass"], r.n, r.first_seq) for r in got if r.chan == 2) == [(0, 2, 100), (0, 2, 200), (1, 3, 100), (2, 1, 102)]


def test_silent_channels_drain_by_a_timer(spark, tmp_path):
    """Channel 1 stops without an end; once event time is far enough on, its window drains, and that of the talking channel doesn't."""
    rows = [(1, k, k, 1, 1.0) for k in range(5)] + [(2, k, 100 + k, 1, 1.0) for k in range(0, 200, 4)]
    m = spark.createDataFrame(rows, "chan long, k long, seq long, itype int, val double").withColumn("arrival", F.timestamp_seconds(F.col("k") + 1000)).select("chan", "arrival", "seq", "itype", "val")
    folder = str(tmp_path / "in")
    sources.acquire(m, "arrival", m.filter("false"), folder, 4)
    stream = sources.opened(spark, folder, m.schema).withWatermark("arrival", "1 second")
    got = sources.run_to_end(channels.count_windows(stream, 4, 2, raw=True, silence=60.0, blocks=2), str(tmp_path / "run")).collect()
    assert sorted((r["pass"], r.n) for r in got if r.chan == 1) == [(0, 2), (1, 4), (2, 3), (3, 1)]
    assert all(r.n == 4 for r in got if r.chan == 2 and r["pass"] > 0)


def test_an_empty_stream(spark):
    m = messages(spark).filter("false")
    assert sources.replayed(channels.normalised(sources.message_stream(m, 2))).count() == 0
    assert sources.replayed(channels.count_windows(sources.message_stream(m, 2), 4, 2)).count() == 0


def frames(spark, n=4, slices=3, count=26):
    rnd = np.random.default_rng(5)
    rows = [(p, 0.05 + p * 0.11, None if p % 3 else 2.25, rnd.normal(size=n * slices).tolist()) for p in range(count)]
    return spark.createDataFrame(rows, "proj long, theta double, center double, px array<double>")


def as_rays(f, n):
    return f.select("proj", "theta", "center", F.posexplode("px").alias("e", "val")).select("proj", "theta", "center", F.expr(f"int(e div {n})").alias("slice"), (F.col("e") % n).cast("int").alias("col"), "val")


def test_reconstruction_goes_on_after_a_restart(spark, tmp_path):
    """Stopped in the middle and started again, it publishes the images of an uninterrupted run; a batch that runs twice is there once."""
    f = frames(spark).cache()
    how = {"length": 8, "step": 3, "emit_every": 2}
    want = rows_of(raytrace.sirt_windowed(as_rays(f, 4), 4, **how), "pass", "slice", "pix", "val")
    folder, top = str(tmp_path / "in"), str(tmp_path / "run")
    own = f.select("proj", F.lit(1).alias("itype"), "theta", "center", "px")
    sources.acquire(own.filter("proj < 13"), "proj", own.filter("false"), folder, 2)
    run = lambda: reconstruction.publish(reconstruction.images(sources.opened(spark, folder, reconstruction.FRAME), 4, 3, **how), top)
    run()
    early = reconstruction.published(spark, top).count()
    ends = own.limit(1).select(F.lit(99).cast("long").alias("proj"), F.lit(END).alias("itype"), "theta", "center", F.lit(None).cast("array<double>").alias("px"))
    sources.acquire(own.filter("proj >= 13"), "proj", ends, folder, 2)
    run()
    got = rows_of(reconstruction.published(spark, top), "pass", "slice", "pix", "val")
    assert got == want and 0 < early < len(got)
    run()
    assert rows_of(reconstruction.published(spark, top), "pass", "slice", "pix", "val") == want


def test_live_reconstruction_is_that_of_all_rows(spark):
    f = frames(spark, count=11)
    got = reconstruction.reconstructed(f, 4, 3, parts=3, length=4, step=2)
    assert rows_of(got, "pass", "slice", "pix", "val") == rows_of(raytrace.sirt_windowed(as_rays(f, 4), 4, 4, 2), "pass", "slice", "pix", "val")
