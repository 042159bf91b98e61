"""Stateful processing of detector channels: fields, normalisation and counters as of arrival, then count windows.

State of a channel is a few numbers and one window with one step. Channels are dealt over blocks by hash; a block's states
are read and written once a micro-batch, and its messages are handled as arrays over all its channels. Only windows take
a step of Python for each channel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenfold.operators.normalise import LEAST
from lumenfold.operators.stream_checks import DARKS, FLATS
from lumenfold.sources.scans import END
from lumenfold.streaming.sources import LENGTH, keep_state_on_disk

NAN = float("nan")
PASSES = "chan bigint, pass bigint, n int, first_seq bigint, last_seq bigint, total double"
PROJECTIONS = "chan bigint, seq bigint, flat double, dark double, out double, flats bigint, darks bigint, received bigint, lost bigint"
NUMBERS = "flat_sum double, flat_n bigint, dark_sum double, dark_n bigint, flats bigint, darks bigint, received bigint, lost bigint, seq bigint"
WINDOW = "number bigint, length int, seqs array<bigint>, vals array<double>, new_seqs array<bigint>, new_vals array<double>"
STATE = f"none boolean, chan bigint, last double, {NUMBERS}, {WINDOW}"
BLOCKS = 64  # of channels; a stream keeps its number for life
NEW = (0.0, 0, 0.0, 0, 0, 0, 0, 0, None)  # the NUMBERS of a channel before its first message


def fields(first: np.ndarray, carried: list[tuple], seq: np.ndarray, kind: np.ndarray, val: np.ndarray, least: float) -> pd.DataFrame:
    """What is known at each message, its own field included. Messages lie run by run (a channel in order of arrival), runs begin at `first`; carried: each run's NUMBERS before.

    Sums begin anew with a reset; rows before a run's first reset stand on top of what is carried.
    """
    run = np.repeat(np.arange(len(first)), np.diff(first, append=len(seq)))
    start = np.zeros(len(seq), bool)
    start[first] = True
    before = dict(zip((c.split()[0] for c in NUMBERS.split(", ")), zip(*carried, strict=True), strict=True))
    brought = lambda name: np.array(before[name])[run]

    def count(values: np.ndarray, name: str) -> np.ndarray:
        return pd.Series(values).groupby(run).cumsum().to_numpy() + brought(name)

    out = {}
    for name, kinds in (("flat", FLATS), ("dark", DARKS)):  # kinds are (field, field that resets)
        mine, reset = np.isin(kind, kinds), kind == kinds[1]
        there = mine & ~np.isnan(val)
        part = np.cumsum(start | reset)
        bare = pd.Series(reset.astype(int)).groupby(run).cumsum().to_numpy() == 0
        for what, values in ((f"{name}_sum", np.where(there, val, 0.0)), (f"{name}_n", there.astype(np.int64))):
            out[what] = pd.Series(values).groupby(part).cumsum().to_numpy() + np.where(bare, brought(what), 0)
        out[f"{name}s"] = count(mine.astype(np.int64), f"{name}s")
    previous = np.concatenate((seq[:1], seq[:-1]))
    previous[first] = [s - 1 if b is None else b for s, b in zip(seq[first].tolist(), before["seq"], strict=True)]
    out["received"], out["lost"] = count(np.ones(len(seq), np.int64), "received"), count(np.maximum(seq - previous - 1, 0), "lost")
    f = pd.DataFrame(out | {"seq": seq})
    for name in ("flat", "dark"):
        f[name] = np.divide(f[f"{name}_sum"], f[f"{name}_n"], out=np.full(len(f), NAN), where=f[f"{name}_n"].to_numpy() > 0)
    seen = ~np.isnan(f["flat"]) & ~np.isnan(f["dark"])
    f["out"] = np.where(seen, (val - f["dark"]) / np.maximum(f["flat"] - f["dark"], least), val)
    return f


class Window:
    """One channel's count window over (seq, val) members; passes come as (pass, n, first seq, last seq, total)."""

    def __init__(self, state: tuple | None, length: int, step: int) -> None:
        self.step = step
        self.number, self.length, *members = state or (0, length, [], [], [], [])
        self.seqs, self.vals, self.new_seqs, self.new_vals = (np.array(x, kind) for x, kind in zip(members, (np.int64, float) * 2, strict=True))

    def state(self) -> tuple:
        return (self.number, self.length, *(x.tolist() for x in (self.seqs, self.vals, self.new_seqs, self.new_vals)))

    def feed(self, seqs: np.ndarray, vals: np.ndarray) -> list[tuple]:
        """The passes that these members complete: one for each step of new members.

        With h members held before a pass, a window that isn't full (h < length) keeps all, a full one its newest length - step.
        Once full it stays so, so where each pass begins has a closed form.
        """
        held, new = len(self.seqs), len(self.new_seqs)
        seqs, vals = np.concatenate([self.seqs, self.new_seqs, seqs]), np.concatenate([self.vals, self.new_vals, vals])
        passes = (len(seqs) - held) // self.step
        if not passes:
            self.new_seqs, self.new_vals = seqs[held:], vals[held:]
            return []
        before = held + self.step * np.arange(passes)
        low = np.where(before >= self.length, np.minimum(before, before - self.length + self.step), 0)
        out = self._made(seqs, vals, low, before + self.step)
        end = int(before[-1]) + self.step
        self.seqs, self.vals, self.new_seqs, self.new_vals = seqs[low[-1] : end], vals[low[-1] : end], seqs[end:], vals[end:]
        return out

    def close(self) -> list[tuple]:
        """The last passes: what is left of a step, then the drain, a step less each time."""
        out = []
        if len(self.new_seqs):
            held = len(self.seqs)
            low = min(held, held - self.length + self.step) if held >= self.length else 0
            self.seqs, self.vals = np.concatenate([self.seqs[low:], self.new_seqs]), np.concatenate([self.vals[low:], self.new_vals])
            out = self._made(self.seqs, self.vals, np.array([0]), np.array([len(self.seqs)]))
        n = len(self.seqs)
        low = np.arange(max(n - self.length, 0) + self.step, n, self.step)
        if len(low):
            out += self._made(self.seqs, self.vals, low, np.full(len(low), n))
        return out

    def _made(self, seqs: np.ndarray, vals: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple]:
        totals = np.add.reduceat(np.append(np.nan_to_num(vals), 0.0), np.stack([low, high], 1).ravel())[::2]
        numbers = range(self.number, self.number + len(low))
        self.number += len(low)
        return list(zip(numbers, (high - low).tolist(), seqs[low].tolist(), seqs[high - 1].tolist(), totals.tolist(), strict=True))


class Channels(StatefulProcessor):
    """gives: "projections" (PROJECTIONS) or "passes" (PASSES), over projections as normalised, or over all messages as they are if raw."""

    def __init__(self, gives: str, length: int = 1, step: int = 1, raw: bool = False, least: float = LEAST, silence: float | None = None) -> None:
        self.gives, self.length, self.step, self.raw, self.least, self.silence = gives, length, step, raw, least, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.channels = handle, handle.getListState("channels", STATE)

    def _load(self) -> dict[tuple, tuple]:
        return {(r[0], r[1]): (r[2], tuple(r[3:12]), tuple(r[12:])) for r in self.channels.get()}

    def _store(self, known: dict[tuple, tuple]) -> None:
        if known:
            self.channels.put([(*key, last, *numbers, *window) for key, (last, numbers, window) in known.items()])
        else:
            self.channels.clear()
        if self.silence is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if known:
                self.handle.registerTimer(int((min(last for last, _, _ in known.values()) + self.silence) * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """A block's micro-batch. At one time a channel's messages come before a new length, and its end last; what follows an end begins the channel anew."""
        m = pd.concat(list(rows), ignore_index=True)
        m["late"] = m["itype"].map({LENGTH: 1, END: 2}).fillna(0)
        m = m.sort_values(["none", "chan", "arrival", "late", "seq"], kind="stable", ignore_index=True)
        none, chan, seq, kind = (m[c].to_numpy() for c in ("none", "chan", "seq", "itype"))
        val, at = m["val"].to_numpy(float, na_value=np.nan), m["arrival"].to_numpy("datetime64[us]").astype(np.int64) / 1e6
        ended = kind == END
        new = np.concatenate(([True], (chan[1:] != chan[:-1]) | (none[1:] != none[:-1]) | ended[:-1]))
        begins = np.flatnonzero(new)
        known, out = self._load(), []
        keys = list(zip(none[begins].tolist(), chan[begins].tolist(), strict=True))
        again = [k > 0 and keys[k] == keys[k - 1] for k in range(len(keys))]
        held = [None if more else known.get(own) for own, more in zip(keys, again, strict=True)]
        data = (kind != LENGTH) & ~ended
        found = self._fields(begins, data, held, seq, kind, val)
        spans = list(zip(begins.tolist(), [*begins[1:].tolist(), len(m)], strict=True))
        for own, state, numbers, (low, high) in zip(keys, held, found[1], spans, strict=True):
            window = Window(state[2] if state else None, self.length, self.step)
            if self.gives == "passes":
                values = val if self.raw else found[0]
                for passes in self._windows(window, low, high, seq, kind, data, values, val):
                    out += [(*own, *p) for p in passes]
            if ended[high - 1]:
                out += [(*own, *p) for p in window.close()] if self.gives == "passes" else []
                known.pop(own, None)
            else:
                known[own] = (max(at[low:high].max(), state[0] if state else -np.inf), numbers, window.state())
        self._store(known)
        if self.gives == "passes":
            yield self._passes(out)
        elif found[2] is not None:
            mine = kind[data] == 1
            yield found[2].assign(chan=pd.array(np.where(none[data], 0, chan[data]), "Int64"), none=none[data])[mine].pipe(lambda f: f.assign(chan=f["chan"].mask(f["none"])))[[c.split()[0] for c in PROJECTIONS.split(", ")]]

    def _fields(self, begins: np.ndarray, data: np.ndarray, held: list, seq: np.ndarray, kind: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, list[tuple], pd.DataFrame | None]:
        """Normalised values by row, each run's NUMBERS after it, and what is known at each message."""
        numbers = [state[1] if state else NEW for state in held]
        values = np.full(len(seq), NAN)
        place = np.cumsum(data) - data  # of a row among the data
        first = place[begins]
        size = np.diff(first, append=int(data.sum()))
        there = np.flatnonzero(size)
        if not len(there):
            return values, numbers, None
        f = fields(first[there], [numbers[k] for k in there], seq[data], kind[data], val[data], self.least)
        values[data] = f["out"]
        last = f[[c.split()[0] for c in NUMBERS.split(", ")]].iloc[first[there] + size[there] - 1]
        for k, row in zip(there.tolist(), zip(*(last[c].tolist() for c in last.columns), strict=True), strict=True):
            numbers[k] = row
        return values, numbers, f

    def _windows(self, window: Window, low: int, high: int, seq: np.ndarray, kind: np.ndarray, data: np.ndarray, values: np.ndarray, val: np.ndarray) -> Iterator[list[tuple]]:
        """The passes of one run of rows, between its changes of length."""
        taken = data if self.raw else kind == 1
        begin = low
        for at in [*(low + np.flatnonzero(kind[low:high] == LENGTH)).tolist(), high]:
            own = taken[begin:at]
            yield window.feed(seq[begin:at][own], values[begin:at][own])
            if at < high:
                window.length = max(1, int(val[at]))
            begin = at + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Channels of the block that have been silent for so long have ended."""
        now, known, out = expiredTimerInfo.getExpiryTimeInMs() / 1000, self._load(), []
        for own, (last, _, state) in list(known.items()):
            if last + self.silence <= now + 1e-3:
                out += [(*own, *p) for p in Window(state, self.length, self.step).close()]
                del known[own]
        self._store(known)
        if self.gives == "passes":
            yield self._passes(out)

    def _passes(self, passes: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(None if p[0] else p[1], *p[2:]) for p in passes], columns=[c.split()[0] for c in PASSES.split(", ")]).astype({"chan": "Int64"})


def _run(stream: DataFrame, processor: Channels, kinds: str, blocks: int) -> DataFrame:
    keep_state_on_disk(stream.sparkSession)
    mode = "None" if processor.silence is None else "EventTime"
    block = F.pmod(F.xxhash64("chan"), F.lit(blocks)).cast("int").alias("block")
    own = stream.select(block, F.col("chan").isNull().alias("none"), F.coalesce("chan", F.lit(0)).cast("bigint").alias("chan"), "arrival", F.coalesce("seq", F.lit(0)).cast("bigint").alias("seq"), F.col("itype").cast("int").alias("itype"), F.col("val").cast("double").alias("val"))
    return own.groupBy("block").transformWithStateInPandas(processor, kinds, "Append", mode)


def normalised(stream: DataFrame, least: float = LEAST, blocks: int = BLOCKS) -> DataFrame:
    """Projections of a stream (chan, arrival, seq, itype, val) with what is known as they arrive: flat, dark, out, counts of fields, messages received and lost.

    As normalise.normalised, stream_checks.lost and stream_checks.acquisition_counts give it over all rows; a channel's
    state goes with its end message. Nulls: a null value is no field and stays null, a null channel is one of its own; numbers are not null.
    """
    out = _run(stream, Channels("projections", least=least), PROJECTIONS, blocks)
    nan = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("chan", "seq", nan("flat"), nan("dark"), nan("out"), "flats", "darks", "received", "lost")


def count_windows(stream: DataFrame, length: int, step: int, raw: bool = False, least: float = LEAST, silence: float | None = None, blocks: int = BLOCKS) -> DataFrame:
    """The passes of a count window a channel, for any length and step, over normalised projections (raw: over all messages as they are).

    An end message drains its channel. A LENGTH message sets the length from the next pass on. silence: seconds of event
    time after which a channel without messages has ended; the stream needs a watermark on arrival then. A null value
    adds nothing to a pass's total.
    """
    return _run(stream, Channels("passes", length, step, raw, least, silence), PASSES, blocks)
