"""Repeated-substring removal by a cover sample of positions, in buckets; no suffix is sorted.

A byte goes if a `window`-byte string that covers it also starts earlier (smaller document, or same document and
earlier). This stands in for the difference-cover construction of a suffix array. What it keeps of that: a sparse
sample of positions such that any two equal windows hold a sampled position at the same offset, names of the sample's
strings that resolve long ties, and work in buckets whose memory is bounded. What it doesn't: the sample is chosen by
content, the position of the smallest GRAM-byte hash in each window (about 4 % of positions, where a cover by residues
would take 14 % and be shifted by every insertion), strings are told apart by 128-bit hashes, and their order is never
needed, so nothing is sorted as suffixes. The README has the figures behind the choice.

1. All windows with the same sampled position form a segment, named by (hash of the gram, hash of all its bytes). Equal
   segments meet in one bucket; all but the earliest repeat whole. A batch first settles its own repeats, so a hot
   passage or a group of copies has one row a batch, not one a document.
2. Where a gram has several different segments, the windows of each segment's earliest occurrence are compared, by
   hashes in buckets, again after each batch has settled its own.
3. Repeats travel back to their documents as intervals, and the rest of the text is cut out there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.llm.common import documents, stash, text_or_empty

WINDOW, GRAM, SEED = 100, 48, 7
MIX = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Hashes of any substrings of a text, by prefix sums of a polynomial modulo 2**64, two independent ones."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.tables = rng.integers(0, 2**64, (2, 256), dtype=np.uint64)
        self.bases = [int(x) | 1 for x in rng.integers(0, 2**64, 2, dtype=np.uint64)]
        self.powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        self.inverses = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def reach(self, n: int) -> None:
        if len(self.powers[0]) <= n:
            size = max(2 * len(self.powers[0]), n + 1)
            for k in range(2):
                for own, base in ((self.powers, self.bases[k]), (self.inverses, pow(self.bases[k], -1, 2**64))):
                    steps = np.full(size, base, np.uint64)
                    steps[0] = 1
                    own[k] = np.cumprod(steps)

    def sums(self, data: np.ndarray, k: int) -> np.ndarray:
        self.reach(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.tables[k][data] * self.powers[k][: len(data)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (sums[end] - sums[start]) * self.inverses[k][start]
        x ^= x >> np.uint64(32)
        x *= MIX
        return x ^ (x >> np.uint64(29))


_hasher: list[Hasher] = []


def hasher() -> Hasher:
    if not _hasher:
        _hasher.append(Hasher())
    return _hasher[0]


def leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each start of a run of `width` values, the place of the smallest (leftmost of equals), by doubling."""
    val, idx, span = values, np.arange(len(values)), 1
    while 2 * span <= width:
        take = val[:-span] <= val[span:]
        val, idx, span = np.where(take, val[:-span], val[span:]), np.where(take, idx[:-span], idx[span:]), 2 * span
    rest = width - span
    if rest:
        idx = np.where(val[:-rest] <= val[rest:], idx[:-rest], idx[rest:])
    return idx


def segments(data: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(name, segment hash, first window, number of windows) of a text of at least `window` bytes."""
    h = hasher()
    s0, s1 = h.sums(data, 0), h.sums(data, 1)
    at = np.arange(len(data) - GRAM + 1)
    grams = h.between(s0, 0, at, at + GRAM)
    owner = leftmost_min(grams, window - GRAM + 1)
    lo = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
    n = np.diff(np.concatenate([lo, [len(owner)]]))
    end, anchor = lo + n + window - 1, owner[lo]
    seg = h.between(s0, 0, lo, end) * MIX + h.between(s1, 1, lo, end) + (n * 256 + anchor - lo).astype(np.uint64) * MIX
    return grams[anchor].astype(np.int64), seg.astype(np.int64), lo, n


def settled(a: np.ndarray, b: np.ndarray, key: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which rows are the earliest of their (a, b)."""
    order = np.lexsort((lo, key, b, a))
    first = np.ones(len(a), bool)
    first[order[1:]] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    return first


#: at: first window << 32 | number of windows << 1 | known to repeat; in order of the first window.
NAMED = "name bigint, seg bigint, key bigint, at bigint"
LO, N, KNOWN = "int(shiftright(at, 32))", "int(shiftright(at, 1) & 2147483647)", "at & 1 = 1"


def packed(lo: np.ndarray, n: np.ndarray, known: int) -> np.ndarray:
    return lo.astype(np.int64) << 32 | n.astype(np.int64) << 1 | known


def rows_of(parts: list[tuple]) -> Iterator[pd.DataFrame]:
    """parts: (a, b, key, lo, n) arrays. The earliest rows of a batch, and the others as known repeats, runs of them as one."""
    if not parts:
        return
    a, b, key, lo, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = settled(a, b, key, lo)
    yield pd.DataFrame({"name": a[first], "seg": b[first], "key": key[first], "at": packed(lo[first], n[first], 0)})
    key, lo, n = key[~first], lo[~first], n[~first]
    order = np.lexsort((lo, key))
    key, lo, n = key[order], lo[order], n[order]
    if len(key):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] > (lo + n)[:-1])])
        start = np.flatnonzero(new)
        stop = np.concatenate([start[1:], [len(key)]]) - 1
        yield pd.DataFrame({"name": key[start] * 1000003 + lo[start], "seg": np.zeros(len(start), np.int64), "key": key[start], "at": packed(lo[start], lo[stop] + n[stop] - lo[start], 1)})


BATCH = 8_000_000  # bytes of text that settle their repeats together, at least


def named_segments(window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for frame in frames:
            for key, text in zip(frame.key.tolist(), frame.text, strict=True):
                if len(text) >= window:
                    name, seg, lo, n = segments(np.frombuffer(text, np.uint8), window)
                    parts.append((name, seg, np.full(len(lo), key), lo, n))
                    held += len(text)
            if held >= BATCH:
                yield from rows_of(parts)
                parts, held = [], 0
        yield from rows_of(parts)

    return run


def single_windows(window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = hasher()
        parts, held = [], 0
        for frame in frames:
            for key, text, spans in zip(frame.key.tolist(), frame.text, frame.spans, strict=True):
                data = np.frombuffer(text, np.uint8)
                at = np.concatenate([np.arange(x["lo"], x["lo"] + x["n"]) for x in spans])
                s0, s1 = h.sums(data, 0), h.sums(data, 1)
                parts.append((h.between(s0, 0, at, at + window).astype(np.int64), h.between(s1, 1, at, at + window).astype(np.int64), np.full(len(at), key), at, np.ones(len(at), np.int64)))
                held += 8 * len(at)
            if held >= BATCH:
                yield from rows_of(parts)
                parts, held = [], 0
        yield from rows_of(parts)

    return run


def merged(spans, window: int) -> list[tuple[int, int]]:
    """Byte runs covered by windows, given as (first window, number)."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((x["lo"], x["lo"] + x["n"] + window - 1) for x in spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def cut(window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, spans in zip(frame.text, frame.spans, strict=True):
                runs, at, kept = merged(spans, window) if spans is not None else [], 0, []
                for lo, hi in runs:
                    kept.append(text[at:lo])
                    at = hi
                kept.append(text[at:])
                out.append((len(text), runs, b"".join(kept)))
            yield pd.DataFrame({"key": frame.key, "n_bytes": [x[0] for x in out], "removed": [[{"start": a, "end": b} for a, b in x[1]] for x in out], "kept": [x[2] for x in out]})

    return run


def repeats(rows: DataFrame) -> tuple[Column, Column]:
    """(not the earliest of its name and segment; its name has several segments), as windows over rows dealt by name."""
    first = F.row_number().over(Window.partitionBy("name", "seg").orderBy("key", "at")) > 1
    whole = Window.partitionBy("name")
    return first, F.min("seg").over(whole) != F.max("seg").over(whole)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(key, text as bytes), and (key, id) where ids can't be keys: keys are unique and ordered as documents are.

    Ids serve where they are whole numbers, unique and not null; else (strings, too) rows are sorted by (id, nulls last, text) and numbered.
    """
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    whole = dict(own.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint")
    if whole and not own.groupBy("id").count().filter("id IS NULL OR count > 1").limit(1).count():
        return own.select(F.col("id").cast("bigint").alias("key"), "text"), None
    ordered = own.orderBy(F.col("id").asc_nulls_last(), "text")
    numbered = stash(ordered.select(F.monotonically_increasing_id().alias("key"), "id", "text"), "ordered-documents")
    return numbered.select("key", "text"), numbered.select("key", "id")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each input row: id, n_bytes, removed array<struct<start, end>> (maximal byte runs), kept (the other bytes).

    Texts are UTF-8 bytes; a cut may fall inside a character. Nulls: a null text is empty; null ids come last. Ids may be
    of any type that has an order. Very long texts are taken whole, in arrays of some 60 bytes a byte of text. Ties: rows
    that share an id count as documents of their own, in the order of their texts, so a repeated row loses what the
    first has. Texts shorter than window keep all. An empty table gives an empty result. Other columns are ignored.
    """
    own, ids = keyed(docs, id_col, text_col)  # one exchange of the texts by key serves both joins below
    rows = own.mapInPandas(named_segments(window), NAMED)
    again, contested = repeats(rows)
    judged = rows.withColumn("again", again).withColumn("contested", contested)
    found = stash(judged.select("key", F.expr(LO).alias("lo"), F.expr(N).alias("n"), (F.expr(KNOWN) | F.col("again")).alias("dup"), "contested").filter("dup OR contested"), "segments")
    spans = F.collect_list(F.struct("lo", "n")).alias("spans")
    open_spans = found.filter("NOT dup").groupBy("key").agg(spans)
    windows = own.join(open_spans, "key").mapInPandas(single_windows(window), NAMED)
    buckets = windows.withColumn("again", F.row_number().over(Window.partitionBy("name", "seg").orderBy("key", "at")) > 1)
    dup = found.filter("dup").select("key", "lo", "n").unionByName(buckets.filter(F.expr(KNOWN) | F.col("again")).select("key", F.expr(LO).alias("lo"), F.expr(N).alias("n")))
    per_doc = dup.groupBy("key").agg(spans)
    done = own.join(per_doc, "key", "left").mapInPandas(cut(window), "key bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")
    return done.withColumnRenamed("key", id_col) if ids is None else done.join(ids, "key").select(F.col("id").alias(id_col), "n_bytes", "removed", "kept")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, bytes]], window: int = WINDOW) -> dict[int, tuple[int, int, int, str]]:
    """The same by a set of all windows seen so far; for tests."""
    seen: set[bytes] = set()
    out = {}
    for key, text in sorted(texts):
        gone = np.zeros(len(text) + 1, np.int64)
        for p in range(len(text) - window + 1):
            if (w := text[p : p + window]) in seen:
                gone[p : p + window] = 1
            seen.add(w)
        mask = gone[: len(text)].astype(bool)
        out[key] = len(text), int(mask.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(text, np.uint8)[~mask].tobytes()).hexdigest()
    return out


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLES = {}
