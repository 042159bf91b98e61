"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8; and, if asked for, documents that SimHash links.

Fingerprints within simhash.MOST bits (simhash.links, by pivot distance tables) are links as they are. At a similarity of 0.8
fingerprints differ by about ten bits, so many pairs lie beyond; the rest is found by bands. Each different set of shingles is a class. Classes meet when they agree in one of BANDS bands of ROWS MinHash values
(two sets at 0.8 miss all bands with a chance of (1 - 0.8**4)**20 = 3e-5, more similar ones with less). Those that meet
are held against each other by the sets themselves, so that no link is below the similarity. Only a spanning forest
of a group's links is written; groups that agree in all members count once. Groups above `chunk` classes are cut into
chunks, each linked for itself first; then chunks meet across the components that were found (simhash.across), so no
link between two components is left out.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from lumenfold.llm import simhash
from lumenfold.llm.common import keep_rows, stash, text_or_empty
from lumenfold.llm.simhash import across, components, salted, spread

SHINGLE, SIMILAR, BANDS, ROWS, SEED, CHUNK = 5, 0.8, 20, 4, 42, 1024
PIECE = 20_000  # shingles hashed at a time
_DRAW = np.random.default_rng(SEED)
MASKS = _DRAW.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64)
FACTORS = _DRAW.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
MIX = _DRAW.integers(0, 2**64, ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles of UTF-8 text, words as in simhash.fingerprint; a shorter text is one shingle."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: max(1, len(words) - shingle + 1)].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64))


def bands(own: np.ndarray) -> np.ndarray:
    """One number for each band of MinHash values."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(own), PIECE):
        least = np.minimum(least, ((own[None, k : k + PIECE] ^ MASKS) * FACTORS).min(1))
    return (least.reshape(BANDS, ROWS) * MIX).sum(1, dtype=np.uint64).view(np.int64)


@F.pandas_udf(StructType().add("key", BinaryType()).add("bands", ArrayType(LongType())).add("fp", LongType()))
def sketch_udf(texts: pd.Series) -> pd.DataFrame:
    sets = [shingles(bytes(x)) for x in texts]
    fps = np.array([simhash.fingerprint(bytes(x)) for x in texts], dtype=np.uint64).view(np.int64)
    return pd.DataFrame({"key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "bands": [bands(s) for s in sets], "fp": fps})


@F.pandas_udf(BinaryType())
def shingles_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(bytes(x)).tobytes() for x in texts], dtype=object)


def forest(sides: np.ndarray, sets: list[np.ndarray], similar: float = SIMILAR, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect all sets of one group that are connected; of two sides other than -1, only pairs across are held against each other.

    known: a number for the component of each set, where some are connected already.

    Each set is held against the later ones that are not in its component yet, all at once.
    """
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    root, out = np.arange(len(sets)) if known is None else known.copy(), []
    for i in range(len(sets) - 1):
        other = root != root[i]
        if not other.any():
            break
        other[:i] = False
        other &= ((sides != sides[i]) | (sides[i] < 0)) & (np.minimum(sizes, sizes[i]) >= similar * np.maximum(sizes, sizes[i]) - 1e-9)
        if not other.any() or not sizes[i]:
            continue
        held = other[owner]
        values, own = flat[held], owner[held]
        at = np.minimum(np.searchsorted(sets[i], values), sizes[i] - 1)
        common = np.bincount(own[sets[i][at] == values], minlength=len(sets))
        for j in np.flatnonzero(other & (common >= similar * (sizes + sizes[i] - common) - 1e-9)).tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def _links(similar: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group; a group that a batch may have cut waits for the next batch."""
        held: list[pd.DataFrame] = []

        def linked() -> pd.DataFrame:
            own = pd.concat(held, ignore_index=True)
            pairs = forest(own.side.to_numpy(), [np.frombuffer(s, np.uint64) for s in own["set"]], similar, pd.factorize(own.root)[0])
            return pd.DataFrame({"a": [own.key[i] for i, _ in pairs], "b": [own.key[j] for _, j in pairs]})

        last = None
        for frame in frames:
            for group, own in frame.groupby(["g", "part"], sort=False):
                if held and group != last:
                    yield linked()
                    held.clear()
                held.append(own)
                last = group
        if held:
            yield linked()

    return run


def links(docs: DataFrame, classes: DataFrame, similar: float = SIMILAR, chunk: int = CHUNK) -> DataFrame:
    """(a, b) over the keys of classes (key, bands, best): enough links of at least `similar` to connect all that are connected."""
    members = classes.select("key", F.posexplode("bands").alias("k", "v")).select("key", F.xxhash64("k", "v").alias("g"))  # a collision only adds rows to be held against each other
    marks = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"m{i}") for i in (0, 1)]
    groups = members.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *marks).filter("n > 1").groupBy("n", "m0", "m1").agg(F.min("g").alias("g")).select("g", F.ceil(F.col("n") / chunk).cast("int").alias("n"))
    own = stash(members.join(groups, "g").withColumn("part", F.pmod(F.xxhash64("key", F.lit(2)), F.col("n"))), "near-members")
    wanted = classes.join(own.select("key").distinct(), "key", "left_semi").select("key", F.col("best.id").alias("own_id"), F.col("best.sha").alias("own_sha"))
    texts = docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("t")).withColumn("sha", F.unhex(F.sha2("t", 256)))
    found = texts.join(wanted, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("sha") == F.col("own_sha"))).select("key", "t")
    sets = stash(found.groupBy("key").agg(F.first("t").alias("t")).select("key", shingles_udf(F.col("t").cast("binary")).alias("set")), "near-sets")

    def linked(dealt: DataFrame) -> DataFrame:
        # in order of keys, so that groups with the same members in them mostly link these to the same one
        ready = dealt.join(sets, "key").select("g", "part", "side", "key", "root", "set").repartition("g", "part").sortWithinPartitions("g", "part", "key")
        return ready.mapInPandas(_links(similar), "a binary, b binary")

    alone = linked(own.select("g", "part", F.lit(-1).cast("long").alias("side"), "key", F.col("key").alias("root"))).distinct()
    large = own.filter("n > 1").select("g", "key")
    if large.isEmpty():
        return alone
    alone = stash(alone, "near-links")
    return alone.unionByName(linked(across(large, alone, "g", "key", chunk))).distinct()


def fingerprint_links(marked: DataFrame) -> DataFrame:
    """(a, b) over the keys of marked (key, fp; different rows): each to the least key of its component of fingerprints."""
    fps = stash(marked.select("fp").distinct(), "near-fingerprints")
    found = components(simhash.links(fps)).select(F.col("node").alias("fp"), "root")
    coded = stash(salted(marked, "key").join(spread(found), ["fp", "__salt"], "left").select("key", F.coalesce("root", "fp").alias("code")), "near-codes")
    least = coded.groupBy("code").agg(F.min("key").alias("a"), F.max("key").alias("last")).filter(F.col("a") != F.col("last"))
    both = salted(coded, "key").join(spread(least), ["code", "__salt"])
    return both.filter(F.col("key") != F.col("a")).select("a", F.col("key").alias("b")).distinct()


def drop_near_copies(docs: DataFrame, similar: float = SIMILAR, chunk: int = CHUNK, fingerprints: bool = False) -> DataFrame:
    """docs with one document of each component of near copies, linked by similarity, and by fingerprints if asked for; all columns stay.

    Very long texts are taken whole. The one that stays has the smallest (id, SHA-256 of the text), null ids last. A null text counts as empty. Rows with
    the same id, or without one, stay as long as their texts are no near copies. An empty table gives an empty result.
    """
    sketched = docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("t")).select("id", F.unhex(F.sha2("t", 256)).alias("sha"), sketch_udf(F.col("t").cast("binary")).alias("s"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sha")).alias("best")
    marked = stash(sketched.select("id", "sha", "s.*").groupBy("key", "fp").agg(best, F.first("bands").alias("bands")), "near-marked")
    classes = stash(marked.groupBy("key").agg(F.min("best").alias("best"), F.first("bands").alias("bands")), "near-classes")
    linked = links(docs, classes, similar, chunk)
    if fingerprints:
        linked = fingerprint_links(marked.select("key", "fp")).unionByName(linked)
    found = components(linked)
    rooted = classes.select("key", "best").join(found.select(F.col("node").alias("key"), "root"), "key", "left")
    kept = rooted.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("best").alias("best")).select("best.id", "best.sha")
    return keep_rows(docs, [("id", F.col("doc_id")), ("sha", F.unhex(F.sha2(text_or_empty(), 256)))], kept)
