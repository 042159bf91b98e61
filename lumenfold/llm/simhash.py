"""SimHash near-dedup with pivot distance tables.

Each different fingerprint gets its Hamming distances to a table of reference fingerprints (pivots). By the triangle
inequality, two fingerprints within `most` bits differ by at most `most` in every coordinate, so a pair whose maximum
coordinate difference is larger is discarded without being compared; survivors are verified bit by bit.

Pivot tables alone can't deal the work out: random 64-bit codes lie at 32 +- 4 bits from any pivot, so cells of
`most` + 1 distances with their neighbours hold most of all codes. So pairs meet by exact blocks first: of `blocks` bit
blocks, at least blocks - most agree in any pair within `most` bits, and one exchange for each choice of that many blocks
brings them together (every link is found, none is sampled). Within a block group, rows are sorted by the first pivot's
distance and held only against those near in it, pivot tables discard pairs, and only a spanning forest of the links is
written, so a dense group of g fingerprints writes at most g - 1 rows. Groups above `chunk` fingerprints are cut into
chunks, each linked for itself first; then chunks meet only across the components that were found (across()), so that a
group of one component, however large, costs as much as it has rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lumenfold.llm.common import discard, documents, join_classes, stash

SHINGLE, SEED, MOST, PIVOTS, CHUNK = 4, 42, 4, 24, 4096
PIECE = 200_000  # shingles counted at a time
SALTS = 8  # over how many keys a component's members are dealt in joins on its root


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Of UTF-8 text, as an unsigned number: bit b is 1 if it is set in over half the shingles' hashes."""
    words = data.lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: max(1, len(words) - shingle + 1)].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    counts = sum(np.unpackbits(hashes[k : k + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for k in range(0, len(hashes), PIECE))
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(text: Column, shingle: int = SHINGLE) -> Column:
    """Of a binary column, as a signed number; a null counts as empty."""

    @F.pandas_udf(LongType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(bytes(x or b""), shingle) for x in texts], dtype=np.uint64).astype(np.int64))

    return run(text)


def pivot_table(fps: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Distances to n fixed reference fingerprints, one row each."""
    pivots = np.random.default_rng(SEED).integers(0, 2**64, n, dtype=np.uint64)
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def forest(groups: np.ndarray, sides: np.ndarray, fps: np.ndarray, most: int, tally: dict[str, int] | None = None, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest fingerprint reached) within each group; fps are unsigned, groups sorted or not.

    known: the component of each row, where some are connected already; no link within one is written.

    Sorted by group and first pivot distance, each row is held against the k-th after it, for k = 1, 2, ..., as long
    as that is in its group and within `most` on the first pivot; then all pivots, then the bits. tally: counts the
    pairs that reach the pivot table ("met") and those that it leaves ("left").
    """
    table = pivot_table(fps)
    order = np.lexsort((table[:, 0], groups))
    groups, sides, fps, table = groups[order], sides[order], fps[order], table[order]
    parent = np.arange(len(fps))
    if known is not None:
        _, first, of = np.unique(np.stack([groups, known[order]]), axis=1, return_index=True, return_inverse=True)
        parent = first[of.reshape(-1)]
    root, own = parent.copy(), parent == np.arange(len(fps))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    active, k = np.arange(len(fps)), 0
    while len(active):
        k += 1
        active = active[active + k < len(fps)]
        other = active + k
        near = (groups[active] == groups[other]) & (table[other, 0] - table[active, 0] <= most)
        active, other = active[near], other[near]
        a = active[(root[active] != root[other]) & ((sides[active] != sides[other]) | (sides[active] < 0))]
        met = len(a)
        a = a[(np.abs(table[a] - table[a + k]).max(1) <= most)] if len(a) else a
        if tally is not None:
            tally["met"], tally["left"] = tally.get("met", 0) + met, tally.get("left", 0) + len(a)
        a = a[np.bitwise_count(fps[a] ^ fps[a + k]) <= most]
        if len(a):
            for x in a.tolist():
                p, q = find(x), find(x + k)
                if p != q:
                    parent[max(p, q)] = min(p, q)
            while not (parent[parent] == parent).all():
                parent = parent[parent]
            root = parent.copy()
    linked = np.flatnonzero(own & (root != np.arange(len(fps))))
    return fps[linked], fps[root[linked]]


def link_groups(most: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group; a group that a batch may have cut waits for the next batch."""
        held = pd.DataFrame({"block": [], "part": [], "side": [], "fp": [], "root": []}, dtype=np.int64)
        for frame in itertools.chain(frames, [None]):
            own = held if frame is None else pd.concat([held, frame], ignore_index=True)
            if not len(own):
                continue
            last = (own.block == own.block.iloc[-1]) & (own.part == own.part.iloc[-1])
            held = own.iloc[:0] if frame is None else own[last]
            own = own if frame is None else own[~last]
            if len(own):
                groups = own.groupby(["block", "part"], sort=False).ngroup().to_numpy()
                a, b = forest(groups, own.side.to_numpy(), own.fp.to_numpy().astype(np.uint64), most, known=own.root.to_numpy())
                yield pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64)})

    return run


def blocks_for(n: int, most: int) -> int:
    """Into how many bit blocks n fingerprints are cut. Any number above `most` gives the same links; more blocks are more rows in smaller groups.

    With two agreeing blocks of six (21 bits), a group of random fingerprints has n / 2**21 members; from 2**26 on,
    three of seven (27 bits) keep groups as small.
    """
    return most + 2 if n < 2**26 else most + 3


def links(fps: DataFrame, most: int = MOST, chunk: int = CHUNK, blocks: int | None = None) -> DataFrame:
    """(a, b) over the different fingerprints (column fp): enough links within `most` bits to connect all that are connected."""
    blocks = blocks or blocks_for(fps.count(), most)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in own) for own in itertools.combinations(range(blocks), blocks - most)]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])  # a collision only adds rows to be held against each other
    rows = fps.select("fp", F.explode(keys).alias("block"))
    big = stash(rows.groupBy("block").count().filter(F.col("count") > chunk).select("block", F.ceil(F.col("count") / chunk).cast("int").alias("n")), "large-blocks")
    cut = rows.join(big, "block", "left").withColumn("part", F.when(F.col("n").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("fp", F.lit(1)), F.col("n"))).cast("long"))

    def linked(dealt: DataFrame) -> DataFrame:
        sorted_groups = dealt.select("block", "part", "side", "fp", "root").repartition("block", "part").sortWithinPartitions("block", "part")
        return sorted_groups.mapInPandas(link_groups(most), "a bigint, b bigint")

    alone = linked(cut.select("block", "part", F.lit(-1).cast("long").alias("side"), "fp", F.col("fp").alias("root"))).distinct()
    if big.isEmpty():
        return alone
    alone = stash(alone, "links")
    return alone.unionByName(linked(across(rows.join(big, "block", "left_semi"), alone, "block", "fp", chunk))).distinct()


def across(members: DataFrame, edges: DataFrame, group: str, key: str, chunk: int) -> DataFrame:
    """Members (group, key) of large groups, dealt out to meet those of other components of edges (a, b): group, key, root, part, side.

    Within a component nothing is left to link, so a group of one component is done. Elsewhere all but the largest
    component's members meet each other and its members, in chunks, each pair of chunks a part; of a part with two
    sides, only pairs across are to be held against each other. Rows grow with the square only of what lies outside
    the largest component, as all pairs of it have to be held against each other.
    """
    found = components(edges).withColumnRenamed("node", key)
    rooted = stash(members.select(group, key).join(found, key, "left").withColumn("root", F.coalesce("root", key)), "rooted")
    sizes = rooted.groupBy(group, "root").agg(F.count(F.lit(1)).alias("n"))
    tops = sizes.groupBy(group).agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n")).filter("top.n < n")
    chunks = [F.ceil(n / chunk).cast("long").alias(a) for a, n in (("mine", F.col("top.n")), ("others", F.col("n") - F.col("top.n")))]
    met = salted(rooted, key).join(spread(tops.select(group, F.col("top.root").alias("top"), *chunks)), [group, "__salt"])
    own = met.withColumn("own", F.pmod(F.xxhash64(key, F.lit(3)), F.when(F.col("root") == F.col("top"), F.col("mine")).otherwise(F.col("others"))))

    def each(n: str, part, side) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda j: F.struct(part(j).alias("part"), side(j).cast("long").alias("side")))

    # chunks i and j outside the largest component meet in part min * others + max, chunk i of it and j outside beyond these
    n, beyond = F.col("others"), F.col("others") * F.col("others")
    of_top = each("others", lambda j: beyond + F.col("own") * n + j, lambda j: F.lit(0))
    outside = F.concat(
        each("others", lambda j: F.least("own", j) * n + F.greatest("own", j), lambda j: F.when(j == F.col("own"), F.lit(-1)).otherwise(F.col("own"))),
        each("mine", lambda i: beyond + i * n + F.col("own"), lambda i: F.lit(1)),
    )
    return own.select(group, key, "root", F.inline(F.when(F.col("root") == F.col("top"), of_top).otherwise(outside)))


def salted(rows: DataFrame, by: str) -> DataFrame:
    """rows with a salt by a column that tells them apart."""
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def spread(table: DataFrame) -> DataFrame:
    """A table once for each salt: what salted rows join, so that those of a hot key meet it in SALTS tasks."""
    return table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def followed(up: DataFrame) -> DataFrame:
    """up (node, root), in which roots are nodes, with roots followed to those that are their own; the distance doubles each round."""
    while True:
        far = spread(up.select(F.col("node").alias("root"), F.col("root").alias("far")))
        new = stash(salted(up, "node").join(far, ["root", "__salt"]).select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), "pointers")
        discard(up)
        if new.filter("moved").isEmpty():
            return new.drop("moved")
        up = new.select("node", "root")
        up.stash_path = new.stash_path


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b): root is the smallest node reached.

    Each node points to its smallest neighbour, if that is smaller; pointers are followed to their ends, and edges are
    then drawn between the ends, once each. So a round leaves half of the nodes that have edges, or fewer, and the edges
    that lie within what has been joined are gone: the first round takes about as much as all others. Each round is
    written. Joins on an end are salted, as one may have a third of all nodes.
    """
    ordered = lambda rows: rows.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live, labels = stash(ordered(edges), "edges"), None
    while True:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        up = followed(stash(least, "pointers"))
        if labels is None:
            labels = up
        else:
            to = spread(up.select(F.col("node").alias("root"), F.col("root").alias("far")))
            labels = stash(salted(labels, "node").join(to, ["root", "__salt"], "left").select("node", F.coalesce("far", "root").alias("root")), "labels")
        ends = spread(up)
        first = salted(live, "b").join(ends.select(F.col("node").alias("a"), F.col("root").alias("p"), "__salt"), ["a", "__salt"]).drop("__salt")
        second = salted(first, "a").join(ends.select(F.col("node").alias("b"), F.col("root").alias("q"), "__salt"), ["b", "__salt"])
        rest = stash(ordered(second.select(F.col("p").alias("a"), F.col("q").alias("b"))), "edges")
        discard(live)
        live = rest
        if live.isEmpty():
            return labels


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, shingle: int = SHINGLE) -> DataFrame:
    """One row for each input row: id, fp (signed 64 bits), component_id (smallest id in the component).

    Nulls: a null text counts as empty (fingerprint zero, linked like any other); a null id never is the smallest, and
    a component of null ids only has a null component_id. Very long texts are taken whole, their shingles counted PIECE
    at a time. Ties and repeated rows stay, each with its row. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    rows = stash(docs.select(F.col(id_col).alias("id"), fingerprint_of(F.col(text_col).cast("binary"), shingle).alias("fp")), "fingerprints")
    classes = stash(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "fingerprint-classes")
    found = components(links(classes.select("fp"), most)).withColumnRenamed("node", "fp")
    linked = classes.select("fp", "least").join(found, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = salted(linked, "fp").join(spread(least), ["root", "__salt"]).select("fp", "component_id")
    of_fp = stash(classes.join(of_linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "components")
    return join_classes(rows, of_fp, "fp", "n").select(F.col("id").alias(id_col), "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLES = {}
