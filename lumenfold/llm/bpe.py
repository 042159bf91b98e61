"""Byte-level BPE: a priority queue of merge ranks over a doubly linked symbol list; decoding concatenates vocabulary strings."""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import documents, text_or_empty

#: Fixed: how byte-level vocabularies cut a text before merging. White space as Unicode has it.
PIECES = r"""'(?:[stmd]|re|ve|ll)| ?\p{L}++| ?\p{N}++| ?[^\p{White_Space}\p{L}\p{N}]++|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: The same for texts that are all ASCII, which the plain engine cuts faster.
ASCII_PIECES = r"""'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
CACHED, CACHED_LONG = 400_000, 32  # pieces kept in each of a worker's two generations, and their length at most; others are encoded each time
BLOCK, TOGETHER = 10_000, 500_000  # characters of new pieces that are merged together, and of texts whose pieces are looked up together, about


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte: itself where printable Latin-1, else the next one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """Encodes texts to packed ids (little-endian unsigned 32-bit) and decodes them."""

    def __init__(self, path: str, kept: int = CACHED) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        vocab, of_char = spec["model"]["vocab"], byte_symbols()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        strings = {i: bytes(of_char[c] for c in s) for s, i in vocab.items() if s not in special} | {i: s.encode() for s, i in special.items()}
        of_byte = np.zeros(256, np.int64)
        for c, b in of_char.items():
            of_byte[b] = vocab[c]
        self.wall = max(strings) + 1  # stands between pieces; no pair has it
        self.token_bytes = np.array([strings.get(i, b"") for i in range(self.wall + 1)], object)
        pairs: list[dict[int, int]] = [{} for _ in range(self.wall + 1)]  # ranks by left and right id; the rank tells the merged id
        self.merged_id: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs[vocab[a]][vocab[b]] = rank
            self.merged_id.append(vocab[a + b])
        self.rank_after = [x.get for x in pairs]
        # a text's bytes as 0 to 255 and a wall as 256: their ids, and the ranks of their pairs (-1: none)
        self.first_id = np.append(of_byte, self.wall)
        self.first_rank = np.full((257, 257), -1, np.int64)
        for x, left in enumerate(of_byte.tolist()):
            self.first_rank[x, :256] = [pairs[left].get(right, -1) for right in of_byte.tolist()]
        self.special = {s: i.to_bytes(4, "little") for s, i in special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces, self.ascii_pieces = regex.compile(PIECES).findall, re.compile(ASCII_PIECES).findall
        self.cache: dict[str, bytes] = dict(self.special)
        self.older: dict[str, bytes] = {}  # the generation before: what is used again moves to the newer, the rest goes with it
        self.kept = kept

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of pieces: in each, the pair of lowest rank (leftmost of equals) merges first.

        All pieces are one doubly linked list with walls between; each has a queue of its own. Queue entries are
        rank << shift | left place. An entry is stale unless it is the one that its place holds in `now`: the place's
        pair has changed since, or the place is merged away and holds -1.
        """
        line = np.frombuffer(b"\0".join([b"", *pieces, b""]), np.uint8).astype(np.int64)
        walls = np.cumsum([0] + [len(x) + 1 for x in pieces])
        line[walls] = 256
        n = len(line)
        shift = n.bit_length()
        mask = (1 << shift) - 1
        ids, ranks = self.first_id[line].tolist(), self.first_rank[line[:-1], line[1:]]
        places = np.flatnonzero(ranks >= 0)
        entries = ranks << shift | np.arange(n - 1)
        starts, queued = np.searchsorted(places, walls).tolist(), entries[places].tolist()
        now = np.where(ranks >= 0, entries, -1).tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_after, merged_id, pop, push = self.rank_after, self.merged_id, heapq.heappop, heapq.heappush
        for low, high in zip(starts, starts[1:], strict=False):
            queue = queued[low:high]
            heapq.heapify(queue)
            while queue:
                entry = pop(queue)
                left = entry & mask
                if now[left] != entry:
                    continue
                right, previous = after[left], before[left]
                ids[left] = new = merged_id[entry >> shift]
                ids[right] = now[right] = now[left] = -1
                after[left] = following = after[right]
                before[following] = left
                rank = rank_after[new](ids[following])
                if rank is not None:
                    now[left] = entry = rank << shift | left
                    push(queue, entry)
                rank = rank_after[ids[previous]](new)
                if rank is None:
                    now[previous] = -1
                else:
                    now[previous] = entry = rank << shift | previous
                    push(queue, entry)
        final = np.array(ids)
        final[walls] = -1
        there = final >= 0
        packed, ends = final[there].astype("<u4").tobytes(), (4 * np.cumsum(there)[walls]).tolist()
        return [packed[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def learn(self, pieces: list[str]) -> None:
        """Puts pieces that the newer generation lacks into it."""
        block, size = [], 0
        for piece in pieces:
            found = self.older.get(piece)
            if found is not None:
                self.cache[piece] = found
                continue
            block.append(piece)
            size += len(piece)
            if size >= BLOCK:
                self.cache.update(zip(block, self.merged([x.encode() for x in block]), strict=True))
                block, size = [], 0
        if block:
            self.cache.update(zip(block, self.merged([x.encode() for x in block]), strict=True))

    def cut_up(self, text: str) -> list[str]:
        """A text's pieces and special tokens."""
        pieces = self.ascii_pieces if text.isascii() else self.pieces
        parts = self.cut.split(text) if self.cut else [text]
        return pieces(text) if len(parts) == 1 else [x for k, part in enumerate(parts) for x in ([part] if k % 2 else pieces(part))]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text; the texts' new pieces are merged together."""
        if len(self.cache) >= self.kept:
            self.older, self.cache = self.cache, dict(self.special)
        cut = [self.cut_up(x) for x in texts]
        new = list(set().union(*cut).difference(self.cache))
        self.learn(new)
        out = [b"".join(map(self.cache.__getitem__, x)) for x in cut]
        for piece in new:
            if len(piece) > CACHED_LONG:
                del self.cache[piece]
        return out

    def decode(self, packed: bytes) -> str:
        """An id that the vocabulary lacks adds nothing; bytes that aren't UTF-8 become U+FFFD."""
        ids = np.minimum(np.frombuffer(packed, "<u4"), self.wall)
        return b"".join(self.token_bytes.take(ids).tolist()).decode("utf-8", "replace")


@functools.cache
def codec(path: str, kept: int = CACHED) -> Codec:
    return Codec(path, kept)


def groups(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about TOGETHER characters; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > TOGETHER:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def encoded(text: Column, path: str | None = None) -> Column:
    """The packed ids of a text, binary; null as for an empty text: no ids. path: a byte-level BPE file that every executor has."""
    path = path or default_vocabulary()

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        own = codec(path)
        return pd.Series([x for run in groups([t or "" for t in texts]) for x in own.encode_all(run)], dtype=object)

    return encode(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of packed ids; null ids give an empty text."""
    path = path or default_vocabulary()

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        own = codec(path)
        return pd.Series([own.decode(bytes(x or b"")) for x in ids], dtype=object)

    return decode(ids)


def id_lists(texts: pa.Array, own: Codec) -> Iterator[pa.Array]:
    """The ids of texts, a list each, for runs of about TOGETHER characters: neither all strings nor all ids of a batch are held at once."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))])
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(size, size[low] + TOGETHER, "right")) - 1)
        packed = own.encode_all([x or "" for x in texts[low:high].to_pylist()])
        ends = np.cumsum([0] + [len(x) // 4 for x in packed], dtype=np.int32)
        yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
        low = high


def listed(text: Column, path: str | None = None) -> Column:
    """The ids of a text, array<int>; none for null. Made in one pass, where ids that are packed first would be made again for each column of them."""
    path = path or default_vocabulary()

    @F.arrow_udf("array<int>")
    def encode_lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from id_lists(batch, codec(path))

    return encode_lists(text)


def encode_documents(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with ids (packed, binary) and n_tokens; columns of these names are replaced.

    Nulls: a null text gives no ids. Very long texts take memory of a few times their size in one worker. Ties and
    repeated rows are encoded alike; an empty table gives an empty result.
    """
    return docs.withColumn("ids", encoded(text_or_empty(text_col), path)).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode_documents(documents(spark, sf_dir).select("doc_id", "text"))
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(decoded(F.col("ids")), 256).alias("decoded_sha256"))


QUERIES = {"op5_bpe": op5_bpe}
ORACLES = {}
