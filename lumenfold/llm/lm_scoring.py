"""LM scoring: a causal self-attention model over subword ids, trained and applied in numpy batches.

The model: embeddings of the last CONTEXT ids, one masked attention layer and a hidden layer, both residual, and an
output in two digits of RADIX (a class of ids), plus the id's share of its class. The digits' logits start from counts
of the training documents: of the class before, and of the first digit. So the network learns what counts of neighbours
don't tell; probabilities sum to one at the cost of 2 * RADIX exponentials a token.

Training covers every window of every training document once, in ROUNDS rounds. Documents are dealt by a hash of their
id and ids over copies of about SLICE ids a round, in hash order; in each round every copy starts from the weights that
the round before left, averaged over the copies by ids seen, in a tree of groups of FAN_IN. Nothing depends on how the
input was partitioned; more documents make more copies.

Scoring slides windows of CONTEXT positions by STRIDE; each id is scored once, by the first window that holds it, with
at least CONTEXT - STRIDE ids before it.

Texts are encoded once, and later passes read ids only. A word's ids start with one that begins with a space, so words
are told apart by hashes of their ids, without Python objects. The base score needs exact counts of all words. Those with
at least a HEAVY-th of all tokens (so at most HEAVY of them) are looked up in a broadcast array; only the others travel,
as (row, word hash), to their counts and back as one sum a row.
"""

from __future__ import annotations

import base64
import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, documents, stash

RADIX, DIM, HIDDEN, CONTEXT, STRIDE = 24, 16, 32, 32, 24
CLASSES = RADIX * RADIX
BUCKETS, OWN = 4096, 4032  # embedding rows, and those that one frequent id has for itself
HEAVY, FAN_IN, LEAST, BATCH, RATE, SEED, SMOOTH = 4_000_000, 16, 16, 64, 0.1, 5, 20.0
ROUNDS, SLICE = 4, 1_000_000  # averaged rounds of training; ids of a copy in a round
AT_ONCE = 8  # batches whose windows are cut together
KEPT = 1_200_000  # words that a worker keeps, and counts before it passes the counts on
ROWS = 250  # documents that a worker unpacks at a time
END = 50_256  # the id after the vocabulary's; starts and ends a text


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def grown(a: np.ndarray, need: int) -> np.ndarray:
    """a with room for so many: twice its size, zeros, if it has to grow."""
    if need <= len(a):
        return a
    out = np.zeros(max(need, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class Words:
    """Subword ids of words, each word with the space before it as one piece. Words are encoded together and kept, with their hashes and counts, by number."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.codec = tiktoken.Encoding("subwords", pat_str=r" ?[^ ]+", mergeable_ranks=self.ranks, special_tokens={})
        self.first = self.starts()
        self.forget()

    def forget(self) -> None:
        self.flat, self.slots = np.empty(0, "<u2"), np.full(1 << 16, -1, np.int32)
        self.start, self.length, self.h, self.n, self.own = (np.empty(0, np.int64) for _ in range(5))
        self.words = self.used = 0

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, count) of the words counted since the last call; words are forgotten if there are too many."""
        there = np.flatnonzero(self.n)
        found = self.h[there], self.n[there]
        self.n[:] = 0
        if self.full():
            self.forget()
        return found

    def full(self) -> bool:
        return self.words > KEPT

    def ids(self, texts: list[list[bytes]], counted: list[bool]) -> list[bytes]:
        """The packed ids of texts given as words; words of those to be counted are."""
        line = pa.array(list(itertools.chain.from_iterable(texts)), pa.binary()).dictionary_encode()
        return self.packed(self.numbers(line.dictionary).take(line.indices.to_numpy()), np.array([len(x) for x in texts], np.int64), counted)

    def ids_of(self, texts: pa.Array, counted: list[bool]) -> list[bytes]:
        """The same of a column of texts, lower-cased and cut at white space (in ASCII, both) by Arrow, which also finds equal words."""
        cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
        coded = cut.flatten().dictionary_encode()
        at = self.numbers(coded.dictionary).take(coded.indices.to_numpy())
        sizes = np.diff(cut.offsets.to_numpy()).astype(np.int64)
        empty = at < 0  # before white space that begins a text, and after what ends it
        if empty.any():
            sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty], minlength=len(sizes))
            at = at[~empty]
        return self.packed(at, sizes, counted)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of distinct words, -1 for one without bytes; new ones are encoded. Words are told apart by hashes of their bytes."""
        out = np.full(len(words), -1)
        if not len(words):
            return out
        _, ends, data = words.buffers()
        ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data, ends = memoryview(data or b"")[ends[0] : ends[-1]], ends - ends[0]
        there = np.flatnonzero(np.diff(ends))
        if not len(there):
            return out
        own = hashes_of(np.frombuffer(data, np.uint8), ends[there])
        found = self.found(own)
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = np.arange(self.words, self.words + len(new))
            low, high = ends[there[new]].tolist(), ends[there[new] + 1].tolist()
            self.add([bytes(data[a:b]) for a, b in zip(low, high, strict=True)])
            self.keep(own[new], found[new])
        out[there] = found
        return out

    def found(self, own: np.ndarray) -> np.ndarray:
        """The number of the word with each hash, or -1: from its slot on, up to a free one."""
        out, left, last = np.full(len(own), -1), np.arange(len(own)), len(self.slots) - 1
        slot = own & last
        while len(left):
            number = self.slots.take(slot)
            taken = number >= 0
            left, slot, number = left[taken], slot[taken], number[taken]
            same = self.own.take(number) == own[left]
            out[left[same]] = number[same]
            left, slot = left[~same], (slot[~same] + 1) & last
        return out

    def keep(self, own: np.ndarray, number: np.ndarray) -> None:
        """Takes slots for new words; at most half of all are taken."""
        self.own = grown(self.own, self.words)
        self.own[number] = own
        if 2 * self.words > len(self.slots):
            self.slots = np.full(4 << int(self.words).bit_length(), -1, np.int32)
            own, number = self.own[: self.words], np.arange(self.words)
        last = len(self.slots) - 1
        slot = own & last
        while len(number):
            free = self.slots.take(slot) < 0
            self.slots[slot[free]] = number[free]
            left = self.slots.take(slot) != number  # one of several that want a slot gets it
            number, slot = number[left], (slot[left] + 1) & last

    def packed(self, at: np.ndarray, sizes: np.ndarray, counted: list[bool]) -> list[bytes]:
        """at: the numbers of all words, those of the first text first."""
        np.add.at(self.n, at[np.repeat(np.array(counted, bool), sizes)], 1)
        length = self.length.take(at)
        ends = np.cumsum(length)
        packed = self.flat.take(np.repeat(self.start.take(at) - ends + length, length) + np.arange(length.sum())).tobytes()
        cuts = [0, *(2 * np.concatenate([[0], ends])[np.cumsum(sizes)]).tolist()]
        return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def add(self, words: list[bytes]) -> None:
        try:
            line = self.codec.encode_to_numpy((b" " + b" ".join(words)).decode()).astype("<u2")
        except UnicodeDecodeError:  # bytes that aren't UTF-8 take the ids of single bytes; each word for itself
            line = np.concatenate([self.one(w) for w in words])
        h, at = word_hashes(line, self.first)
        old, new, low, high = self.words, self.words + len(h), self.used, self.used + len(line)
        self.start, self.length, self.h, self.n = (grown(x, new) for x in (self.start, self.length, self.h, self.n))
        self.flat = grown(self.flat, high)
        self.start[old:new], self.length[old:new] = at + low, np.diff(np.concatenate([at, [len(line)]]))
        self.flat[low:high], self.h[old:new] = line, h
        self.words, self.used = new, high

    def one(self, word: bytes) -> np.ndarray:
        try:
            return self.codec.encode_to_numpy(" " + word.decode()).astype("<u2")
        except UnicodeDecodeError:
            return np.array([self.ranks[bytes([b])] for b in b" " + word], "<u2")

    def starts(self) -> np.ndarray:
        """Which ids begin a word."""
        out = np.zeros(END + 1, bool)
        out[[i for token, i in self.ranks.items() if token[:1] == b" "]] = True
        return out


@functools.cache
def words_of(path: str) -> Words:
    return Words(path)


_DRAW = np.random.default_rng(SEED)
OF_ID = _DRAW.integers(0, 2**64, END + 1, dtype=np.uint64)
PLACE = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, PLACE)]))


def word_hashes(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of its first id) of each word of a line of ids; first tells which ids begin a word."""
    at = np.flatnonzero(first.take(ids))
    if not len(at):
        return np.empty(0, np.int64), at
    return hashes_of(ids, at), at


def hashes_of(line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of what stands in a line of numbers from each place in `at` up to the next."""
    length = np.diff(np.concatenate([at, [len(line)]]))
    place = np.arange(len(line)) - np.repeat(at, length)
    table = powers(1 << int(length.max()).bit_length())
    h = np.add.reduceat(OF_ID.take(line) * table.take(place), at)
    h ^= h >> np.uint64(31)
    h *= PLACE
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    return (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))


ENCODED = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("h", pa.int64()), ("token", pa.int32()), ("c", pa.int64())])


def encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with their subword ids; and, as rows without ids, word counts (by hash h) and subword counts (by token) of the training rows."""
        own, tokens = words_of(path), np.zeros(END + 1, np.int64)
        own.counts()  # a task that didn't end may have left some; words are kept from task to task

        def padded(n: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in ENCODED], schema=ENCODED)

        def words() -> pa.RecordBatch:
            h, c = own.counts()
            return padded(len(h), h=pa.array(h), c=pa.array(c))

        for b in slices(batches, 2 * ROWS):
            counted = [not x for x in b.column("held_out").to_pylist()]
            ids = own.ids_of(b.column("text"), counted)
            learnt = [x for x, c in zip(ids, counted, strict=True) if c]
            tokens += np.bincount(np.frombuffer(b"".join(learnt), "u2"), minlength=END + 1)
            tokens[END] += len(learnt)
            yield padded(b.num_rows, id=b.column("id"), held_out=b.column("held_out"), ids=pa.array(ids, pa.binary()))
            if own.full():
                yield words()
        yield words()
        there = np.flatnonzero(tokens)
        yield padded(len(there), token=pa.array(there, pa.int32()), c=pa.array(tokens[there]))

    return run


def texts_of(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), "u2").astype(np.int64) for x in b.column("ids")]


def codes(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each id's class: the first digit tells words' beginnings from the rest; frequent ids are dealt out over the classes in turn."""
    out = np.zeros(len(counts), np.int64)
    first = min(max(round(RADIX * counts[starts].sum() / max(counts.sum(), 1)), 1), RADIX - 1)
    for chosen, low, n in ((starts, 0, first), (~starts, first, RADIX - first)):
        own = np.flatnonzero(chosen)
        rank = np.empty(len(own), np.int64)
        rank[np.argsort(-counts[own], kind="stable")] = np.arange(len(own))
        out[own] = (low + rank % n) * RADIX + rank // n % RADIX
    return out


def rows_by_count(counts: np.ndarray) -> np.ndarray:
    """The embedding row of each id: its own if it is among the OWN most frequent, else one of the rest by its number."""
    out = OWN + np.arange(len(counts)) % (BUCKETS - OWN)
    out[np.argsort(-counts, kind="stable")[:OWN]] = np.arange(min(OWN, len(counts)))
    return out


def log_shares(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log shares within each row of counts, smoothed towards the prior's."""
    return np.log((counts + SMOOTH * prior) / (counts.sum(-1, keepdims=True) + SMOOTH)).astype(np.float32)


class Vocabulary:
    """What counts of ids and of neighbouring classes give the model: classes, embedding rows, first logits, and shares of ids in their class."""

    def __init__(self, counts: np.ndarray, starts: np.ndarray) -> None:
        self.code, self.row = codes(counts, starts), rows_by_count(counts)
        self.digit, self.rest = np.divmod(self.code, RADIX)
        whole = np.bincount(self.code, counts + 0.1, CLASSES)
        self.share = np.log((counts + 0.1) / np.maximum(whole, 1e-9)[self.code]).astype(np.float32)
        self.whole = whole.reshape(RADIX, RADIX) + 1e-6

    def with_pairs(self, pairs: np.ndarray) -> Vocabulary:
        """pairs: how often each class follows each, (CLASSES, CLASSES)."""
        pairs = pairs.reshape(CLASSES, RADIX, RADIX)
        digit = self.whole.sum(1) / self.whole.sum()
        self.first = log_shares(pairs.sum(2).astype(float), digit)
        self.second = log_shares(pairs.astype(float), self.whole / self.whole.sum(1, keepdims=True)).reshape(-1, RADIX)
        return self


SHAPES = {"emb": (BUCKETS, DIM), "pos": (CONTEXT, DIM), "qkv": (DIM, 3 * DIM), "o": (DIM, DIM), "in": (DIM, HIDDEN), "back": (HIDDEN, DIM), "out0": (DIM, RADIX), "out1": (DIM, RADIX), "gate": (RADIX, DIM)}


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parts of all weights (or gradients) in one array; embeddings come first."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        out[name] = flat[at : at + math.prod(shape)].reshape(shape)
        at += math.prod(shape)
    return out


SIZE = sum(math.prod(s) for s in SHAPES.values())
REST = BUCKETS * DIM  # where the embeddings end


def start_weights(kind: str = "f4") -> np.ndarray:
    """All weights; outputs are small, so that the model starts at the counts' logits."""
    rng, flat = np.random.default_rng(SEED), np.empty(SIZE, kind)
    scale = {"emb": 0.5, "pos": 0.5, "gate": 0.3, "out0": 0.02, "out1": 0.02}
    for name, part in views(flat).items():
        part[:] = rng.standard_normal(part.shape) * scale.get(name, 0.6 / math.sqrt(part.shape[0])) + (name == "gate")
    return flat


HIGHEST = 40.0  # scores are cut there, so that exponentials stay finite
SCALE = 1 / math.sqrt(DIM)


class Network:
    """Forward and backward passes over batches of windows. Arrays are kept from batch to batch: fresh memory costs as much as the arithmetic.

    A score x Q (x K)' is x (Q K') x', and what is attended to, (a (x V)) O, is a (x (V O)). So places are multiplied by
    these two products, which are made once a batch, and their gradients give those of the four factors.
    """

    def __init__(self, v: Vocabulary, flat: np.ndarray, fixed: bool = False) -> None:
        """fixed: the weights don't change, so that what ids and places give is looked up instead of multiplied out."""
        self.v, self.flat, self.w, self.kind = v, flat, views(flat), flat.dtype
        self.slopes = np.zeros_like(flat)
        self.g = views(self.slopes)
        self.starts = np.arange(BATCH * CONTEXT) * RADIX
        self.rooms: dict[str, np.ndarray] = {}
        self.cut: dict[tuple, np.ndarray] = {}  # the rooms' beginnings, by name and shape
        self.past = np.tril(np.ones((CONTEXT, CONTEXT), self.kind))
        self.ones, self.eye = np.ones(max(CONTEXT, RADIX, DIM, BATCH), self.kind), np.eye(RADIX, dtype=self.kind)
        self.cells, self.touched = np.arange(REST).reshape(BUCKETS, DIM), np.empty(0, np.int64)
        self.marks = np.zeros(BUCKETS, bool)
        self.none = np.zeros(BATCH * CONTEXT * HIDDEN, self.kind)
        self.fixed = [np.concatenate([self.w[k], self.w[k] @ self.into()], 1) for k in ("emb", "pos")] if fixed else None

    def room(self, name: str, *shape: int, kind: np.dtype | None = None) -> np.ndarray:
        found = self.cut.get((name, shape))
        if found is None:
            n = math.prod(shape)
            if name not in self.rooms or self.rooms[name].size < n:
                self.rooms[name] = np.empty(n, kind or self.kind)
                self.cut = {k: x for k, x in self.cut.items() if k[0] != name}
            found = self.cut[name, shape] = self.rooms[name][:n].reshape(shape)
        return found

    def taken(self, table: np.ndarray, at: np.ndarray, name: str) -> np.ndarray:
        return table.take(at, 0, out=self.room(name, len(at), table.shape[1], kind=table.dtype), mode="clip")

    def into(self) -> np.ndarray:
        """(DIM, 2 * DIM): Q K', scaled, and V O."""
        q, k, val = self.factors()
        return np.concatenate([SCALE * (q @ k.T), val @ self.w["o"]], 1)

    def factors(self) -> list[np.ndarray]:
        return [self.w["qkv"][:, i * DIM : (i + 1) * DIM] for i in range(3)]

    def times(self, a: np.ndarray, b: np.ndarray, name: str) -> np.ndarray:
        return np.matmul(a, b, out=self.room(name, *a.shape[:-1], b.shape[-1]))

    @staticmethod
    def exponentials(x: np.ndarray) -> np.ndarray:
        if x.max() > HIGHEST:
            np.minimum(x, HIGHEST, out=x)
        return np.exp(x, out=x)

    def forward(self, inputs: np.ndarray, targets: np.ndarray, learning: bool = False, skip: int = 0) -> np.ndarray | None:
        """Natural log probabilities (windows, CONTEXT - skip) of the targets' classes after the input ids; none while learning, which needs none.

        skip: the first places of each window, which only give context.
        """
        w, v, (n, t) = self.w, self.v, inputs.shape
        target = targets[:, skip:].reshape(-1)
        self.rows, before, digit, rest = v.row.take(inputs.reshape(-1)), v.code.take(inputs[:, skip:].reshape(-1)), v.digit.take(target), v.rest.take(target)
        self.twice = 2 * w["back"]
        if self.fixed:
            own = self.taken(self.fixed[0], self.rows, "x").reshape(n, t, 3 * DIM)
            own += self.fixed[1]
            cube, self.q, self.val = own[:, :, :DIM], own[:, :, DIM : 2 * DIM], own[:, :, 2 * DIM :]
        else:
            x = self.x = self.taken(w["emb"], self.rows, "x")
            cube = x.reshape(n, t, DIM)
            cube += w["pos"]
            self.mix = self.into()
            mixed = self.times(x, self.mix, "mixed").reshape(n, t, 2 * DIM)
            self.q, self.val = mixed[:, :, :DIM], mixed[:, :, DIM:]
        turned = self.room("turned", n, DIM, t)
        turned[:] = cube.transpose(0, 2, 1)
        a = self.a = self.exponentials(self.times(self.q[:, skip:], turned, "a"))
        a *= self.past[skip:]
        self.low = a.reshape(-1, t) @ self.ones[:t]
        av = self.av = self.times(a, self.val, "av").reshape(-1, DIM)
        av /= self.low[:, None]
        z = self.z = self.room("z", *av.shape)
        np.add(av.reshape(n, t - skip, DIM), cube[:, skip:], out=z.reshape(n, t - skip, DIM))
        hidden = self.hidden = self.times(z, w["in"], "hidden")
        if self.fixed:
            np.maximum(hidden, self.none[: hidden.size].reshape(hidden.shape), out=hidden)
        else:
            hidden *= np.greater(hidden, 0, out=self.room("positive", *hidden.shape), casting="unsafe")
        top = self.top = self.times(hidden, self.twice, "top")
        top += z
        self.digit, self.gate = digit, self.taken(w["gate"], digit, "gate")
        gated = np.multiply(top, self.gate, out=self.room("gated", *top.shape))
        at = self.starts[: len(target)]
        total, self.parts = None if learning else np.zeros(len(target), self.kind), []
        for k, (u, bias, cell, own) in enumerate(((top, v.first, before, at + digit), (gated, v.second, before * RADIX + digit, at + rest))):
            p = self.times(u, w[f"out{k}"], f"p{k}")
            p += self.taken(bias, cell, "bias")
            if total is not None:
                total += p.reshape(-1).take(own)
            s = self.exponentials(p) @ self.ones[:RADIX]
            if total is not None:
                total -= np.log(s)
            self.parts.append((u, p, own, s))
        return None if total is None else total.reshape(n, t - skip)

    def backward(self, weight: np.ndarray) -> None:
        """Gradients, into g, of the weighted negative log likelihood of the batch that forward() has just seen; of the embeddings into `pulls`, a row for each in `touched`."""
        w, g, (n, t), flat, down = self.w, self.g, weight.shape, weight.reshape(-1), []
        for k, (u, p, own, s) in enumerate(self.parts):
            p *= (flat / s)[:, None]
            p.reshape(-1)[own] -= flat
            np.matmul(u.T, p, out=g[f"out{k}"])
            down.append(self.times(p, w[f"out{k}"].T, f"down{k}"))
        through = np.multiply(down[1], self.top, out=self.room("through", *self.top.shape))
        np.matmul(self.taken(self.eye, self.digit, "by_digit").T, through, out=g["gate"])
        down[1] *= self.gate
        dtop = down[0]
        dtop += down[1]
        np.matmul(self.hidden.T, dtop, out=g["back"])
        g["back"] *= 2
        dhidden = self.times(dtop, self.twice.T, "dhidden")
        dhidden *= self.room("positive", *dhidden.shape)
        np.matmul(self.z.T, dhidden, out=g["in"])
        dz = self.times(dhidden, w["in"].T, "dz")
        dz += dtop
        # with low the sum of a: av = (a @ val) / low, so da = (dz . val - dz . av) / low
        wide, turned = self.room("wide", n, t, DIM + 1), self.room("wide_turned", n, DIM + 1, t)
        np.multiply(dz, self.av, out=through)
        np.divide((through @ self.ones[:DIM]).reshape(n, t), -self.low.reshape(n, t), out=wide[:, :, DIM])
        dav = np.divide(dz.reshape(n, t, DIM), self.low.reshape(n, t, 1), out=wide[:, :, :DIM])
        turned[:, :DIM], turned[:, DIM] = self.val.transpose(0, 2, 1), 1
        ds = self.times(wide, turned, "ds")
        ds *= self.a
        d = self.room("d", n, t, 2 * DIM)
        np.matmul(ds, self.x.reshape(n, t, DIM), out=d[:, :, :DIM])
        np.matmul(self.a.transpose(0, 2, 1), dav, out=d[:, :, DIM:])
        d = d.reshape(-1, 2 * DIM)
        q, k, val = self.factors()
        both = self.x.T @ d
        by_score, by_value = SCALE * both[:, :DIM], both[:, DIM:]
        np.concatenate([by_score @ k, by_score.T @ q, by_value @ w["o"].T], 1, out=g["qkv"])
        np.matmul(val.T, by_value, out=g["o"])
        dx = self.times(d, self.mix.T, "dx")
        dx += dz
        dx += self.times(ds.transpose(0, 2, 1), self.q, "part").reshape(dx.shape)
        np.matmul(self.ones[:n], dx.reshape(n, -1), out=g["pos"].reshape(-1))
        pulls = g["emb"]
        pulls[self.touched] = 0  # of the batch before
        self.marks[self.rows] = True
        self.touched = np.flatnonzero(self.marks)
        self.marks[self.touched] = False
        np.add.at(pulls.reshape(-1), self.taken(self.cells, self.rows, "cells").reshape(-1), dx.reshape(-1))
        self.pulls = pulls.take(self.touched, 0)

    def step(self, squares: np.ndarray, weight: np.ndarray) -> None:
        """One step of Adagrad, on all weights but the embeddings of ids that the batch lacks."""
        self.backward(weight)
        rate, slopes, sums, w = self.kind.type(RATE), self.slopes[REST:], squares[REST:], self.flat[REST:]
        sums += slopes * slopes
        w -= rate * slopes / np.sqrt(sums)
        table = squares[:REST].reshape(BUCKETS, DIM)
        own = table.take(self.touched, 0)
        own += self.pulls * self.pulls
        table[self.touched] = own
        self.pulls *= rate
        self.pulls /= np.sqrt(own, out=own)
        self.w["emb"][self.touched] = np.subtract(self.w["emb"].take(self.touched, 0), self.pulls, out=self.pulls)


def windows(texts: list[np.ndarray], stride: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, targets, fresh, place of the text) of up to BATCH windows at a time: fresh marks targets that no earlier window holds.

    Where windows overlap, texts' first windows come in batches of their own: in all others, the overlap is context only.
    """
    if not texts:
        return
    line = np.concatenate([x for text in texts for x in ([END], text)] + [[END]])
    n = np.array([len(x) + 1 for x in texts])
    many = np.maximum(1, -(-(n - (CONTEXT - stride)) // stride))
    row = np.repeat(np.arange(len(texts)), many)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * stride
    before, step = np.cumsum(n) - n, np.arange(CONTEXT)
    if stride < CONTEXT:
        order = np.argsort(start > 0, kind="stable")
        row, start = row[order], start[order]
    firsts = int((start == 0).sum()) if stride < CONTEXT else len(row)
    for low, high in ((0, firsts), (firsts, len(row))):
        for j in range(low, high, BATCH * AT_ONCE):
            own, first = row[j : min(j + BATCH * AT_ONCE, high)], start[j : min(j + BATCH * AT_ONCE, high), None]
            at, last = first + step, n[own, None]
            fresh = (at < last) & ((step >= CONTEXT - stride) | (first == 0))
            at = np.minimum(at, last - 1) + before[own, None]
            inputs, targets = line.take(at), line.take(at + 1)
            for k in range(0, len(own), BATCH):
                yield inputs[k : k + BATCH], targets[k : k + BATCH], fresh[k : k + BATCH], own[k : k + BATCH]


WEIGHTS = "place bigint, n bigint, weights binary"
COLUMNS = ["place", "n", "weights"]


def learn(network: Network, squares: np.ndarray, texts: list[np.ndarray], seen: int) -> int:
    """Steps over all windows of texts; returns how many ids have been seen."""
    for part in windows(texts, CONTEXT):
        k = 0
        while k < len(part[0]):  # steps start small and grow with what has been seen
            size = min(BATCH, max(LEAST, seen // (32 * CONTEXT)))
            inputs, targets, fresh = (x[k : k + size] for x in part[:3])
            k += size
            n = int(fresh.sum())
            network.forward(inputs, targets, learning=True)
            network.step(squares, fresh.astype(network.kind) / network.kind.type(n))
            seen += n
    return seen


def trained(v: Vocabulary, start: bytes, before: int):
    """before: ids that a copy has seen in earlier rounds, about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The weights of each copy (its rows follow one another) after its slice."""
        place, seen = None, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([place]), pa.array([seen - before]), pa.array([np.concatenate([network.flat, squares]).tobytes()])], COLUMNS)

        for b in slices(batches):
            places = b.column("place").to_numpy()
            texts = texts_of(b)
            edges = [0, *(np.flatnonzero(places[1:] != places[:-1]) + 1).tolist(), len(places)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if places[lo] != place:
                    if place is not None:
                        yield done()
                    both = np.frombuffer(start, np.float32).copy()
                    place, seen, squares, network = int(places[lo]), before, both[SIZE:], Network(v, both[:SIZE])
                seen = learn(network, squares, texts[lo:hi], seen)
        if place is not None:
            yield done()

    return run


def averaged(table: pa.Table) -> pa.Table:
    """One row of several: the mean by ids seen. In order of place, so that it doesn't depend on who came first."""
    order = np.argsort(table.column("place").to_numpy(), kind="stable").tolist()
    n, data = table.column("n").to_pylist(), table.column("weights")
    total = sum(n[k] * np.frombuffer(data[k].as_py(), np.float32).astype(float) for k in order)
    mean = (total / sum(n)).astype(np.float32).tobytes()
    return pa.table([[table.column("place")[0].as_py() // FAN_IN], [sum(n)], [mean]], COLUMNS)


def fit(rows: DataFrame, v: Vocabulary, total: int) -> np.ndarray:
    """The weights after all rounds over rows (id, ids) with `total` ids in all; starting weights where nothing is to be learnt."""
    state = np.concatenate([start_weights(), np.full(SIZE, 1e-6, np.float32)]).tobytes()  # weights and their squared gradients
    copies = max(1, -(-total // (ROUNDS * SLICE)))
    h = F.xxhash64(F.col("id"), F.col("ids"))
    dealt = rows.select("ids", h.alias("h")).repartition(copies, "h").withColumns({"place": F.spark_partition_id().cast("long"), "round": F.pmod(F.shiftright("h", 40), F.lit(ROUNDS)).cast("int")})
    # a file a copy and round, sorted, so that a copy's rows follow one another in one task
    files = stash(dealt.sortWithinPartitions("round", "h"), "training", by="round")
    for k in range(ROUNDS):
        own = files.filter(F.col("round") == k).select("place", "ids")
        weights = stash(own.mapInArrow(trained(v, state, total * k // (ROUNDS * copies)), WEIGHTS), "weights")
        level, last = weights, copies - 1
        while last > 0:
            level = level.groupBy(F.floor(F.col("place") / FAN_IN).alias("group")).applyInArrow(averaged, WEIGHTS)
            last //= FAN_IN
        found = level.select("weights").collect()  # one row at most
        state = bytes(found[0].weights) if found else state
        discard(weights)
    discard(files)
    return np.frombuffer(state, np.float32)[:SIZE].copy()


def neighbours(v: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pair of classes, count) over the rows of a task."""
        pairs, ends = np.zeros(CLASSES * CLASSES, np.int64), np.array([END])
        for b in slices(batches):
            texts = texts_of(b)
            if texts:
                line = v.code.take(np.concatenate([x for t in texts for x in (ends, t)] + [ends]))
                pairs += np.bincount(line[:-1] * CLASSES + line[1:], minlength=len(pairs))
        there = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(pairs[there])], ["pair", "c"])

    return run


class Looked:
    """Values by hash. Hashes are sorted, and found by their first bits: about as many beginnings as hashes, so few steps from there."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray) -> None:
        own = hashes.view(np.uint64)
        order = np.argsort(own)
        self.shift = np.uint64(64 - max(len(own).bit_length(), 1))
        begins = np.bincount((own >> self.shift).astype(np.int64), minlength=1 << (64 - int(self.shift)))
        self.begin = np.concatenate([[0], np.cumsum(begins)]).astype(np.int32)
        self.hashes, self.values = np.append(hashes[order], 0), np.append(values[order], 0.0)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash in `values`; the last place, whose value is 0, for those that aren't there."""
        first = (h.view(np.uint64) >> self.shift).astype(np.int64)
        at, end = self.begin.take(first).astype(np.int64), self.begin.take(first + 1)
        out = np.where((self.hashes.take(at) == h) & (at < end), at, len(self.values) - 1)
        left = np.flatnonzero((out == len(self.values) - 1) & (at + 1 < end))
        while len(left):
            at[left] += 1
            found = self.hashes.take(at[left]) == h[left]
            out[left[found]] = at[left[found]]
            left = left[~found]
            left = left[at[left] + 1 < end[left]]
        return out


def scored(path: str, v: Vocabulary, weights: np.ndarray, hashes: np.ndarray, values: np.ndarray):
    """hashes, in order, and values: the words that are looked up here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, network, looked = words_of(path).first, Network(v, weights, fixed=True), Looked(hashes, values)
        for b in slices(batches):
            texts = texts_of(b)
            score = np.zeros(len(texts))
            for inputs, targets, fresh, row in windows(texts, STRIDE):
                skip = 0 if fresh[0, 0] else CONTEXT - STRIDE
                logp = network.forward(inputs, targets, skip=skip)
                logp += v.share.take(targets[:, skip:])
                score += np.bincount(row, (logp * fresh[:, skip:]).sum(1, dtype=float), len(texts))
            h, at = word_hashes(np.concatenate(texts), first)
            row = np.searchsorted(np.cumsum([len(x) for x in texts]), at, side="right")
            at = looked(h)
            there = at < len(hashes)
            base, found = np.bincount(row, looked.values.take(at), len(texts)), there
            count = lambda r: np.bincount(r, minlength=len(texts)).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(count(row[~found]))]).astype(np.int32)
            columns = {"id": b.column("id"), "held_out": b.column("held_out"), "n_tokens": pa.array(count(row) + 1), "base": pa.array(base), "known": pa.array(count(row[found]))}
            columns |= {"rest": pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[~found])), "score": pa.array(score / math.log(10))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row for each input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text).

    Rows whose crc32 of the id's text leaves 1 modulo 5 are held out; a null id isn't. Ids are numbers. Nulls: a null
    text is empty, that is only an end. Repeated rows are scored, and learnt from, each; ties don't arise. Very long
    texts are scored whole, window by window; a task holds ROWS texts and their ids. An empty table gives an empty
    result; without any training row all words are unknown and the model is the starting one. Other columns are
    ignored, whatever their names. Words are told apart by 64-bit hashes. The same rows give the same scores, however
    they are partitioned.
    """
    path = path or default_ranks()
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 1, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), held.alias("held_out"))
    found = stash(rows.mapInArrow(encoded(path), "id bigint, held_out boolean, ids binary, h bigint, token int, c bigint"), "encoded")
    rows = found.filter("ids IS NOT NULL").select("id", "held_out", "ids")
    training = rows.filter("NOT held_out").select("id", "ids")
    counts = stash(found.filter("h IS NOT NULL").groupBy("h").agg(F.sum("c").alias("c")), "words")
    of_id = np.zeros(END + 1)
    for r in found.filter("token IS NOT NULL").groupBy("token").agg(F.sum("c").alias("c")).collect():  # as many rows as the vocabulary at most
        of_id[r.token] = r.c
    ends = int(of_id[END])
    whole = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = (whole.n or 0) + ends, whole.v + (1 if ends else 0)
    low = n + 0.5 * (v + 1)
    value = lambda c: np.log10((c + 0.5) / low)
    heavy = counts.filter(F.col("c") * HEAVY >= n).toPandas().sort_values("h")  # HEAVY rows at most
    known = Vocabulary(of_id, words_of(path).first)
    pairs = np.zeros(CLASSES * CLASSES)
    got = training.mapInArrow(neighbours(known), "pair bigint, c bigint").groupBy("pair").agg(F.sum("c").alias("c")).toPandas()  # CLASSES ** 2 rows at most
    pairs[got.pair.to_numpy(np.int64)] = got.c.to_numpy(float)
    weights = fit(training, known.with_pairs(pairs), int(of_id.sum()))
    schema = "id bigint, held_out boolean, n_tokens bigint, base double, known bigint, rest array<bigint>, score double"
    done = rows.mapInArrow(scored(path, known, weights, heavy.h.to_numpy(np.int64), value(heavy.c.to_numpy(float))), schema)
    own = stash(done.withColumn("rid", F.monotonically_increasing_id()), "scores")
    each = own.select("rid", F.explode("rest").alias("h")).join(counts, "h", "left")
    rare = each.groupBy("rid").agg(F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(low))).alias("rare"), F.count("c").alias("n_rare"))
    return own.drop("rest").join(rare, "rid", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("n_rare", F.lit(0)) + F.lit(1 if ends else 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare", F.lit(0.0)) + F.lit(float(value(ends)))).alias("base_score"), "score",
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


QUERIES = {"op9_lm_scoring": op9_lm_scoring}
ORACLES = {}
