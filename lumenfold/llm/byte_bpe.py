"""Byte-level BPE by a lazily determinised transducer over bytes, and a streaming decoder over an incremental UTF-8 machine.

Which token sequences are right can be told pairwise: a sequence is what merging gives exactly if merging the bytes of
each two neighbours gives those two. So the nondeterministic transducer reads bytes, guesses where tokens end, and lets
two tokens follow each other if they fit; of all its guesses at most one ends at any byte. Its determinisation has
as states the sets of guesses still open: for each the tokens not yet agreed on, and the bytes of the token under way.
What all guesses agree on is emitted, so output lags by less than the longest token. States and transitions are made
when first needed, and all are dropped when there are too many.

Letters and numbers are those of the installed `regex`; a character that is new in its version of Unicode may be cut
otherwise by a library with an older one.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.bpe import ASCII_PIECES, PIECES, groups
from lumenfold.llm.common import documents, text_or_empty

KEPT, KEPT_LONG = 400_000, 32  # pieces kept in each of a worker's two generations, and their length at most
STATES = 200_000  # of the transducer, until all are dropped
FOREVER = 1 << 60  # a time after all merges
NONE = -1  # no token
NOWHERE: dict[int, tuple[int, bytes]] = {}  # of a state that has no transition yet


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Merges:
    """Ranks of byte strings, and which tokens may follow each other. A token's id is its rank, its time the step at which merging makes it."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.string = {i: s for s, i in self.rank.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fitting: dict[int, bool] = {}  # by left token << 32 | right token

    def parts(self, string: bytes, before: int = FOREVER) -> list[bytes]:
        """The string merged by all ranks under `before`: the lowest first, the leftmost of equals."""
        out = [string[k : k + 1] for k in range(len(string))]
        while len(out) > 1:
            ranks = [self.rank.get(a + b, FOREVER) for a, b in zip(out, out[1:], strict=False)]
            lowest = min(ranks)
            if lowest >= before:
                break
            k = ranks.index(lowest)
            out[k : k + 2] = [out[k] + out[k + 1]]
        return out

    def half(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; None for a byte, and for a token that no merge reaches."""
        if token not in self.halves:
            parts = self.parts(self.string[token], token)
            self.halves[token] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def reached(self, token: int) -> bool:
        return len(self.string[token]) == 1 or self.half(token) is not None

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives both again: no merge goes over the border between them.

        Backwards in time, the last part of the left token and the first part of the right one come apart in turn, the
        one made later first (of equal times the right one, as merges go from the left). While two such parts lie side
        by side, they must not merge before either becomes part of a larger one.
        """
        key = left << 32 | right
        if key in self.fitting:
            return self.fitting[key]
        rank, string = self.rank, self.string
        left_end = right_end = FOREVER
        while True:
            both = rank.get(string[left] + string[right], FOREVER)
            if both < left_end and both <= right_end:
                found = False
                break
            a, b = self.half(left), self.half(right)
            if a is None and b is None:
                found = True
                break
            if b is not None and (a is None or right >= left):
                right, right_end = b[0], right
            else:
                left, left_end = a[1], left
        self.fitting[key] = found
        return found


class Transducer:
    """Bytes to packed ids (little-endian unsigned 32-bit), state by state. State 0 is the start of a piece.

    A state is (the token emitted last, guesses); a guess is (tokens not yet emitted, node of the token under way), a node
    being a place in the tree of all tokens' bytes and 0 its root.
    """

    def __init__(self, merges: Merges, most: int = STATES) -> None:
        self.merges, self.most = merges, most
        self.child: list[dict[int, int]] = [{}]  # of a node, by byte
        self.token: list[int] = [NONE]  # that ends at a node
        nodes = {b"": 0}
        for string, token in sorted(merges.rank.items()):
            if not merges.reached(token):
                continue
            for k in range(len(string)):
                if string[: k + 1] not in nodes:
                    self.child[nodes[string[:k]]][string[k]] = nodes[string[: k + 1]] = len(self.child)
                    self.child.append({})
                    self.token.append(NONE)
            self.token[nodes[string]] = token
        self.ids = {t: t.to_bytes(4, "little") for t in merges.string}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple[int, tuple]] = []
        self.number: dict[tuple[int, tuple], int] = {}
        self.steps: list[dict[int, tuple[int, bytes]]] = []
        self.last_ids: list[bytes] = []
        self.state_of((NONE, (((), 0),)))

    def state_of(self, found: tuple[int, tuple]) -> int:
        """The number of a state, made if new."""
        number = self.number.get(found)
        if number is None:
            number = self.number[found] = len(self.states)
            self.states.append(found)
            self.steps.append(NOWHERE)
            ids = self.ids
            self.last_ids.append(next((ids[t[0]] if len(t) == 1 else b"".join([ids[x] for x in t]) for t, node in found[1] if not node), b""))
        return number

    def step(self, state: int, symbol: int) -> tuple[int, bytes]:
        """The transition, made and kept. Guesses are in order of where their token under way begins, so only the first can have no token of its own."""
        last, guesses = self.states[state]
        after, child, token_at, fitting = [], self.child, self.token, self.merges.fitting
        for tokens, node in guesses:
            node = child[node].get(symbol)
            if node is None:
                continue
            if child[node]:
                after.append((tokens, node))
            token = token_at[node]
            if token != NONE:
                before = tokens[-1] if tokens else last
                fits = before == NONE or fitting.get(before << 32 | token)
                if self.merges.fits(before, token) if fits is None else fits:
                    after.append(((*tokens, token), 0))
        emitted = b""
        while after[0][0]:
            first = after[0][0][0]
            last = NONE  # each guess has a token of its own that the next one must fit
            for tokens, _ in after:
                if tokens[0] != first:
                    break
            else:
                last, emitted = first, emitted + self.ids[first]
                after = [(tokens[1:], node) for tokens, node in after]
                continue
            break
        out = self.state_of((last, tuple(after))), emitted
        if self.steps[state] is NOWHERE:
            self.steps[state] = {}
        self.steps[state][symbol] = out
        return out

    def run(self, piece: bytes) -> bytes:
        """The packed ids of a piece: what is emitted on the way, then the tokens of the guess that ends with it."""
        if len(self.states) > self.most:
            self.clear()
        steps, state, out = self.steps, 0, b""
        for symbol in piece:
            state, emitted = steps[state].get(symbol) or self.step(state, symbol)
            if emitted:
                out += emitted
        return out + self.last_ids[state]


def packed(tokens: Iterable[int]) -> bytes:
    return b"".join(t.to_bytes(4, "little") for t in tokens)


class Encoder:
    """Texts to packed ids. Each match of the pattern is a piece; one that is a token as a whole is that token, others go through the transducer."""

    def __init__(self, path: str, kept: int = KEPT, states: int = STATES) -> None:
        self.merges = Merges(path)
        self.transducer = Transducer(self.merges, states)
        self.pieces, self.ascii_pieces = regex.compile(PIECES).findall, re.compile(ASCII_PIECES).findall
        self.kept, self.newer, self.older = kept, {}, {}

    def of_piece(self, piece: str) -> bytes:
        string = piece.encode()
        whole = self.merges.rank.get(string)
        return packed([whole]) if whole is not None else self.transducer.run(string)

    def learn(self, pieces: Iterable[str]) -> None:
        """Puts pieces that the newer generation lacks into it."""
        older = self.older
        self.newer.update({p: older[p] if p in older else self.of_piece(p) for p in pieces})

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        if len(self.newer) >= self.kept:
            self.older, self.newer = self.newer, {}
        cut = [(self.ascii_pieces if t.isascii() else self.pieces)(t) for t in texts]
        new = set().union(*cut).difference(self.newer)
        self.learn(new)
        out = [b"".join(map(self.newer.__getitem__, pieces)) for pieces in cut]
        for piece in new:
            if len(piece) > KEPT_LONG:
                del self.newer[piece]
        return out


class Utf8Machine:
    """UTF-8 byte by byte. A state is (bytes still to come, least and greatest next byte); what can't go on becomes U+FFFD, once for its longest start."""

    START = (0, 0, 0)

    def __init__(self) -> None:
        self.state, self.held = self.START, b""

    @staticmethod
    def first(byte: int) -> tuple[int, int, int] | None:
        """The state after a byte that begins a character; None where none begins so."""
        if byte < 0x80:
            return Utf8Machine.START
        if 0xC2 <= byte <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= byte <= 0xEF:
            return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
        if 0xF0 <= byte <= 0xF4:
            return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
        return None

    def feed(self, part: bytes) -> str:
        """What can be told after these bytes too."""
        out, (left, low, high), held = [], self.state, self.held
        for byte in part:
            if left:
                if low <= byte <= high:
                    left, low, high, held = left - 1, 0x80, 0xBF, held + bytes([byte])
                    if not left:
                        out.append(held.decode())
                        held = b""
                    continue
                out.append("�")
                left, held = 0, b""
            begun = self.first(byte)
            if begun is None:
                out.append("�")
            elif begun[0]:
                (left, low, high), held = begun, bytes([byte])
            else:
                out.append(chr(byte))
        self.state, self.held = (left, low, high) if left else self.START, held
        return "".join(out)

    def finish(self) -> str:
        """What is left at the end: U+FFFD for a character that isn't whole."""
        rest = "�" if self.state[0] else ""
        self.state, self.held = self.START, b""
        return rest


class Decoder:
    """Packed ids to text, in chunks of any size. Tokens of whole characters go out as they are; others go through the UTF-8 machine."""

    def __init__(self, merges: Merges) -> None:
        most = max(merges.string)
        self.bytes = np.array([merges.string.get(i, b"") for i in range(most + 2)], object)  # an id that the ranks lack adds nothing
        self.text = np.full(most + 2, None, object)
        for i, s in enumerate(self.bytes):
            machine = Utf8Machine()
            text = machine.feed(s)
            if not machine.held and "�" not in text:
                self.text[i] = text
        self.whole = np.array([x is not None for x in self.text])

    def feed(self, machine: Utf8Machine, ids: np.ndarray) -> str:
        """The text that these ids add. Only in the run of broken tokens, and in the whole one after it, is the machine asked."""
        ids = np.minimum(ids, len(self.text) - 1)
        whole = self.whole[ids]
        if not len(ids) or whole.all() and not machine.held:
            return "".join(self.text[ids].tolist())
        out = self.text[ids]
        for k in np.flatnonzero(~whole | np.concatenate(([True], ~whole[:-1]))).tolist():
            out[k] = machine.feed(self.bytes[ids[k]])
        return "".join(out.tolist())

    def stream(self, chunks: Iterable[np.ndarray]) -> Iterator[str]:
        machine = Utf8Machine()
        for ids in chunks:
            yield self.feed(machine, ids)
        yield machine.finish()

    def decode(self, ids: bytes, chunk: int = 65_536) -> str:
        """The text of packed ids, chunk by chunk."""
        all_ids = np.frombuffer(ids, "<u4")
        return "".join(self.stream(all_ids[k : k + chunk] for k in range(0, len(all_ids), chunk)))


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.cache
def decoder(path: str) -> Decoder:
    return Decoder(encoder(path).merges)


def encoded(text: Column, path: str | None = None) -> Column:
    """The packed ids of a text, binary; null as for an empty text: no ids. path: a file of ranks that every executor has."""
    path = path or default_ranks()

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        own = encoder(path)
        return pd.Series([x for run in groups([t or "" for t in texts]) for x in own.encode_all(run)], dtype=object)

    return encode.asNondeterministic()(text)  # else it would run again inside each function of the ids


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of packed ids; null ids give an empty text, bytes that aren't UTF-8 U+FFFD."""
    path = path or default_ranks()

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        return pd.Series([decoder(path).decode(bytes(x or b"")) for x in ids], dtype=object)

    return decode(ids)


def encode_documents(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with ids (packed, binary) and n_tokens; columns of these names are replaced, all others stay.

    Nulls: a null text gives no ids. Very long texts take memory of a few times their size in one worker. Ties and
    repeated rows are encoded alike; an empty table gives an empty result.
    """
    return docs.withColumn("ids", encoded(text_or_empty(text_col), path)).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


@functools.cache
def decimals(most: int) -> np.ndarray:
    return np.array([b"%d " % k for k in range(most + 1)], object)


def digests(text: Column, path: str | None = None) -> Column:
    """n_tokens, the SHA-256 (lowercase hex) of a text's ids in decimal with a space between, and that of the text decoded from them; null as for an empty text.

    One function from text to digests: ids that go back to Spark in between would need a second worker beside the first.
    """
    path = path or default_ranks()

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        own, back = encoder(path), decoder(path)
        written, sha, out = decimals(max(own.merges.string)), hashlib.sha256, []
        for run in groups([t or "" for t in texts]):
            for ids in own.encode_all(run):
                decimal = b"".join(written[np.frombuffer(ids, "<u4")].tolist())[:-1]
                out.append((len(ids) // 4, sha(decimal).hexdigest(), sha(back.decode(ids).encode()).hexdigest()))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest.asNondeterministic()(text)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", digests(F.col("text")).alias("d")).select("doc_id", "d.*")


QUERIES = {"op11_byte_bpe": op11_byte_bpe}
ORACLES = {}
