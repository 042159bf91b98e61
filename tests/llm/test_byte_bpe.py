"""The transducer against the library, the UTF-8 machine against the plain decoder, the query against both."""

import base64
import hashlib
import random
import unicodedata

import numpy as np
import pytest

from lumenfold.llm import byte_bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
DATA = "/root/testdata/sf0.001"


def library(name):
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(x):
    return np.frombuffer(x, "<u4").tolist()


def some_texts(n):
    rnd = random.Random(5)
    letters = ["a", "b", " ", "e", "t", "h", "A", "é", "ß", "中", "文", "　", "\n", "'s", "1", "9", "-", "=", "😀", "\x1c", "́", "ं", "\x85", "<|endoftext|>"]
    yield from ["", " ", "\n\n", "-" * 5000, "ab" * 3000, "'ll it's"]
    for k in range(n):
        if k % 3 == 0:
            some = [chr(rnd.choice([rnd.randint(0, 0x2FF), rnd.randint(0x300, 0xD7FF), rnd.randint(0x10000, 0x10FFFF)])) for _ in range(60)]
            yield "".join(c for c in some if unicodedata.category(c) != "Cn")
        else:
            yield "".join(rnd.choice(letters if k % 3 == 1 else "-=aeth") for _ in range(rnd.randint(0, 120)))


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_encodes_as_the_library(name):
    own, other = byte_bpe.Encoder(public_tokenizers.path(name), kept=300, states=2000), library(name)
    texts = list(some_texts(1500))
    for k in range(0, len(texts), 50):
        for text, got in zip(texts[k : k + 50], own.encode_all(texts[k : k + 50]), strict=True):
            assert ids(got) == other.encode_ordinary(text)
    assert len(own.transducer.states) < 4000  # they are dropped when there are too many


def test_ranks_that_no_merge_reaches(tmp_path):
    """A token that merging can't make comes only from a piece that is the token."""
    ranks = [bytes([b]) for b in range(256)] + [b"bc", b"abc", b"abcd", b"xyz"]  # xyz: neither xy nor yz is there
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(s) + b" %d" % k for k, s in enumerate(ranks)))
    own = byte_bpe.Encoder(str(path))
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={s: k for k, s in enumerate(ranks)}, special_tokens={})
    for text in ("xyz", "xyzx", "abcd", "aabcd", "abc abcbc", "xyz xyz"):
        assert ids(own.encode_all([text])[0]) == other.encode_ordinary(text)


def test_fits_is_what_merging_says():
    merges = byte_bpe.Merges(byte_bpe.default_ranks())
    rnd = random.Random(7)
    words = list(merges.string.values())
    short = [w for w in words if len(w) < 3]
    for _ in range(4000):
        a, b = rnd.choice(words if rnd.random() < 0.5 else short), rnd.choice(words if rnd.random() < 0.5 else short)
        assert merges.fits(merges.rank[a], merges.rank[b]) == (merges.parts(a + b) == [a, b])


def test_output_lags_by_less_than_the_longest_token():
    own = byte_bpe.Encoder(byte_bpe.default_ranks())
    transducer, longest = own.transducer, max(map(len, own.merges.string.values()))
    state, read, written = 0, 0, 0
    for symbol in b"internationalisation" * 40:
        state, emitted = transducer.steps[state].get(symbol) or transducer.step(state, symbol)
        read, written = read + 1, written + sum(len(own.merges.string[t]) for t in ids(emitted))
        assert read - written < 2 * longest


def test_utf8_machine_and_streams():
    rnd = random.Random(3)
    odd = [0x41, 0x80, 0x9F, 0xA0, 0xBF, 0xC1, 0xC2, 0xE0, 0xED, 0xF0, 0xF4, 0xF5]
    dec = byte_bpe.Decoder(byte_bpe.Merges(byte_bpe.default_ranks()))
    for _ in range(3000):
        s = bytes(rnd.choice([*odd, rnd.randint(0, 255)]) for _ in range(rnd.randint(0, 8)))
        machine, at = byte_bpe.Utf8Machine(), rnd.randint(0, len(s))
        assert machine.feed(s[:at]) + machine.feed(s[at:]) + machine.finish() == s.decode("utf-8", "replace")
        x = np.array([rnd.randint(0, 50300) for _ in range(20)], "<u4")
        assert dec.decode(x.tobytes(), rnd.randint(1, 7)) == b"".join(dec.bytes[np.minimum(x, len(dec.bytes) - 1)]).decode("utf-8", "replace")


def test_query_is_the_library(spark):
    other = library("byte_bpe_50k.tiktoken")
    got = {r.doc_id: r for r in byte_bpe.op11_byte_bpe(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = other.encode_ordinary(d.text or "")
        hashed = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, want)).encode(), other.decode_bytes(want))]
        r = got[d.doc_id]
        assert [r.n_tokens, r.ids_sha256, r.decoded_sha256] == [len(want), *hashed]


def test_odd_rows(spark, odd, empty):
    other = library("byte_bpe_50k.tiktoken")
    own = byte_bpe.encode_documents(odd.withColumn("ids_", odd.kept))
    assert set(odd.columns) < set(own.columns)
    for r in own.withColumn("back", byte_bpe.decoded(own.ids)).collect():
        assert ids(r.ids) == other.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids) // 4 and r.back == (r.text or "")
    assert byte_bpe.encode_documents(empty).count() == 0
