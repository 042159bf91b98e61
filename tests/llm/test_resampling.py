"""Resampling against a plain loop, on the smallest tables and on odd ones."""

import hashlib
import math
import re
import zlib

import pytest

from lumenfold.llm import resampling
from lumenfold.llm.resampling import resample

DATA = "/root/testdata/sf0.001"


def plain(docs, target, longest=1, percent=10, least=20):
    """(id, n_features, weight, score) of each, and the drawn ids in order."""

    def own(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        runs = [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]

    found, goal = [own(t) for _, t in docs], [own(t) for t in target]
    s, t = [0] * 10000, [0] * 10000
    for counts, side in ((s, found), (t, goal)):
        for _, runs in side:
            for k in runs:
                counts[k] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t, strict=True)]
    rows, able = [], []
    for (i, _), (n, runs) in zip(docs, found, strict=True):
        weight = sum(gain[k] for k in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(runs), weight, score))
        if n >= least:
            able.append((-score, i is None, i or 0, i))
    return rows, [x[3] for x in sorted(able, key=lambda x: x[:3])[: percent * len(able) // 100]]


def check(got, docs, target, **how):
    rows, first = plain(docs, target, **how)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r[0], r.n_features, r.weight, r.score) for r in got), key=key) == sorted(rows, key=key)
    assert [r[0] for r in sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)] == first
    assert sorted(r.rank for r in got if r.rank is not None) == list(range(1, len(first) + 1))


def test_query_is_the_plain_loop(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    check(resampling.op12_resampling(spark, DATA).collect(), docs, target)


@pytest.mark.parametrize("longest", [1, 3])
def test_odd_rows(spark, odd, longest):
    more = odd.unionByName(odd.withColumn("text", odd.doc_id.cast("string"))).unionByName(odd.filter("doc_id = 5"))
    target = odd.filter("doc_id in (7, 8)")
    docs = [(r.doc_id, r.text) for r in more.collect()]
    got = resample(more, target, percent=60, least_words=2, longest=longest).collect()
    check(got, docs, [r.text for r in target.collect()], longest=longest, percent=60, least=2)


def test_empty(spark, odd, empty):
    assert resample(empty, odd).columns == ["doc_id", "n_features", "weight", "score", "rank"] and resample(empty, odd).count() == 0
    check(resample(odd, empty).collect(), [(r.doc_id, r.text) for r in odd.collect()], [])


def test_clashing_names_and_string_ids(spark, odd):
    named = odd.withColumns({n: odd.kept for n in ("id", "row", "key", "range", "last", "rank", "score", "n_words", "weight")}).withColumn("doc_id", odd.doc_id.cast("string"))
    assert {r.doc_id for r in resample(named, odd).collect()} == {None, *map(str, range(1, 10))}


@pytest.mark.parametrize("same", [0, 400, 1000])
def test_brackets_hold_the_cutoff(spark, same):
    """`same` of 1000 rows share one score, and sketches of any accuracy lead to the same draw."""
    scores = [(k, 5 if k < same else (k * 7919) % 1000 - 500) for k in range(1000)]
    rows = spark.createDataFrame(scores, "id long, score long").withColumn("row", resampling.F.monotonically_increasing_id()).withColumn("key", resampling.order_key())
    order = [i for i, _ in sorted(scores, key=lambda x: (-x[1], x[0]))]
    for k in (1, 100, 555, 1000):
        for accuracy in (3, 2000):
            low, high, above = resampling.bracket(rows, k, 1000, accuracy)
            assert above == sum(s > high for _, s in scores) and above < k <= above + sum(low <= s <= high for _, s in scores)
        got = sorted(resampling.drawn(rows, k, 1000).select("rank", "id").collect())
        assert [r.id for r in got] == order[:k] and [r.rank for r in got] == list(range(1, k + 1))
