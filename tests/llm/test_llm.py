"""The training-data operators against SQL, libraries and brute force."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lumenfold.llm import bpe, catalog, exact_dedup, lm_scoring, mixing, near_copies, pseudonyms, quality, secrets, sharding, simhash, substring_dedup

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def rows(frame):
    cols = sorted(frame.columns)
    plain = lambda x: str(int(x) if isinstance(x, float) and x.is_integer() else x)  # noqa: E731 - whole numbers beside nulls are floats in pandas
    return sorted(map(tuple, frame[cols].astype(object).where(frame[cols].notna(), None).map(plain).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    assert rows(catalog.queries()[name](spark, DATA).toPandas()) == rows(con.execute(catalog.oracle_sql()[name]).df())


def test_exact_groups_odd(odd, empty):
    got = exact_dedup.exact_groups(odd).toPandas()
    assert len(got) == 11 and exact_dedup.exact_groups(empty).count() == 0
    by = got.groupby("text_sha256").agg(n=("kept", "sum"), size=("group_size", "max"), rows=("kept", "count"))
    assert (by.n == 1).all() and (by["size"] == by.rows).all()
    assert exact_dedup.drop_exact_copies(odd).columns == odd.columns
    assert exact_dedup.drop_exact_copies(odd, "largest").count() == got.kept.sum()


def test_sharding(spark, docs, odd, empty):
    got = sharding.op2_sharding(spark, DATA).toPandas()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got.itertuples(index=False) for r in [r._replace()])
    for s in (got, sharding.shard_documents(odd, 3).select("shard", "slot", "size").toPandas()):
        for _, own in s.groupby("shard"):
            assert sorted(own.slot) == list(range(len(own)))
    assert got["size"].groupby(got.shard).sum().max() - got["size"].sum() / 24 <= got["size"].max()
    assert sharding.shard_documents(odd, 3).count() == 11 and sharding.shard_documents(empty, 3).count() == 0


def test_sharding_splits_a_hot_text(spark):
    hot = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'one hot text', concat('text ', id)) AS text")
    per = sharding.shard_documents(hot, 8).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert len(per) == 8 and per.max() - per.min() < 0.02 * per.mean()


def test_secrets_odd(odd, empty, spark):
    assert secrets.find_secrets(odd).count() == 11 and secrets.find_secrets(empty).count() == 0
    weak = "aB3" * 8
    near, far = f"AKIA{'Z9' * 8} {weak}", f"AKIA{'Z9' * 8} {'. ' * 300}{weak}"
    one = spark.createDataFrame([(1, near), (2, far), (3, weak), (4, f"https://host.example {weak}"), (5, f"AKIA{'Z9' * 8} token={weak}")], "doc_id int, text string")
    kinds = {r.doc_id: [s.kind for s in r.spans] for r in secrets.find_secrets(one).collect()}
    assert kinds == {1: ["access", "linked"], 2: ["access"], 3: [], 4: ["linked"], 5: ["access", "assign"]}


def test_secrets_long_parts(spark):
    """A weak part has no upper length: session tokens and long keys are parts of credentials."""
    token = "aB3x" * 100
    one = spark.createDataFrame([(1, f"AKIA{'Z9' * 8} {token}"), (2, f"{token} https://host.example"), (3, token), (4, f"AKIA{'Z9' * 8} {'. ' * 300}{token}")], "doc_id int, text string")
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind == "linked"] for r in secrets.find_secrets(one).collect()}
    assert spans == {1: [("linked", 21, 421)], 2: [("linked", 0, 400)], 3: [], 4: []}


def test_simhash(docs, odd, empty, spark):
    table = docs.toPandas()
    fp = np.array([simhash.fingerprint((x or "").encode()) for x in table.text], np.uint64)
    near, label = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4, table.doc_id.to_numpy().copy()
    while (new := np.array([label[row].min() for row in near])).tolist() != label.tolist():
        label = new
    got = simhash.near_groups(docs).toPandas().set_index("doc_id")
    assert [got.loc[i].component_id for i in table.doc_id] == label.tolist()
    assert simhash.near_groups(odd).count() == 11 and simhash.near_groups(empty).count() == 0


def test_simhash_chunks(spark):
    """Groups cut into chunks give the components of whole ones."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 5)
    fps = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (40, 2))})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = [sorted(map(tuple, simhash.components(simhash.links(df, chunk=c)).collect())) for c in (8, 4096)]
    assert roots[0] == roots[1]


def test_near_copies(spark):
    """Against all pairs: five-word shingles, similarity of 0.8; whole groups and chunks of them."""
    rng = np.random.default_rng(5)
    texts = []
    for base in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        texts.append(words)
        for cut in rng.integers(0, 24, 4):
            texts.append(words[: len(words) - int(cut)] + [f"new{x}" for x in rng.integers(0, 9999, int(cut) // 3)])
    texts = [" ".join(x) for x in texts] + ["", "one two", "One  two", "one three"]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in texts]
    near = np.array([[a == b or len(a & b) >= 0.8 * len(a | b) > 0 for b in sets] for a in sets])
    label = np.arange(len(texts))
    while (new := np.array([label[row].min() for row in near])).tolist() != label.tolist():
        label = new
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(set(label.tolist())) < len(texts) - 100
    for chunk in (2, 1024):
        assert sorted(r.doc_id for r in near_copies.drop_near_copies(df, chunk=chunk).collect()) == sorted(set(label.tolist()))


def test_near_copies_by_fingerprint(spark):
    """What SimHash links goes, also where five-word similarity is below 0.8: a run of three words, with a few of them changed."""
    run = ["alpha", "beta", "gamma"] * 300
    texts = [list(run), list(run)]
    for k in range(0, 300, 60):
        texts[1][k] = f"x{k}"
    a, b = (" ".join(t) for t in texts)
    assert (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() <= simhash.MOST
    one, two = (set(near_copies.shingles(t.encode()).tolist()) for t in (a, b))
    assert len(one & two) < 0.8 * len(one | two)
    df = spark.createDataFrame([(1, a), (2, b), (3, "another text of six words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(df, fingerprints=True).collect()) == [1, 3]
    assert near_copies.drop_near_copies(df).count() == 3
    assert [r.doc_id for r in corpus_pipeline.near_copies(spark, df, DATA).orderBy("doc_id").collect()] == [1, 3]


def test_bpe(docs, odd, empty):
    own, path = bpe.encode_documents(odd).toPandas(), bpe.default_vocabulary()
    ours, theirs = bpe.Codec(path), Tokenizer.from_file(path)
    for r in own.itertuples():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
    for text in ["", " ", "a  b\t\n c", "I'll don't", "日本語テキスト", "<|endoftext|><|endoftext|>x", "x" * 3000, "\x1c\x85　 é"]:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == ids
        assert ours.decode(np.array(ids[1:], "<u4").tobytes()) == theirs.decode(ids[1:], skip_special_tokens=False)
    assert bpe.encode_documents(empty).count() == 0
    assert docs.select(bpe.decoded(bpe.encoded(docs.text)) == docs.text).distinct().collect() == [(True,)]


def test_bpe_blocks_and_generations(docs):
    """Pieces merged in blocks, with walls between, and a cache that is replaced all the time: the library's ids still."""
    path, draw = bpe.default_vocabulary(), np.random.default_rng(4)
    texts = [r.text or "" for r in docs.limit(60).collect()]
    texts += ["".join(map(chr, draw.choice([0, 9, 10, 32, 39, 65, 97, 115, 233, 0x3000, 0x4E2D, 0x1F600], n))) for n in range(200)]
    texts += ["y" * 30000, "ab " * 9000, "<|endoftext|>", "a<|endoftext|>é", ""]
    want = [np.array(x.ids, "<u4").tobytes() for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for own in (bpe.Codec(path), bpe.Codec(path, kept=50)):
        assert [x for run in bpe.groups(texts) for x in own.encode_all(run)] == want
        assert own.encode_all(texts) == want


def test_quality_odd(odd, empty, spark):
    judged = quality.judged(odd).toPandas()
    assert len(judged) == 11 and quality.judged(empty).count() == 0
    assert set(judged[judged.text.isna()].rejected_by) == {"too_few_words"}
    prose = spark.createDataFrame([(1, " ".join(f"plain{k} words" for k in range(80))), (2, "same words here " * 60)], "doc_id int, text string")
    assert [r.rejected_by for r in quality.judged(prose).orderBy("doc_id").collect()] == [None, "repeated_words"]


def test_pseudonyms(docs, odd, empty):
    key = hashlib.blake2b(b"k", digest_size=32).digest()
    values = {"email": "jo.Doe9@mail.example.com", "ip": "10.2.3.4", "date": "2021-02-28", "card": "4111 1111 1111 1111", "phone": "+1 (386) 555-3733"}
    for kind, value in values.items():
        new = pseudonyms.pseudonym(kind, value, key)
        assert new != value and pseudonyms.pseudonym(kind, new, key, True) == value
        assert [x[2] for x in pseudonyms.found(f"see {new} now")] == [kind]
    for bad in ("4111 1111 1111 1112", "300.1.1.1", "2021-02-30"):
        assert pseudonyms.found(f"see {bad} now") == []
    for r in docs.limit(100).collect():
        assert pseudonyms.replaced(pseudonyms.replaced(r.text, key)[0], key, True)[0] == r.text
    assert len({tuple(pseudonyms.permute([a, b, c], [3, 5, 2], key, "t")) for a in range(3) for b in range(5) for c in range(2)}) == 30
    assert pseudonyms.pseudonymise_documents(odd, "k").count() == 11 and pseudonyms.pseudonymise_documents(empty, "k").count() == 0


def test_substrings(docs, odd, empty):
    for df, n in ((docs, docs.count()), (odd.filter("doc_id <> 8"), 8)):
        got = {r[0]: r[1:] for r in substring_dedup.remove_repeats(df).rdd.map(lambda r: (r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest())).collect()}
        want = substring_dedup.brute_force([(r.doc_id, (r.text or "").encode()) for r in df.collect()])
        assert got == want and len(got) == n
    assert substring_dedup.remove_repeats(odd).count() == 11 and substring_dedup.remove_repeats(empty).count() == 0


def test_lm(docs, odd, empty):
    got, table = lm_scoring.score_documents(docs).toPandas().set_index("doc_id"), docs.toPandas()
    train = {i for i in table.doc_id if zlib.crc32(str(i).encode()) % 5 != 1}
    words = {r.doc_id: (r.text or "").encode().lower().split() for r in table.itertuples()}
    counts = Counter(w for i in train for w in words[i])
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    for i, own in words.items():
        r = got.loc[i]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own) + math.log10((len(train) + 0.5) / (n + 0.5 * (v + 1)))
        assert r.base_score == pytest.approx(base) and r.held_out == (i not in train)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own) + 1, sum(counts[w] > 0 for w in own) + 1, n)
    assert (got.score < 0).all()
    assert lm_scoring.score_documents(odd).count() == 11 and lm_scoring.score_documents(empty).count() == 0


def vocabulary(rng):
    counts = rng.random(lm_scoring.END + 1) * (rng.random(lm_scoring.END + 1) < 0.5)
    return lm_scoring.Vocabulary(counts, rng.random(len(counts)) < 0.6).with_pairs(rng.random(lm_scoring.CLASSES**2) * 5)


def test_lm_is_a_distribution():
    """Over all next ids, probabilities sum to one."""
    rng, t, n = np.random.default_rng(0), lm_scoring.CONTEXT, lm_scoring.END + 1
    known, w = vocabulary(rng), lm_scoring.start_weights()
    every = np.arange(n + -n % t) % n
    inputs = np.full((len(every) // t, t), 7)
    parts = lm_scoring.views(w)
    parts["pos"][:] = parts["pos"][0]
    parts["out0"] *= 20
    network, step = lm_scoring.Network(known, w), lm_scoring.BATCH
    logp = np.concatenate([network.forward(inputs[k : k + step], every.reshape(-1, t)[k : k + step]) for k in range(0, len(inputs), step)])
    assert np.exp((logp.reshape(-1) + known.share[every])[:n].astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_lm_sees_no_future():
    """An id's probability doesn't change with the ids after it."""
    rng = np.random.default_rng(1)
    network, ids = lm_scoring.Network(vocabulary(rng), lm_scoring.start_weights()), rng.integers(0, lm_scoring.END, (1, lm_scoring.CONTEXT + 1))
    one = network.forward(ids[:, :-1], ids[:, 1:]).copy()
    other = ids.copy()
    other[:, 20:] = 5
    assert network.forward(other[:, :-1], other[:, 1:])[0, :19] == pytest.approx(one[0, :19], abs=1e-5)


def test_lm_gradients():
    """Against differences of the loss."""
    rng = np.random.default_rng(3)
    network = lm_scoring.Network(vocabulary(rng), lm_scoring.start_weights("f8"))
    w, shape = network.w, (3, lm_scoring.CONTEXT)
    w["out0"] *= 20
    w["out1"] *= 20
    inputs, targets, weight = rng.integers(0, lm_scoring.END, shape), rng.integers(0, lm_scoring.END, shape), rng.random(shape)
    loss = lambda: -(network.forward(inputs, targets) * weight).sum()
    loss()
    network.backward(weight)
    network.g["emb"][network.touched] = network.pulls
    grads = {k: x.copy() for k, x in network.g.items()}
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        own, step = w[name][at], 1e-4
        w[name][at] = own + step
        above = loss()
        w[name][at] = own - step
        below = loss()
        w[name][at] = own
        assert (above - below) / (2 * step) == pytest.approx(g[at], rel=1e-3, abs=1e-4), name


def test_lm_scores_do_not_depend_on_partitions(spark, docs):
    """One partition or seven, in either order: the same scores; so with many small copies and rounds of training."""
    few = docs.limit(60).cache()
    slice_, lm_scoring.SLICE = lm_scoring.SLICE, 3000
    try:
        both = [{r.doc_id: r.score for r in lm_scoring.score_documents(df).collect()} for df in (few.coalesce(1), few.orderBy(F.desc("doc_id")).repartition(7))]
    finally:
        lm_scoring.SLICE = slice_
    assert both[0] == pytest.approx(both[1], rel=1e-5)


def test_lm_learns(spark):
    """Held-out texts of a language in which each word sets the next one: context must beat any unigram score."""
    line = "red blue green gold pink grey".split()
    texts = spark.range(0, 1500, 1, 2).selectExpr("id AS doc_id", f"concat_ws(' ', transform(sequence(0, 200), k -> element_at(array({', '.join(map(repr, line))}), int((id + k) % 6) + 1))) AS text")
    got = lm_scoring.score_documents(texts).filter("held_out").selectExpr("sum(score) / sum(n_tokens) AS own", "sum(base_score) / sum(n_tokens) AS base").first()
    assert got.own > got.base / 3


def test_windows_score_each_token_once():
    texts = [np.arange(n) for n in (0, 1, 13, 14, 15, 16, 17, 100, 20_000)]
    for stride in (lm_scoring.STRIDE, lm_scoring.CONTEXT):
        seen = {k: [] for k in range(len(texts))}
        for inputs, targets, fresh, row in lm_scoring.windows(texts, stride):
            for k, i, t, f in zip(row, inputs, targets, fresh):
                seen[k] += t[f].tolist()
                assert all(b == a + 1 or b == lm_scoring.END or a == lm_scoring.END for a, b in zip(i[f], t[f]))
        assert seen == {k: [*range(len(x)), lm_scoring.END] for k, x in enumerate(texts)}


def test_words_by_their_ids():
    """Ids give the words back, whatever their bytes; equal words have equal hashes, different ones differ."""
    own = lm_scoring.Words(lm_scoring.default_ranks())
    of_id = {i: b for b, i in own.ranks.items()}
    words = [b"plain", b"'t", b"\xff\xfe", "日本語".encode(), b"x" * 500, "\u00a0\u3000é\x1c\x85".encode(), b"<|endoftext|>", b"plain", b"plainer"]
    ids = own.ids([words, [], words], [True, True, False])
    assert ids[0] == ids[2] and ids[1] == b""
    line = np.frombuffer(ids[0], "<u2")
    assert b"".join(of_id[i] for i in line.tolist()) == b"".join(b" " + w for w in words)
    h, at = lm_scoring.word_hashes(line, own.first)
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words)) and h[0] == h[7]
    assert dict(zip(*(x.tolist() for x in own.counts()))) == dict(Counter(h.tolist()))
    assert at.tolist() == sorted(at.tolist()) and lm_scoring.word_hashes(line[:0], own.first)[0].size == 0


def test_words_are_encoded_once_a_worker():
    """Words of one task aren't encoded again in the next, and a column gives the ids that its texts split by Python give."""
    texts = [b" Two words\x0bTWO\x0c", b"", b" \t ", b"\xc2\xa0a\x1cb\x85 \xc3\x89\xc3\xa9 \x00", b"two\xff\nwords\r\n", "日本語 x".encode() * 40, bytes(range(1, 128))] * 3
    counted = [k % 3 > 0 for k in range(len(texts))]
    one, other = lm_scoring.Words(lm_scoring.default_ranks()), lm_scoring.Words(lm_scoring.default_ranks())
    column = pa.array([b"before", *texts], pa.binary())[1:]
    assert one.ids_of(column, counted) == other.ids([x.lower().split() for x in texts], counted)
    assert sorted(zip(*(x.tolist() for x in one.counts()))) == sorted(zip(*(x.tolist() for x in other.counts())))

    lm_scoring.words_of.cache_clear()
    path, batch = lm_scoring.default_ranks(), pa.RecordBatch.from_arrays([pa.array(range(21)), column, pa.array([False] * 21)], ["id", "text", "held_out"])
    first = list(lm_scoring.encoded(path)(iter([batch])))
    lm_scoring.words_of(path).add = None  # nothing is left to be encoded
    assert list(lm_scoring.encoded(path)(iter([batch]))) == first
    lm_scoring.words_of.cache_clear()


def test_many_words_find_their_slots():
    """More words than slots at first, several to a slot: each keeps its number."""
    own, n = lm_scoring.Words(lm_scoring.default_ranks()), 50_000
    words = pa.array([b"w%d" % k for k in range(n)], pa.binary())
    for k in range(0, n, 10_000):
        assert own.numbers(words[k : k + 10_000]).tolist() == [*range(k, k + 10_000)]
    assert own.numbers(words.take(pa.array(range(n - 1, -1, -1)))).tolist() == [*range(n - 1, -1, -1)]


def test_looked_up_values():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 3000):
        hashes = np.unique(rng.integers(-(2**63), 2**63, n))
        if n > 5:
            hashes = np.unique(np.concatenate([hashes, np.arange(40), [-1, -(2**63), 2**63 - 1]]))  # many with the same first bits
        values, asked = rng.random(len(hashes)), np.concatenate([hashes, rng.integers(-(2**63), 2**63, 50), [0, -1, 39, 40]])
        want, looked = dict(zip(hashes.tolist(), values.tolist())), lm_scoring.Looked(hashes, values)
        at = looked(asked)
        assert (at < len(hashes)).tolist() == [h in want for h in asked.tolist()]
        assert looked.values.take(at).tolist() == [want.get(h, 0.0) for h in asked.tolist()]


def test_lm_of_fixed_weights():
    """Scoring by looked up products gives what learning's forward pass gives."""
    rng, shape = np.random.default_rng(4), (5, lm_scoring.CONTEXT)
    known, w = vocabulary(rng), lm_scoring.start_weights("f8")
    inputs, targets = rng.integers(0, lm_scoring.END, shape), rng.integers(0, lm_scoring.END, shape)
    for skip in (0, 8):
        one, other = (lm_scoring.Network(known, w, fixed=f).forward(inputs, targets, skip=skip) for f in (True, False))
        assert one == pytest.approx(other, rel=1e-9)


def test_mixing(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = mixing.mix(docs, labels).toPandas()
    total = got.n_tokens.sum()
    for d, share in mixing.TARGETS.items():
        assert (got.rate * got.n_tokens * got[f"p_{d}"]).sum() / total == pytest.approx(share, abs=2e-3)
    assert (got.rate >= 0).all() and len(got) == docs.count()
    assert mixing.mix(odd, labels).count() == 11 and mixing.mix(empty, labels).count() == 0


def test_stages_keep_null_and_repeated_ids(spark, docs, odd):
    """Documents are told apart by id and text, not by the id alone."""
    kept = near_copies.drop_near_copies(odd).collect()
    assert [r.doc_id for r in kept].count(None) == 0 and sorted(r.doc_id for r in kept) == [1, 3, 5, 7, 8, 9]  # the row without an id has 16 of 19 shingles in common with 7
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    same = spark.createDataFrame([(i, words(k)) for k, i in enumerate([None] * 5 + [7] * 5)] + [(7, words(0) + " end"), (None, words(5) + " end"), (None, words(1))], "doc_id long, text string")
    # a component keeps the smallest id, so text 0 goes for its near copy that has an id, and text 5 keeps its own
    assert sorted(r.text for r in near_copies.drop_near_copies(same).collect()) == sorted([words(0) + " end"] + [words(k) for k in range(1, 10)])
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    clean = docs.selectExpr("CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 1 ELSE doc_id END AS doc_id", "text")
    got = [r.doc_id for r in mixing.thin(clean, labels).collect()]
    assert min(sum(i is None for i in got), sum(i == 1 for i in got)) > 0.5 * sum(i not in (None, 1) for i in got) > 5


def test_encoding_makes_ids_once(spark, docs, odd):
    """One pass over the texts, whose ids leave a worker run by run."""
    import pyarrow as pa

    plan = corpus_pipeline.encode(spark, docs, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "pythonUDF0#" in plan and "pythonUDF1#" not in plan
    own, texts = bpe.Codec(bpe.default_vocabulary()), [None, "", "one two", *["many words " * 10_000] * 12, "x" * (bpe.TOGETHER + 1), "end", None]
    runs = list(bpe.id_lists(pa.array(texts, pa.string()), own))
    assert max(sum(len(x or "") for x in texts[a : a + len(r)]) for a, r in zip(np.cumsum([0] + [len(r) for r in runs]), runs, strict=False) if len(r) > 1) <= bpe.TOGETHER
    assert len(runs) > 3 and [x for r in runs for x in r.to_pylist()] == [np.frombuffer(own.encode(x or ""), "<u4").tolist() for x in texts]
    assert list(bpe.id_lists(pa.array([], pa.string()), own)) == []
    got = corpus_pipeline.encode(spark, odd, DATA).toPandas()
    assert len(got) == odd.count() and got.n_tokens.tolist() == got.ids.map(len).tolist()


def test_pipeline(spark, docs):
    ids = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        ids = stage(spark, ids, DATA)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert ids.columns == docs.columns
    got = corpus_pipeline.run(spark, DATA)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in ids.collect())
    own = bpe.Codec(bpe.default_vocabulary())
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(own.decode(np.array(r.ids, "<u4").tobytes()) == text[r.doc_id] for r in got.limit(20).collect())
