"""Edge cases and brute-force versions: hot keys, odd ids, pseudonyms, mixing, and the pipeline stage by stage."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lumenfold.llm import bpe, lm_scoring, mixing, near_copies, pseudonyms, quality, secrets, sharding, simhash, substring_dedup
from lumenfold.llm.common import join_classes

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


# ---- op2


def test_sharding_against_sorting(spark):
    """Half the rows share one text and no id: bytes stay equal, slots gapless, equal texts side by side; as sorting all rows and cutting at equal shares."""
    rows = [(None, "one hot text", k) for k in range(4000)] + [(k, f"text number {k} " + "x" * (k % 50), k) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other int")
    got = sharding.shard_documents(df, 8, tolerance=0.001).toPandas()
    assert sorted(got.other) == sorted(r[2] for r in rows) and len(got) == 8000
    total, share = got["size"].sum(), got["size"].sum() / 8
    assert (got.groupby("shard")["size"].sum() - share).abs().max() <= 0.002 * share + 2 * got["size"].max()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    placed = got.sort_values(["shard", "slot"]).reset_index(drop=True)
    h = {t: hash_ for t, hash_ in df.select("text", F.xxhash64("text")).distinct().collect()}
    keys = [(h[t], -1 if i != i or i is None else i) for t, i in zip(placed.text, placed.doc_id)]
    assert keys == sorted(keys)
    below = placed["size"].cumsum().to_numpy() - placed["size"].to_numpy()
    want = np.minimum(below * 8 // total, 7)
    assert (want != placed.shard).mean() < 0.01


def test_sharding_small_ranges(spark):
    """Many ranges in a shard, more boundaries than rows in places, a very long row: slots stay gapless."""
    df = spark.range(500).selectExpr("id % 7 AS doc_id", "if(id = 3, repeat('long ', 20000), concat('t', id % 11)) AS text")
    got = sharding.shard_documents(df, 4, part_bytes=200).toPandas()
    assert len(got) == 500
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


# ---- op4


def slow_fingerprint(text):
    own = words(text)
    if not own:
        return 0
    shingles = [" ".join(own[k : k + 4]) for k in range(len(own) - 3)] or [" ".join(own)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_simhash_query_against_brute_force(spark, docs):
    """Fingerprints counted bit by bit, all pairs compared: every row of the query."""
    table = docs.toPandas()
    fps = [slow_fingerprint(t) for t in table.text]
    own = np.array(fps, np.uint64)
    near, label = np.bitwise_count(own[:, None] ^ own[None, :]) <= 4, table.doc_id.to_numpy().copy()
    while (new := np.array([label[row].min() for row in near])).tolist() != label.tolist():
        label = new
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op4_simhash(spark, DATA).collect()}
    assert got == {i: (f"{f:016x}", c) for i, f, c in zip(table.doc_id.tolist(), fps, label.tolist())}


def test_components_of_a_star_and_a_chain(spark):
    edges = [(k, 1000) for k in range(5, 300)] + [(2000 + k, 2001 + k) for k in range(40)] + [(3, 1000)]
    got = dict(simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 3 for k in [3, *range(5, 300), 1000]}, **{2000 + k: 2000 for k in range(41)}}


def test_dense_groups_cut_into_chunks_write_few_links(spark):
    """Of one component in chunks, rows grow with its members, not with pairs of chunks; components that lie in several chunks are still linked."""
    rng = np.random.default_rng(11)
    fps = sorted({(1 << int(i)) | (1 << int(j)) for i, j in rng.integers(0, 62, (900, 2))})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = simhash.links(df, chunk=20)
    assert len(fps) > 600 and links.count() < 15 * len(fps)
    assert {r.root for r in simhash.components(links).collect()} == {fps[0]}
    members, edges = spark.createDataFrame([(0, x) for x in range(1000)], "g long, key long"), spark.createDataFrame([(0, x) for x in range(1, 990)], "a long, b long")
    dealt = simhash.across(members, edges, "g", "key", 50).collect()
    assert len(dealt) == 990 + 10 * (1 + 20)
    meet = {}
    for r in dealt:
        meet.setdefault(r.part, []).append(r)
    pairs = {(x.key, y.key) for own in meet.values() for x in own for y in own if x.side != y.side or x.side < 0}
    assert all((x, y) in pairs for x in range(990, 1000) for y in range(1000) if x != y)
    assert not simhash.across(members.filter("key < 990"), edges, "g", "key", 50).count()


def test_components_draw_edges_anew_each_round(spark, monkeypatch):
    """What has been joined drops out: all rounds together write no more edges than twice the first."""
    rng, written = np.random.default_rng(2), []
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 4000, (6000, 2))] + [(7, int(b)) for b in range(4000, 6000)]
    stash = simhash.stash

    def noted(df, tag):
        out = stash(df, tag)
        if tag == "edges":
            written.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stash", noted)
    got = dict(simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    label = {x: x for e in edges for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert got == label
    assert len(written) > 1 and sum(written) < 2 * written[0]


def test_pivots_discard_pairs_without_losing_links():
    """Of random pairs that meet, pivots leave next to none; all links stay."""
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    fps = np.unique(np.concatenate([fps, fps[:50] ^ np.uint64(5)]))
    tally = {}
    a, b = simhash.forest(np.zeros(len(fps), int), np.full(len(fps), -1), fps, 4, tally)
    assert len(a) == 50 and (np.bitwise_count(a ^ b) == 2).all()
    assert tally["left"] < 0.001 * tally["met"]


def test_hot_classes(spark):
    """A class with most rows is joined apart; no row is lost or doubled."""
    rows = spark.range(60_000).selectExpr("if(id < 30000, 7, id) AS k", "id")
    classes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    got = join_classes(rows, classes, "k", "n")
    assert got.count() == 60_000 and got.filter("k = 7 AND (n <> 30000 OR low <> 0)").count() == 0


# ---- op1


def test_substrings_with_strings_and_nulls_for_ids(spark):
    """Ids of any type; rows that share one, or have none, count one after the other, in the order of (id, text)."""
    passage = "a passage of well over one hundred bytes that several of these documents have in common, word for word, to its end. "
    rows = [("b", "first " + passage), ("a", "second " + passage), ("b", "third " + passage), (None, "fourth " + passage), (None, None), ("c", "")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", (r[1] or "").encode()))
    want = substring_dedup.brute_force([(k, (t or "").encode()) for k, (_, t) in enumerate(ordered)])
    told = sorted((r.doc_id or "", r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed)) for r in got)
    assert told == sorted((i or "", *want[k][:3]) for k, (i, _) in enumerate(ordered))


def test_substrings_odd(odd):
    got = Counter((r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.removed)) for r in substring_dedup.remove_repeats(odd).collect())
    ordered = sorted(odd.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, (r.text or "").encode()))
    want = substring_dedup.brute_force([(k, (r.text or "").encode()) for k, r in enumerate(ordered)])
    assert got == Counter((r.doc_id, *want[k][:2]) for k, r in enumerate(ordered))


# ---- op3, op9: odd input


def test_secrets_of_odd_rows(spark):
    key = "AKIA" + "Z9" * 8
    rows = [(1, None, 5), (1, "", 6), (None, f"x {key}", 7), (2, f"password = 'abcdefgh1' {'f' * 32}", 8), (2, f"password = 'abcdefgh1' {'f' * 32}", 8), (3, "p " * 60_000 + key, 9)]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id int, text string, spans int")).collect()
    told = Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in got)
    both = (("assign", 0, 21), ("hex", 23, 55))
    assert told == Counter([(1, ()), (1, ()), (None, (("access", 2, 22),)), (2, both), (2, both), (3, (("access", 120_000, 120_020),))])


def test_lm_of_odd_rows(odd):
    """Base columns of null, empty, repeated and very long rows against counting."""
    rows = odd.collect()
    held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows]
    own = [words(r.text) for r in rows]
    counts = Counter(w for k, ws in enumerate(own) if not held[k] for w in ws)
    ends = len(rows) - sum(held)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base = lambda ws: sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) + np.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
    want = sorted((str(r.doc_id), h, len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, round(base(ws), 4)) for r, h, ws in zip(rows, held, own))
    got = lm_scoring.score_documents(odd).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(round(r.score, 3))
    assert len(by[8]) == 1


# ---- op8


def test_pseudonyms_against_a_slow_scan(spark, docs):
    """Every span found by claiming text character by character; all else stays; equal values stay linked and different ones apart."""
    key = pseudonyms.key_of(spark)
    got = {r.doc_id: r for r in pseudonyms.op8_pii(spark, DATA).collect()}
    seen: dict[tuple[str, str], str] = {}
    for r in docs.collect():
        claimed, want = set(), []
        for kind, pattern in pseudonyms.PATTERNS.items():
            for m in re.finditer(pattern, r.text or ""):
                digits = [int(c) for c in m.group() if c.isdigit()]
                check = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
                valid = {"email": True, "ip": kind == "ip" and all(str(int(x)) == x and int(x) < 256 for x in m.group().split(".")), "card": sum(check) % 10 == 0, "phone": not m.group().isdigit()}
                if kind == "date":
                    y, a, b = digits[:4], digits[4:6], digits[6:8]
                    if not m.group()[4] == "-":
                        y, a, b = digits[4:], digits[2:4], digits[:2]
                    year, month, day = (int("".join(map(str, x))) for x in (y, a, b))
                    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
                    valid["date"] = year > 0 and 1 <= month <= 12 and 1 <= day <= [31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][month - 1]
                if valid[kind] and not claimed & set(range(*m.span())):
                    claimed |= set(range(*m.span()))
                    want.append((m.start(), m.end(), kind))
        want.sort()
        new = got[r.doc_id]
        assert [(s.start, s.end, s.kind) for s in new.pii_spans] == want and new.n_found == len(want)
        edges = [0, *[x for span in want for x in span[:2]], len(r.text or "")]
        outside = [re.escape((r.text or "")[a:b]) for a, b in zip(edges[::2], edges[1::2])]
        put = re.fullmatch("(.+?)".join(outside), new.text, re.DOTALL)
        assert put
        for (start, end, kind), value in zip(want, put.groups()):
            assert seen.setdefault((kind, r.text[start:end]), value) == value
            assert kind == "ip" or [c.isdigit() for c in value] == [c.isdigit() for c in r.text[start:end]]
    assert len(set((k, v) for (k, _), v in seen.items())) == len(seen) > 10 and key


def test_bare_digits_are_no_phone():
    assert pseudonyms.found("call 1234567890 now") == [] and [x[2] for x in pseudonyms.found("call 123-456-7890 now")] == ["phone"]


# ---- op10


def test_mixing_against_plain_least_squares(spark, docs):
    """Targets that bounds can't reach: the sum of squares is that of many small projected steps over all documents at once."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for targets, most in (({"clean": 0.1, "poor": 0.8, "toxic": 0.1}, 1.0), ({"clean": 0.86, "poor": 0.12, "toxic": 0.02}, None)):
        got = mixing.mix(docs, labels, targets, most=most).toPandas()
        p = got[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy() * got.n_tokens.to_numpy()[:, None]
        total = got.n_tokens.sum()
        want = np.array([targets[d] for d in mixing.DOMAINS]) * total
        rates = np.ones(len(got))
        step = 1 / np.linalg.eigvalsh(p.T @ p).max()
        for _ in range(4000):
            rates = np.clip(rates - step * (p @ (rates @ p - want)), 0, most)
        best, own = ((rates @ p - want) ** 2).sum(), ((got.rate.to_numpy() @ p - want) ** 2).sum()
        assert (got.rate >= 0).all() and (most is None or (got.rate <= most + 1e-9).all())
        assert own <= best * 1.05 + (2e-3 * total) ** 2


def test_mixing_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, 1, 0), (7, 1, 1), (None, 1, 0), (8, None, None), (77, 0, 1)], "doc_id long, quality int, toxic int")
    got = mixing.mix(odd, labels).collect()
    tokens = Counter((r.doc_id, r.n_tokens) for r in got)
    assert tokens == Counter((r.doc_id, len(words(r.text))) for r in odd.collect())
    assert all(abs(sum(r[f"p_{d}"] for d in mixing.DOMAINS) - 1) < 1e-9 and r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    twice = [tuple(r)[1:] for r in got if r.doc_id == 8]
    assert twice[0] == twice[1]


# ---- op6


def test_quality_order_is_by_measured_gain(spark, docs):
    """A rule that rejects much and costs little comes before one that costs much and rejects none; verdicts don't depend on the order."""
    text, own = F.col("__text"), F.col("__words")
    table = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).withColumn("__words", quality.words_of(text))
    cheap, dear = quality.Rule("many", F.length(text) > 10, F.lit(1)), quality.Rule("none", quality.n_repeat_words(own) < 0, F.lit(20))
    assert [r.name for r in quality.ordered(table, [dear, cheap])] == ["many", "none"]
    assert quality.ordered(table.limit(0), [dear, cheap]) == [dear, cheap]
    rules = quality.base_rules(own) + quality.added_rules(text, own)
    both = [table.filter(quality.first_failure(x).isNull()).count() for x in (rules, rules[::-1])]
    assert both[0] == both[1]


# ---- the pipeline


def test_pipeline_of_odd_and_empty_input(spark, odd, empty):
    """Each stage on nulls in any column, repeats, ties and clashing names; columns stay."""
    prose = " ".join(f"plain{k} words{k * 7}" for k in range(80))
    more = [(None, prose, None, None, None, None, None), (None, prose, "en", "a", 1, "x", "y"), (11, prose.upper(), None, "a", 1, None, "y"), (12, prose + " end", "en", None, 1, "x", None)]
    full = odd.unionByName(spark.createDataFrame(more, odd.schema))
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, full, DATA)
        assert stage(spark, empty, DATA).count() == 0, name
        assert kept.count() > 0, name
        if name != "encoding":
            assert kept.columns == full.columns, name
            assert not kept.exceptAll(full).count(), name
    assert corpus_pipeline.encode(spark, full, DATA).count() == 15
    good = corpus_pipeline.quality_rules(spark, full, DATA)
    assert sorted(str(r.doc_id) for r in good.collect()) == ["11", "12", "None", "None"]
    assert [r.doc_id for r in corpus_pipeline.exact_copies(spark, good, DATA).orderBy("doc_id").collect()] == [11, 12]
    assert [r.doc_id for r in corpus_pipeline.near_copies(spark, good, DATA).collect()] == [11]


def test_pipeline_against_brute_force(spark, docs):
    """Stage by stage over all documents: rules by SQL, copies by dictionaries, near copies by all pairs, ids by the library."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    good = {i for i, kept in con.execute(f"SELECT doc_id, kept FROM ({quality.ORACLES['op6_quality']})").fetchall() if kept}
    table = {r.doc_id: r.text for r in docs.collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    one = corpus_pipeline.quality_rules(spark, docs, DATA).cache()
    assert ids(one) == good
    best = {}
    for i in good:
        best[lower(table[i])] = max(i, best.get(lower(table[i]), i))
    two = corpus_pipeline.exact_copies(spark, one, DATA).cache()
    assert ids(two) == set(best.values())
    own = sorted(best.values())
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (words(table[i]) for i in own)]
    label = dict(enumerate(own))
    moved = True
    links = [(a, b) for a in range(len(own)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    three = corpus_pipeline.near_copies(spark, two, DATA).cache()
    assert ids(three) == set(label.values())
    four = corpus_pipeline.mix(spark, three, DATA).cache()
    assert ids(four) <= ids(three) and len(ids(four)) > 0.3 * len(ids(three))
    library = Tokenizer.from_file(bpe.default_vocabulary())
    five = corpus_pipeline.encode(spark, four, DATA).collect()
    assert {r.doc_id: r.ids for r in five} == {i: library.encode(table[i], add_special_tokens=False).ids for i in ids(four)}
    assert all(r.n_tokens == len(r.ids) for r in five)


def test_near_copies_of_documents(spark, docs):
    """Recall over all documents of the table: all pairs of different texts at 0.8 lose one side."""
    table = [(r.doc_id, words(r.text)) for r in docs.collect()]
    sets = [(i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))) for i, w in table if w]
    pairs = [(i, j) for a, (i, s) in enumerate(sets) for j, t in sets[:a] if s != t and len(s & t) >= 0.8 * len(s | t)]
    kept = {r.doc_id for r in near_copies.drop_near_copies(docs).select("doc_id").collect()}
    assert pairs and not [p for p in pairs if set(p) <= kept]


#: Names that operators give to columns of their own.
INNER = ["__id", "__sha", "__n", "__kid", "__ksha", "__text", "__words", "__w", "__p", "__k", "__h", "__row", "__start", "__range", "__salt", "__key", "ids", "id", "sha", "n", "fp", "run", "rid", "node", "bs", "m"]


def test_all_columns_stay_whatever_their_names_and_ids_may_be_text(spark, odd, tmp_path):
    """Each operator that gives its input back, and each stage of the pipeline."""
    named = odd.withColumns({n: F.lit(n) for n in INNER}).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    labels = spark.createDataFrame([("d1", 1, 0), ("d5", 1, 0), ("d6", 0, 0), ("d7", 0, 1)], "doc_id string, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    same = lambda out: {tuple(r[n] for n in INNER) for r in out.collect()} <= {tuple(INNER)}
    for out, gone in ((quality.judged(named), set()), (quality.word_stats(named), set()), (sharding.shard_documents(named, 3), {"size"}), (pseudonyms.pseudonymise_documents(named, "k"), set()), (mixing.thin(named, labels), set())):
        assert set(named.columns) <= set(out.columns) and same(out), out.columns
    assert sharding.shard_documents(named, 3).count() == named.count() == 11
    assert {r.doc_id for r in mixing.mix(named, labels).collect()} == {r.doc_id for r in named.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, named, str(tmp_path))
        assert out.columns == named.columns and same(out), name
    assert corpus_pipeline.STAGES[-1][1](spark, named.withColumn("text", F.lit("a b")), str(tmp_path)).count() == 11


def test_rules_come_in_the_same_order_each_time(spark, docs):
    text, words = F.col("text"), quality.words_of(quality.text_or_empty())
    rules = quality.base_rules(words) + quality.added_rules(quality.text_or_empty(), words)
    orders = {tuple(r.name for r in quality.ordered(docs.select("text"), rules)) for _ in range(3)}
    assert len(orders) == 1 and sorted(orders.pop()) == sorted(r.name for r in rules)


def test_a_session_without_a_key_has_a_random_one(spark):
    own = pseudonyms.key_of(spark)
    assert len(own) == 64 and pseudonyms.key_of(spark) == own
    spark.conf.set(pseudonyms.KEY_SETTING, "given")
    try:
        assert pseudonyms.key_of(spark) == "given"
    finally:
        spark.conf.unset(pseudonyms.KEY_SETTING)
