"""Quality rules as a short-circuit cascade: cheap rules that reject much come first.

Each rule is a Boolean column (true: the document fails), with a column that counts its work on a document: steps over
characters, words or lines. On a sample drawn from all partitions, the share that a rule rejects is its selectivity, its
mean work its cost; counts, unlike times, are the same in each run. Rules are ordered by rejection per cost, and a CASE evaluates them in that order, so a document pays for rules only up to the first that rejects it. The order
can't change a verdict, which is the conjunction of all rules; only the reported rule (the first that rejects) depends
on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import documents, fresh, let, text_or_empty, words_of

SAMPLE_ROWS, SEED = 1000, 11  # rows of the sample, about, and its seed. Verdicts don't depend on them
PASS, PATTERN, EACH, SORT = 1, 6, 8, 12  # work: a built-in pass over a character, a pattern's, a function's call for a word, a word's share of sorting


def n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def n_repeat_words(words: Column, window: int = 3) -> Column:
    """Words inside windows of `window` words that occur at least twice in the text.

    Windows are hashed to 64 bits and sorted with their places; equal neighbours mark repeated windows, and the places
    these cover are counted over the sorted starts. All in one row: no shuffle, n log n in the words of a text.
    """

    def of(ws: Column) -> Column:
        last = F.size(ws) - F.lit(window)
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        hashed = F.transform(starts, lambda k: F.xxhash64(*[F.get(ws, k + i) for i in range(window)]))
        return let(hashed, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs)))

    def covered(hs: Column) -> Column:
        keyed = F.sort_array(F.transform(hs, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        again = lambda s: lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["k"])
        return let(keyed, lambda s: covered_by(F.array_sort(F.filter(F.transform(s, again(s)), lambda k: k.isNotNull()))))

    def covered_by(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda acc, k: F.struct((acc["n"] + k + window - F.greatest(acc["end"], k)).alias("n"), (k + window).alias("end"))
        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    return let(words, of)


def word_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (columns of these names are replaced).

    Nulls: a null text counts as empty, so all numbers are 0. Very long texts are counted whole, in one row's arrays of
    words. Ties and repeated rows: each row is counted alone. An empty table gives an empty result.
    """
    text = text_or_empty(text_col)

    def of(ws: Column) -> Column:
        chars = F.aggregate(ws, F.lit(0), lambda a, w: a + F.length(w))
        return F.struct(F.size(ws).cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), n_repeat_words(ws).cast("long").alias("n_repeat_words"))

    [found] = fresh(docs, "__w")
    own = docs.withColumn(found, let(words_of(text), of))
    counts = {name: F.col(f"{found}.{name}") for name in ("n_words", "word_chars", "n_repeat_words")}
    return own.withColumns(counts | {"n_symbols": n_symbols(text).cast("long"), "n_dup_lines": n_dup_lines(text).cast("long")}).drop(found)


@dataclass(frozen=True)
class Rule:
    """fails and work are expressions over a text and its words."""

    name: str
    fails: Column
    work: Column


def base_rules(words: Column) -> list[Rule]:
    n = F.size(words)
    return [Rule("too_few_words", n < 50, F.lit(1)), Rule("repeated_words", 100 * n_repeat_words(words) > 50 * n, (EACH + SORT) * n)]


def added_rules(text: Column, words: Column) -> list[Rule]:
    """What the method adds to the base rules. Bounds are wide of anything running prose reaches."""
    n, chars = F.size(words), F.length(text)
    lines = F.size(F.split(text, "\n", -1))
    word_chars = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    return [
        Rule("symbols", n_symbols(text) > F.lit(0.25) * chars, PASS * chars),
        Rule("duplicate_lines", (lines >= 8) & (n_dup_lines(text) > F.lit(0.6) * lines), PASS * chars + F.when(lines >= 8, PASS * chars + EACH * lines).otherwise(0)),
        Rule("word_length", (word_chars < F.lit(1.5) * n) | (word_chars > F.lit(25) * n), EACH * n),
        Rule("no_letters", F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) < F.lit(0.2) * chars, PATTERN * chars),
    ]


def ordered(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejection per mean work, over a sample of about sample_rows documents of all partitions; ties by name.

    docs has the columns that the rules name. On an empty table or sample, as given.
    """
    n = docs.count()
    if not n:
        return rules
    drawn = docs.sample(fraction=min(1.0, sample_rows / n), seed=SEED).limit(4 * sample_rows)  # a sample's size varies; by far less than this
    measures = [m for r in rules for m in (F.count_if(r.fails), F.sum(r.work))]
    found = drawn.agg(*[m.alias(f"m{k}") for k, m in enumerate(measures)]).first()
    gain = {r.name: (found[2 * k] or 0) / max(found[2 * k + 1] or 0, 1) for k, r in enumerate(rules)}
    return sorted(rules, key=lambda r: (-gain[r.name], r.name))


def first_failure(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, in order; null if none does. CASE stops there."""
    out = F.when(rules[0].fails, F.lit(rules[0].name))
    for r in rules[1:]:
        out = out.when(r.fails, F.lit(r.name))
    return out


def judged(docs: DataFrame, text_col: str = "text", base: bool = True, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with rejected_by, the first rule of the cascade that the document fails, or null.

    Nulls: a null text counts as empty, and fails too_few_words. Very long texts are judged whole, in one row. Ties and
    repeated rows: each row is judged alone, so equal texts get equal verdicts. An empty table gives an empty result. A
    column named rejected_by is replaced; others stay as they are, whatever their names.
    """
    text, words = fresh(docs, "__text", "__words")
    with_words = docs.withColumn(text, text_or_empty(text_col)).withColumn(words, words_of(F.col(text)))
    rules = (base_rules(F.col(words)) if base else []) + added_rules(F.col(text), F.col(words))
    order = ordered(with_words.select(text, words), rules, sample_rows)
    return with_words.withColumn("rejected_by", first_failure(order)).drop(words, text)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects; all columns stay.

    Nulls: a null text goes, as an empty one does; null ids and other columns don't matter. Very long texts are judged
    whole. Repeated rows stay or go together. An empty table gives an empty result.
    """
    return judged(docs).filter("rejected_by IS NULL").drop("rejected_by")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = word_stats(judged(documents(spark, sf_dir).select("doc_id", "text"), base=False))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & F.col("rejected_by").isNull()
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))


QUERIES = {"op6_quality": op6_quality}
ORACLES = {
    "op6_quality": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, string_split(t, chr(10)) AS ls FROM d),
        p AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS k, unnest(list_transform(range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2])) AS g FROM w WHERE len(ws) >= 3),
        g AS (SELECT rid, k, count(*) OVER (PARTITION BY rid, g) AS c FROM p),
        r AS (SELECT rid, count(DISTINCT k + o) AS n FROM g, range(3) s(o) WHERE c > 1 GROUP BY rid),
        s AS (SELECT w.rid, doc_id, t, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
            (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
            list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS wl, len(ls) AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
            length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters
            FROM w LEFT JOIN r ON w.rid = r.rid),
        u AS (SELECT *, (len(wl) - len(list_distinct(wl)))::BIGINT AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND NOT (n_symbols > 0.25 * length(t)) AND NOT (n_lines >= 8 AND n_dup_lines > 0.6 * n_lines)
            AND NOT (word_chars < 1.5 * n_words OR word_chars > 25 * n_words) AND NOT (letters < 0.2 * length(t)) AS kept
        FROM u"""
}
