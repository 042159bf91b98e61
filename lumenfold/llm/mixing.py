"""Mixing sources to target weights, with soft membership.

A naive Bayes classifier over hashed words, fitted on the labelled table, gives each document posteriors over domains.
Document rates (expected copies) are then fitted so that the expected tokens of each domain,
sum over documents of rate * tokens * posterior, match the targets in least squares with rates kept in bounds:
projected gradient steps, scaled by the Hessian over the documents that bounds don't hold. A step needs one
aggregate of as many numbers as domains squared; a document's rate follows from its posteriors and the list of steps,
so no rates are stored or exchanged between steps.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import documents, keep_rows, let, lower_ascii, stash, text_or_empty, words_of

DOMAINS = ["clean", "poor", "toxic"]
TARGETS = {"clean": 0.86, "poor": 0.12, "toxic": 0.02}  # shares of tokens
LABEL_ROWS = 20_000  # labelled rows that the classifier is fitted on, at most (the first by hash of their id)
BUCKETS, SHARPNESS = 4096, 0.25  # of hashed words; of log odds
STEPS, CLOSE = 30, 1e-3  # steps at most; the share of the token budget by which totals may be off


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, F.lit(2)).when(quality == 0, F.lit(1)).otherwise(F.lit(0))


def buckets(text: Column) -> Column:
    return F.transform(words_of(lower_ascii(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def doubles(xs) -> Column:
    """A literal array<double>, as one string that folds to a constant."""
    return F.split(F.lit(",".join(f"{x:.9g}" for x in xs)), ",").cast("array<double>")


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_rows: int = LABEL_ROWS) -> tuple[list[float], list[list[float]]]:
    """Log priors and, for each domain, log likelihoods by bucket. Labels that are null or have no document are left out, one given twice counts twice; without any, all domains are equally likely. Ids are compared as text."""
    texts = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text"))
    known = labels.select(F.col("doc_id").alias("__id"), domain(F.col("quality"), F.col("toxic")).alias("__k")).filter("__id IS NOT NULL")
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(label_rows)  # so many rows at most, so small enough to broadcast
    own = texts.join(F.broadcast(sample), F.col("id") == F.col("__id").cast("string")).select("__k", buckets(F.col("text")).alias("bs"))
    counts = np.zeros((len(DOMAINS), BUCKETS))
    rows = np.zeros(len(DOMAINS))
    found = own.select("__k", F.explode(F.concat("bs", F.array(F.lit(-1)))).alias("b")).groupBy("__k", "b").count()
    for k, b, n in found.collect():  # domains * (buckets + 1) rows at most
        if b < 0:
            rows[k] += n
        else:
            counts[k, b] += n
    likely = np.log((counts + 1) / (counts.sum(1, keepdims=True) + BUCKETS))
    return np.log((rows + 1) / (rows.sum() + len(DOMAINS))).tolist(), likely.tolist()


def posteriors(text: Column, model: tuple[list[float], list[list[float]]]) -> Column:
    """struct<n_tokens, p array<double>>: domain posteriors of a text; of an empty one, the priors."""
    priors, likely = model
    against = [doubles(np.subtract(row, likely[0])) for row in likely[1:]]

    def of(bs: Column) -> Column:
        total = lambda ws: F.aggregate(bs, F.lit(0.0), lambda a, b: a + F.get(ws, b))
        odds = [total(ws) * SHARPNESS + float(prior - priors[0]) for ws, prior in zip(against, priors[1:], strict=True)]

        def softmax(x: Column) -> Column:
            return let(F.transform(x, lambda v: F.exp(v - F.array_max(x))), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))

        return F.struct(F.size(bs).cast("long").alias("n_tokens"), let(F.array(F.lit(0.0), *odds), softmax).alias("p"))

    return let(buckets(text), of)


def rate(p: Column, steps: list[list[float]], start: float, most: float | None) -> Column:
    """A document's rate after the steps: each adds (posteriors . step) and goes back into bounds."""
    bound = (lambda r: F.least(F.greatest(r, F.lit(0.0)), F.lit(most))) if most is not None else lambda r: F.greatest(r, F.lit(0.0))
    if not steps:
        return F.lit(start)
    flat = doubles([x for s in steps for x in s])
    k = len(DOMAINS)
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), F.lit(start), lambda r, i: bound(sum((F.get(p, F.lit(j)) * F.get(flat, i * k + j) for j in range(k)), r)))


def fit_rates(members: DataFrame, targets: dict[str, float], budget: float | None = None, most: float | None = None) -> tuple[list[list[float]], float]:
    """Steps and the starting rate for members (n_tokens, p): expected domain tokens come as near to targets * budget as bounds allow.

    budget: tokens that the mix is to have; all that there are, if None. Stops within CLOSE of every target or when no step helps.
    """
    total = members.agg(F.sum("n_tokens")).first()[0] or 0
    budget = total if budget is None else budget
    want = np.array([targets[d] for d in DOMAINS]) * budget
    start = min(budget / total if total else 1.0, most if most is not None else math.inf)
    k = len(DOMAINS)

    def totals(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        r = members.withColumn("r", rate(F.col("p"), steps, start, most))
        free = (F.col("r") > 0) & (F.col("r") < most if most is not None else F.lit(True))
        p = [F.get("p", F.lit(i)) for i in range(k)]
        sums = [F.sum(F.col("r") * F.col("n_tokens") * p[i]) for i in range(k)]
        hessian = [F.sum(F.when(free, F.col("n_tokens") * p[i] * p[j]).otherwise(0.0)) for i in range(k) for j in range(k)]
        got = r.agg(*[c.alias(f"s{i}") for i, c in enumerate([*sums, *hessian])]).first()
        values = np.array([x or 0.0 for x in got])
        return values[:k], values[k:].reshape(k, k)

    steps: list[list[float]] = []
    if not total:
        return steps, start
    at, hessian = totals(steps)
    size = 1.0
    while len(steps) < STEPS and np.abs(want - at).max() > CLOSE * budget and size > 1e-3:
        step = np.linalg.solve(hessian + 1e-9 * total * np.eye(k), want - at) * size
        tried = [*steps, [float(f"{x:.9g}") for x in step]]
        after, free = totals(tried)
        if ((want - after) ** 2).sum() < ((want - at) ** 2).sum() * (1 - 1e-6):
            steps, at, hessian, size = tried, after, free, min(1.0, 2 * size)
        else:
            size /= 4
    return steps, start


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None, most: float | None = None, id_col: str = "doc_id", text_col: str = "text", label_rows: int = LABEL_ROWS) -> DataFrame:
    """One row for each input row: id, n_tokens (words), p_<domain>, rate, copies (rate rounded up or down by a hash of the id).

    Nulls: a null text has no tokens and the prior posteriors; a null id adds nothing to the hash; ids may be of any type. Very long texts are classified
    whole. Ties don't arise. Repeated rows get equal rates and copies. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    model = fit_classifier(docs, labels, id_col, text_col, label_rows)
    members = stash(docs.select(F.col(id_col).alias("id"), posteriors(text_or_empty(text_col), model).alias("m")).select("id", "m.*"), "members")
    steps, start = fit_rates(members, targets, budget, most)
    own = members.withColumn("rate", rate(F.col("p"), steps, start, most))
    draw = F.pmod(F.xxhash64("id", F.lit("copies")), F.lit(2**32)) / F.lit(float(2**32))
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).alias("copies")
    return own.select(F.col("id").alias(id_col), "n_tokens", *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", copies)


def thin(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """docs thinned to the targets, each at most once; all columns stay. The budget keeps the first domain whole, as far as its tokens go.

    Nulls: a null text has the prior posteriors and stays or goes by them; null labels are left out. Very long texts are
    classified whole. An empty table gives an empty result. Rows are told apart by id and text: those that agree in both stay or go together, one of them; rows that share an id, or have none, are drawn each for itself.
    """
    model = fit_classifier(docs, labels)
    sha = F.unhex(F.sha2(text_or_empty(), 256))
    own = docs.select("doc_id", sha.alias("sha"), posteriors(text_or_empty(), model).alias("m")).select("doc_id", "sha", "m.*")
    members = stash(own, "members")
    first = members.agg(F.sum(F.col("n_tokens") * F.get("p", F.lit(0)))).first()[0] or 0.0
    total = members.agg(F.sum("n_tokens")).first()[0] or 0
    steps, start = fit_rates(members, targets, min(first / targets[DOMAINS[0]], float(total)), 1.0)
    draw = F.pmod(F.xxhash64("doc_id", "sha", F.lit("copies")), F.lit(2**32)) / F.lit(float(2**32))
    kept = members.filter(draw < rate(F.col("p"), steps, start, 1.0)).select(F.col("doc_id").alias("id"), "sha").distinct()
    return keep_rows(docs, [("id", F.col("doc_id")), ("sha", sha)], kept)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op10_mixing": op10_mixing}
ORACLES = {}
