"""Secret scans, with credentials linked from their parts.

Base patterns report on their own. A weak part (a token that mixes cases and digits) is no finding by itself: it is
reported, as kind `linked`, only when a complementary part (an access identifier or an endpoint) lies in the same scope,
that is within SCOPE code points. Parts are rows, and an interval join over (document, cell of SCOPE code points) finds
co-occurrence; as parts don't overlap within a kind, a cell holds a bounded number of them, and no document or group is
ever gathered for it.

Places come without Python: the text is split at the matches of a pattern, and running sums over the lengths of the
pieces and matches give code-point offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.llm.common import documents, stash, text_or_empty

#: Fixed patterns: kind, pattern, group whose length counts, its least length. In the order of report; scans are leftmost and non-overlapping.
PATTERNS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("weak", r"[A-Za-z0-9+/_-]{20,}", 0, 20),
    ("endpoint", r"https?://[A-Za-z0-9.-]+", 0, 1),
]
BASE = ["assign", "access", "hex"]
SCOPE = 200  # code points between the parts of one credential, at most


def parts(text: Column) -> Column:
    """array<struct<kind, k, gap, len, found>>: each match with the code points since the one before (gap) and its own."""

    def of(kind: str, pattern: str, group: int, least: int) -> Column:
        if kind == "hex":
            pattern = r"[0-9a-f]{32,}"  # the same runs: maximal ones, of which short ones would be dropped
        if kind == "access":
            pattern = r"AKIA[A-Z0-9]{12,}"  # likewise

        def found(v: Column) -> Column:
            long_enough = F.length(v) >= least
            return long_enough & v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]") if kind == "weak" else long_enough

        gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
        # whole matches and the counted group side by side; their number is one less than that of the gaps
        whole, counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        zipped = F.zip_with(whole, counted, lambda m, v: F.struct(F.length(m).alias("len"), found(v).alias("found")))
        own = F.transform(
            F.zip_with(gaps, zipped, lambda g, m: F.struct(g.alias("gap"), m.alias("m"))),
            lambda x, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), x["gap"].alias("gap"), x["m"]["len"].alias("len"), x["m"]["found"].alias("found")),
        )
        matched = F.filter(own, lambda x: x["len"].isNotNull())  # not the last gap
        return F.when(text.rlike(pattern), matched).otherwise(F.array().cast("array<struct<kind:string,k:int,gap:int,len:int,found:boolean>>"))

    out = [of(*p) for p in PATTERNS]
    return F.concat(*out)


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, id, parts) of every row; written, so that row numbers stay and patterns run once."""
    text = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    return stash(text.select("rid", "id", parts(F.col("t")).alias("parts")), "secret-parts")


def placed(rows: DataFrame) -> DataFrame:
    """(rid, kind, start, end) of the matches that count, in code points, end exclusive."""
    before = Window.partitionBy("rid", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = rows.select("rid", F.inline("parts")).withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before))
    return each.filter("found").select("rid", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans that lie within scope of an access identifier or endpoint and outside of every assignment; kind `linked`."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / scope), F.floor(hi / scope)))
    weak = spans.filter("kind = 'weak'").select("rid", "start", "end", cells(F.col("start"), F.col("end")).alias("cell"))
    other = lambda kinds, reach: spans.filter(F.col("kind").isin(kinds)).select(F.col("rid").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"), cells(F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach).alias("c"))
    near = other(["access", "endpoint"], scope)
    held = other(["assign"], 0)
    met = lambda o, reach: (weak.rid == o.r) & (weak.cell == o.c) & (weak.start < o.e + reach) & (o.s < weak.end + reach)
    inside = weak.join(held, met(held, 0), "left_semi").select("rid", "start").distinct()
    return weak.join(near, met(near, scope), "left_semi").select("rid", "start", "end").distinct().join(inside, ["rid", "start"], "left_anti").select("rid", F.lit("linked").alias("kind"), "start", "end")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each input row: id, spans array<struct<start, rank, kind, end>> by start, then kind as listed (linked last).

    Nulls: a null text has no spans; a null id stays null. Very long texts are scanned whole; parts have no upper
    length. Ties: spans that start together are ordered by kind. Repeated rows are scanned each for itself. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    rows = scanned(docs, id_col, text_col)
    spans = placed(rows)
    ranks = F.array_position(F.lit([*BASE, "linked"]), F.col("kind")).cast("int")
    found = spans.filter(F.col("kind").isin(BASE)).select("rid", "kind", "start", "end").unionByName(linked(spans, scope))
    by_row = found.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", ranks.alias("rank"), "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return rows.select("rid", "id").join(by_row, "rid", "left").select(F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "linked")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """The same findings by SQL: ends are running sums over pieces and matches, links a join on the document."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"""SELECT rid, '{kind}' AS kind, k, end_ - length(m) AS start_, end_ FROM (
            SELECT rid, k, m, v, sum(length(p) + length(m)) OVER (PARTITION BY rid ORDER BY k) AS end_ FROM (
                SELECT rid, unnest(range(1, len(ms) + 1)) AS k, unnest(ps[1:len(ms)]) AS p, unnest(ms) AS m, unnest(vs) AS v FROM (
                    SELECT rid, string_split_regex(t, {quote(pattern)}) AS ps, regexp_extract_all(t, {quote(pattern)}, 0) AS ms, regexp_extract_all(t, {quote(pattern)}, {group}) AS vs FROM d)))
            WHERE length(v) >= {least}{" AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')" if kind == "weak" else ""}"""
        for kind, pattern, group, least in PATTERNS
    )
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        s AS ({each}),
        l AS (SELECT rid, 'linked' AS kind, start_, end_ FROM s w WHERE kind = 'weak'
            AND EXISTS (SELECT 1 FROM s o WHERE o.rid = w.rid AND o.kind IN ('access', 'endpoint') AND w.start_ < o.end_ + {SCOPE} AND o.start_ < w.end_ + {SCOPE})
            AND NOT EXISTS (SELECT 1 FROM s o WHERE o.rid = w.rid AND o.kind = 'assign' AND w.start_ < o.end_ AND o.start_ < w.end_)),
        f AS (SELECT rid, kind, start_, end_, list_position(['assign', 'access', 'hex', 'linked'], kind) AS r FROM (SELECT rid, kind, start_, end_ FROM s WHERE kind IN ('assign', 'access', 'hex') UNION ALL SELECT * FROM l)),
        g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY start_, r) FILTER (kind <> 'linked') AS base, string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY start_, r) AS spans FROM f GROUP BY rid)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g USING (rid)"""


QUERIES = {"op3_secrets": op3_secrets}
ORACLES = {"op3_secrets": _oracle()}
