"""The library's queries, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

import math
import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import payload
from lumenfold.functions import scalars as sc
from lumenfold.plans import quality_sql
from lumenfold.operators import art, center, count_window, image_quality, normalise, raytrace, reduction, reorder, stream_checks, stripes, tiles
from lumenfold.plans.cut import cut, noted, shared_dir
from lumenfold.sources import arrays, scans
from lumenfold.sources import tables as t
from lumenfold.sources.tables import SIDE, with_views
from lumenfold.streaming import channels, finished, reconstruction, sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Q = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = re.sub(r"(, \d\)) AS (\w+)", r"\1 + 0.0::DOUBLE AS \2", sql)  # rounds to -0.0 else
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---- messages


@query(with_views("m", "SELECT itype, count(*) AS n, count(val) * 8 AS n_bytes FROM m GROUP BY itype"))
def route_counts(spark, d):
    return stream_checks.route_counts(t.messages(spark, d))


@query(with_views("m", "SELECT chan, count(*) AS received, coalesce(sum(greatest(gap, 0)), 0)::BIGINT AS lost FROM (SELECT chan, seq - lag(seq) OVER (PARTITION BY chan ORDER BY arrival) - 1 AS gap FROM m) GROUP BY chan"))
def seq_loss(spark, d):
    return stream_checks.lost(t.messages(spark, d))


@query(with_views("m", "SELECT * FROM (SELECT chan, seq, seq - min(seq) OVER (PARTITION BY chan) AS number, row_number() OVER (PARTITION BY chan ORDER BY arrival) - 1 AS place FROM m) WHERE number <> place"))
def seq_check(spark, d):
    return stream_checks.out_of_sequence(t.messages(spark, d))


_RATES = "SELECT {key}, n, n_bytes, round(seconds, 6) AS seconds, round(n / nullif(seconds, 0), 6) AS per_second, round(n_bytes / 1048576.0::DOUBLE / nullif(seconds, 0), 9) AS mib_per_second FROM (SELECT {key}, count(*) AS n, sum({size})::BIGINT AS n_bytes, (epoch_us(max({at})) - epoch_us(min({at}))) / 1000000.0::DOUBLE AS seconds FROM {table} GROUP BY {key})"


@query(_RATES.format(key="user_id", size="strlen(props)", at="ts", table="events"))
def throughput(spark, d):
    return stream_checks.rates(t.read(spark, d, "events"), "user_id", "ts", F.octet_length("props"))


@query("SELECT source, count(*) AS n, sum(strlen(text))::BIGINT AS n_bytes FROM documents GROUP BY source")
def bytes_by_source(spark, d):
    return t.read(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))


@query(with_views("m", "SELECT chan, seq, received, val, 0::BIGINT AS unique_id, 0.0::DOUBLE AS rotation FROM (SELECT *, row_number() OVER (PARTITION BY chan ORDER BY arrival) AS received FROM m) WHERE received % 5 = 0 AND itype = 1"))
def sample_every_k(spark, d):
    return stream_checks.every_kth(t.messages(spark, d), 5)


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events) WHERE n = 2")
def newest_but_one(spark, d):
    return stream_checks.newest_but_one(t.read(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts")


_BEFORE = "OVER (PARTITION BY chan ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_COUNTS = f"SELECT chan, seq, coalesce(sum((itype IN (2, 4))::INT) {_BEFORE}, 0)::BIGINT AS flats, coalesce(sum((itype IN (3, 5))::INT) {_BEFORE}, 0)::BIGINT AS darks, itype FROM m"


@query(with_views("m", f"SELECT chan, seq, flats, darks FROM ({_COUNTS}) WHERE itype = 1"))
def acquisition_counts(spark, d):
    return stream_checks.acquisition_counts(t.messages(spark, d))


@query(with_views("m", f"SELECT chan, seq, round((((0.5::DOUBLE + (seq - (flats + darks))) * 0.25::DOUBLE) % 360 + 360) % 360, 6) AS angle FROM ({_COUNTS}) WHERE itype = 1"))
def pv_angle(spark, d):
    m = stream_checks.acquisition_counts(t.messages(spark, d))
    return m.select("chan", "seq", F.round(sc.pv_angle(0.5, F.col("seq"), F.col("flats"), F.col("darks"), 0.25), 6).alias("angle"))


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://www')")
def topic_prefix(spark, d):
    return t.read(spark, d, "pages").filter(F.col("url").startswith("https://www")).select("page_id", "url")


# ---- scalars


def _odd(val: Column, k: Column) -> Column:
    """Measured values with what detectors give at times: NaN, 0, infinity, negatives, subnormals."""
    return F.when(k % 7 == 0, sc.NAN).when(k % 11 == 0, 0.0).when(k % 13 == 0, sc.INF).when(k % 17 == 0, 1e-40).otherwise(val - 20)


_ODD = "SELECT seq, CASE WHEN seq % 7 = 0 THEN 'nan'::DOUBLE WHEN seq % 11 = 0 THEN 0 WHEN seq % 13 = 0 THEN 'inf'::DOUBLE WHEN seq % 17 = 0 THEN 1e-40::DOUBLE ELSE val - 20 END AS x FROM m"


def _odd_values(spark, d):
    return t.messages(spark, d).select("seq", _odd(F.col("val"), F.col("seq")).alias("x"))


@query(with_views("m", f"SELECT seq, round(CASE WHEN isnan(x) OR x < 0 OR x = 'inf'::DOUBLE THEN 0 ELSE x END, 6) AS y FROM ({_ODD})"))
def clean_invalids(spark, d):
    return _odd_values(spark, d).select("seq", F.round(sc.remove_invalids(F.col("x")), 6).alias("y"))


@query(with_views("m", f"SELECT seq, round(CASE WHEN isnan(x) OR isinf(x) OR abs(x) < 1.17549435e-38::DOUBLE THEN 0 ELSE x END, 6) AS y FROM ({_ODD})"))
def remove_abnormal(spark, d):
    return _odd_values(spark, d).select("seq", F.round(sc.remove_abnormals(F.col("x")), 6).alias("y"))


@query(with_views("m", f"SELECT count(*) FILTER (isnan(x)) AS nans, count(*) FILTER (x < 0) AS negatives, count(*) FILTER (isnan(x) OR isinf(x) OR abs(x) < 1.17549435e-38::DOUBLE) AS abnormals FROM ({_ODD})"))
def abnormal_counts(spark, d):
    x = F.col("x")
    return _odd_values(spark, d).agg(F.count_if(F.isnan(x)).alias("nans"), F.count_if((x < 0) & ~F.isnan(x)).alias("negatives"), F.count_if(F.isnan(x) | (F.abs(x) == sc.INF) | (F.abs(x) < sc.SMALLEST_NORMAL)).alias("abnormals"))


@query(with_views("m", f"SELECT seq, CASE WHEN isnan(y) THEN 'nan' WHEN isinf(y) THEN 'inf' ELSE 'number' END AS kind, CASE WHEN isnan(y) OR isinf(y) THEN NULL ELSE round(y, 6) + 0.0::DOUBLE END AS y FROM (SELECT seq, CASE WHEN isnan(x) THEN x WHEN isinf(x) THEN '-inf'::DOUBLE WHEN x > 0 THEN -ln(x) WHEN x = 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END AS y FROM ({_ODD}))"))
def minus_log(spark, d):
    y = sc.minus_log(F.col("x"))
    finite = ~F.isnan("y") & (F.abs("y") != sc.INF)
    return _odd_values(spark, d).select("seq", y.alias("y")).select("seq", F.when(F.isnan("y"), "nan").when(F.abs("y") == sc.INF, "inf").otherwise("number").alias("kind"), F.when(finite, F.round("y", 6)).alias("y"))


@query("SELECT vec_id AS proj, round(radians(vec_id * 0.7::DOUBLE), 9) AS theta, CASE WHEN th < pi() / 2 OR (th >= pi() AND th < 3 * pi() / 2) THEN 1 ELSE 0 END AS quadrant FROM (SELECT vec_id, ((radians(vec_id * 0.7::DOUBLE) - 3) % (2 * pi()) + 2 * pi()) % (2 * pi()) AS th FROM embeddings)")
def angles(spark, d):
    theta = F.radians(F.col("proj") * F.lit(0.7))
    return t.frames(spark, d).select("proj", F.round(theta, 9).alias("theta"), sc.quadrant(theta - 3).alias("quadrant"))


_CENTER = "CASE WHEN proj % 3 = 0 THEN 0::DOUBLE WHEN proj % 3 = 1 THEN proj / 10.0::DOUBLE END"


@query(with_views("f", f"SELECT proj, CASE WHEN c > 0 THEN c ELSE 5 END::DOUBLE AS reconstruct, CASE WHEN c = 0 THEN 4 ELSE c END::DOUBLE AS distribute, coalesce(c, 4)::DOUBLE AS serialise, round(4 - coalesce(c, 4) + 1e-6::DOUBLE, 7) AS mov, round(CASE WHEN ms - floor(ms) < 0.01::DOUBLE THEN ms + 0.01::DOUBLE ELSE ms END + 0.5::DOUBLE, 6) AS mov_sequential FROM (SELECT proj, c, 3.5::DOUBLE - coalesce(c, 4) AS ms FROM (SELECT proj, {_CENTER} AS c FROM f))"))
def center_mov_grid(spark, d):
    n = F.lit(SIDE)
    c = t.frames(spark, d).select("proj", F.when(F.col("proj") % 3 == 0, 0.0).when(F.col("proj") % 3 == 1, F.col("proj") / 10.0).alias("c"))
    own = sc.center_or(F.col("c"), n, "serialise")
    return c.select("proj", *[sc.center_or(F.col("c"), n, k).alias(k) for k in ("reconstruct", "distribute", "serialise")], F.round(sc.mov(own, n), 7).alias("mov"), F.round(sc.mov_sequential(own, n), 6).alias("mov_sequential"))


def _per_pixel(name: str, value: str, pix: str = "k - 1") -> str:
    return f"SELECT proj, ({pix})::BIGINT AS pix, {value} AS {name} FROM (SELECT proj, px, list_min(px) AS lo, list_max(px) AS hi, unnest(range(1, 65)) AS k FROM f)"


@query(with_views("f", _per_pixel("y", "round((px[k] - lo) / (hi - lo) * 255, 6)")))
def minmax_byte(spark, d):
    return t.frames(spark, d).select("proj", F.posexplode(sc.min_max(F.col("px"), 255.0)).alias("pix", "y")).select("proj", F.col("pix").cast("long"), F.round("y", 6).alias("y"))


@query(with_views("f", _per_pixel("y", "floor((px[k] - lo) / (hi - lo) * 1.0::DOUBLE * 255)::INT")))
def quantise(spark, d):
    own = t.frames(spark, d).select("proj", sc.min_max(F.col("px")).alias("px"))
    return own.select("proj", F.posexplode(sc.quantised(F.col("px"))).alias("pix", "y")).select("proj", F.col("pix").cast("long"), "y")


@query(with_views("f", _per_pixel("val", "px[k]", "((k - 1) % 8) * 8 + (k - 1) // 8")))
def transpose_view(spark, d):
    return t.frames(spark, d).select("proj", F.posexplode(sc.transposed(F.col("px"), SIDE)).alias("pix", "val")).select("proj", F.col("pix").cast("long"), "val")


@query(with_views("f", "SELECT proj % 10 AS part, round(sum(c), 3) AS crossings, round(sum(c * (abs(sin(th)) + 1)), 3) AS cost FROM (SELECT proj, th, (abs(sin(th)) + abs(cos(th))) * 1048576 AS c FROM (SELECT proj, radians((proj % 180)::DOUBLE) AS th FROM f)) GROUP BY 1"))
def intersection_cost(spark, d):
    deg = (F.col("proj") % 180).cast("double")
    return t.frames(spark, d).groupBy((F.col("proj") % 10).alias("part")).agg(F.round(F.sum(sc.crossings(deg, 1024)), 3).alias("crossings"), F.round(F.sum(sc.crossing_cost(deg, 1024)), 3).alias("cost"))


@query(with_views("r", "SELECT proj, slice, col, val FROM r WHERE (col - 3.5) * (col - 3.5) + (slice - 3.5) * (slice - 3.5) <= 3.8 * 3.8"))
def circ_mask(spark, d):
    return t.rays(spark, d).filter(sc.in_circle(F.col("col"), F.col("slice"), SIDE)).select("proj", "slice", "col", "val")


@query(with_views("m", f"SELECT seq, CASE WHEN NOT isnan(x) AND NOT isinf(x) THEN round(CASE WHEN x < 0 THEN 0 ELSE x END, 6) + 0.0::DOUBLE END AS positive, CASE WHEN NOT isinf(x) THEN round(CASE WHEN isnan(x) THEN 0 ELSE x END, 6) + 0.0::DOUBLE END AS number FROM ({_ODD})"))
def clean_parts(spark, d):
    """Negatives, and NaNs, alone."""
    x = F.col("x")
    finite = ~F.isnan(x) & (F.abs(x) != sc.INF)
    positive, number = F.when(finite, sc.remove_negatives(x)), F.when(F.isnan(x) | finite, sc.remove_nans(x))
    return rounded(_odd_values(spark, d).select("seq", positive.alias("positive"), number.alias("number")), "positive", "number")


@query(with_views("f", f"SELECT proj, CASE WHEN c > 0 THEN c ELSE 5 END::DOUBLE AS own, 3::DOUBLE AS given FROM (SELECT proj, {_CENTER} AS c FROM f)"))
def center_override(spark, d):
    c = F.when(F.col("proj") % 3 == 0, 0.0).when(F.col("proj") % 3 == 1, F.col("proj") / 10.0)
    shown = lambda given: sc.center_or(sc.center_override(c, given), F.lit(SIDE), "reconstruct")
    return t.frames(spark, d).select("proj", shown(0.9).alias("own"), shown(3.7).alias("given"))


@query(with_views("f", "SELECT proj, (k - 1)::BIGINT AS pix, px[((k - 1) % 2) * 32 + ((k - 1) // 2 % 8) * 4 + (k - 1) // 16 + 1] AS ends, px[(k - 1) // 4 % 2 * 32 + (k - 1) // 8 * 4 + (k - 1) % 4 + 1] AS front FROM (SELECT *, unnest(range(1, 65)) AS k FROM f)"))
def axis_swap(spark, d):
    """Frames as volumes of 2 x 8 x 4, the outer axes swapped and the first two."""
    swapped = F.arrays_zip(sc.swapped_axes(F.col("px"), (2, 8, 4), 0, 2).alias("ends"), sc.swapped_axes(F.col("px"), (2, 8, 4), 0, 1).alias("front"))
    return t.frames(spark, d).select("proj", F.posexplode(swapped).alias("pix", "v")).select("proj", F.col("pix").cast("long"), "v.ends", "v.front")


@query(with_views("f", "SELECT proj, y * 4 + x AS pix, round(avg(v), 6) AS val FROM (SELECT proj, (k - 1) // 16 AS y, (k - 1) % 8 // 2 AS x, px[k] AS v FROM (SELECT *, unnest(range(1, 65)) AS k FROM f)) GROUP BY 1, 2"))
def downsample_half(spark, d):
    return rounded(t.frames(spark, d).select("proj", F.posexplode(sc.halved(F.col("px"), SIDE)).alias("pix", "val")).withColumn("pix", F.col("pix").cast("long")), "val")


@query(with_views("m", "SELECT chan, round(coalesce(CASE WHEN NOT (nf = 1 AND mf = 0) THEN af END, 100), 4) AS flat, round(coalesce(CASE WHEN NOT (nd = 1 AND md = 0) THEN ad END, 0.5), 4) AS dark FROM (SELECT chan, count(val) FILTER (itype IN (2, 4)) AS nf, max(val) FILTER (itype IN (2, 4)) AS mf, avg(val) FILTER (itype IN (2, 4)) AS af, count(val) FILTER (itype IN (3, 5)) AS nd, max(val) FILTER (itype IN (3, 5)) AS md, avg(val) FILTER (itype IN (3, 5)) AS ad FROM m GROUP BY chan)"))
def field_fallback(spark, d):
    return rounded(scans.flat_and_dark(t.messages(spark, d), 100.0, 0.5), "flat", "dark", digits=4)


@query("SELECT vec_id AS proj, round((radians(vec_id * 0.3::DOUBLE)::FLOAT * 180.0::DOUBLE / pi())::FLOAT, 2) AS degrees FROM embeddings")
def theta_degrees(spark, d):
    theta = F.radians(F.col("proj") * F.lit(0.3))
    return t.frames(spark, d).select("proj", F.round(scans.simulation_angle(theta), 2).alias("degrees"))


@query(with_views("f", "SELECT proj, NULL::DOUBLE AS missing, len(px) AS there FROM f"))
def missing_dataset(spark, d):
    own = t.read(spark, d, "embeddings").withColumnRenamed("vec_id", "proj")
    return own.select("proj", scans.dataset_or_null(own, "theta", "double").alias("missing"), F.size(scans.dataset_or_null(own, "embedding", "array<double>")).cast("long").alias("there"))


@query(with_views("f", "SELECT proj, (k - 1) // 8 AS y, (k - 1) % 8 AS x, px[k] AS val FROM (SELECT *, unnest(range(1, 65)) AS k FROM f)"))
def squeeze_reshape(spark, d):
    """A message's (1, y, x) image without its first axis, pixel by pixel."""
    return t.frames(spark, d).select("proj", F.posexplode("px").alias("k", "val")).select("proj", F.floor(F.col("k") / SIDE).alias("y"), (F.col("k") % SIDE).cast("long").alias("x"), "val")


@query(with_views("f", "SELECT proj, c, px[c + 1] AS val FROM f, range(8) s(c)"))
def extract_sinogram(spark, d):
    """Row 0 of every frame."""
    own = scans.extract_sinogram(t.frames(spark, d), SIDE)
    return own.select("proj", F.posexplode("px").alias("c", "val")).withColumn("c", F.col("c").cast("long"))


# ---- scans, orders, partitions


@query(with_views("r", "SELECT proj, slice, col, val FROM r WHERE slice >= 2 AND slice < 7 AND (slice - 2) % 2 = 0 AND proj >= 10"))
def row_slice(spark, d):
    return t.rays(spark, d).filter(scans.in_slice(F.col("slice"), 2, 7, 2) & (F.col("proj") >= 10)).select("proj", "slice", "col", "val")


@query("SELECT o_orderkey, greatest(ceil((stop - start) / step::DOUBLE), 0)::BIGINT AS n FROM (SELECT o_orderkey, o_orderkey % 17 AS start, o_custkey % 23 AS stop, o_orderkey % 4 + 1 AS step FROM orders)")
def slice_lengths(spark, d):
    return t.read(spark, d, "orders").select("o_orderkey", scans.slice_length(F.col("o_orderkey") % 17, F.col("o_custkey") % 23, F.col("o_orderkey") % 4 + 1).alias("n"))


@query("SELECT vec_id AS proj, round(radians(coalesce(CASE WHEN vec_id % 2 = 0 THEN vec_id * 0.3::DOUBLE END, 1 + vec_id * 0.5::DOUBLE)), 9) AS stepped, round(radians(coalesce(CASE WHEN vec_id % 2 = 0 THEN vec_id * 0.3::DOUBLE END, vec_id * 180.0::DOUBLE / (n - 1))), 9) AS even FROM embeddings, (SELECT count(*) AS n FROM embeddings)")
def theta_fallback(spark, d):
    stored = F.when(F.col("proj") % 2 == 0, F.col("proj") * 0.3)
    n = t.n_frames(spark, d)
    return t.frames(spark, d).select("proj", F.round(scans.theta_or(stored, F.col("proj"), n, 1.0, 0.5), 9).alias("stepped"), F.round(scans.theta_or(stored, F.col("proj"), n), 9).alias("even"))


@query(with_views("f", "SELECT count(*) AS n, max(proj) + 1 AS size, max(len(px)) AS width FROM f"))
def scan_metadata(spark, d):
    return t.frames(spark, d).agg(F.count(F.lit(1)).alias("n"), (F.max("proj") + 1).alias("size"), F.max(F.size("px")).cast("long").alias("width"))


_IDX = "(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders)"


def _orders(spark, d):
    own = t.read(spark, d, "orders").select("o_orderkey")
    return reorder.dense_index(own, "o_orderkey", "idx"), own.count()


@query(f"SELECT o_orderkey, idx, row_number() OVER (ORDER BY idx % ceil(n / 16.0)::BIGINT, idx) - 1 AS place FROM {_IDX}")
def ordered_subset(spark, d):
    own, n = _orders(spark, d)
    return own.select("o_orderkey", "idx", reorder.subset_place(F.col("idx"), n, -(-n // 16)).alias("place"))


@query(f"SELECT o_orderkey, idx, row_number() OVER (ORDER BY idx % 7, idx) - 1 AS place FROM {_IDX}")
def interleave_subsets(spark, d):
    own, n = _orders(spark, d)
    return own.select("o_orderkey", "idx", reorder.subset_place(F.col("idx"), n, 7).alias("place"))


@query(
    f"""WITH RECURSIVE o AS (SELECT * FROM {_IDX}), c AS (SELECT n, n / 2.0::DOUBLE AS half FROM o LIMIT 1),
    s AS (SELECT 0 AS level, half AS step FROM c UNION ALL SELECT level + 1, floor(step / 2) FROM s WHERE floor(step / 2) > 0),
    z AS (SELECT 0::DOUBLE AS x, 0 AS k UNION ALL SELECT floor(x) + half, k + 1 FROM z, c WHERE floor(x) + half < n AND k < 4)
    SELECT o_orderkey, idx, (CASE WHEN idx IN (SELECT floor(x)::BIGINT FROM z) THEN 0 ELSE (SELECT min(level) FROM s WHERE level > 0 AND idx % step::BIGINT = 0) END)::INT AS level FROM o"""
)
def interleave_halving(spark, d):
    own, n = _orders(spark, d)
    return own.select("o_orderkey", "idx", reorder.halving_level(F.col("idx"), n).alias("level"))


@query(f"SELECT o_orderkey, (CASE WHEN idx < (n // 12 + 1) * (n % 12) THEN idx // (n // 12 + 1) ELSE n % 12 + (idx - (n // 12 + 1) * (n % 12)) // (n // 12) END)::BIGINT AS block FROM {_IDX}")
def block_partition(spark, d):
    own, n = _orders(spark, d)
    return own.select("o_orderkey", reorder.block_of(F.col("idx"), n, 12).alias("block"))


@query("SELECT block, start_ AS start, size_ AS size, s_name FROM (SELECT r AS block, CASE WHEN r < n % 12 THEN (n // 12 + 1) * r ELSE (n // 12 + 1) * (n % 12) + (n // 12) * (r - n % 12) END AS start_, n // 12 + (r < n % 12)::BIGINT AS size_ FROM range(12) t(r), (SELECT count(*) AS n FROM supplier)) JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier) ON idx = start_")
def block_starts(spark, d):
    own = t.read(spark, d, "supplier").select("s_suppkey", "s_name")
    placed = reorder.dense_index(own, "s_suppkey", "idx")
    blocks = reorder.blocks_table(spark, own.count(), 12)
    return placed.join(blocks, placed.idx == blocks.start).select("block", "start", "size", "s_name")


@query(f"SELECT o_orderkey, idx, row_number() OVER (ORDER BY idx) - 1 AS file, row_number() OVER (ORDER BY idx % 5, idx) - 1 AS subsets FROM {_IDX}")
def order_parameter(spark, d):
    """Places under the order parameter 0 and 5, as ranks of one sort key."""
    own, n = _orders(spark, d)
    places = reorder.dense_index(own.withColumn("__k", reorder.place_in(F.col("idx"), n, 5)), "__k", "subsets")
    return places.select("o_orderkey", "idx", reorder.place_in(F.col("idx"), n, 0).alias("file"), "subsets")


@query(f"WITH o AS {_IDX} SELECT q.idx AS place, r.o_orderkey FROM o q JOIN o r ON r.idx = (q.idx * 7 + 3) % q.n")
def gather_permuted(spark, d):
    """Rows gathered by an index vector."""
    own, n = _orders(spark, d)
    vector = own.select(F.col("idx").alias("place"), ((F.col("idx") * 7 + 3) % n).alias("idx"))
    return reorder.gathered(own, vector).select("place", "o_orderkey")


@query("SELECT iteration, vec_id AS proj, label FROM embeddings, range(3) s(iteration)")
def scan_repeat(spark, d):
    own = t.read(spark, d, "embeddings").select(F.col("vec_id").alias("proj"), "label")
    return reorder.repeat_scan(own, 3).select(F.col("iteration").cast("long").alias("iteration"), "proj", "label")


# ---- normalisation

_FIELDS = """, g AS (SELECT *, sum((itype = 4)::INT) OVER w AS wgrp, sum((itype = 5)::INT) OVER w AS dgrp FROM m WINDOW w AS (PARTITION BY chan ORDER BY arrival ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, avg(CASE WHEN itype IN (2, 4) THEN val END) OVER (PARTITION BY chan, wgrp ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS flat, avg(CASE WHEN itype IN (3, 5) THEN val END) OVER (PARTITION BY chan, dgrp ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS dark FROM g),
o AS (SELECT chan, seq, flat, dark, CASE WHEN flat IS NULL OR dark IS NULL THEN val ELSE (val - dark) / greatest(flat - dark, 1e-6::DOUBLE) END AS x FROM h WHERE itype = 1) """


def _seven_digits(x: Column) -> Column:
    """Rounded to six decimals, or seven significant digits if larger: values over a tiny flat - dark are large, and rounding errors with them."""
    power = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(F.abs(x))).cast("double"), F.lit(0.0)))
    return F.when(x == 0, 0.0).otherwise(F.round(x / power, 6) * power + 0.0)


_DIGITS = "CASE WHEN x = 0 THEN 0::DOUBLE ELSE round(x / pow(10::DOUBLE, greatest(floor(log10(abs(x))), 0)), 6) * pow(10::DOUBLE, greatest(floor(log10(abs(x))), 0)) + 0.0::DOUBLE END"


@query(with_views("m", "").rstrip() + _FIELDS + f"SELECT chan, seq, round(flat, 9) AS flat, round(dark, 9) AS dark, {_DIGITS} AS x FROM o")
def asof_normalise(spark, d):
    own = normalise.normalised(t.messages(spark, d))
    return rounded(own.select("chan", "seq", "flat", "dark", _seven_digits(F.col("out")).alias("x")), "flat", "dark", digits=9)


@query(with_views("m", "").rstrip() + _FIELDS + "SELECT chan, seq, round(CASE WHEN y < 0 THEN 0 ELSE y END, 4) AS x FROM (SELECT chan, seq, CASE WHEN x > 0 THEN -ln(x) ELSE 0 END AS y FROM o)")
def preprocess_chain(spark, d):
    return rounded(normalise.preprocessed(t.messages(spark, d)).select("chan", "seq", F.col("out").alias("x")), "x", digits=4)


_KINDS = {0: 2, 1: 3, 5: 4, 6: 5}  # of frames, by their number modulo 11; all others are projections


@query(
    f"""WITH m AS (SELECT vec_id AS arrival, vec_id AS seq, e AS chan, {"CASE vec_id % 11 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _KINDS.items()) + " ELSE 1 END"} AS itype, val
    FROM (SELECT vec_id, unnest(range(64)) AS e, unnest(embedding::DOUBLE[]) AS val FROM embeddings))"""
    + _FIELDS
    + """, y AS (SELECT seq, chan // 2 AS pair, avg(x) AS x FROM o GROUP BY 1, 2)
    SELECT o.seq AS proj, o.chan::INT AS pix, round(CASE WHEN y.x > 0 AND y.x < 1 THEN -ln(y.x) ELSE 0 END, 4) + 0.0::DOUBLE AS x FROM o JOIN y ON y.seq = o.seq AND y.pair = o.chan // 2"""
)
def preprocess_images(spark, d):
    """The whole chain on frames, pixel by pixel: fields as of arrival, stripes of each projection (one Haar level leaves pairs their mean), -log, clean-up."""
    kind = F.lit(1)
    for k, v in _KINDS.items():
        kind = F.when(F.col("proj") % 11 == k, v).otherwise(kind)
    m = t.frames(spark, d).select(F.col("proj").alias("arrival"), F.col("proj").alias("seq"), F.posexplode("px").alias("chan", "val"), kind.alias("itype"))
    out = normalise.normalised(m).groupBy(F.col("seq").alias("proj")).agg(F.transform(F.sort_array(F.collect_list(F.struct("chan", "out"))), lambda c: c["out"]).alias("px"))
    clean = stripes.remove_stripes_of_frames(out, SIDE, levels=1, kind="haar")
    return clean.select("proj", F.posexplode("px").alias("pix", "x")).withColumn("x", F.round(sc.remove_invalids(sc.minus_log(F.col("x"))), 4))


SCAN = 32  # projections of a scan, where a query needs scans
_HAAR = f""", s AS (SELECT proj, proj // {SCAN} AS scan, (proj % {SCAN}) // 2 AS k, col // 2 AS c, CASE WHEN col % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS side, slice, col, val FROM r),
n AS (SELECT scan, count(DISTINCT k) AS m FROM s GROUP BY scan),
w AS (SELECT scan, m, d, sum((1 - exp(-pow((2 * p + 1 - m) / 2.0::DOUBLE, 2) / (2 * 1.5::DOUBLE * 1.5::DOUBLE))) * cos(2 * pi() * (p - m // 2) * d / m)) / m AS w
    FROM n, range({SCAN}) a(p), range({SCAN}) b(d) WHERE p < m AND d < m GROUP BY 1, 2, 3),
v AS (SELECT scan, slice, c, k, sum(val * side) AS v FROM s GROUP BY 1, 2, 3, 4),
z AS (SELECT v.scan, v.slice, v.c, v.k, any_value(v.v) AS v, sum(o.v * w.w) AS damped
    FROM v JOIN v o ON o.scan = v.scan AND o.slice = v.slice AND o.c = v.c JOIN w ON w.scan = v.scan AND w.d = (v.k - o.k + w.m) % w.m GROUP BY 1, 2, 3, 4) """


def _scans(spark, d):
    return t.rays(spark, d).select(F.floor(F.col("proj") / SCAN).cast("long").alias("scan"), "proj", "slice", "col", "val")


@query(with_views("r", "").rstrip() + _HAAR + "SELECT proj, slice, col, round(val + (damped - v) * side, 6) AS val FROM s JOIN z USING (scan, slice, c, k)")
def stripe_removal(spark, d):
    """One Haar level, its vertical details as one sum over pairs of projections in the SQL."""
    clean = stripes.remove_stripes(_scans(spark, d), ["scan", "slice"], levels=1, kind="haar", sigma=1.5, pad=False)
    return rounded(clean.drop("scan"), "val")


@query()
def stripe_removal_deep(spark, d):
    """Seven levels of the long symmetric filter, padded, as an acquisition runs it."""
    return rounded(stripes.remove_stripes(_scans(spark, d), ["scan", "slice"]).drop("scan"), "val")


def _scans_with_angles(spark, d):
    """Scans of half a turn each."""
    theta = (F.col("proj") % SCAN) * F.lit(math.pi / SCAN)
    return _scans(spark, d).select("scan", "proj", theta.alias("theta"), "slice", "col", "val")


@query()
def find_centers(spark, d):
    """The rotation center of every slice of every scan, to a quarter of a column."""
    return rounded(center.find_centers(_scans_with_angles(spark, d), ["scan", "slice"], reach=2.0, step=1.0, tolerance=0.25), "score")


# ---- windows

_PASSES = "SELECT p AS pass, greatest(0, (least(p, ff - 1) + 1) * 8 - 32) + greatest(p - (ff - 1), 0) * 8 AS lo, least((p + 1) * 8, n) AS hi FROM (SELECT count(*) AS n, ceil(count(*) / 8.0)::BIGINT AS ff FROM embeddings), range(100000) s(p) WHERE p < ff + 4"


def _windows(spark, d):
    return count_window.passes(spark, t.n_frames(spark, d), 32, 8)


@query(with_views("f", f"SELECT pass, lo, hi, proj FROM ({_PASSES}) JOIN f ON proj >= lo AND proj < hi"))
def count_window_members(spark, d):
    return count_window.members(_windows(spark, d), t.frames(spark, d).select("proj")).join(_windows(spark, d), "pass").select("pass", "lo", "hi", "proj")


@query(with_views("f", f"SELECT pass, count(*) AS n, round(arg_max(px[1], proj), 6) AS center FROM ({_PASSES}) JOIN f ON proj >= lo AND proj < hi GROUP BY pass"))
def count_window_center(spark, d):
    own = t.frames(spark, d).select("proj", F.get("px", F.lit(0)).alias("center"))
    return count_window.members(_windows(spark, d), own).groupBy("pass").agg(F.count(F.lit(1)).alias("n"), F.round(F.max_by("center", "proj"), 6).alias("center"))


def _state_machine(counts: str, length: int, step: int) -> str:
    """Passes of a count window over streams of n members (counts: key, n), one after the other."""
    cut_, pulled = f"greatest(lo, hi - {length})", f"least({step}, n - hi)"
    full = f"n = hi OR hi - {cut_} >= {length}"
    return f"""SELECT key, n, -1::BIGINT AS pass, 0::BIGINT AS lo, 0::BIGINT AS hi FROM ({counts})
        UNION ALL SELECT key, n, pass + 1, CASE WHEN {full} THEN least(hi, {cut_} + {step}) ELSE {cut_} END, hi + {pulled}
        FROM s WHERE NOT (n = hi AND {cut_} + {step} >= hi)"""


@query(f"WITH RECURSIVE s AS ({_state_machine('SELECT 0 AS key, count(*) AS n FROM embeddings', 32, 12)}) SELECT pass, hi - lo AS n, lo, hi - 1 AS hi FROM s WHERE pass >= 0 AND lo < hi")
def count_window_general(spark, d):
    """A step that doesn't divide the length."""
    windows = count_window.passes(spark, t.n_frames(spark, d), 32, 12)
    held = count_window.members(windows, t.read(spark, d, "embeddings").select(F.col("vec_id").alias("proj"), "label"))
    return held.groupBy("pass").agg(F.count(F.lit(1)).alias("n"), F.min("proj").alias("lo"), F.max("proj").alias("hi"))


def _stream_sql(length: int, step: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT user_id AS chan, event_id AS seq, value AS val, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS k FROM events),
        s AS ({_state_machine("SELECT chan AS key, count(*) AS n FROM e GROUP BY chan", length, step)})
        SELECT chan, pass, count(*)::INT AS n, arg_min(seq, k) AS first_seq, arg_max(seq, k) AS last_seq, round(sum(val), 6) AS total
        FROM s JOIN e ON e.chan = s.key AND k >= lo AND k < hi WHERE pass >= 0 GROUP BY 1, 2"""


def _live(spark, d, parts: int = 4):
    return sources.message_stream(t.messages(spark, d), parts)


@query(_stream_sql(4, 2))
def stream_window(spark, d):
    """Feeding passes and, from the end message on, the drain."""
    return rounded(sources.replayed(channels.count_windows(_live(spark, d, 2), 4, 2, raw=True)), "total")


@query(_stream_sql(5, 3))
def stream_window_general(spark, d):
    return rounded(sources.replayed(channels.count_windows(_live(spark, d, 2), 5, 3, raw=True)), "total")


@query(
    with_views("m", "").rstrip()
    + _FIELDS
    + f""", c AS (SELECT chan, seq, sum((itype IN (2, 4))::INT) OVER w AS flats, sum((itype IN (3, 5))::INT) OVER w AS darks, row_number() OVER w AS received, sum(greatest(gap, 0)) OVER w AS lost
    FROM (SELECT *, coalesce(seq - lag(seq) OVER (PARTITION BY chan ORDER BY arrival) - 1, 0) AS gap FROM m) WINDOW w AS (PARTITION BY chan ORDER BY arrival ROWS UNBOUNDED PRECEDING))
    SELECT chan, seq, round(flat, 9) AS flat, round(dark, 9) AS dark, {_DIGITS} AS x, flats::BIGINT AS flats, darks::BIGINT AS darks, received, lost::BIGINT AS lost FROM o JOIN c USING (chan, seq)"""
)
def live_normalise(spark, d):
    """Fields, normalisation and counters kept as state, over several micro-batches."""
    own = sources.replayed(channels.normalised(_live(spark, d)))
    return rounded(own.select("chan", "seq", "flat", "dark", _seven_digits(F.col("out")).alias("x"), "flats", "darks", "received", "lost"), "flat", "dark", digits=9)


def _live_windows_sql(length: int, step: int) -> str:
    """Windows over normalised projections; the length of a pass is that of the last control message before the member that completes it."""
    cut_, pulled = "greatest(lo, hi - len)", f"least({step}, n - hi)"
    return (
        with_views("m", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
        + _FIELDS
        + f""", e AS (SELECT chan, seq, x AS val, row_number() OVER (PARTITION BY chan ORDER BY arrival) - 1 AS k, arrival FROM o JOIN m USING (chan, seq)),
        l AS (SELECT chan, arrival, (seq % 5 + 2)::INT AS len FROM m WHERE itype = 5),
        z AS (SELECT chan, k, (SELECT arg_max(len, arrival) FROM l WHERE l.chan = e.chan AND l.arrival < e.arrival) AS len FROM e),
        n AS (SELECT chan, count(*) AS n, (SELECT arg_max(len, arrival) FROM l WHERE l.chan = e.chan) AS final FROM e GROUP BY chan),
        p AS (SELECT chan, n, p - 1 AS pass, coalesce(CASE WHEN p * {step} <= n THEN (SELECT len FROM z WHERE z.chan = n.chan AND z.k = p * {step} - 1) ELSE final END, {length}) AS len FROM n, range(1, 100000) r(p) WHERE p <= ceil(n / {step}) + 8),
        s AS (SELECT chan, n, -1::BIGINT AS pass, 0::BIGINT AS lo, 0::BIGINT AS hi FROM n
            UNION ALL SELECT s.chan, s.n, s.pass + 1, CASE WHEN s.n = hi OR hi - {cut_} >= len THEN least(hi, {cut_} + {step}) ELSE {cut_} END, hi + least({step}, s.n - hi)
            FROM s JOIN p ON p.chan = s.chan AND p.pass = s.pass + 1 WHERE NOT (s.n = hi AND {cut_} + {step} >= hi))
        SELECT chan, pass, n, first_seq, last_seq, {_DIGITS} AS total FROM (SELECT chan, pass, count(*)::INT AS n, arg_min(seq, k) AS first_seq, arg_max(seq, k) AS last_seq, sum(val) AS x
            FROM s JOIN e USING (chan) WHERE k >= lo AND k < hi AND pass >= 0 GROUP BY 1, 2)"""
    )


@query(_live_windows_sql(4, 2))
def live_windows(spark, d):
    """Normalised projections through windows whose length control messages change, until the end messages drain them."""
    m = t.messages(spark, d)
    control = m.filter("itype = 5").select("arrival", F.lit(0).cast("bigint").alias("seq"), "chan", F.lit(sources.LENGTH).alias("itype"), (F.col("seq") % 5 + 2).cast("double").alias("val"))
    own = sources.replayed(channels.count_windows(sources.message_stream(m.unionByName(control)), 4, 2))
    return own.select("chan", "pass", "n", "first_seq", "last_seq", _seven_digits(F.col("total")).alias("total"))


# ---- ray tracing and reconstruction

def _system_sql(shift: str = "1e-6::DOUBLE", source: str = "SELECT DISTINCT proj, theta, col FROM r", margin: float | None = None, by_column: bool = False) -> str:
    """CTEs ray, l, g, pt, nx, sys (proj, theta, col, seg, pix, leng) and nrm after one named r."""
    inside = "{0} > -4 AND {0} < 4" if margin is None else f"{{0}} >= {margin - 4}::DOUBLE AND {{0}} <= {4 - margin}::DOUBLE"
    x, y = "(g - sy) / slope + sx", "slope * (g - sx) + sy"
    px, py = "floor((x + x1) / 2 + 4)", "floor((y + y1) / 2 + 4)"
    pix = f"{py} + 8 * {px}" if by_column else f"{px} + 8 * {py}"
    return f""", ray AS ({source}),
l AS (SELECT proj, theta, col, -16 * cos(theta) - y * sin(theta) AS sx, -16 * sin(theta) + y * cos(theta) AS sy, sin(theta) / cos(theta) AS slope
  FROM (SELECT *, -3.5::DOUBLE + {shift} + col AS y FROM ray)),
g AS (SELECT (k - 4)::DOUBLE AS g FROM range(9) s(k)),
pt AS (SELECT proj, theta, col, {x} AS x, 1 AS kind, g AS y FROM l, g WHERE slope <> 0 AND {inside.format(x)}
  UNION ALL SELECT proj, theta, col, g, 0, {y} FROM l, g WHERE {inside.format(y)}),
nx AS (SELECT proj, theta, col, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, row_number() OVER w - 1 AS seg
  FROM pt WINDOW w AS (PARTITION BY proj, col ORDER BY x, kind, y)),
sys AS (SELECT proj, theta, col, seg::INT AS seg, ({pix})::INT AS pix, sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) AS leng
  FROM nx WHERE x1 IS NOT NULL AND {pix} < 64),
nrm AS (SELECT proj, col, sum(leng * leng) AS nrm FROM sys GROUP BY 1, 2) """


_R0 = with_views("r", "").rstrip()
_R = _R0 + _system_sql()


def _system(spark, d):
    return raytrace.segments(t.rays(spark, d).select("proj", "theta", "col").distinct(), SIDE)


@query(_R + "SELECT proj, col, seg, pix, round(leng, 6) AS leng FROM sys")
def ray_segments(spark, d):
    return rounded(_system(spark, d).select("proj", "col", "seg", "pix", "leng"), "leng")


@query(_R + "SELECT proj, col, round(nrm, 6) AS nrm FROM nrm")
def ray_norms(spark, d):
    return rounded(raytrace.ray_norms(_system(spark, d)), "nrm")


@query(_R + "SELECT pix, round(sum(leng), 4) AS den, count(*) AS n FROM sys GROUP BY pix")
def pixel_coverage(spark, d):
    return rounded(raytrace.coverage(_system(spark, d)), "den", digits=4)


def _volume(system: DataFrame) -> DataFrame:
    """Projections in groups of SIDE, each along the rays of a volume of its own."""
    return system.withColumn("vol", F.floor(F.col("proj") / SIDE).cast("long"))


def _image(spark, d):
    """(vol, slice, pix, val): SIDE frames after one another are the slices of one volume."""
    frames = t.frames(spark, d).select(F.col("proj"), F.posexplode("px").alias("pix", "val"))
    return frames.select(F.floor(F.col("proj") / SIDE).cast("long").alias("vol"), (F.col("proj") % SIDE).cast("int").alias("slice"), "pix", "val")


_IMG = f""", img AS (SELECT proj // 8 AS vol, (proj % 8)::INT AS slice, (k - 1)::INT AS pix, px[k] AS val
FROM (SELECT vec_id AS proj, embedding::DOUBLE[] AS px, unnest(range(1, 65)) AS k FROM embeddings)) """
_SEEN = "SELECT proj, slice, col, round(sum({} * leng), 6) AS sim FROM sys JOIN img ON img.vol = sys.proj // 8 AND img.pix = sys.pix GROUP BY 1, 2, 3"


@query(_R + _IMG + _SEEN.format("val"))
def forward_project(spark, d):
    return rounded(raytrace.forward(_volume(_system(spark, d)), _image(spark, d), "vol").drop("vol"), "sim")


@query(_R + _IMG + _SEEN.format("(val * cos(theta) + val * val * sin(theta))"))
def vector_project(spark, d):
    image = _image(spark, d).select("vol", "slice", "pix", F.col("val").alias("mx"), (F.col("val") * F.col("val")).alias("my"))
    return rounded(art.vector_forward(_volume(_system(spark, d)), image, "vol").drop("vol"), "sim")


_VOL3 = """, img AS (SELECT vol, {place}::INT AS slice, ({column} + 8 * {row})::INT AS pix, {first} AS mx, {second} AS my FROM (SELECT proj // 8 AS vol, proj % 8 AS z,
(k - 1) // 8 AS y, (k - 1) % 8 AS x, px[k] AS mx, px[k] * px[k] AS my, 1 - px[k] AS mz
FROM (SELECT vec_id AS proj, embedding::DOUBLE[] AS px, unnest(range(1, 65)) AS k FROM embeddings))) """
_ART_SQL = _R0 + _system_sql("0.0::DOUBLE", margin=0.01, by_column=True)
_AXES = {1: dict(place="x", row="y", column="z", first="my", second="mz"), 2: dict(place="y", row="x", column="z", first="mx", second="mz")}


def _three(spark, d, axis: int):
    """The three-component model along the sequential solver's rays, across one axis."""
    px = F.col("val")
    cells = _image(spark, d).select("vol", F.col("slice").alias("z"), F.floor(F.col("pix") / SIDE).cast("int").alias("y"), (F.col("pix") % SIDE).alias("x"), px.alias("mx"), (px * px).alias("my"), (1 - px).alias("mz"))
    system = art.art_segments(t.rays(spark, d).select("proj", "theta", "col").distinct(), SIDE)
    return rounded(art.vector_forward(_volume(system), art.volume_as_slices(cells, SIDE, axis), "vol").drop("vol"), "sim")


_SEEN3 = _SEEN.format("(mx * cos(theta) + my * sin(theta))")


@query(_ART_SQL + _VOL3.format(**_AXES[1]) + _SEEN3)
def vector3_axis1(spark, d):
    return _three(spark, d, 1)


@query(_ART_SQL + _VOL3.format(**_AXES[2]) + _SEEN3)
def vector3_axis2(spark, d):
    return _three(spark, d, 2)


@query(_R0 + _system_sql("0.3::DOUBLE + 0.5 - 0.5", margin=0.01, by_column=True) + "SELECT proj, col, seg, pix, round(leng, 6) AS leng FROM sys")
def art_ray_segments(spark, d):
    """The sequential solver's rays about a center of 3.7: shift -0.2 less its floor is 0.8, so + 0.5; margin 0.01."""
    system = art.art_segments(t.rays(spark, d).select("proj", "theta", "col").distinct(), SIDE, 3.7)
    return rounded(system.select("proj", "col", "seg", "pix", "leng"), "leng")


_PASS1 = ", u1 AS (SELECT r.proj, slice, r.col, val / nrm AS upd FROM r JOIN nrm ON r.proj = nrm.proj AND r.col = nrm.col), i1 AS (SELECT slice, pix, coalesce(sum(leng * upd) / nullif(sum(leng), 0), 0) AS val FROM sys JOIN u1 ON sys.proj = u1.proj AND sys.col = u1.col GROUP BY 1, 2) "


@query(_R + _PASS1 + "SELECT slice, pix, round(val, 6) AS val FROM i1")
def sirt_one_pass(spark, d):
    return rounded(raytrace.sirt(t.rays(spark, d), SIDE), "val")


_TWO = _R + _PASS1 + ", f1 AS (SELECT proj, slice, col, sum(val * leng) AS sim FROM sys JOIN i1 USING (pix) GROUP BY 1, 2, 3), u2 AS (SELECT r.proj, r.slice, r.col, (val - coalesce(sim, 0)) / nrm AS upd FROM r JOIN nrm ON r.proj = nrm.proj AND r.col = nrm.col LEFT JOIN f1 ON f1.proj = r.proj AND f1.slice = r.slice AND f1.col = r.col), i2 AS (SELECT slice, pix, coalesce(sum(leng * upd) / nullif(sum(leng), 0), 0) AS change FROM sys JOIN u2 ON sys.proj = u2.proj AND sys.col = u2.col GROUP BY 1, 2) SELECT slice, pix, round(coalesce(val, 0) + coalesce(change, 0), 6) AS val FROM i1 FULL JOIN i2 USING (slice, pix)"


@query(_TWO)
def sirt_two_iter(spark, d):
    return rounded(raytrace.sirt(t.rays(spark, d), SIDE, 2), "val")


@query(_TWO)
def sirt_tiled(spark, d):
    """The same on dense tiles: partial images are exchanged, not segments."""
    return rounded(tiles.sirt(t.rays(spark, d), SIDE, 2), "val")


_CENTERED = "SELECT DISTINCT proj, theta, col, CASE WHEN proj % 4 = 0 THEN 0 ELSE 3.5::DOUBLE + (proj % 4) * 0.25 END AS c FROM r"
_MOVED = "(4 - CASE WHEN c > 0 THEN c ELSE 5 END + 1e-6::DOUBLE)"


def _centered(spark, d):
    """Rays with a center each; 0 stands for unknown."""
    return t.rays(spark, d).withColumn("center", F.when(F.col("proj") % 4 == 0, 0.0).otherwise(3.5 + (F.col("proj") % 4) * 0.25))


@query(_R0 + _system_sql(_MOVED, _CENTERED) + _PASS1 + "SELECT slice, pix, round(val, 6) AS val FROM i1")
def sirt_own_centers(spark, d):
    return rounded(raytrace.sirt(_centered(spark, d), SIDE), "val")


@query(_R0 + _system_sql("(4 - 3 + 1e-6::DOUBLE)") + _PASS1 + "SELECT slice, pix, round(val, 6) AS val FROM i1")
def sirt_given_center(spark, d):
    """A center given for the run replaces all others; its fraction is cut off."""
    return rounded(raytrace.sirt(_centered(spark, d), SIDE, center=3.8), "val")


@query()
def sirt_windowed(spark, d):
    """All frames through windows of 32 that slide by 4, every eighth image published."""
    return rounded(raytrace.sirt_windowed(t.rays(spark, d), SIDE, 32, 4, emit_every=8), "val")


@query()
def sirt_live(spark, d):
    """The same as a stream of frames: images and windows are state, and published as they come."""
    frames = t.frames(spark, d).select("proj", t.angle(F.col("proj"), t.n_frames(spark, d)).alias("theta"), F.lit(None).cast("double").alias("center"), "px")
    return rounded(reconstruction.reconstructed(frames, SIDE, SIDE, length=32, step=4, emit_every=8), "val")


@query()
def art_slices(spark, d):
    return rounded(art.art(t.rays(spark, d), SIDE), "val")


@query()
def art_restart(spark, d):
    """Once more over all rays from the image of the first pass, as from a checkpoint."""
    first = cut(art.art(t.rays(spark, d), SIDE))
    return rounded(art.art(t.rays(spark, d), SIDE, 1, first), "val")


@query(with_views("r", "SELECT proj, slice, col, val FROM r WHERE slice >= 3 AND slice < 3 + 4"))
def slice_block(spark, d):
    return scans.row_range(t.rays(spark, d), "slice", 3, 4, SIDE).select("proj", "slice", "col", "val")


@query(with_views("f", "SELECT proj // 8 AS pass, 0 AS seq, 0::FLOAT AS center, 0::TINYINT AS itype, count(*)::INT AS z, 8 AS y, 8 AS x, (count(*) * 256)::INT AS n_bytes, round(sum(list_sum(px)), 3) AS total FROM f GROUP BY proj // 8"))
def volume_message(spark, d):
    """Volumes as the messages that publish them."""
    image = _image(spark, d).withColumnRenamed("vol", "pass")
    own = scans.volume_messages(image, SIDE).withColumn("px", payload.decoded(F.col("tdata"), "float32").cast("array<double>"))
    total = F.aggregate("px", F.lit(0.0), lambda s, v: s + v)
    return own.select("pass", "seq", "center", "itype", "dims.z", "dims.y", "dims.x", F.octet_length("tdata").alias("n_bytes"), F.round(total, 3).alias("total"))


@query(with_views("f", "SELECT proj // 8 AS pass, (proj % 8 // 2)::INT AS seq, 0::TINYINT AS itype, count(*)::INT AS z, 8 AS y, 8 AS x, (count(*) * 256)::INT AS n_bytes, round(sum(list_sum(px)), 3) AS total FROM f GROUP BY 1, 2"))
def volume_blocks(spark, d):
    """Volumes as messages of two slices each."""
    own = scans.volume_messages(_image(spark, d).withColumnRenamed("vol", "pass"), SIDE, 2).withColumn("px", payload.decoded(F.col("tdata"), "float32").cast("array<double>"))
    total = F.aggregate("px", F.lit(0.0), lambda s, v: s + v)
    return own.select("pass", "seq", "itype", "dims.z", "dims.y", "dims.x", F.octet_length("tdata").alias("n_bytes"), F.round(total, 3).alias("total"))


# ---- array files and stored images


def _stored(spark, name: str) -> str:
    """A path of its own in the shared folder, as tasks that write arrays name it."""
    return noted(spark, f"{shared_dir(spark).removeprefix('file://')}/{name}-{uuid.uuid4().hex}")


@query(with_views("r", "SELECT proj, slice, col, val::FLOAT AS val, round((proj * 0.5::DOUBLE)::FLOAT, 3) AS theta FROM r WHERE slice >= 2 AND slice < 5 AND proj >= 7"))
def array_block(spark, d):
    """All frames as one array file, written by slices at their offsets; of it a block of slices and projections."""
    n, path = t.n_frames(spark, d), _stored(spark, "array")
    rows = t.frames(spark, d).select("proj", F.posexplode(F.expr(f"transform(sequence(0, {SIDE - 1}), s -> slice(px, s * {SIDE} + 1, {SIDE}))")).alias("slice", "px"))
    arrays.write_array(rows.select("proj", "slice", (F.col("proj") * 0.5).cast("float").alias("theta"), F.col("px").cast("array<float>").alias("px")), path, n, SIDE, SIDE)
    own = arrays.read_arrays(spark, path).filter((F.col("slice") >= 2) & (F.col("slice") < 5) & (F.col("proj") >= 7))
    return own.select("proj", "slice", F.posexplode("px").alias("col", "val"), F.round("theta", 3).alias("theta"))


@query(with_views("r", "SELECT proj // 3 AS proj, slice, col, val::FLOAT AS val FROM r WHERE proj % 3 < 2"))
def finished_files(spark, d):
    """Three array files, one after the other, in a folder that is watched: the newest is held back."""
    n, folder = t.n_frames(spark, d), _stored(spark, "watched")
    rows = t.frames(spark, d).select("proj", F.posexplode(F.expr(f"transform(sequence(0, {SIDE - 1}), s -> slice(px, s * {SIDE} + 1, {SIDE}))")).alias("slice", "px"))
    own = rows.select("proj", "slice", F.lit(0.0).cast("float").alias("theta"), F.col("px").cast("array<float>").alias("px"))
    os.makedirs(folder)
    for k in range(3):
        part = own.filter(F.col("proj") % 3 == k).withColumn("proj", F.floor(F.col("proj") / 3).cast("long"))
        arrays.write_array(part, f"{folder}/{k}.data", (n - k + 2) // 3, SIDE, SIDE)
    out = sources.replayed(finished.finished_arrays(spark, folder))
    return out.select("proj", "slice", F.posexplode("px").alias("col", "val"))


@query(with_views("f", "SELECT proj::BIGINT AS slice, (k - 1)::INT AS pix, px[k]::FLOAT::DOUBLE AS val FROM (SELECT *, unnest(range(1, 65)) AS k FROM f) WHERE proj >= 3 AND proj < 3 + 40"))
def checkpoint_slices(spark, d):
    """Images stored as the solver stores them, and the slices that a restart takes."""
    image = t.frames(spark, d).select(F.col("proj").alias("slice"), F.posexplode("px").alias("pix", "val"))
    folder = scans.write_iterations(image, noted(spark, f"{shared_dir(spark)}/checkpoint-{uuid.uuid4().hex}"), 1, restarted=True)
    return scans.read_checkpoint(spark, folder, 3, 40)


@query("SELECT vec_id AS proj, round(radians(vec_id * 0.3::DOUBLE), 9) AS theta FROM embeddings")
def stored_angles(spark, d):
    """Angles read from a column of the scan."""
    own = t.read(spark, d, "embeddings").select(F.col("vec_id").alias("proj"), F.radians(F.col("vec_id") * 0.3).alias("angle"))
    return scans.read_theta(own, "angle").select("proj", F.round("theta", 9).alias("theta"))


# ---- image quality, reductions, payloads

_MM = ", s AS (SELECT pair, list_transform(a, lambda v: (v - list_min(a)) / (list_max(a) - list_min(a))) AS a, list_transform(b, lambda v: (v - list_min(b)) / (list_max(b) - list_min(b))) AS b FROM p), px AS (SELECT pair, unnest(a) AS a, unnest(b) AS b FROM s) "


@query(with_views("p", "").rstrip() + _MM + "SELECT pair, round(mse, 6) AS mse, CASE WHEN m8 > 0 THEN round(10 * log10(65025 / m8), 6) END AS psnr FROM (SELECT pair, avg((a - b) * (a - b)) AS mse, avg((floor(a * 255) - floor(b * 255)) * (floor(a * 255) - floor(b * 255))) AS m8 FROM px GROUP BY pair)")
def mse_psnr(spark, d):
    return rounded(image_quality.mse_psnr(t.pairs(spark, d)), "mse", "psnr")


@query(with_views("p", "SELECT pair, round(corr(a, b), 6) AS pcc FROM (SELECT pair, unnest(a) AS a, unnest(b) AS b FROM p) GROUP BY pair"))
def pearson(spark, d):
    return rounded(image_quality.pearson(t.pairs(spark, d)), "pcc")


@query(with_views("p", "SELECT pair, round(corr(a[k], b[k]), 6) AS pcc FROM (SELECT *, unnest(range(1, 65)) AS k FROM p) WHERE ((k - 1) % 8 - 3.5) * ((k - 1) % 8 - 3.5) + ((k - 1) // 8 - 3.5) * ((k - 1) // 8 - 3.5) <= 3.8 * 3.8 GROUP BY pair"))
def pearson_masked(spark, d):
    inside = sc.in_circle(F.col("pix") % SIDE, F.floor(F.col("pix") / SIDE), SIDE)
    return rounded(image_quality.pearson(t.pairs(spark, d), inside), "pcc")


@query(with_views("p", ", px AS (SELECT pair, ((k - 1) % 8) AS x, ((k - 1) // 8) AS y, a[k] AS a, b[k] AS b FROM (SELECT *, unnest(range(1, 65)) AS k FROM p)), s AS (SELECT pair, ty, tx, sum(a) AS sa, sum(b) AS sb, sum(a * b) AS sab, sum(a * a) AS saa, sum(b * b) AS sbb FROM px, range(5) q(ty), range(5) w(tx) WHERE y >= ty AND y < ty + 4 AND x >= tx AND x < tx + 4 GROUP BY 1, 2, 3) SELECT pair, round(avg(CASE WHEN (16 * (saa + sbb) - sa * sa - sb * sb) * (sa * sa + sb * sb) <> 0 THEN 4 * (16 * sab - sa * sb) * sa * sb / ((16 * (saa + sbb) - sa * sa - sb * sb) * (sa * sa + sb * sb)) WHEN sa * sa + sb * sb <> 0 THEN 2 * sa * sb / (sa * sa + sb * sb) ELSE 1 END), 5) AS uqi FROM s GROUP BY pair").replace(") ,", "),"))
def uqi(spark, d):
    return rounded(image_quality.uqi(t.pairs(spark, d), SIDE), "uqi", digits=5)


_KERNEL = ",".join(f"({a},{b},{x!r}::DOUBLE)" for a, b, x in image_quality.blur_table(SIDE, image_quality.SIGMA))


@query(with_views("p", f", k(src, dst, w) AS (VALUES {_KERNEL}), px AS (SELECT pair, (k - 1) % 8 AS x, (k - 1) // 8 AS y, a[k] AS a, b[k] AS b FROM (SELECT *, unnest(range(1, 65)) AS k FROM p)), m AS (SELECT pair, h.dst AS x, v.dst AS y, sum(a * h.w * v.w) AS a, sum(b * h.w * v.w) AS b, sum(a * a * h.w * v.w) AS aa, sum(b * b * h.w * v.w) AS bb, sum(a * b * h.w * v.w) AS ab FROM px JOIN k h ON h.src = px.x JOIN k v ON v.src = px.y GROUP BY 1, 2, 3), q AS (SELECT pair, a, b, ab - a * b AS cov, greatest(aa - a * a, 0) AS va, greatest(bb - b * b, 0) AS vb FROM m), z AS (SELECT *, sqrt(va) * sqrt(vb) AS sd FROM q) SELECT pair, round(avg(least(greatest(pow((2 * a * b + 1e-4::DOUBLE) / (a * a + b * b + 1e-4::DOUBLE), 4) * pow(((2 * sd + 9e-4::DOUBLE) / (va + vb + 9e-4::DOUBLE)) * ((cov + 4.5e-4::DOUBLE) / (sd + 4.5e-4::DOUBLE)), 4), -1), 1)), 5) AS ssim FROM z GROUP BY pair").replace(") ,", "),"))
def ssim(spark, d):
    return rounded(image_quality.ssim(t.pairs(spark, d), SIDE), "ssim", digits=5)


@query(quality_sql.msssim())
def msssim(spark, d):
    return rounded(image_quality.quality(t.pairs(spark, d), SIDE, "MSSSIM", 2).select("pair", "value"), "value", digits=5)


@query(quality_sql.vifp())
def vifp(spark, d):
    return rounded(image_quality.quality(t.pairs(spark, d), SIDE, "VIFp", 2).select("pair", "level", "scale", "value"), "value")


@query("SELECT v.vec_id AS pair, round(avg((x.a - x.b) * (x.a - x.b)), 8) AS mse FROM embeddings v, LATERAL (SELECT unnest(v.embedding::DOUBLE[]) AS a, unnest((SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id DESC LIMIT 1)) AS b) x GROUP BY 1")
def many_against_last(spark, d):
    one = t.frames(spark, d).withColumn("ref", F.lit(0))
    last = one.groupBy("ref").agg(F.max_by("px", "proj").alias("last"))  # one row: the reference image
    squares = F.zip_with("px", "last", lambda x, y: (x - y) * (x - y))
    return one.join(F.broadcast(last), "ref").select(F.col("proj").alias("pair"), F.round(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v) / F.size("px"), 8).alias("mse"))


@query(with_views("r", "SELECT proj, slice, col, val, lag(val) OVER w AS below, lead(val) OVER w AS above FROM r WINDOW w AS (PARTITION BY proj, col ORDER BY slice)"))
def halo_exchange(spark, d):
    return reduction.halo(t.rays(spark, d).select("proj", "slice", "col", "val"))


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS total, count(*) AS n FROM lineitem GROUP BY 1")
def tree_reduce_sum(spark, d):
    return rounded(reduction.total(t.read(spark, d, "lineitem"), "l_returnflag", "l_quantity"), "total", digits=2)


_GIVEN = """CASE WHEN vec_id % 3 = 0 THEN 0.4::FLOAT END AS rotation, CASE WHEN vec_id % 5 = 0 THEN 1024.5::FLOAT END AS center,
    CASE WHEN vec_id % 7 = 0 THEN 0::TINYINT END AS itype, CASE WHEN vec_id % 2 = 0 THEN (vec_id + 3456)::INT END AS unique_id"""


@query(
    f"""SELECT vec_id::INT AS seq, u AS unique_id, coalesce(rotation, (u * 0.25)::FLOAT) AS rotation, coalesce(center, 4.0::FLOAT) AS center, coalesce(itype, 1::TINYINT) AS itype,
    1 AS z, 8 AS y, 8 AS x, 256 AS n_bytes, round(list_sum(px), 6) AS total, 0::BIGINT AS n_changed
    FROM (SELECT *, coalesce(unique_id, vec_id::INT) AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS px, {_GIVEN} FROM embeddings))"""
)
def message_roundtrip(spark, d):
    """Messages with rotation, center, id and kind given or missing, there and back."""
    k = F.col("proj")
    given = {"rotation": F.when(k % 3 == 0, 0.4), "center": F.when(k % 5 == 0, 1024.5), "itype": F.when(k % 7 == 0, 0), "unique_id": F.when(k % 2 == 0, k + 3456)}
    frames = t.frames(spark, d).withColumn("dims", F.struct(F.lit(SIDE).alias("y"), F.lit(SIDE).alias("x")))
    back = payload.received(payload.as_messages(frames.withColumns(given))).withColumn("px", F.col("px").cast("array<double>"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    whole = back.join(frames.select(k.cast("int").alias("seq"), F.col("px").alias("sent")), "seq")
    changed = F.size(F.filter(F.zip_with("px", "sent", lambda a, b: a != b), lambda x: x)).cast("long")
    sizes = [F.col(f"dims.{c}") for c in "zyx"]
    return whole.select("seq", "unique_id", "rotation", "center", "itype", *sizes, F.octet_length("tdata").alias("n_bytes"), F.round(total(F.col("px")), 6).alias("total"), changed.alias("n_changed"))


@query("SELECT vec_id::INT AS seq, 1::TINYINT AS itype, 1 AS z, 8 AS y, 8 AS x FROM embeddings")
def old_messages(spark, d):
    """Messages of the older schema, without a kind and with two dimensions, as today's."""
    old = t.frames(spark, d).select(F.col("proj").cast("int").alias("seq"), F.struct(F.lit(SIDE).alias("y"), F.lit(SIDE).alias("x")).alias("dims"))
    return payload.from_old_schema(old).select("seq", "itype", "dims.z", "dims.y", "dims.x")


@query(with_views("f", "SELECT proj, list_sum(q)::BIGINT AS total8, list_sum(list_transform(range(1, 33), lambda k: q[2 * k - 1] + 256 * q[2 * k]))::BIGINT AS total16 FROM (SELECT proj, list_transform(px, lambda v: floor((v - list_min(px)) / (list_max(px) - list_min(px)) * 1.0::DOUBLE * 255)::BIGINT) AS q FROM f)"))
def dtype_reinterpret(spark, d):
    sent = t.frames(spark, d).select("proj", payload.encoded(quantised_image(F.col("px")), "uint8").alias("b"))
    total = lambda x: F.aggregate(x.cast("array<double>"), F.lit(0.0), lambda s, v: s + v).cast("long")
    return sent.select("proj", total(payload.decoded(F.col("b"), "uint8")).alias("total8"), total(payload.decoded(F.col("b"), "uint16")).alias("total16"))


def quantised_image(px: Column) -> Column:
    return sc.quantised(sc.min_max(px))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sirt_one_pass(spark, sf_dir)


