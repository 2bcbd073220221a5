"""The registered queries over the driver's tables, each with SQL for the same rows where SQL can express it.

Streams are events of a user, episodes are orders or conversations, frames are hours or days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetable.functions import values as V
from kinetable.operators import align, assembly, audits, clocks, quality, rollups, runs, stats
from kinetable.plans.registry import DAY, HOUR, ORACLE_SQL, QUERIES, events, query, read, rounded

_MOMENTS = """round(avg({x}), 4) AS mean, round(stddev_pop({x}), 4) AS std, round(min({x}), 4) AS "min", round(max({x}), 4) AS "max",
round(quantile_cont({x}, 0.01), 4) AS q01, round(quantile_cont({x}, 0.1), 4) AS q10, round(quantile_cont({x}, 0.5), 4) AS q50, round(quantile_cont({x}, 0.9), 4) AS q90, round(quantile_cont({x}, 0.99), 4) AS q99"""
_E = "e AS (SELECT *, epoch_us(ts) AS us FROM events)"


@query(f"SELECT l_returnflag, {_MOMENTS.format(x='l_extendedprice')}, count(*) AS count FROM lineitem GROUP BY 1")
def scalar_feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.scalar_stats(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice"))


@query(f"""WITH c AS (SELECT label, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label::BIGINT AS label, dim::BIGINT AS dim, {_MOMENTS.format(x='x')}, count(*) AS count FROM c GROUP BY ALL""")
def vector_feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.vector_stats(read(spark, sf_dir, "embeddings"), ["label"], "embedding"))


@query("""WITH c AS (SELECT unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT dim::BIGINT AS dim, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(min(x), 4) AS "min", round(max(x), 4) AS "max", count(*) AS count FROM c GROUP BY 1""")
def wide_vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.from_blocks(stats.vector_blocks(read(spark, sf_dir, "embeddings"), [], "embedding")))


@query("""SELECT l_returnflag, round(avg(l_quantity), 4) AS mean, round(stddev_pop(l_quantity), 4) AS std, min(l_quantity) AS "min", max(l_quantity) AS "max", count(*) AS count FROM lineitem GROUP BY 1""")
def episode_stats_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stats.scalar_stats(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_orderkey"], "l_quantity", quantiles_too=False)
    return rounded(stats.from_blocks(stats.merged(stats.to_blocks(own, ["l_returnflag"]), ["l_returnflag"])))


@query("""WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY p_brand ORDER BY p_size) AS upto, sum(n) OVER (PARTITION BY p_brand) AS whole FROM c)
SELECT p_brand, min(CASE WHEN upto > whole * 0.1 THEN p_size END)::BIGINT AS q10, min(CASE WHEN upto > whole * 0.5 THEN p_size END)::BIGINT AS q50, min(CASE WHEN upto > whole * 0.9 THEN p_size END)::BIGINT AS q90, max(whole)::BIGINT AS count FROM u GROUP BY 1""")
def histogram_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.histogram_quantiles(read(spark, sf_dir, "part"), ["p_brand"], "p_size", {"q10": 0.1, "q50": 0.5, "q90": 0.9}))


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.75), 4) AS p75, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.9), 4) AS p90,
round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr, count(*) AS n FROM events GROUP BY 1""")
def robust_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.robust(events(spark, sf_dir), ["event_type"], "value"))


_ORDERS = "o AS (SELECT *, epoch_us(o_orderdate) // 1000000 AS s FROM orders), d AS (SELECT *, s - lag(s) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM o)"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").withColumn("s", F.floor(V.micros("o_orderdate") / 1_000_000).cast("long"))


@query(f"""WITH {_ORDERS} SELECT o_custkey, count(*) AS "rows", count(*) FILTER (step < 0) AS regressions, 0::BIGINT AS wraps, max(CASE WHEN step < 0 THEN -step END) AS worst FROM d GROUP BY 1""")
def ts_regression_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.regressions(orders(spark, sf_dir), ["o_custkey"], ["o_orderkey"], "s")


@query(f"""WITH {_ORDERS}, c AS (SELECT o_custkey, count(*) AS "rows", count(*) FILTER (abs(step) <= 86399) AS duplicates FROM d GROUP BY 1)
SELECT *, 0::BIGINT AS within_rows, CASE WHEN duplicates = 0 THEN 'info' WHEN duplicates / greatest("rows" - 1, 1) > 0.001 THEN 'error' ELSE 'warn' END AS severity FROM c""")
def ts_duplicate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.duplicates(orders(spark, sf_dir), ["o_custkey"], ["o_orderkey"], "s", quantum=86_400)


@query(f"""WITH {_E}, s AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM e), t AS (SELECT * FROM s WHERE step IS NOT NULL), b AS (SELECT user_id, quantile_cont(step, 0.5) AS nominal FROM t GROUP BY 1),
g AS (SELECT user_id, any_value(nominal) AS nominal, count(*) FILTER (step > nominal * 1.8 AND step - nominal >= 3000000) AS gaps, count(*) FILTER (step < nominal * 0.5) AS compressed, max(CASE WHEN step > nominal * 1.8 AND step - nominal >= 3000000 THEN step END) AS largest FROM t JOIN b USING (user_id) GROUP BY 1)
SELECT user_id, round(nominal, 4) AS nominal, gaps, compressed, largest, CASE WHEN gaps = 0 THEN 'info' WHEN largest >= nominal * 5 OR gaps >= 10 THEN 'error' ELSE 'warn' END AS severity FROM g""")
def ts_jump_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clocks.jumps(events(spark, sf_dir), ["user_id"], ["event_id"], "us"))


@query(f"""WITH {_E}, g AS (SELECT user_id, count(*) AS samples, max(us) - min(us) AS own_span FROM e GROUP BY 1), x AS (SELECT *, 2.0::DOUBLE * 30 + 1 AS expected, own_span / ({30 * DAY})::DOUBLE AS coverage FROM g)
SELECT user_id, samples, round(expected, 4) AS expected, round(samples / expected - 1, 4) AS deviation, round(coverage, 4) AS coverage, CASE WHEN abs(samples / expected - 1) > 0.05 THEN 'error' WHEN abs(samples / expected - 1) > 0.01 OR coverage < 0.95 THEN 'warn' ELSE 'info' END AS severity FROM x""")
def rate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clocks.rate_and_coverage(events(spark, sf_dir), ["user_id"], "us", F.lit(2.0 / DAY), F.lit(float(30 * DAY)))
    return rounded(out.select("user_id", "samples", "expected", "deviation", "coverage", "severity"))


@query("""SELECT conv_id, count(*) AS "rows", min(turn) AS first, max(turn) AS last, count(DISTINCT turn) AS "distinct", min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS ok FROM conversations GROUP BY 1""")
def frame_index_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.frame_contract(read(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query("""WITH n AS (SELECT l_orderkey AS i, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), p AS (SELECT *, lag(i) OVER (ORDER BY i) AS prev FROM n)
SELECT 'missing' AS kind, prev + 1 AS first, i - 1 AS last FROM p WHERE i > prev + 1 UNION ALL SELECT 'repeated', i, i FROM p WHERE n > 1""")
def index_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.holes(read(spark, sf_dir, "lineitem").filter("l_linenumber = 1"), "l_orderkey", width=1000)


_PAIR = f"{_E}, p AS (SELECT user_id, event_id, us FROM e WHERE event_type = 'purchase'), c AS (SELECT user_id, us, event_id, value FROM e WHERE event_type = 'click')"


def purchases_and_clicks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf_dir)
    return e.filter("event_type = 'purchase'").select("user_id", "event_id", "us"), e.filter("event_type = 'click'").select("user_id", "us", F.col("event_id").alias("click"), "value")


@query(f"""WITH {_PAIR}, m AS (SELECT p.*, c.event_id AS click, c.us AS t, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(c.us - p.us), c.us) AS r FROM p LEFT JOIN c ON p.user_id = c.user_id)
SELECT user_id, event_id, click AS r_click, t - us AS residual FROM m WHERE r = 1""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = purchases_and_clicks(spark, sf_dir)
    return align.asof(p, c, ["user_id"], "us", "nearest", tie="click", bucket=DAY).select("user_id", "event_id", "r_click", (F.col("r_us") - F.col("us")).alias("residual"))


@query(f"""WITH {_PAIR}, m AS (SELECT p.*, c.event_id AS click, row_number() OVER (PARTITION BY p.event_id ORDER BY c.us DESC NULLS LAST) AS r FROM p LEFT JOIN c ON p.user_id = c.user_id AND c.us <= p.us AND c.us >= p.us - {6 * HOUR})
SELECT user_id, event_id, click AS r_click FROM m WHERE r = 1""")
def asof_backward_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = purchases_and_clicks(spark, sf_dir)
    return align.asof(p, c, ["user_id"], "us", "backward", tolerance=6 * HOUR, tie="click").select("user_id", "event_id", "r_click")


@query(f"""WITH {_PAIR}, m AS (SELECT p.*, c.event_id AS click, row_number() OVER (PARTITION BY p.event_id ORDER BY c.us NULLS LAST) AS r FROM p LEFT JOIN c ON p.user_id = c.user_id AND c.us >= p.us)
SELECT user_id, event_id, click AS f_click FROM m WHERE r = 1""")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = purchases_and_clicks(spark, sf_dir)
    return align.first_from(p, c, ["user_id"], "us").select("user_id", "event_id", "f_click")


@query(f"""WITH {_PAIR}, b AS (SELECT p.*, (SELECT max(c.us) FROM c WHERE c.user_id = p.user_id AND c.us <= p.us) AS t0, (SELECT min(c.us) FROM c WHERE c.user_id = p.user_id AND c.us >= p.us) AS t1 FROM p)
SELECT b.user_id, b.event_id, round(CASE WHEN t1 - t0 <= {5 * DAY} THEN x.value + (CASE WHEN t1 = t0 THEN 0 ELSE (b.us - t0) / (t1 - t0)::DOUBLE END) * (y.value - x.value) END, 4) AS value
FROM b LEFT JOIN c x ON x.user_id = b.user_id AND x.us = t0 LEFT JOIN c y ON y.user_id = b.user_id AND y.us = t1""")
def interpolate_bracketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = purchases_and_clicks(spark, sf_dir)
    return rounded(align.bracketed(p, c, ["user_id"], "us", ["value"], 5 * DAY).select("user_id", "event_id", "value"))


@query(f"""WITH {_PAIR} SELECT p.user_id, p.event_id, count(c.us) AS hits, min(c.us - p.us) AS nearest FROM p LEFT JOIN c ON p.user_id = c.user_id AND c.us - p.us BETWEEN 1 AND {12 * HOUR} GROUP BY ALL""")
def window_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = purchases_and_clicks(spark, sf_dir)
    return align.hits(p, c, ["user_id"], "us", 1, 12 * HOUR, "event_id").select("user_id", "event_id", "hits", "nearest")


@query(f"""WITH {_E}, f AS (SELECT user_id, (us // {DAY}) * {DAY} AS us, us // {DAY} AS frame FROM e WHERE event_type = 'view' GROUP BY ALL), m AS (SELECT e.user_id, e.event_id, e.us, f.us AS t, f.frame, row_number() OVER (PARTITION BY e.event_id ORDER BY f.us DESC NULLS LAST) AS r FROM e LEFT JOIN f ON e.user_id = f.user_id AND f.us <= e.us)
SELECT user_id, CASE WHEN us < t + {DAY} THEN frame END AS frame, count(*) AS samples FROM m WHERE r = 1 GROUP BY ALL""")
def bin_samples_to_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    day = F.floor(F.col("us") / DAY).cast("long")
    frames = e.filter("event_type = 'view'").select("user_id", (day * DAY).alias("us"), day.alias("frame")).distinct()
    out = align.binned(e.select("user_id", "event_id", "us"), frames, ["user_id"], "us", DAY, "frame")
    return out.groupBy("user_id", "frame").agg(F.count("*").alias("samples"))


_SEGMENTS = f"g AS (SELECT user_id, event_id AS seg, us AS a, us + {2 * DAY} AS z FROM e WHERE event_type = 'signup')"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("seg"), F.col("us").alias("a"), (F.col("us") + 2 * DAY).alias("z"))


@query(f"WITH {_E}, {_SEGMENTS} SELECT e.event_id, min(seg) AS seg FROM e LEFT JOIN g ON e.user_id = g.user_id AND us BETWEEN a AND z WHERE event_type = 'error' GROUP BY 1")
def interval_first_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = events(spark, sf_dir).filter("event_type = 'error'").select("user_id", "event_id", "us")
    return align.first_interval(points, segments(spark, sf_dir), ["user_id"], "us", "a", "z", "seg", DAY).select("event_id", "seg")


@query(f"WITH {_E}, {_SEGMENTS} SELECT e.event_id, seg FROM e JOIN g ON e.user_id = g.user_id AND us BETWEEN a AND z WHERE event_type = 'error'")
def interval_all_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = events(spark, sf_dir).filter("event_type = 'error'").select("user_id", "event_id", "us")
    return align.in_intervals(points, segments(spark, sf_dir), ["user_id"], "us", "a", "z", DAY).select("event_id", "seg")


@query(f"""WITH {_E}, {_SEGMENTS}, p AS (SELECT user_id, event_id AS prop, us AS b, us + {DAY} AS y FROM e WHERE event_type = 'view'),
m AS (SELECT g.user_id, seg, prop, 2 * (least(z, y) - greatest(a, b) + 1) / (z - a + 1 + y - b + 1 + 1e-6) AS dice FROM g JOIN p ON g.user_id = p.user_id AND least(z, y) >= greatest(a, b)),
r AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY dice DESC, prop) AS r FROM m)
SELECT g.user_id, g.seg, prop AS proposal, round(dice, 6) AS dice FROM g LEFT JOIN (SELECT * FROM r WHERE r = 1) x ON g.seg = x.seg""")
def overlap_dice_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = events(spark, sf_dir).filter("event_type = 'view'").select("user_id", F.col("event_id").alias("prop"), F.col("us").alias("a"), (F.col("us") + DAY).alias("z"))
    out = align.best_overlap(segments(spark, sf_dir), props, ["user_id"], "seg", "a", "z", "prop", DAY)
    return rounded(out.select("user_id", "seg", "proposal", "dice"), 6)


@query(f"""WITH {_E}, s AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM e), l AS (SELECT user_id, CASE WHEN step > 0 AND step - {6 * HOUR} >= {HOUR} THEN step - {6 * HOUR} END AS lost, step FROM s)
SELECT user_id, count(*) AS readings, count(lost) AS gaps, coalesce(sum(lost), 0)::BIGINT AS lost, max(lost) AS peak, count(*) FILTER (step < 0) AS resyncs FROM l GROUP BY 1""")
def gap_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.gap_watch(events(spark, sf_dir), ["user_id"], ["event_id"], "us", 6 * HOUR, HOUR)


_ISLANDS = "w AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS st FROM events), i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM w)"


@query(f"WITH {_ISLANDS} SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM i GROUP BY user_id, run, event_type HAVING count(*) >= 2")
def frozen_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.runs_of(read(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type", "event_id", 2)


@query(f"""WITH {_E}, n AS (SELECT user_id, us, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN CURRENT ROW AND {DAY} FOLLOWING) AS n FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, us) AS r FROM n)
SELECT user_id, n AS most, us AS since FROM r WHERE r = 1""")
def density_max_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.density(events(spark, sf_dir), ["user_id"], "us", DAY)


@query(f"""WITH {_E}, x AS (SELECT user_id, us FROM e WHERE event_type = 'error'), n AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN CURRENT ROW AND {2 * DAY} FOLLOWING) AS n FROM x),
d AS (SELECT DISTINCT x.* FROM x JOIN n ON x.user_id = n.user_id AND n.n >= 3 AND x.us BETWEEN n.us AND n.us + {2 * DAY}), s AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= {DAY} THEN 0 ELSE 1 END AS st FROM d), i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY us) AS run FROM s)
SELECT user_id, min(us) AS start, max(us) AS "end", count(*) AS "rows" FROM i GROUP BY user_id, run""")
def flood_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("event_type = 'error'").select("user_id", "us")
    return runs.floods(e, ["user_id"], "us", 2 * DAY, 3, DAY)


_RANGES = "r AS (SELECT o_custkey, o_orderkey, (epoch_us(o_orderdate) // 86400000000) - 9131 AS a, (epoch_us(o_orderdate) // 86400000000) - 9131 + (o_orderkey % 90) - 3 AS z FROM orders)"


@query(f"""WITH {_RANGES}, g AS (SELECT * FROM r WHERE z >= a), f AS (SELECT DISTINCT o_custkey, unnest(range(a, z + 1)) AS f FROM g), c AS (SELECT o_custkey, count(*) AS covered FROM f GROUP BY 1),
w AS (SELECT o_custkey, a, max(z) OVER (PARTITION BY o_custkey ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g), o AS (SELECT o_custkey, count(*) FILTER (a > reach + 1) AS gaps, count(*) FILTER (a <= reach) AS "overlaps" FROM w GROUP BY 1), i AS (SELECT o_custkey, count(*) FILTER (z < a) AS invalid FROM r GROUP BY 1)
SELECT o_custkey, invalid, coalesce(covered, 0) AS covered, coalesce(gaps, 0) AS gaps, coalesce("overlaps", 0) AS "overlaps", round(coalesce(covered, 0) / 2500.0::DOUBLE, 4) AS ratio FROM i LEFT JOIN c USING (o_custkey) LEFT JOIN o USING (o_custkey)""")
def coverage_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    a = F.floor(V.micros("o_orderdate") / DAY).cast("long") - 9131
    ranges = o.select("o_custkey", a.alias("a"), (a + F.col("o_orderkey") % 90 - 3).alias("z"))
    return rounded(runs.coverage(ranges, ["o_custkey"], "a", "z", F.lit(2500)).select("o_custkey", "invalid", "covered", "gaps", "overlaps", "ratio"))


@query("""WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events), f AS (SELECT user_id, event_type, min(event_id) AS i FROM events GROUP BY ALL)
SELECT user_id, count(*) FILTER (event_type <> p) AS changes, 0::BIGINT AS blank, (SELECT string_agg(event_type, ',' ORDER BY i) FROM f WHERE f.user_id = e.user_id) AS statuses, count(DISTINCT event_type) AS "distinct" FROM e GROUP BY user_id""")
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.changes(read(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type")


@query("SELECT user_id::VARCHAR AS episode_id, 'umi.gripper_range' AS rule, CASE WHEN avg((value NOT BETWEEN 0 AND 100)::INT) > 0.01 THEN 'warn' ELSE 'pass' END AS status, event_type AS stream, round(avg((value NOT BETWEEN 0 AND 100)::INT), 4) AS value FROM events GROUP BY user_id, event_type")
def range_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("episode_id"), F.col("event_type").alias("stream"), F.col("event_id").alias("frame_index"), F.array("value").alias("values"))
    return rounded(quality.gripper_range(rows).drop("message"))


@query("""WITH r AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, round(quantile_cont(CASE WHEN i <= n // 2 THEN l_quantity END, 0.5), 4) AS first, round(quantile_cont(CASE WHEN i > n // 2 THEN l_quantity END, 0.5), 4) AS second, round(quantile_cont(CASE WHEN i > n // 2 THEN l_quantity END, 0.5) - quantile_cont(CASE WHEN i <= n // 2 THEN l_quantity END, 0.5), 4) AS drift FROM r WHERE n >= 20 GROUP BY 1""")
def baseline_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.half_drift(read(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"], "l_quantity"))


_GRADE = "CASE event_type WHEN 'error' THEN (CASE WHEN value > 60 THEN 'fail' ELSE 'warn' END) WHEN 'signup' THEN 'pending_review' ELSE 'pass' END"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings: a rule is an event's type, a stream the hour of the day in four parts."""
    e = events(spark, sf_dir)
    status = F.when(F.col("event_type") == "error", F.when(F.col("value") > 60, "fail").otherwise("warn")).when(F.col("event_type") == "signup", "pending_review").otherwise("pass")
    part = F.floor(F.pmod(F.col("us"), F.lit(DAY)) / (6 * HOUR)).cast("string")
    return e.select(F.col("user_id").alias("episode_id"), F.concat(F.lit("s"), part).alias("stream"), F.col("event_type").alias("rule"), status.alias("status"))


_FINDINGS = f"{_E}, f AS (SELECT user_id AS episode_id, 's' || ((us % {DAY}) // {6 * HOUR}) AS stream, event_type AS rule, {_GRADE} AS status FROM e)"
_RANK = "CASE min(CASE status WHEN 'error' THEN 0 WHEN 'fail' THEN 1 WHEN 'pending_review' THEN 2 WHEN 'warn' THEN 3 ELSE 4 END) WHEN 0 THEN 'error' WHEN 1 THEN 'fail' WHEN 2 THEN 'pending_review' WHEN 3 THEN 'warn' ELSE 'pass' END"


@query(f"WITH {_FINDINGS} SELECT episode_id, stream, {_RANK} AS status, coalesce(string_agg(DISTINCT CASE WHEN status <> 'pass' THEN rule END, ',' ORDER BY CASE WHEN status <> 'pass' THEN rule END), '') AS reasons, count(*) AS findings FROM f GROUP BY ALL")
def worst_severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.stream_rollup(findings(spark, sf_dir))


@query(f"""WITH {_FINDINGS}, s AS (SELECT episode_id, stream, {_RANK} AS status FROM f GROUP BY ALL)
SELECT episode_id, {_RANK} AS status, coalesce(string_agg(CASE WHEN status IN ('fail', 'error') THEN stream END, ',' ORDER BY stream), '') AS failed, coalesce(string_agg(CASE WHEN status = 'warn' THEN stream END, ',' ORDER BY stream), '') AS warned,
coalesce(string_agg(CASE WHEN status = 'pending_review' THEN stream END, ',' ORDER BY stream), '') AS pending, {_RANK} IN ('fail', 'error') AS blocking FROM s GROUP BY episode_id""")
def episode_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.episode_rollup(quality.stream_rollup(findings(spark, sf_dir)))


@query("""WITH n(k, channels) AS (VALUES (0, ['rgb', 'time']), (1, ['rgb', 'gripper_state', 'slam', 'time']), (2, ['tactile', 'time'])), c AS (SELECT c_custkey AS episode_id, channels, CASE WHEN c_acctbal < 0 THEN 'fail' ELSE 'pass' END AS status FROM customer JOIN n ON c_custkey % 3 = k),
u(use, needs) AS (VALUES ('pure_vision', ['rgb', 'time']), ('vision_gripper_joint', ['rgb', 'gripper_state', 'time']), ('slam_trajectory', ['slam', 'time']), ('vision_tactile_joint', ['rgb', 'tactile', 'time']), ('bimanual_tactile', ['tactile', 'time']))
SELECT episode_id, use, len(list_filter(needs, lambda x: NOT list_contains(channels, x))) = 0 AND status = 'pass' AS usable, array_to_string(list_filter(needs, lambda x: NOT list_contains(channels, x)), ',') AS missing FROM c, u""")
def training_use_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [("rgb", "time"), ("rgb", "gripper_state", "slam", "time"), ("tactile", "time")]
    channels = F.element_at(F.array(*[F.array(*map(F.lit, k)) for k in kinds]), (F.col("c_custkey") % 3 + 1).cast("int"))
    own = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("episode_id"), channels.alias("channels"), F.when(F.col("c_acctbal") < 0, "fail").otherwise("pass").alias("status"))
    return quality.training_uses(own)


@query("""WITH s AS (SELECT c_mktsegment, o_orderstatus, count(*) AS episodes, sum(o_totalprice) AS s, count(o_totalprice) AS n, max(o_orderdate) AS r FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_mktsegment, o_orderstatus, episodes, round(sum(s) OVER w / sum(n) OVER w, 2) AS avg_frames, epoch_us(max(r) OVER w) AS last_received FROM s WINDOW w AS (PARTITION BY c_mktsegment)""")
def project_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = rollups.status_summary(o, "c_mktsegment", "o_orderstatus", "o_totalprice", "o_orderdate")
    return rounded(out.withColumn("last_received", V.micros("last_received")), 2)


@query("SELECT d.doc_id, d.source FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""WITH d AS (SELECT unnest(range(0, 45)) AS i) SELECT strftime(DATE '2024-02-05' - i::INT, '%Y-%m-%d') AS day, (SELECT count(*) FROM events WHERE ts::DATE = DATE '2024-02-05' - i::INT) AS n FROM d""")
def daily_trend_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.daily_trend(read(spark, sf_dir, "events"), "ts", "2024-02-05", 45).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT c_custkey, c_custkey % 25 AS target, coalesce(n, 0) AS n FROM customer LEFT JOIN n ON c_custkey = o_custkey)
SELECT c_custkey, target, n, CASE WHEN target > 0 THEN least(100.0::DOUBLE, round_even(100.0::DOUBLE * n / target, 1)) ELSE 0.0 END AS percent, target > 0 AND n >= target AS complete FROM t""")
def task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 25).alias("target"))
    return rollups.progress(tasks, read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "target")


@query("""WITH s AS (SELECT l_suppkey AS task, count(*) AS seen FROM lineitem GROUP BY 1), r AS (SELECT s_suppkey AS task, max(s_nationkey)::BIGINT AS reported FROM supplier GROUP BY 1) SELECT task, coalesce(reported, seen) AS total FROM s FULL JOIN r USING (task)""")
def device_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "task")
    reported = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("task"), F.col("s_nationkey").cast("long").alias("count"))
    return rollups.device_totals(rows.select("task"), reported, "task")


@query("""WITH n AS (SELECT c_nationkey, count(*) AS uploaded, count(*) FILTER (c_mktsegment IN ('BUILDING', 'HOUSEHOLD')) AS approved FROM customer GROUP BY 1)
SELECT c_nationkey::BIGINT AS c_nationkey, uploaded, approved, (c_nationkey * 2)::BIGINT AS target, c_nationkey > 0 AND approved >= c_nationkey * 2 AS ready, round(CASE WHEN c_nationkey > 0 THEN approved / (c_nationkey * 2)::DOUBLE ELSE -1 END, 4) AS share FROM n""")
def training_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").withColumn("status", F.when(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD"), "reviewed").otherwise("processing"))
    targets = c.select("c_nationkey", (F.col("c_nationkey") * 2).alias("target")).distinct()
    return rounded(rollups.readiness(c, "c_nationkey", "status", targets))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.recent(read(spark, sf_dir, "orders"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 20).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 50")
def page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return rollups.page(o, ["o_orderdate", "o_orderkey"], 50, 25).select("o_orderkey", "total")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) AS r FROM labels) SELECT d.doc_id, d.lang, r.quality::BIGINT AS label_quality, r.toxic::BIGINT AS label_toxic FROM documents d LEFT JOIN (SELECT * FROM r WHERE r = 1) r USING (doc_id)""")
def dedup_keep_first_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return rounded(align.with_results(docs, read(spark, sf_dir, "labels"), ["doc_id"], ["quality", "toxic"], {"quality": "label_quality", "toxic": "label_toxic"}))


@query("""SELECT l_partkey, l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey * 8 + l_linenumber DESC) AS r FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem)) WHERE r = 1""")
def argmax_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_quantity", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("nth")).distinct()
    return align.best_by_confidence(rows, ["l_partkey"], "l_quantity", "nth").select("l_partkey", "l_orderkey", "l_quantity")


@query("""WITH a AS (SELECT DISTINCT doc_id, n_chars AS quality FROM documents), b AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) SELECT doc_id, coalesce(b.quality, a.quality)::BIGINT AS quality FROM a FULL JOIN b USING (doc_id)""")
def upsert_later_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("quality")).distinct()
    return rounded(align.upserted(old, read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), ["doc_id"]))


@query("""SELECT md5(text) AS digest, count(*) AS files, count(DISTINCT source) AS folders, max(n_chars) AS bytes, (count(*) - 1) * max(n_chars) AS wasted FROM documents GROUP BY 1 HAVING count(*) > 1""")
def fingerprint_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.duplicate_files(read(spark, sf_dir, "documents").withColumn("digest", F.md5("text")), "source", "digest", "n_chars")


@query("""WITH k AS (SELECT unnest(['small', 'small r', 'red', 'red widget', 'blue', 'large bolt', 'green', 's']) AS k), m AS (SELECT p_partkey, p_name, k, row_number() OVER (PARTITION BY p_partkey ORDER BY length(k) DESC NULLS LAST) AS r FROM part LEFT JOIN k ON starts_with(p_name, k)) SELECT p_partkey, p_name, k AS match FROM m WHERE r = 1""")
def prefix_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["small", "small r", "red", "red widget", "blue", "large bolt", "green", "s"]
    names = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return align.longest_prefix(names, spark.createDataFrame([(k,) for k in keys], "k string"), "p_name", "k", sorted({len(k) for k in keys}))


@query("""WITH a AS (SELECT DISTINCT p_name AS name FROM part), b AS (SELECT unnest(['small_ring', 'red-widget v2', 'bolt blue', 'large', 'ring']) AS match),
t AS (SELECT name, match, len(list_intersect(list_distinct(regexp_split_to_array(name, '[^a-z0-9]+')), list_distinct(regexp_split_to_array(match, '[^a-z0-9]+')))) AS shared FROM a, b) SELECT name, match, shared::BIGINT AS shared FROM t WHERE shared > 0 QUALIFY rank() OVER (PARTITION BY name ORDER BY shared DESC) = 1""")
def token_overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "part").select("p_name").distinct()
    other = spark.createDataFrame([(k,) for k in ("small_ring", "red-widget v2", "bolt blue", "large", "ring")], "m string")
    return align.token_overlap(names, other, "p_name", "m")


@query("""WITH e AS (SELECT conv_id AS i, count(*) AS n FROM conversations GROUP BY 1), s AS (SELECT i + (i % 2) AS i, n + (i % 5 = 4)::INT AS n FROM e), x AS (SELECT e.i, e.n, bool_or(s.i IS NOT NULL) AS exact FROM e LEFT JOIN s ON e.i = s.i AND e.n = s.n GROUP BY ALL), u AS (SELECT n, min(i) AS stats_index FROM s GROUP BY 1 HAVING count(*) = 1)
SELECT i, x.n, CASE WHEN exact THEN 'exact' WHEN stats_index IS NOT NULL THEN 'length' ELSE 'none' END AS source, CASE WHEN exact THEN i ELSE stats_index END AS stats_index FROM x LEFT JOIN u ON x.n = u.n""")
def stats_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("i")).agg(F.count("*").alias("n"))
    s = e.select((F.col("i") + F.col("i") % 2).alias("i"), (F.col("n") + (F.col("i") % 5 == 4).cast("int")).alias("n"))
    return align.repaired(s, e, "i", "n").select("i", "n", "source", "stats_index")


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) FILTER (json_extract(props, '$.k') IS NULL) AS missing FROM events GROUP BY 1")
def json_counter_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(k.isNull()).alias("missing"))


@query("""WITH c AS (SELECT p_partkey, p_retailprice * 3 - 2000 AS mm FROM part), d AS (SELECT *, CASE WHEN mm > 0 THEN greatest(least(round_even((ln(mm) - ln(100.0::DOUBLE)) * (4095 / ln(50.0::DOUBLE)), 0), 4095), 0) ELSE 0 END AS code FROM c)
SELECT p_partkey, code::BIGINT AS code, round_even(exp(ln(100.0::DOUBLE) + code / (4095 / ln(50.0::DOUBLE))), 0)::BIGINT AS mm FROM d""")
def depth_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").withColumn("code", V.depth_code(F.col("p_retailprice") * 3 - 2000))
    return rounded(p.select("p_partkey", "code", V.depth_mm("code").alias("mm")))


@query(f"""WITH {_E}, n AS (SELECT user_id, us / {HOUR}.0::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::DOUBLE AS x FROM e) SELECT user_id, CASE WHEN count(*) >= 8 THEN round(regr_slope(y, x) * 1e6, 0) END AS drift_ppm, CASE WHEN count(*) >= 8 THEN round(regr_r2(y, x), 4) END AS r2, count(*) AS n FROM n GROUP BY 1""")
def clock_fit_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("double")
    e = events(spark, sf_dir).select("user_id", (F.col("us") / HOUR).alias("y"), n.alias("x"))
    return rounded(stats.drift_ppm(e, ["user_id"], "x", "y").withColumn("drift_ppm", F.round("drift_ppm", 0)))


@query("""WITH p AS (SELECT user_id, value, ntile(20) OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM events), m AS (SELECT user_id, part, quantile_cont(value, 0.5) AS mid FROM p GROUP BY ALL), s AS (SELECT user_id, abs(mid - lag(mid) OVER (PARTITION BY user_id ORDER BY part)) AS step FROM m)
SELECT user_id, round(max(step), 4) AS largest_step, count(*) AS parts FROM s GROUP BY 1""")
def segment_median_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.segment_steps(read(spark, sf_dir, "events"), ["user_id"], ["event_id"], "value"))


@query("""WITH p AS (SELECT user_id, value, least((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // greatest(1, count(*) OVER (PARTITION BY user_id) // 8), 7) AS b FROM events), m AS (SELECT user_id, b, quantile_cont(value, 0.5) AS mid FROM p GROUP BY ALL)
SELECT user_id, round(regr_slope(mid, b), 6) AS slope, round(regr_r2(mid, b), 4) AS r2, count(*) AS buckets FROM m GROUP BY 1""")
def growth_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Slopes are multiples of 1 / 16,800, of which none with a finite expansion is halfway at six places.
    out = stats.growth(read(spark, sf_dir, "events"), ["user_id"], ["event_id"], "value")
    return rounded(out.withColumn("r2", F.round("r2", 4)), 6)


@query("""WITH e AS (SELECT conv_id, count(*) AS length FROM conversations GROUP BY 1) SELECT conv_id, length, sum(length) OVER (ORDER BY conv_id)::BIGINT AS dataset_to_index, (sum(length) OVER (ORDER BY conv_id) - length)::BIGINT AS dataset_from_index FROM e""")
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("length"))
    return assembly.offsets(e, "conv_id", "length", width=50)


@query("SELECT p_name, row_number() OVER (ORDER BY min(p_partkey), p_name) - 1 AS task_index FROM part GROUP BY 1")
def task_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.task_indexes(read(spark, sf_dir, "part"), "p_name", "p_partkey")


@query("""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN i <= greatest(1, floor(n * 0.9)) THEN 'train' ELSE 'val' END AS split FROM n""")
def split_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.split(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.9)


_STEPS = f"{_E}, s AS (SELECT user_id, event_id, us, us - lag(us) OVER w AS step, row_number() OVER w AS i, min(us) OVER (PARTITION BY user_id) AS origin FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), m AS (SELECT user_id, quantile_cont(step, 0.5) AS mid FROM s GROUP BY 1), t AS (SELECT s.user_id, round_even(coalesce(avg(CASE WHEN step > mid * 0.9 AND step < mid * 1.1 THEN step END), any_value(mid)), 0)::BIGINT AS period FROM s JOIN m USING (user_id) GROUP BY 1)"


@query(f"WITH {_STEPS} SELECT user_id, event_id, period, origin + (i - 1) * period AS rebuilt FROM s JOIN t USING (user_id)")
def uniform_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.uniform(events(spark, sf_dir), ["user_id"], ["event_id"], "us").select("user_id", "event_id", "period", "rebuilt")


@query(f"WITH {_STEPS} SELECT user_id, event_id, period, (origin + sum(coalesce(CASE WHEN step <= 0 OR step > period * 1.5 OR step < period * 0.5 THEN period ELSE step END, 0)) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS rebuilt FROM s JOIN t USING (user_id)")
def interpolated_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.uniform(events(spark, sf_dir), ["user_id"], ["event_id"], "us", "interp").select("user_id", "event_id", "period", "rebuilt")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 - 1704067200000 AS t FROM events) SELECT user_id, event_id, t - first_value(t) OVER (PARTITION BY user_id ORDER BY event_id) AS since FROM e""")
def clock_unwrap32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds as a counter of 31 bits shows them, and unwrapped again."""
    e = events(spark, sf_dir).select("user_id", "event_id", ((F.col("us") / 1000).cast("long") % (1 << 31)).alias("t"))
    out = clocks.unwrapped(e, ["user_id"], ["event_id"], "t", 31)
    first = F.first("unwrapped").over(Window.partitionBy("user_id").orderBy("event_id"))
    return out.select("user_id", "event_id", (F.col("unwrapped") - first).alias("since"))


_FILL = f"{_E}, v AS (SELECT user_id, event_id, us, CASE WHEN event_type <> 'error' THEN value END AS v FROM e)"


@query(f"""WITH {_FILL}, b AS (SELECT x.*, (SELECT max(us) FROM v y WHERE y.user_id = x.user_id AND y.us <= x.us AND y.v IS NOT NULL) AS t0, (SELECT min(us) FROM v y WHERE y.user_id = x.user_id AND y.us >= x.us AND y.v IS NOT NULL) AS t1 FROM v x)
SELECT b.user_id, b.event_id, round(coalesce(b.v, a.v + (b.us - t0) / (t1 - t0)::DOUBLE * (z.v - a.v), a.v, z.v, 0), 4) AS filled FROM b LEFT JOIN v a ON a.user_id = b.user_id AND a.us = t0 LEFT JOIN v z ON z.user_id = b.user_id AND z.us = t1""")
def interp_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return rounded(runs.interpolated(e.select("user_id", "event_id", "us", "v"), ["user_id"], "us", "v").select("user_id", "event_id", "filled"))


@query("""WITH f AS (SELECT conv_id, turn, role FROM conversations), a AS (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'user'), s AS (SELECT conv_id, unnest(range(0, max(turn) + 1)) AS frame_index FROM conversations GROUP BY 1)
SELECT s.conv_id, s.frame_index, coalesce(role, '') AS role, coalesce(n, 0)::BIGINT AS n FROM s LEFT JOIN f ON s.conv_id = f.conv_id AND s.frame_index = f.turn LEFT JOIN a ON s.conv_id = a.conv_id AND s.frame_index = a.turn""")
def export_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").withColumnRenamed("turn", "frame_index")
    spine = assembly.spine(c.groupBy("conv_id").agg((F.max("frame_index") + 1).alias("length")), "conv_id")
    users = c.filter("role = 'user'").select("conv_id", "frame_index", F.length("text").cast("long").alias("n"))
    return assembly.filled(assembly.assembled(spine, [c.select("conv_id", "frame_index", "role"), users], ["conv_id", "frame_index"]))


@query(f"""WITH {_E}, d AS (SELECT user_id, us, event_type, value, dense_rank() OVER (PARTITION BY user_id ORDER BY us // {DAY}) AS x, us // {DAY} AS day FROM e) SELECT user_id, day, max_by(event_type, us) AS event_type, max_by(value, us) FILTER (event_type <> 'error') AS value FROM d GROUP BY user_id, day""")
def last_valid_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY).cast("long")).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return runs.last_valid(e, ["user_id", "day"], "us", ["event_type", "value"])


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), k AS (SELECT DISTINCT user_id, CASE WHEN n <= 10 THEN i ELSE round_even(j * (n - 1) / 9.0::DOUBLE, 0)::BIGINT END AS i FROM r, (SELECT unnest(range(0, 10)) AS j)) SELECT r.user_id, r.event_id FROM r JOIN k ON r.user_id = k.user_id AND r.i = k.i""")
def uniform_decimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.sampled(read(spark, sf_dir, "events"), ["user_id"], "event_id", 10).select("user_id", "event_id")


@query("""WITH w AS (SELECT *, value > 20 AS ok FROM events), s AS (SELECT user_id, ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) FILTER (ok) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS n FROM w)
SELECT user_id, round(avg(ok::INT), 4) AS share, min(CASE WHEN ok THEN i END) AS first_ok, min(CASE WHEN n = 5 THEN i END) AS recovered FROM s GROUP BY 1""")
def tracking_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("ok", F.col("value") > 20)
    return rounded(runs.recovery(e, ["user_id"], ["event_id"], "ok", 5))


@query("""WITH t AS (SELECT user_id, event_id, value > 0.15 * max(value) OVER (PARTITION BY user_id) AS p FROM events), e AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY user_id ORDER BY event_id), false) AS q FROM t) SELECT user_id, event_id, CASE WHEN p THEN 'grasp' ELSE 'open' END AS kind FROM e WHERE p <> q""")
def pressure_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.pressure_edges(read(spark, sf_dir, "events"), ["user_id"], ["event_id"], "value").select("user_id", "event_id", "kind")


@query(f"""WITH {_E}, {_SEGMENTS}, w AS (SELECT *, max(z) OVER (PARTITION BY user_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g), i AS (SELECT *, sum(CASE WHEN a <= reach + {HOUR} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, z) AS run FROM w)
SELECT user_id, min(a) AS a, max(z) AS z, count(*) AS parts FROM i GROUP BY user_id, run""")
def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.merged_ranges(segments(spark, sf_dir).drop("seg"), ["user_id"], "a", "z", HOUR)


@query(f"""WITH {_E}, r AS (SELECT user_id, (us // {DAY})::DOUBLE AS a, (us // {DAY})::DOUBLE + 1 AS z, event_type FROM e) SELECT user_id::VARCHAR AS episode_id, a AS start_sec, z AS end_sec, event_type AS code FROM r GROUP BY ALL""")
def range_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.col("us") / DAY).cast("double")
    own = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("episode_id"), F.array(F.struct(day.alias("start_sec"), (day + 1).alias("end_sec"), F.col("event_type").alias("code"))).alias("ranges"))
    return quality.timeline(own)


@query("""WITH s AS (SELECT c_custkey AS episode_id, CASE c_custkey % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'completed' ELSE 'processing' END AS status, c_acctbal < 0 AS blocking FROM customer)
SELECT episode_id, CASE WHEN coalesce(blocking, false) AND status <> 'processing' THEN 'to_review' ELSE status END AS status, NOT coalesce(blocking, false) AS can_approve FROM s""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "episode_id")
    status = F.element_at(F.array(*map(F.lit, ("approved", "reviewed", "completed", "processing"))), (F.col("episode_id") % 4 + 1).cast("int"))
    reports = c.select("episode_id", (F.col("c_acctbal") < 0).alias("blocking"))
    return quality.gated(c.select("episode_id", status.alias("status")), reports)


@query("""WITH d AS (SELECT DISTINCT o_custkey AS episode_id, o_orderpriority AS slug FROM orders), o AS (SELECT o_custkey AS episode_id, o_orderpriority AS slug, o_orderkey::VARCHAR AS value, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F')
SELECT d.episode_id, d.slug, 'limit' AS param, coalesce(o.value, 'default') AS value FROM d LEFT JOIN o ON d.episode_id = o.episode_id AND d.slug = o.slug AND r = 1""")
def check_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("episode_id"), F.col("o_orderpriority").alias("slug"), F.lit("limit").alias("param"), F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderkey").alias("device_pos"), "o_orderstatus")
    defaults = o.select("episode_id", "slug", "param").distinct().withColumn("value", F.lit("default"))
    return quality.resolved_config(defaults, o.filter("o_orderstatus = 'F'").drop("o_orderstatus"))


@query(f"""WITH {_E}, f AS (SELECT us // {DAY} AS day, event_type, min(us) AS t FROM e GROUP BY ALL), p AS (SELECT x.event_type AS a, y.event_type AS b, y.t - x.t AS d FROM f x JOIN f y ON x.day = y.day AND x.event_type < y.event_type)
SELECT a, b, count(*) AS n, round(quantile_cont(d, 0.5), 2) AS median, round(quantile_cont(d, 0.75) - quantile_cont(d, 0.25), 2) AS iqr, abs(quantile_cont(d, 0.5)) <= {HOUR} AS same_epoch FROM p GROUP BY ALL""")
def stream_pair_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.col("us") / DAY).cast("long")
    first = events(spark, sf_dir).groupBy(day.alias("day"), "event_type").agg(F.min("us").alias("us"))
    return rounded(clocks.pair_offsets(first, ["day"], "event_type", "us", HOUR), 2)


@query(f"""WITH {_E}, w AS (SELECT user_id, event_id, us, event_type <> 'error' AS ok, lead(us) OVER (PARTITION BY user_id ORDER BY event_id) AS nx, coalesce(lag(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY event_id), true) AS pok FROM e), i AS (SELECT *, sum((NOT ok AND pok)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM w),
s AS (SELECT user_id, run, max(coalesce(nx, us)) - min(us) AS stall FROM i WHERE NOT ok GROUP BY ALL) SELECT user_id, count(*) AS stalls, sum(stall)::BIGINT AS stalled, max(stall) AS longest FROM s GROUP BY 1""")
def read_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("ok", F.col("event_type") != "error")
    return clocks.stalls(e, ["user_id"], ["event_id"], "us", "ok")


@query("""WITH t AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events WHERE event_type IN ('click', 'view')) SELECT user_id, count(*) FILTER (event_type <> p) AS flips, count(*) AS "rows" FROM t GROUP BY 1""")
def label_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("label", F.when(F.col("event_type").isin("click", "view"), F.col("event_type")))
    return rollups.fingers_flips(e, ["user_id"], "event_id", "label")


@query("""WITH b AS (SELECT s_suppkey AS id, 'task ' || (s_suppkey % 40) AS name, s_nationkey AS count, 10 AS target FROM supplier), l AS (SELECT c_custkey AS id, 'task ' || (c_custkey % 40) AS name, c_custkey % 7 AS count, c_custkey % 4 AS synced FROM customer),
j AS (SELECT id, coalesce(b.name, l.name) AS name, b.name IS NULL AS only_local, coalesce(b.count, 0) + coalesce(l.count, 0) - least(coalesce(l.synced, 0), coalesce(l.count, 0)) AS shown, coalesce(b.target, 0) AS target FROM b FULL JOIN l USING (id)), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY only_local, id) AS r FROM j)
SELECT id, name, shown::BIGINT AS shown, CASE WHEN target > 0 AND shown >= target THEN 'completed' WHEN shown > 0 THEN 'in_progress' ELSE 'pending' END AS status FROM r WHERE r = 1""")
def merged_task_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.concat(F.lit("task "), (F.col("id") % 40).cast("string")).alias("name")
    backend = read(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "id").select("id", named, F.col("s_nationkey").alias("count"), F.lit(10).alias("target"))
    local = read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id").select("id", named, (F.col("id") % 7).alias("count"), (F.col("id") % 4).alias("synced"))
    return rounded(rollups.merged_tasks(backend, local, "id", "name"))


@query("""WITH g AS (SELECT regexp_replace(lower(p_name || CASE p_partkey % 3 WHEN 0 THEN '_left' WHEN 1 THEN '_right' ELSE '' END), '[_.-]?(left|right|l|r)$', '') AS base, CASE p_partkey % 3 WHEN 0 THEN 'l' WHEN 1 THEN 'r' ELSE left(regexp_extract(lower(p_name), '(left|right|l|r)$', 1), 1) END AS side FROM part)
SELECT base, count(*) AS streams, bool_or(side = 'l') AND bool_or(side = 'r') AS stereo FROM g GROUP BY 1""")
def camera_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, ("_left", "_right", ""))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return rollups.groups_by_prefix(read(spark, sf_dir, "part").select(F.concat("p_name", ending).alias("name")), "name")


@query("""WITH s AS (SELECT user_id, event_type AS source, count(*) AS points, count(DISTINCT ts::DATE) AS frames FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY points DESC, frames DESC, source DESC) AS r FROM s) SELECT user_id, source FROM r WHERE r = 1""")
def best_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("source")).agg(F.count("*").alias("points"), F.countDistinct(F.to_date("ts")).alias("frames"))
    return rollups.best_source(s, ["user_id"], "source")


@query("SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.latest(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "o_orderkey", "pending")


_UPLOADS = "u AS (SELECT o_custkey AS path, o_orderpriority AS episode, o_orderkey AS id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'uploading' END AS status FROM orders)"


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("uploading")
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("episode"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), status.alias("status"))


@query(f"""WITH {_UPLOADS}, r AS (SELECT *, row_number() OVER (PARTITION BY path, episode ORDER BY created_at DESC, id DESC) AS r FROM u) SELECT path, episode, id, CASE WHEN status = 'done' THEN 'done' WHEN created_at < TIMESTAMP '2000-01-01' - INTERVAL 700 DAY THEN 'old' WHEN status = 'uploading' THEN 'status' END AS skip FROM r WHERE r = 1""")
def resumable_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.resumable(uploads(spark, sf_dir), "2000-01-01", 700).select("path", "episode", "id", "skip")


@query(f"WITH {_UPLOADS} SELECT id FROM u WHERE status = 'pending' OR (status = 'uploading' AND created_at + INTERVAL 30 DAY < TIMESTAMP '1998-01-01')")
def claimable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = uploads(spark, sf_dir)
    status = F.when(F.col("status") == "pending", "queued").when(F.col("status") == "uploading", "running").otherwise("completed")
    return rollups.claimable(u.withColumn("status", status).withColumn("lease_until", F.col("created_at") + F.expr("interval 30 days")), "1998-01-01").select("id")


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderdate::DATE = DATE '1998-03-01') AS today, 0::BIGINT AS processing, count(*) FILTER (o_orderstatus = 'O') AS to_review, count(*) FILTER (o_orderstatus = 'F') AS approved, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders""")
def overview_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.create_map(*map(F.lit, ("O", "completed", "F", "reviewed", "P", "failed"))), F.col("o_orderstatus"))
    return rollups.overview(read(spark, sf_dir, "orders").withColumn("status", status), "status", F.to_date("o_orderdate"), "1998-03-01")


@query("""WITH r AS (SELECT vec_id, label, sqrt((embedding[1]::DOUBLE - embedding[4]) * (embedding[1]::DOUBLE - embedding[4]) + (embedding[2]::DOUBLE - embedding[5]) * (embedding[2]::DOUBLE - embedding[5]) + (embedding[3]::DOUBLE - embedding[6]) * (embedding[3]::DOUBLE - embedding[6])) * 1000 AS d FROM embeddings)
SELECT label::BIGINT AS label, round(quantile_cont(d, 0.5), 3) AS median, round(quantile_cont(d, 0.75) - quantile_cont(d, 0.25), 3) AS iqr, round(avg((d NOT BETWEEN 55 AND 115)::INT), 4) AS outside FROM r GROUP BY 1""")
def bone_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    out = rollups.bone_lengths(e.select("label", F.slice("v", 1, 3).alias("a"), F.slice("v", 4, 3).alias("b")), ["label"], "a", "b")
    return rounded(out.withColumn("median", F.round("median", 3)).withColumn("iqr", F.round("iqr", 3)))


@query("""WITH n AS (SELECT o_custkey, count(*) AS rows FROM orders GROUP BY 1), p AS (SELECT o_custkey AS k, rows, rows + o_custkey % 9 AS video FROM n)
SELECT k AS episode_id, 'video.frame_drop' AS rule, CASE WHEN abs(video - rows) > 5 * greatest(2, floor(rows * 0.005)) THEN 'fail' WHEN abs(video - rows) > greatest(2, floor(rows * 0.005)) THEN 'warn' ELSE 'pass' END AS status, abs(video - rows)::DOUBLE AS value FROM p""")
def video_frame_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("episode_id")).agg(F.count("*").alias("rows"))
    return quality.frame_drop(p.withColumn("frame_count", F.col("rows") + F.col("episode_id") % 9)).drop("stream", "message")


@query("SELECT epoch_us(date_trunc('day', ts)) AS day, count(*) AS n FROM events GROUP BY 1")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, counted by day; the stream works through all that is there and ends."""
    from kinetable.sources.datasets import scratch
    from kinetable.streaming import incremental

    own = scratch(spark, "daily")
    stream = incremental.source(spark, f"{sf_dir}/events.parquet*", read(spark, sf_dir, "events").schema)
    counts = incremental.tumbling(stream, "ts", "1 day", "0 seconds")
    incremental.started(counts, f"{own}/checkpoint", lambda batch, n: batch.write.mode("overwrite").parquet(f"{own}/counts"), "complete").awaitTermination()
    return spark.read.parquet(f"{own}/counts").select(F.unix_micros("start").alias("day"), "n")


@query("SELECT event_type, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS \"min\", max(value) AS \"max\", count(*) AS count FROM events GROUP BY 1")
def stream_running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each batch of files, kept in a form that adds up."""
    from kinetable.sources.datasets import scratch
    from kinetable.streaming import incremental

    own = scratch(spark, "stats")
    stream = incremental.source(spark, f"{sf_dir}/events.parquet*", read(spark, sf_dir, "events").schema)
    incremental.running_stats(stream, ["event_type"], "value", f"{own}/blocks", f"{own}/checkpoint").awaitTermination()
    return rounded(stats.from_blocks(incremental.whole_stats(spark, f"{own}/blocks", ["event_type"])))


@query("""WITH r AS (SELECT o_custkey, count(*) AS rows, max(epoch_us(o_orderdate)) - min(epoch_us(o_orderdate)) AS span FROM orders GROUP BY 1), m AS (SELECT o_custkey, rows + (o_custkey % 10 = 0)::INT AS length, span * (CASE WHEN o_custkey % 7 = 0 THEN 1.05 ELSE 1 END)::DOUBLE AS duration FROM r JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0)
SELECT r.o_custkey, rows AS "rows", CASE WHEN length IS NULL THEN 'no meta row' WHEN rows <> length THEN 'length' WHEN abs(span - duration) > 0.01 * duration THEN 'duration' END AS problem FROM r LEFT JOIN m USING (o_custkey)""")
def meta_length_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_custkey", V.micros("o_orderdate").alias("t"))
    own = o.groupBy("o_custkey").agg(F.count("*").alias("rows"), (F.max("t") - F.min("t")).alias("span"))
    own = own.join(read(spark, sf_dir, "customer").filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    longer = F.when(F.col("o_custkey") % 7 == 0, 1.05).otherwise(1.0)
    meta = own.select("o_custkey", (F.col("rows") + (F.col("o_custkey") % 10 == 0).cast("int")).alias("length"), (F.col("span") * longer).alias("duration"))
    return audits.meta_length(o, meta, ["o_custkey"], "t").select("o_custkey", "rows", "problem")


@query(f"""WITH {_E}, c AS (SELECT user_id, us // {DAY} AS day, event_type, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT DISTINCT event_type FROM c), d AS (SELECT DISTINCT user_id, day FROM c)
SELECT d.user_id, t.event_type, count(*) AS "rows" FROM d CROSS JOIN t LEFT JOIN c ON c.user_id = d.user_id AND c.day = d.day AND c.event_type = t.event_type WHERE n IS NULL GROUP BY ALL""")
def lonely_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.col("us") / DAY).cast("long")
    e = events(spark, sf_dir).select("user_id", day.alias("day"), "event_type")
    n = e.groupBy("user_id", "day", "event_type").agg(F.count("*").alias("n"))
    kinds = e.agg(F.collect_set("event_type").alias("kinds"))  # one row
    every = e.select("user_id", "day").distinct().crossJoin(F.broadcast(kinds)).select("user_id", "day", F.explode("kinds").alias("event_type"))
    rows = every.join(n, ["user_id", "day", "event_type"], "left").fillna(0, ["n"])
    return audits.lonely_gaps(rows, ["user_id"], "day", "event_type", "n")


@query(f"""WITH {_E}, s AS (SELECT user_id, event_type AS stream, count(*) AS samples FROM e GROUP BY ALL), m AS (SELECT user_id, 'view' AS stream, 60::BIGINT AS received, 2::BIGINT AS adjust, 3::BIGINT AS dropped FROM (SELECT DISTINCT user_id FROM e))
SELECT s.user_id, s.stream, samples, received + adjust AS said, samples - received - adjust AS difference, coalesce(dropped, 0) AS dropped FROM s LEFT JOIN m ON s.user_id = m.user_id AND s.stream = m.stream""")
def recorder_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    said = e.select("user_id").distinct().withColumn("drop_stats", F.lit('{"view": {"received": 60, "dropped": 3, "offline_adjust": 2}}'))
    streams = e.groupBy("user_id", F.col("event_type").alias("stream")).agg(F.count("*").alias("samples"))
    return audits.self_reported(streams, said, ["user_id"], "drop_stats")


@query(f"""WITH {_E}, x AS (SELECT user_id, event_id, us, us + (value * 1000)::BIGINT - (CASE WHEN event_id % 50 = 0 THEN {DAY} ELSE 0 END) AS dev FROM e), w AS (SELECT *, row_number() OVER k AS i, greatest(us - lag(us) OVER k - {8 * HOUR}, 0) AS a, greatest(dev - lag(dev) OVER k - {8 * HOUR}, 0) AS b FROM x WINDOW k AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, CASE WHEN a >= {HOUR} THEN a ELSE 0 END AS la, CASE WHEN b >= {HOUR} THEN b ELSE 0 END AS lb FROM w), f AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY user_id ORDER BY i) <= 2 THEN 0 ELSE 1 END AS st FROM g WHERE la > 0 OR lb > 0), r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY i) AS run FROM f),
o AS (SELECT user_id, min(event_id) AS first, max(event_id) AS last, sum(la)::BIGINT AS lost_wall, sum(lb)::BIGINT AS lost_device FROM r GROUP BY user_id, run) SELECT *, CASE WHEN lost_device = 0 THEN 'wall' WHEN lost_wall = 0 THEN 'device' WHEN abs(lost_wall - lost_device) <= {8 * HOUR} THEN 'both' ELSE 'mismatch' END AS kind FROM o""")
def dual_clock_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    device = F.col("us") + F.rint(F.col("value") * 1000).cast("long") - F.when(F.col("event_id") % 50 == 0, DAY).otherwise(0)
    return audits.gap_events(e.select("user_id", "event_id", "us", device.alias("dev")), ["user_id"], "event_id", "us", "dev", 8 * HOUR, HOUR, 2)


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS samples, avg(value) AS o FROM events GROUP BY ALL) SELECT event_type, sum(samples)::BIGINT AS samples, (14 * count(*))::BIGINT AS expected, 1.0::DOUBLE AS coverage, round(sum(o * samples) / sum(samples), 4) AS "offset", round(100 * (sum(samples) - 14 * count(*)) / (14 * count(*))::DOUBLE, 4) AS deviation_pct FROM s GROUP BY 1""")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("samples"), F.avg("value").alias("offset"))
    return rounded(audits.stream_totals(s.withColumn("expected", F.lit(14)).withColumn("coverage", F.lit(1.0)), ["event_type"]))


@query(f"""WITH {_FINDINGS} SELECT rule, count(DISTINCT episode_id) AS episodes, count(*) FILTER (status = 'fail') AS error, count(*) FILTER (status = 'warn') AS warn, count(*) FILTER (status = 'pass') AS info FROM f WHERE status <> 'pending_review' GROUP BY 1""")
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.element_at(F.create_map(*map(F.lit, ("fail", "error", "warn", "warn", "pass", "info"))), F.col("status"))
    f = findings(spark, sf_dir).withColumn("severity", severity)
    return audits.summary(f, "rule", "severity", "episode_id", F.col("status") == "pending_review")


@query("""WITH c AS (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), d AS (SELECT label, i, stddev_pop(x) AS s FROM c GROUP BY ALL) SELECT label::BIGINT AS label, 0.0::DOUBLE AS nan_share, count(*) FILTER (s > 1e-6) AS active FROM d GROUP BY 1""")
def column_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audits.column_health(read(spark, sf_dir, "embeddings"), ["label"], "embedding"))


@query("""WITH e AS (SELECT md5(text) AS k, doc_id FROM documents) SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1 THEN 'new_batch' ELSE 'reupload' END AS kind, doc_id = max(doc_id) OVER (PARTITION BY k) AS latest FROM e""")
def upload_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "documents").select(F.md5("text").alias("k"), "doc_id")
    return audits.upload_history(own, "k", "doc_id").select("doc_id", "kind", "latest")


@query(f"""WITH {_E}, f AS (SELECT user_id, min(us) AS f0, max(us) AS f1 FROM e WHERE event_type = 'view' GROUP BY 1), s AS (SELECT user_id, min(us) AS s0, max(us) AS s1 FROM e WHERE event_type = 'click' GROUP BY 1) SELECT f.user_id, coalesce(s0 <= f0 AND s1 >= f1, false) AS covered FROM f LEFT JOIN s USING (user_id)""")
def samples_cover_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return audits.covering(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), ["user_id"], "us").select("user_id", "covered")


from kinetable.plans import fields, longstreams, matches, rules, scalars, sequences, storage  # noqa: E402, F401 - these register theirs
