"""Queries that take all events as one stream: no key splits them, so ranges of the order do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.operators import align, assembly, clocks, runs, stats, wide
from kinetable.plans.registry import DAY, HOUR, events, query, read, rounded

#: Rows of a range: few, so that the small tables are cut as well.
ROWS = 500
MINUTE = HOUR // 60
_E = "e AS (SELECT *, epoch_us(ts) AS us FROM events)"
_MOMENTS = """round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(min(x), 4) AS "min", round(max(x), 4) AS "max",
round(quantile_cont(x, 0.01), 4) AS q01, round(quantile_cont(x, 0.1), 4) AS q10, round(quantile_cont(x, 0.5), 4) AS q50, round(quantile_cont(x, 0.9), 4) AS q90, round(quantile_cont(x, 0.99), 4) AS q99, count(*) AS count"""
_STEP = f"{_E}, s AS (SELECT *, us - lag(us) OVER (ORDER BY us, event_id) AS step FROM e)"


@query(f"""WITH {_STEP}, l AS (SELECT CASE WHEN step > 0 AND step - {MINUTE} >= {5 * MINUTE} THEN step - {MINUTE} END AS lost, step FROM s)
SELECT count(*) AS readings, count(lost) AS gaps, coalesce(sum(lost), 0)::BIGINT AS lost, max(lost) AS peak, count(*) FILTER (step < 0) AS resyncs FROM l""")
def long_gap_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.gap_watch(events(spark, sf_dir), [], ["us", "event_id"], "us", MINUTE, 5 * MINUTE, ROWS)


@query(f"""WITH {_E}, s AS (SELECT us - lag(us) OVER (ORDER BY event_id) AS step FROM e)
SELECT count(*) AS "rows", count(*) FILTER (step < 0) AS regressions, 0::BIGINT AS wraps, max(CASE WHEN step < 0 THEN -step END) AS worst FROM s""")
def long_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of events don't follow their times."""
    return clocks.regressions(events(spark, sf_dir), [], ["event_id"], "us", rows=ROWS)


@query(f"""WITH {_STEP}, b AS (SELECT quantile_cont(step, 0.5) AS nominal, quantile_cont(step, 0.95) AS p95 FROM s), j AS (SELECT step, nominal, step > nominal * 1.8 AND step - nominal >= 3000000 AS gap, step < nominal * 0.5 AS short FROM s, b WHERE step IS NOT NULL),
t AS (SELECT min(nominal) AS nominal, count(*) FILTER (gap) AS gaps, count(*) FILTER (short) AS compressed, max(CASE WHEN gap THEN step END) AS largest FROM j)
SELECT nominal, gaps, compressed, largest, CASE WHEN gaps = 0 THEN 'info' WHEN largest >= nominal * 5 OR gaps >= 10 THEN 'error' ELSE 'warn' END AS severity FROM t""")
def long_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median step over all events takes histograms, as no task should sort them all."""
    return rounded(clocks.jumps(events(spark, sf_dir), [], ["us", "event_id"], "us", rows=ROWS))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
m AS (SELECT event_type, i > n // 2 AS late, quantile_cont(value, 0.5) AS mid FROM n WHERE n >= 20 GROUP BY ALL), h AS (SELECT event_type, max(mid) FILTER (NOT late) AS first, max(mid) FILTER (late) AS second FROM m GROUP BY 1)
SELECT event_type, round(first, 4) AS first, round(second, 4) AS second, round(second - first, 4) AS drift FROM h""")
def long_half_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.half_drift(read(spark, sf_dir, "events"), ["event_type"], ["event_id"], "value", rows=ROWS, most=ROWS))


@query("""WITH w AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (ORDER BY event_id) THEN 0 ELSE 1 END AS st FROM events), i AS (SELECT *, sum(st) OVER (ORDER BY event_id) AS run FROM w)
SELECT event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM i GROUP BY run, event_type HAVING count(*) >= 2""")
def long_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.runs_of(read(spark, sf_dir, "events"), [], ["event_id"], "event_type", "event_id", 2, ROWS)


@query(f"""WITH {_E}, n AS (SELECT us, count(*) OVER (ORDER BY us RANGE BETWEEN CURRENT ROW AND {HOUR} FOLLOWING) AS n FROM e)
SELECT n AS most, us AS since FROM n ORDER BY n DESC, us LIMIT 1""")
def long_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.density(events(spark, sf_dir), [], "us", HOUR, ROWS)


@query(f"""WITH {_E}, x AS (SELECT event_type, us FROM e), n AS (SELECT *, count(*) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN CURRENT ROW AND {DAY} FOLLOWING) AS n FROM x),
f AS (SELECT *, max(CASE WHEN n >= 4 THEN us END) OVER (PARTITION BY event_type ORDER BY us) AS dense FROM n), d AS (SELECT * FROM f WHERE dense >= us - {DAY}),
s AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY event_type ORDER BY us) <= {DAY} THEN 0 ELSE 1 END AS st FROM d), i AS (SELECT *, sum(st) OVER (PARTITION BY event_type ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT event_type, min(us) AS start, max(us) AS "end", count(*) AS "rows" FROM i GROUP BY event_type, run""")
def long_floods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five streams, one for each type of event."""
    return runs.floods(events(spark, sf_dir).select("event_type", "us"), ["event_type"], "us", DAY, 4, DAY, ROWS)


@query("""WITH v AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events),
b AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN event_id END) OVER (ORDER BY event_id) AS t0, min(CASE WHEN v IS NOT NULL THEN event_id END) OVER (ORDER BY event_id DESC) AS t1 FROM v)
SELECT b.event_id, round(coalesce(b.v, a.v + (b.event_id - t0) / (t1 - t0)::DOUBLE * (z.v - a.v), a.v, z.v, 0), 4) AS filled FROM b LEFT JOIN v a ON a.event_id = t0 LEFT JOIN v z ON z.event_id = t1""")
def long_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return rounded(runs.interpolated(e, [], "event_id", "v", ROWS).select("event_id", "filled"))


@query("WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS t FROM events) SELECT event_id, t - min(t) OVER () AS since FROM e")
def long_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds as a counter of 31 bits shows them, and unwrapped again over all events."""
    e = events(spark, sf_dir).select("event_id", "us", ((F.col("us") / 1000).cast("long") % (1 << 31)).alias("t"))
    out = clocks.unwrapped(e, [], ["us", "event_id"], "t", 31, ROWS)
    least = out.agg(F.min("unwrapped").alias("least"))
    return out.join(F.broadcast(least)).select("event_id", (F.col("unwrapped") - F.col("least")).alias("since"))  # one row


@query(f"""WITH {_E}, p AS (SELECT event_id, us FROM e WHERE event_type = 'purchase'), c AS (SELECT us, event_id AS click FROM e WHERE event_type = 'click'),
m AS (SELECT event_id, p.us AS us, a.us AS ta, a.click AS ca FROM p ASOF LEFT JOIN (SELECT us, max(click) AS click FROM c GROUP BY 1) a ON p.us >= a.us),
n AS (SELECT m.*, z.us AS tz, z.click AS cz FROM m ASOF LEFT JOIN (SELECT us, min(click) AS click FROM c GROUP BY 1) z ON m.us <= z.us)
SELECT event_id, CASE WHEN tz IS NULL OR us - ta <= tz - us THEN ca ELSE cz END AS r_click, CASE WHEN tz IS NULL OR us - ta <= tz - us THEN ta ELSE tz END - us AS residual FROM n""")
def long_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To each purchase the nearest click of all users."""
    e = events(spark, sf_dir)
    p, c = e.filter("event_type = 'purchase'").select("event_id", "us"), e.filter("event_type = 'click'").select("us", F.col("event_id").alias("click"))
    return align.asof(p, c, [], "us", "nearest", tie="click", rows=ROWS).select("event_id", "r_click", (F.col("r_us") - F.col("us")).alias("residual"))


@query(f"""WITH {_E}, g AS (SELECT us AS a, us + {HOUR} AS z FROM e WHERE event_type = 'error'), w AS (SELECT *, max(z) OVER (ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
i AS (SELECT *, sum(CASE WHEN a <= reach + {HOUR} THEN 0 ELSE 1 END) OVER (ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS run FROM w)
SELECT min(a) AS a, max(z) AS z, count(*) AS parts FROM i GROUP BY run""")
def long_merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir).filter("event_type = 'error'").select(F.col("us").alias("a"), (F.col("us") + HOUR).alias("z"))
    return runs.merged_ranges(g, [], "a", "z", HOUR, ROWS)


@query("SELECT o_orderkey, 1 + o_orderkey % 7 AS length, sum(1 + o_orderkey % 7) OVER (ORDER BY o_orderkey)::BIGINT AS dataset_to_index, (sum(1 + o_orderkey % 7) OVER (ORDER BY o_orderkey) - 1 - o_orderkey % 7)::BIGINT AS dataset_from_index FROM orders")
def long_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last row of each order in one numbering of all of them."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 7).alias("length"))
    return assembly.offsets(o, "o_orderkey", "length", rows=ROWS)


@query(f"""WITH c AS (SELECT label, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label::BIGINT AS label, dim::BIGINT AS dim, {_MOMENTS} FROM c GROUP BY ALL""")
def wide_vector_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of vectors as matrices: no row for each value."""
    return rounded(wide.wide_stats(read(spark, sf_dir, "embeddings"), ["label"], "embedding"))


@query(f"""WITH c AS (SELECT unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT dim::BIGINT AS dim, {_MOMENTS} FROM c GROUP BY ALL""")
def long_vector_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of all vectors as one group that is dealt to pieces."""
    return rounded(wide.wide_stats(read(spark, sf_dir, "embeddings"), [], "embedding", piece=ROWS // 4))
