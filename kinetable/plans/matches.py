"""Queries of one-to-one matching and of uploads that are there already."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.operators import matching, rollups
from kinetable.operators.matching import Claim
from kinetable.plans.registry import DAY, HOUR, events, query, read

_E = "e AS (SELECT *, epoch_us(ts) AS us FROM events)"


@query(f"""WITH RECURSIVE {_E}, p AS (SELECT a.user_id, a.event_id AS purchase, c.event_id AS click, abs(a.us - c.us) AS apart FROM e a JOIN e c ON a.user_id = c.user_id AND a.event_type = 'purchase' AND c.event_type = 'click' AND abs(a.us - c.us) <= {10 * DAY}),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY apart, purchase, click) AS i FROM p), r(user_id, i, l, c, purchase, click, apart) AS (
SELECT user_id, i, [purchase], [click], purchase, click, apart FROM n WHERE i = 1 UNION ALL
SELECT n.user_id, n.i, CASE WHEN f THEN list_append(l, n.purchase) ELSE l END, CASE WHEN f THEN list_append(c, n.click) ELSE c END, CASE WHEN f THEN n.purchase END, n.click, n.apart
FROM (SELECT n.*, r.l, r.c, NOT list_contains(r.l, n.purchase) AND NOT list_contains(r.c, n.click) AS f FROM r JOIN n ON r.user_id = n.user_id AND n.i = r.i + 1) AS n)
SELECT user_id, purchase, click, apart FROM r WHERE purchase IS NOT NULL""")
def greedy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and clicks of a user, each with one of the other, the nearest in time first."""
    e = events(spark, sf_dir)
    a = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("us").alias("a"))
    c = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("us").alias("c"))
    # Met within ten days, in buckets of ten days.
    width = 10 * DAY
    a = a.withColumn("b", F.explode(F.array(*[F.floor(F.col("a") / width) + d for d in (-1, 0, 1)])))
    c = c.withColumn("b", F.floor(F.col("c") / width))
    pairs = a.join(c, ["user_id", "b"]).withColumn("apart", F.abs(F.col("a") - F.col("c"))).filter(F.col("apart") <= width)
    return matching.mutual_matches(pairs.select("user_id", "purchase", "click", "apart"), ["user_id"], "purchase", "click", "apart")


CLAIMS = (Claim("named", keys=("ring", "bolt")), Claim("coloured", words=("red", "blue"), without=("small",)), Claim("large", words=("large",), every=True), Claim("first", without=("zzz",)), Claim("none", keys=("qqq",)))


@query("""WITH a AS (SELECT p_brand, list_sort(list_distinct(list(lower(p_name)))) AS f FROM part GROUP BY 1),
b AS (SELECT *, list_filter(f, lambda s: contains(s, 'ring') OR contains('ring', s))[1:1] AS o1 FROM a), c AS (SELECT *, o1 || list_filter(f, lambda s: NOT list_contains(o1, s) AND (contains(s, 'bolt') OR contains('bolt', s)))[1:1] AS named FROM b),
d AS (SELECT p_brand, named, list_filter(f, lambda s: NOT list_contains(named, s)) AS f FROM c), e AS (SELECT *, list_filter(f, lambda s: (contains(s, 'red') OR contains(s, 'blue')) AND NOT contains(s, 'small'))[1:1] AS coloured FROM d),
g AS (SELECT p_brand, named, coloured, list_filter(f, lambda s: NOT list_contains(coloured, s)) AS f FROM e), h AS (SELECT *, list_filter(f, lambda s: contains(s, 'large')) AS large FROM g),
i AS (SELECT *, list_filter(f, lambda s: NOT contains(s, 'large') AND NOT contains(s, 'zzz'))[1:1] AS first FROM h)
SELECT p_brand, k.kind AS kind, array_to_string(k.s, ',') AS sources FROM i, unnest([{'kind': 'named', 's': named}, {'kind': 'coloured', 's': coloured}, {'kind': 'large', 's': large}, {'kind': 'first', 's': first}, {'kind': 'none', 's': []::VARCHAR[]}]) AS u(k)""")
def claimed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as the sources of a brand, claimed by kinds in turn."""
    out = matching.claimed_sources(read(spark, sf_dir, "part"), ["p_brand"], "p_name", CLAIMS)
    return out.select("p_brand", "kind", F.array_join("sources", ",").alias("sources"))


@query()
def mono_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks of a user as two hands, in frames of an hour; tested on planted motions."""
    e = events(spark, sf_dir).filter("event_type in ('view', 'click')")
    place = F.array(F.col("value") / 1000, F.lit(0.1) * (F.col("event_type") == "view").cast("int"), F.lit(0.5))
    label = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_type") == "view", "Left").otherwise("Right")
    rows = e.select("user_id", F.floor(F.col("us") / HOUR).cast("long").alias("hour"), "event_id", "event_type", place.alias("place"), label.alias("label"))
    one = rows.groupBy("user_id", "hour", "event_type").agg(F.min_by(F.struct("event_id", "place", "label"), "event_id").alias("h")).select("user_id", "hour", "h.*")
    return matching.mono_slots(one, ["user_id"], "hour", "event_id", "label", "place", "place", most=2000).withColumn("slot", F.col("slot").cast("long"))


@query("""WITH u AS (SELECT event_id AS upload, user_id AS digest, epoch_us(ts) / 1e6 AS at FROM events WHERE event_type = 'purchase'), t AS (SELECT c_custkey AS episode FROM customer WHERE c_acctbal > 0),
j AS (SELECT o_orderkey AS job, o_custkey % 200 AS digest, o_orderstatus AS s, epoch_us(o_orderdate) / 1e6 AS created, o_custkey AS episode FROM orders WHERE o_custkey % 200 <> 7)
SELECT u.upload, u.digest, min(CASE WHEN j.s = 'P' OR (j.s = 'F' AND t.episode IS NOT NULL AND greatest(u.at - j.created, 0) <= 86400.0 * 30) THEN j.job END) AS duplicate_of FROM u LEFT JOIN j ON u.digest = j.digest LEFT JOIN t ON j.episode = t.episode GROUP BY 1, 2""")
def upload_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as uploads whose archive a job of theirs may have had: in process, or done in the last month and still there."""
    u = events(spark, sf_dir).filter("event_type = 'purchase'").select(F.col("event_id").alias("upload"), F.col("user_id").cast("string").alias("digest"), (F.col("us") / 1e6).alias("at"))
    o = read(spark, sf_dir, "orders").filter("o_custkey % 200 <> 7")
    status = F.when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    seconds = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate").cast("timestamp_ntz")) / 1e6
    jobs = o.select(F.col("o_orderkey").alias("job"), (F.col("o_custkey") % 200).cast("string").alias("digest"), status.alias("status"), seconds.alias("created"), F.col("o_custkey").alias("episode"))
    there = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("episode"))
    out = rollups.active_duplicates(u, jobs, there, 86400.0 * 30)
    return out.select("upload", F.col("digest").cast("long").alias("digest"), "duplicate_of")
